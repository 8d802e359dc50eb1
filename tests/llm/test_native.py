"""URL trust, mixing, sharding and licences."""

import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tests.llm import fixtures as fx
from tidemark.llm import licences, link_trust, mixing, queries, sharding
from tidemark.llm.scratch import Scratch


def page(host_links):
    return "".join(f'<a href="{u}">x</a>' for u in host_links)


PAGES = [
    (1, "http://good.org/a", page(["http://friend.net/1", "//FRIEND.net:80/2", "/local", "mailto:x@y.z"])),
    (2, "HTTPS://Shop.Com/de/1?x#y", page(["https://other.net"])),
    (3, "http://friend.net/1", page(["http://pal.net/"])),
    (4, "http://spammer.net/", page(["http://shop.com/de/2", "http://shop.com/de/3"])),
    (5, "http://pal.net", None),
    (6, None, "<a href='http://good.org/'>"),
    (7, "no scheme", ""),
    (8, "http://example.org/en/12", ""),
    (9, "http://a.example.org/en/2", ""),
    (10, "http://com/fr/x", ""),
    (11, "http://telecom/fr/x", ""),
    (4, "http://spammer.net/", page(["http://shop.com/de/2"])),
]
SCHEMA = "page_id bigint, url string, html string, host string, kind string, rule string"


def test_urls(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in PAGES], SCHEMA)
    got = {r["page_id"]: r for r in link_trust.judge_urls(df, queries.URL_RULES).collect()}
    assert [got[i]["verdict"] for i in range(1, 12)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow"]
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("shop.com", "/de/1", "com/de/")
    assert (got[6]["host"], got[6]["path"], got[6]["rule"]) == ("", "", None) and got[11]["rule"] is None
    assert got[8]["rule"] == "example.org/en/1" and got[9]["rule"] == "org/"
    # Trust flows along links, distrust against them.
    assert got[3]["trust"] > got[5]["trust"] > 0
    assert got[4]["distrust"] > 0 and got[4]["trust"] == 0


def pagerank(seeds, edges, damping=0.85, rounds=200):
    out = defaultdict(float)
    for a, _, w in edges:
        out[a] += w
    state = {h: (1 - damping) * m for h, m in seeds.items()}
    for _ in range(rounds):
        new = defaultdict(float, {h: (1 - damping) * m for h, m in seeds.items()})
        for a, b, w in edges:
            new[b] += damping * state.get(a, 0.0) * w / out[a]
        state = new
    return state


def test_spread_equals_pagerank_by_hand(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in PAGES], SCHEMA)
    edges = [(r["src"], r["dst"], r["weight"]) for r in link_trust.host_edges(df).collect()]
    assert ("spammer.net", "shop.com", 3.0) in edges and ("good.org", "friend.net", 1.0) in edges
    got = {r["host"]: r for r in link_trust.judge_urls(df, queries.URL_RULES).collect()}
    judged = [(r["host"], r["rule"], r["verdict"]) for r in link_trust.judge_urls(df, queries.URL_RULES).collect()]
    seeds = {k: defaultdict(float) for k in ("allow", "block")}
    for host, rule, verdict in judged:
        if rule:
            seeds[verdict][host] += 1
    trust = pagerank(seeds["allow"], edges)
    distrust = pagerank(seeds["block"], [(b, a, w) for a, b, w in edges])
    for host, r in got.items():
        assert r["trust"] == pytest.approx(trust.get(host, 0), abs=1e-6)
        assert r["distrust"] == pytest.approx(distrust.get(host, 0), abs=1e-6)


def test_url_oracle_and_empty_pages(spark):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in PAGES], SCHEMA)
    c = duckdb.connect()
    pages = df.toPandas()
    c.register("pages", pages)
    want = sorted(map(str, c.sql(link_trust.oracle(queries.URL_RULES)).fetchall()))
    got = link_trust.judge_urls(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert link_trust.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, total, target = set(order), share * sum(sizes.values()), {}
    while left:
        part = sum(w[s] for s in left)
        over = {s for s in left if total * w[s] / part > most * sizes[s]}
        if not over:
            return target | {s: total * w[s] / part for s in left}
        for s in over:
            target[s] = most * sizes[s]
        total -= sum(target[s] for s in over)
        left -= over
    return target


def test_mix(spark):
    rows = fx.documents()
    got = mixing.mix_sources(fx.frame(spark, rows).repartition(7), rows_per_range=8).collect()
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(fx.words(t))
    target = fill(size)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] <= r["taken"] <= 2 * r["size"] if target[r["source"]] >= size[r["source"]] else r["taken"] <= r["size"]
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in target)
    again = mixing.mix_sources(fx.frame(spark, rows).repartition(2), rows_per_range=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mixing.mix_sources(fx.frame(spark, rows), rows_per_range=100_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))
    assert mixing.mix_sources(fx.empty(spark)).collect() == []
    wordless = [r for r in rows if not fx.words(r[1])]
    assert {r["taken"] for r in mixing.mix_sources(fx.frame(spark, wordless)).collect()} == {0}


def test_mixed_documents_keep_columns_and_repeat(spark):
    rows = fx.documents()
    df = fx.frame(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    size, target = defaultdict(int), None
    for _, t, _, s, _ in rows:
        size[s] += len(fx.words(t))
    target, took = fill(size), defaultdict(int)
    for r in out.collect():
        took[r["source"]] += len(fx.words(r["text"]))
    longest = max(len(fx.words(t)) for _, t, *_ in rows)
    assert all(target[s] - 1 <= took[s] <= target[s] + 2 * longest for s in size)


def duck_rows(spark, rows, sql):
    """Rows of the SQL over the view documents, as sorted strings."""
    c = duckdb.connect()
    documents = fx.frame(spark, rows).select("doc_id", "text", "source").toArrow()
    c.register("documents", documents)
    return sorted(map(str, c.sql(sql).fetchall()))


def without_ids(n=60):
    rng = __import__("random").Random(12)
    return [(None if i % 3 else 7, fx.prose(rng, 30), "en", "s9", 0) for i in range(n)]


def test_mix_equals_sql(spark):
    for rows in (fx.documents() + without_ids() + without_ids(10), fx.documents()[:3]):
        names = ["doc_id", "size", "source_size", "target", "taken"]
        got = mixing.mix_sources(fx.frame(spark, rows), rows_per_range=16).select(*names).collect()
        assert sorted(str(tuple(r)) for r in got) == duck_rows(spark, rows, mixing.oracle())


def test_rows_without_ids_keep_to_the_budget(spark):
    rows = fx.documents() + without_ids(90) + without_ids(30)
    size, took = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(fx.words(t))
    df = fx.frame(spark, rows).withColumnRenamed("node", "row").withColumnRenamed("root", "n").withColumnRenamed("taken", "times")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        took[r["source"]] += len(fx.words(r["text"]))
    target = fill(size)
    assert target["s9"] - 1 <= took["s9"] < target["s9"] + 40


def test_shards_equal_sql(spark):
    rows = fx.documents() + without_ids() + [(-5, "ß\u0000x\U0001f389", "en", "s", 0), (2**62, "a" * 3000, None, None, 0)]
    got = sharding.shard_documents(fx.frame(spark, rows), shards=16, rows_per_range=5).collect()
    assert sorted(str(tuple(r)) for r in got) == duck_rows(spark, rows, sharding.oracle(16))


def test_shards(spark):
    rows = fx.documents()
    got = sharding.shard_documents(fx.frame(spark, rows).repartition(3), rows_per_range=4).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    slots = defaultdict(list)
    for r in got:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == fx.jump(key, 16) and r["grown_shard"] == fx.jump(key, 17)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_documents(fx.frame(spark, rows), rows_per_range=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(fx.empty(spark)).collect() == []


def test_jump_over_wide_keys(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 10**12, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 17, 100):
        got = {r[0]: r[1] for r in df.select("k", sharding.jump_shard(df["k"], n)).collect()}
        assert got == {k: fx.jump(k, n) for k in keys}


def normal(s):
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), s)).strip(" ")


def test_licences(spark):
    known = {s: f"<{k}>" for k, s in licences.SENTENCES.items()}
    texts = [
        None, "", "No licence here. None!", "x\nLicensed under the Apache License, Version 2.0.\ny",
        "Intro. Released under the MIT License.\nAll rights reserved.", "licensed UNDER cc by-nc 4.0",
        licences.SENTENCES["bsd-grant"] + ":\n * " + licences.SENTENCES["bsd-source"] + ".\n", licences.SENTENCES["bsd-source"],
        "This work is licensed under the GNU General Public License, version 3. " * 3, "word " * 20000 + "\nAll rights reserved.",
    ]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 0)]
    got = licences.scan_licences(fx.frame(spark, rows)).collect()
    for r, (_, t, *_rest) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), rows, strict=True):
        want = "".join(known.get(normal(s), "") for s in re.split(r"[.!?:][ \t\r\n]+|\n", t or ""))
        assert r["sentence_ids"] == want
    by = {r["doc_id"]: r for r in got}
    assert by[6]["licences"] == "BSD-2-Clause" and by[7]["unmatched"] == "<bsd-source>" and by[4]["kind"] == "restricted"
    assert by[4]["licences"] == "MIT,all-rights-reserved" and by[8]["licences"] == ",".join(["GPL-3.0-only"] * 3) and by[0]["kind"] == "none"
    assert licences.scan_licences(fx.empty(spark)).collect() == []


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def test_wrapped_licences(spark):
    def shapes(t):
        flat = "\n\n".join(re.sub(r"\s*\n\s*", " ", p) for p in t.split("\n\n"))
        led = ["\n".join(a + line for line in t.split("\n")) for a in ("# ", " * ", "// ", "dnl ", "REM ")]
        return [t, flat, flat.replace("\n\n", "\n"), t.replace("\n", "\r\n"), "Some code.\n" + t + "\nMore code", *led]

    texts = [(name, t) for name, whole in NOTICES.items() for t in shapes(whole)]
    texts.append(("Apache-2.0", re.sub(r"\s+", " ", NOTICES["Apache-2.0"])))
    texts += [("", "Released under\n\nthe MIT License."), ("", "It was never released under the\nMIT License, I think.")]
    rows = [(i, t, "en", "s", 0) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r for r in licences.scan_licences(fx.frame(spark, rows)).collect()}
    assert [got[i]["licences"] for i in range(len(texts))] == [name for name, _ in texts]
    left = {got[i]["unmatched"] for i, (name, _) in enumerate(texts) if name}
    assert left == {""}


def test_a_large_corpus_does_not_end_the_spread(spark):
    seeds = spark.createDataFrame([("h0", "distrust", 1.0), ("big", "trust", 1e8)], "host string, kind string, mass double")
    edges = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1.0) for i in range(8)], "src string, dst string, weight double")
    found = link_trust.spread(seeds, edges, Scratch(spark, "spread-test"))
    got = {r["host"]: r["score"] for r in found.filter("kind = 'distrust'").collect()}
    assert got == pytest.approx({f"h{i}": 0.15 * 0.85**i for i in range(9)})


def test_circles_of_links_settle(spark):
    """Two circles that feed each other, and a long way out of them: scores as by solving the linear system."""
    import numpy as np

    ways = [(0, 1, 1.0), (1, 2, 3.0), (2, 0, 2.0), (2, 3, 1.0), (3, 4, 1.0), (4, 2, 1.0)] + [(i, i + 1, 1.0) for i in range(4, 30)]
    share = np.zeros((31, 31))
    for a, b, w in ways:
        share[b, a] = w / sum(x for s, _, x in ways if s == a)
    want = np.linalg.solve(np.eye(31) - 0.85 * share, 0.15 * np.eye(31)[0] * 4)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for a, b, w in ways], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", "trust", 4.0)], "host string, kind string, mass double")
    got = {r["host"]: r["score"] for r in link_trust.spread(seeds, edges, Scratch(spark, "circle")).collect()}
    assert got == pytest.approx({f"h{i}": x for i, x in enumerate(want)}, rel=1e-6)


def test_named_licences_and_tags(spark):
    said = [
        ("LGPL-2.1-only", "Some code. This library is fine.\nReleased under the\n * GNU Lesser General Public License, version 2.1.\nx"),
        ("ISC", "This project is licensed under the ISC License."), ("BUSL-1.1", "made available under the Business Source License 1.1"),
        ("CC-BY-NC-SA-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 License."),
        ("EPL-2.0", "// SPDX-License-Identifier: EPL-2.0\nint x;"), ("AGPL-3.0-only,MIT", "SPDX-License-Identifier: AGPL-3.0-only\nReleased under the MIT License"),
        ("Unlicense", "This is free and unencumbered software released into the public\ndomain."), ("", "We never said released under the MIT License, did we"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ]
    got = {r["doc_id"]: r for r in licences.scan_licences(fx.frame(spark, [(i, t, "en", "s", 0) for i, (_, t) in enumerate(said)])).collect()}
    assert [got[i]["licences"] for i in range(len(said))] == [name for name, _ in said]
    assert [got[i]["kind"] for i in (0, 1, 2, 3, 7)] == ["copyleft", "permissive", "restricted", "restricted", "none"]


def test_every_known_sentence_is_recognised(spark):
    stated = {
        f"{a}{b} {c} {name}": k
        for a in licences.SUBJECTS for b in licences.SAID for c in licences.UNDER for name, k in licences.NAMES.items()
    } | licences.TAGS
    own = set(licences.SENTENCES.values())
    forms = [(x, f"<{k}>") for k, x in licences.SENTENCES.items()] + [(x, f"<{k}>") for x, k in stated.items() if x not in own]
    text = "\n\n".join(x for x, _ in forms)
    got = licences.scan_licences(fx.frame(spark, [(1, text, "en", "s", 0)])).collect()[0]
    assert got["sentence_ids"] == "".join(m for _, m in forms) and got["unmatched"].count("says") == 0
    alone = [(i, x, "en", "s", 0) for i, (x, _) in enumerate(forms) if i % 9 == 0 and not x.startswith("spdx")]
    names = ["doc_id", "sentence_ids", "licences", "unmatched", "kind"]
    found = licences.scan_licences(fx.frame(spark, alone)).select(*names).collect()
    assert sorted(str(tuple(r)) for r in found) == duck_rows(spark, alone, licences.oracle())
