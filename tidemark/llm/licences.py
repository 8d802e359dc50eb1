"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised, and those that are known
become identifiers; a known sentence may run over several lines or cuts.  Known are
sentences of licence texts and notices, and those that a rule makes of the names
of licences: statements such as "released under the <name>" and SPDX tags.  The sequence of identifiers is matched against licence
rules in their order, longest texts first; a match replaces its identifiers, so
later rules cannot use them again.  All steps are DataFrame expressions on one
row; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "mit-name": "mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software"
    ),
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": (
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl2-short": "this work is licensed under the gnu general public license version 2",
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 3 of the license or at your"
        " option any later version"
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose"
    ),
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met"
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer"
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission"
    ),
    "gpl2-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 2 of the license or at your"
        " option any later version"
    ),
    "lgpl21-free": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
        " general public license as published by the free software foundation either version 2 1 of the license or"
        " at your option any later version"
    ),
    "lgpl3-free": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
        " general public license as published by the free software foundation either version 3 of the license or"
        " at your option any later version"
    ),
    "agpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero"
        " general public license as published by the free software foundation either version 3 of the license or"
        " at your option any later version"
    ),
    "lgpl-hope": (
        "this library is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose"
    ),
    "lgpl-see": "see the gnu lesser general public license for more details",
    "agpl-see": "see the gnu affero general public license for more details",
    "gpl-verbatim": (
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is"
        " not allowed"
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "0bsd-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted"
    ),
    "isc-as-is": (
        "the software is provided as is and the author disclaims all warranties with regard to this software"
        " including all implied warranties of merchantability and fitness"
    ),
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and"
        " to alter it and redistribute it freely subject to the following restrictions"
    ),
    "boost-grant": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"
        " and accompanying documentation covered by this license the software to use reproduce display distribute"
        " execute and transmit the software and to prepare derivative works of the software and to permit third"
        " parties to whom the software is furnished to do so all subject to the following"
    ),
    "public-domain": "this is free and unencumbered software released into the public domain",
    "epl2-terms": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license"
        " 2 0 which is available at https www eclipse org legal epl 2 0"
    ),
    "bsd-as-is": (
        "this software is provided by the copyright holders and contributors as is and any express or implied"
        " warranties including but not limited to the implied warranties of merchantability and fitness for a"
        " particular purpose are disclaimed"
    ),
    "cc0-waiver": (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and"
        " related or neighboring rights to this work"
    ),
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
}

#: (licence, kind, identifiers that follow one another), tried in this order.
RULES = [
    ("GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-free", "lgpl-hope", "lgpl-see"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-free", "lgpl-hope", "lgpl-see"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl-free", "gpl-hope", "agpl-see"]),
    ("ISC", "permissive", ["isc-grant", "isc-as-is"]),
    ("0BSD", "permissive", ["0bsd-grant", "isc-as-is"]),
    ("Zlib", "permissive", ["zlib-as-is", "zlib-grant"]),
    ("MIT", "permissive", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", "permissive", ["apache-grant", "apache-use", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", "permissive", ["apache-grant", "apache-use"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-endorse", "bsd-as-is"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-as-is"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-free"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl-free"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("Zlib", "permissive", ["zlib-grant"]),
    ("BSL-1.0", "permissive", ["boost-grant"]),
    ("Unlicense", "permissive", ["public-domain"]),
    ("EPL-2.0", "copyleft", ["epl2-terms"]),
    ("CC0-1.0", "permissive", ["cc0-waiver"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-short"]),
    ("GPL-2.0-only", "copyleft", ["gpl2-short"]),
    ("MPL-2.0", "copyleft", ["mpl-terms"]),
    ("Apache-2.0", "permissive", ["apache-grant"]),
    ("Apache-2.0", "permissive", ["apache-short"]),
    ("MIT", "permissive", ["mit-released"]),
    ("MIT", "permissive", ["mit-licensed"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("all-rights-reserved", "restricted", ["reserved"]),
]
# SPDX identifiers of licences, their kinds and the names they go by, normalised.
NAMED = [
    ("MIT", "permissive", ["mit license"]),
    ("MIT-0", "permissive", ["mit no attribution license"]),
    ("Apache-2.0", "permissive", ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"]),
    ("BSD-2-Clause", "permissive", ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"]),
    ("BSD-3-Clause", "permissive", ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"]),
    ("0BSD", "permissive", ["bsd zero clause license", "zero clause bsd license"]),
    ("ISC", "permissive", ["isc license"]),
    ("Zlib", "permissive", ["zlib license"]),
    ("BSL-1.0", "permissive", ["boost software license version 1 0", "boost software license 1 0"]),
    ("Unlicense", "permissive", ["unlicense"]),
    ("WTFPL", "permissive", ["do what the fuck you want to public license"]),
    ("PSF-2.0", "permissive", ["python software foundation license version 2", "python software foundation license"]),
    ("Artistic-2.0", "permissive", ["artistic license 2 0", "artistic license version 2 0"]),
    ("PostgreSQL", "permissive", ["postgresql license"]),
    ("OFL-1.1", "permissive", ["sil open font license version 1 1", "sil open font license 1 1"]),
    ("GPL-2.0-only", "copyleft", ["gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl v2"]),
    ("GPL-2.0-or-later", "copyleft", ["gnu general public license version 2 or later", "gnu gpl version 2 or later", "gplv2 or later"]),
    ("GPL-3.0-only", "copyleft", ["gnu general public license version 3", "gnu gpl version 3", "gplv3", "gpl v3"]),
    ("GPL-3.0-or-later", "copyleft", ["gnu general public license version 3 or later", "gnu gpl version 3 or later", "gplv3 or later"]),
    ("LGPL-2.1-only", "copyleft", ["gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "lgplv2 1"]),
    ("LGPL-3.0-only", "copyleft", ["gnu lesser general public license version 3", "gnu lgpl version 3", "lgplv3"]),
    ("AGPL-3.0-only", "copyleft", ["gnu affero general public license version 3", "gnu agpl version 3", "agplv3"]),
    ("MPL-1.1", "copyleft", ["mozilla public license version 1 1", "mozilla public license 1 1"]),
    ("MPL-2.0", "copyleft", ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"]),
    ("EPL-1.0", "copyleft", ["eclipse public license version 1 0", "eclipse public license 1 0"]),
    ("EPL-2.0", "copyleft", ["eclipse public license version 2 0", "eclipse public license 2 0"]),
    ("CDDL-1.0", "copyleft", ["common development and distribution license version 1 0", "common development and distribution license 1 0"]),
    ("EUPL-1.2", "copyleft", ["european union public licence version 1 2", "european union public licence 1 2"]),
    ("ODbL-1.0", "copyleft", ["open data commons open database license version 1 0", "open database license"]),
    ("ODC-By-1.0", "permissive", ["open data commons attribution license version 1 0", "open data commons attribution license"]),
    ("SSPL-1.0", "restricted", ["server side public license version 1"]),
    ("BUSL-1.1", "restricted", ["business source license 1 1", "business source license version 1 1"]),
    ("Elastic-2.0", "restricted", ["elastic license 2 0", "elastic license version 2 0"]),
    ("CC0-1.0", "permissive", ["cc0 1 0", "cc0 1 0 universal", "creative commons cc0 1 0 universal"]),
]
#: The parts of a Creative Commons licence, the words for it, and its kind; versions follow.
_PARTS = [
    ("by", "attribution", "permissive"),
    ("by sa", "attribution sharealike", "copyleft"),
    ("by nd", "attribution noderivatives", "restricted"),
    ("by nc", "attribution noncommercial", "restricted"),
    ("by nc sa", "attribution noncommercial sharealike", "restricted"),
    ("by nc nd", "attribution noncommercial noderivatives", "restricted"),
]
NAMED += [
    (
        f"CC-{short.upper().replace(' ', '-')}-{version.replace(' ', '.')}",
        kind,
        [f"cc {short} {version}", f"creative commons {words} {version} international license", f"creative commons {words} {version} license"],
    )
    for version in ("4 0", "3 0")
    for short, words, kind in _PARTS
]
# A statement is a subject, what was done, under what, and a name.
SAID = ["licensed", "released", "distributed", "published", "available", "made available"]
SUBJECTS = ["", "this work is ", "this software is ", "this project is ", "this program is ", "this file is ", "this code is "]
UNDER = ["under the terms of the", "under the", "under a", "under"]


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


#: Names and SPDX tags with their identifiers.
NAMES = {name: f"says-{spdx}" for spdx, _, names in NAMED for name in names}
TAGS = {f"spdx license identifier {_plain(spdx)}": f"says-{spdx}" for spdx, _, _ in NAMED}
#: Every known sentence holds one of these, so a text without any holds none of them.
CUES = (
    r"licen|permission|copyright|warrant|reserved|redistribut|public\W+domain"
    r"|(?:released|distributed|published|available)\W+under"
)
SENTENCE_END = r"[.!?:][ \t\r\n]+|\n"
#: Longer pieces that the canonical texts leave uncut, and the known sentences that they hold.
_COPY = [f"{SENTENCES['apache-copy']} {x} www apache org licenses license 2 0" for x in ("http", "https")]
FORMS = {
    f"{SENTENCES['apache-grant']} {SENTENCES['apache-use']}": ["apache-grant", "apache-use"],
    **{x: ["apache-copy"] for x in _COPY},
    **{f"{x} {SENTENCES['apache-as-is']}": ["apache-copy", "apache-as-is"] for x in _COPY},
    SENTENCES["as-is"] + (
        " including but not limited to the warranties of merchantability fitness for a particular purpose and"
        " noninfringement"
    ): ["as-is"],
}
#: Comment leaders of letters; those of other characters are white space anyway.
LEADER = r"(?md)^[^a-z0-9\n]*+(?:dnl|rem)\b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

assert all(re.search(CUES, x) for x in [*SENTENCES.values(), *TAGS])


def _mark(name: str) -> str:
    return f"<{name}>"


def _one_of(sentences: list[str]) -> str:
    """A pattern for the longest of the sentences that ends at a cut: a tree by words, so that its size costs no time."""
    tree: dict = {}
    for x in sentences:
        at = tree
        for word in x.split():
            at = at.setdefault(word, {})
        at[""] = {}

    def branch(at: dict) -> str:
        words = [x for x in at if x]
        ways = ["[ |](?:" + "|".join(x + branch(at[x]) for x in words) + ")"] if words else []
        ways += ["(?=[|#])"] if "" in at else []
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return "(?:" + "|".join(x + branch(at) for x, at in tree.items()) + ")"


def identifiers(text: Column) -> Column:
    """The known sentences of a text in their order, as ``<id><id>...``; empty without any."""
    folded = F.translate(text, UPPER + "|#", LOWER + "  ")
    forms = {x: _mark(k) for x, k in TAGS.items()} | {x: _mark(k) for k, x in SENTENCES.items()}
    forms |= {x: "".join(map(_mark, ks)) for x, ks in FORMS.items()}
    known = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    names = F.create_map(*[F.lit(x) for name, k in NAMES.items() for x in (name, _mark(k))])
    opening = f"(?:{'|'.join(x for x in SUBJECTS if x)})?(?:{'|'.join(SAID)}) (?:{'|'.join(UNDER)}) "

    # Words with a space, | at a cut, # at an empty line: a known sentence runs from cut to cut, over | but not over #.
    marked = F.regexp_replace(folded, LEADER, "")
    marked = F.regexp_replace(marked, r"\n[^a-z0-9]*\n", "#")
    marked = F.regexp_replace(marked, SENTENCE_END, "|")
    marked = F.regexp_replace(F.concat(F.lit("#"), marked, F.lit("#")), r"[^a-z0-9|#]+", " ")
    marked = F.regexp_replace(marked, r" ?\|[ |]*", "|")
    marked = F.regexp_replace(marked, "[ |]?#(?:[ |]?#)*[ |]?", "#")
    # The Apache notice's first sentence goes on behind the name.
    statement = opening.replace(" ", "[ |]") + _one_of(list(NAMES)) + "(?![ |]the[ |]license[|#])"
    spans = f"(?<=[|#])(?:{statement}|{_one_of(list(forms))})"
    held = F.regexp_extract_all(marked, F.lit(spans), F.lit(0))
    plain = F.transform(held, lambda x: F.translate(x, "|", " "))
    said = lambda x: F.try_element_at(names, F.regexp_replace(x, f"^{opening}", ""))
    marks = F.transform(plain, lambda x: F.coalesce(F.try_element_at(known, x), said(x)))
    # A text without a cue holds no known sentence and is not normalised.
    return F.when(folded.rlike(CUES), F.array_join(marks, "")).otherwise("")


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, unmatched, kind), a row for each row of ``docs``.

    ``sentence_ids``: identifiers of known sentences in order, as ``<id><id>``.
    ``licences``: names of the matched rules in order of their place in the text,
    with commas.  ``unmatched``: identifiers that no rule took.  ``kind``: the
    strictest kind among the matches (restricted, copyleft, permissive), else
    ``none``.

    A text is cut at newlines, and at ``.``, ``!``, ``?`` or ``:`` before white
    space; it is normalised by folding A-Z and turning runs of other characters
    than a-z and 0-9, comment leaders among them, into a space.  A known sentence
    begins and ends at a cut; it may hold cuts, so that wrapped lines count, but no
    empty line.  Of sentences at one place the longest counts.  Null and empty texts have empty results and
    kind ``none``.  Repeated rows each get their row, null doc_ids are carried
    along, columns besides doc_id and text are not read.
    """
    found = docs.select("doc_id", identifiers(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_ids"))
    matched = F.col("_ids")
    for i, (_, _, sequence) in enumerate(RULES):
        matched = F.replace(matched, F.lit("".join(map(_mark, sequence))), F.lit(f"{{{i}}}"))
    # A statement is a rule of its own, after all others.
    matched = F.regexp_replace(matched, "<says-([^>]+)>", r"{$1}")
    named = {str(i): (name, kind) for i, (name, kind, _) in enumerate(RULES)} | {x: (x, kind) for x, kind, _ in NAMED}
    names = F.create_map(*[F.lit(x) for token, (name, _) in named.items() for x in (token, name)])
    kinds = F.create_map(*[F.lit(x) for token, (_, kind) in named.items() for x in (token, kind)])
    found = found.withColumn("_matched", matched).withColumn(
        "_rules", F.regexp_extract_all("_matched", F.lit(r"\{([^}]+)\}"), 1)
    )
    own = F.transform("_rules", lambda i: F.element_at(kinds, i))
    return found.select(
        "doc_id",
        F.col("_ids").alias("sentence_ids"),
        F.array_join(F.transform("_rules", lambda i: F.element_at(names, i)), ",").alias("licences"),
        F.regexp_replace("_matched", r"\{[^}]+\}", "").alias("unmatched"),
        F.when(F.array_contains(own, "restricted"), "restricted")
        .when(F.array_contains(own, "copyleft"), "copyleft")
        .when(F.array_contains(own, "permissive"), "permissive")
        .otherwise("none")
        .alias("kind"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`scan_licences` on the view ``documents``."""
    known = ", ".join(f"('{x}', '{_mark(k)}')" for x, k in [*((x, k) for k, x in SENTENCES.items()), *TAGS.items()])

    def listed(words: list[str]) -> str:
        return "(SELECT unnest([" + ", ".join(f"'{x}'" for x in words) + "]) AS x)"

    said = ", ".join(f"('{x}', '{_mark(k)}')" for x, k in NAMES.items())
    matched = "ids"
    for i, (_, _, sequence) in enumerate(RULES):
        matched = f"replace({matched}, '{''.join(map(_mark, sequence))}', '{{{i}}}')"
    matched = rf"regexp_replace({matched}, '<says-([^>]+)>', '{{\1}}', 'g')"
    named = {str(i): (name, kind) for i, (name, kind, _) in enumerate(RULES)} | {x: (x, kind) for x, kind, _ in NAMED}
    names = "MAP {" + ", ".join(f"'{token}': '{name}'" for token, (name, _) in named.items()) + "}"
    kinds = "MAP {" + ", ".join(f"'{token}': '{kind}'" for token, (_, kind) in named.items()) + "}"
    return rf"""
WITH own(sentence, mark) AS (VALUES {known}),
named(name, mark) AS (VALUES {said}),
stated AS (SELECT concat(a.x, b.x, ' ', c.x, ' ', name) AS sentence, mark
  FROM {listed(SUBJECTS)} a, {listed(SAID)} b, {listed(UNDER)} c, named),
known AS MATERIALIZED (FROM own UNION ALL SELECT * FROM stated WHERE sentence NOT IN (SELECT sentence FROM own)),
cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '[.!?:][ \t\r\n]+|\n') AS s FROM documents),
each AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM cut),
ids AS (SELECT r, string_agg(mark, '' ORDER BY i) AS ids FROM each
  JOIN known ON trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY r),
m AS (SELECT doc_id, coalesce(ids, '') AS ids, {matched.replace("ids", "coalesce(ids, '')", 1)} AS matched FROM cut LEFT JOIN ids USING (r)),
n AS (SELECT *, regexp_extract_all(matched, '\{{([^}}]+)\}}', 1) AS rules FROM m)
SELECT doc_id, ids AS sentence_ids,
  array_to_string(list_transform(rules, lambda i: map_extract({names}, i)[1]), ',') AS licences,
  regexp_replace(matched, '\{{[^}}]+\}}', '', 'g') AS unmatched,
  CASE WHEN list_contains(list_transform(rules, lambda i: map_extract({kinds}, i)[1]), 'restricted') THEN 'restricted'
    WHEN list_contains(list_transform(rules, lambda i: map_extract({kinds}, i)[1]), 'copyleft') THEN 'copyleft'
    WHEN list_contains(list_transform(rules, lambda i: map_extract({kinds}, i)[1]), 'permissive') THEN 'permissive'
    ELSE 'none' END AS kind
FROM n"""
