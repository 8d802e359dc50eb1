"""Trained operators: held-out accuracy, counts against brute force, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from tests.llm import fixtures as fx
from tidemark.llm import byte_lang, line_crf, toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def corpus(n=600, seed=1):
    """Toxic texts hold words that begin with ``zlur`` or the word ``vile``; junk is shouting and symbols."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, toxic, quality = fx.prose(rng, rng.choice([25, 60, 200])), 0, 1
        if i % 5 == 0:
            w = text.split(" ")
            for _ in range(max(3, len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(["vile", "zlur" + rng.choice(fx.VOCABULARY)])
            text, toxic = " ".join(w), 1
        elif i % 5 == 1:
            text, quality = " ".join(w.upper() + "!! ###" for w in text.split(" ")), 0
        rows.append((i, text, "en", "s", 0))
        if i % 2 == 0 or toxic or not quality:
            labels.append((i, quality, toxic))
    return rows, labels + [(None, 1, 1), (5, None, None), (10**9, 0, 1)]


def test_toxicity_on_texts_without_labels(spark):
    rows, labels = corpus()
    train = [r for r in labels if r[0] is None or r[0] % 3]
    got = {r["doc_id"]: r for r in toxicity.score_severity(fx.frame(spark, rows), labelled(spark, train)).collect()}
    truth = {i: i % 5 == 0 for i, *_ in rows}
    held = [i for i in truth if i % 3 == 0]
    assert np.mean([got[i]["kept"] != truth[i] for i in held]) > 0.95
    assert all(0 <= r["severity"] <= 2 and r["grade"] in (0, 1, 2) for r in got.values())
    toxic = [got[i]["severity"] for i in held if truth[i]]
    assert np.mean(toxic) > 5 * np.mean([got[i]["severity"] for i in held if not truth[i]])


def test_toxicity_without_labels_and_awkward_rows(spark):
    rows, labels = corpus(200)
    odd = [(None, rows[0][1], None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "vile " * 50000, "en", "s", 0), (902, "vile " * 50000, "en", "s", 0)]
    df = fx.frame(spark, rows + odd)
    got = toxicity.score_severity(df, labelled(spark, labels)).collect()
    assert len(got) == len(rows) + len(odd)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[None] is False and kept[900] and kept[901] and not kept[902]
    left = toxicity.drop_toxic(df, labelled(spark, labels))
    assert left.columns == df.columns and sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    nothing = toxicity.score_severity(df, labelled(spark, []))
    assert {(r["severity"] < 1e-6, r["kept"]) for r in nothing.collect()} == {(True, True)}
    assert toxicity.score_severity(fx.empty(spark), labelled(spark, labels)).collect() == []


def test_ordinal_fit_recovers_order_and_thresholds():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.integers(0, 2, (n, 12))
    w = rng.normal(0, 1.5, 12)
    z = x @ w + rng.logistic(0, 1, n)
    t = np.quantile(z, [0.5, 0.8])
    grade = np.digitize(z, t)
    row, feature = np.nonzero(x)
    m = toxicity.fit_ordinal(row, feature * 1000, grade, l2=0.01, steps=200)
    assert np.allclose(m.weights[np.arange(12) * 1000], w, atol=0.25) and np.allclose(m.thresholds, t, atol=0.4)
    p = m.at_least(np.array([0.0, 1.0]))
    assert (p[:, 0] > p[:, 1]).all() and (p[1] > p[0]).all()


def test_line_counts_equal_brute_force(spark):
    rows, labels = corpus(120)
    rng = random.Random(2)
    line = fx.prose(rng, 12)
    odd = [
        (None, "a b c", None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "\n\n \n", "en", "s", 0),
        (903, "\n".join([line, line, "other line", line + " ", line]), "en", "s", 0), (904, "x " * 30, "en", "s", 0),
        (905, fx.prose(rng, 9) * 2 + "\n" + fx.prose(rng, 40), "en", "s", 0), (906, "é# $ü\n" * 30000, "en", "s", 0), (907, "a\x0bb\x0cc\x1cd \x85e", "en", "s", 0),
    ]
    rows += odd + [odd[4]]
    got = line_crf.judge_quality(fx.frame(spark, rows), labelled(spark, labels)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    seen = sorted((str(r["doc_id"]), *(r[n] for n in names), r["base_failed"]) for r in got)
    want = []
    for i, t, *_ in rows:
        c = fx.base_counts(t)
        want.append((str(i), *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert seen == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    empty = line_crf.judge_quality(fx.empty(spark), labelled(spark, labels)).collect()
    assert empty == [] and line_crf.judge_quality(fx.frame(spark, rows), labelled(spark, [])).count() == len(rows)


def test_junk_is_told_from_content(spark):
    rows, labels = corpus()
    train = [r for r in labels if r[0] is None or r[0] % 3]
    got = {r["doc_id"]: r for r in line_crf.judge_quality(fx.frame(spark, rows), labelled(spark, train)).collect()}
    held = [i for i, *_ in rows if i % 3 == 0 and not got[i]["base_failed"]]
    assert np.mean([got[i]["kept"] == (i % 5 != 1) for i in held]) > 0.97


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    field = line_crf.Field(rng.normal(0, 1, (3, 2)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))
    lengths = [3, 0, 5, 1, 4, 0]
    at = np.concatenate([[0], np.cumsum(lengths)])
    x = rng.normal(0, 1, (at[-1], 3))
    got = line_crf.decode(field, x, at)
    for i, n in enumerate(lengths):
        e = x[at[i] : at[i + 1]] @ field.emit
        score = lambda p, e=e: field.first[p[0]] + sum(e[t, s] for t, s in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))
        if n:
            assert tuple(got[at[i] : at[i + 1]]) == max(itertools.product((0, 1), repeat=n), key=score)


LETTERS = {"xx": "abcdefg", "yy": "mnopqrs", "zz": "äöüßéñ"}


def language_rows(n=300):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = sorted(LETTERS)[i % 3]
        text = " ".join("".join(rng.choice(LETTERS[lang] + "t") for _ in range(rng.randrange(2, 8))) for _ in range(rng.choice([4, 30, 200])))
        rows.append((i, text, lang, "s", 0))
    return rows


def test_languages(spark):
    rows = language_rows()
    odd = [(None, rows[0][1], "xx", "s", 0), (900, None, "xx", "s", 0), (901, "", None, "s", 0), (902, "123 !!\n", "yy", "s", 0), (903, "ß", None, "s", 0), (904, rows[1][1] * 500, None, "s", 0), rows[2]]
    got = byte_lang.identify_languages(fx.frame(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    for i in by:
        assert by[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i, *_ in rows if by[i]["held_out"]]
    assert np.mean([by[i]["lang_pred"] == sorted(LETTERS)[i % 3] for i in held]) > 0.97
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[904]["lang_pred"] == "yy"
    assert by[903]["lang_pred"] in LETTERS and all(0 <= r["score"] <= 1 for r in got)
    assert byte_lang.identify_languages(fx.empty(spark)).collect() == []
    blind = byte_lang.identify_languages(fx.frame(spark, [(i, t, None, s, n) for i, t, _, s, n in rows]))
    assert {r["lang_pred"] for r in blind.collect()} == {"und"}


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    net = byte_lang.train(rng.integers(0, 256, (50, byte_lang.LENGTH)).astype(np.uint8), np.arange(50) % 2, ["a", "b"], steps=3)
    x = rng.integers(0, 256, (5, byte_lang.LENGTH)).astype(np.uint8)
    e, pooled = net.embedding[x], []
    for w, f, b in zip(byte_lang.WIDTHS, net.filters, net.biases, strict=True):
        n = byte_lang.LENGTH - w + 1
        cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
        pooled.append((cols @ f + b).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.offset
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(byte_lang.probabilities(net, net.tables(), x), p / p.sum(axis=1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_windows_cover_whole_texts(n):
    data = np.arange(n, dtype=np.uint8)
    got = byte_lang.cut(data, np.zeros(min(n, 1), int), np.full(min(n, 1), n))
    assert got.shape == (min(n, 1), byte_lang.LENGTH) and (got[:, n:] == 0).all()


def plain_features(text):
    """Hash numbers of a text's features, word by word."""
    import re
    from collections import Counter

    from tidemark.llm import textkit as tk

    def number(data, tag):
        raw = np.frombuffer(data, np.uint8)
        h = tk.mix(tk.span_hashes(raw, np.array([0]), np.array([len(raw)])) + tk.U64(tag))
        return int(h[0] >> np.uint64(64 - toxicity.BITS))

    found, times = set(), Counter()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        times[number(w, 1)] += 1
        found |= {number(w[:4], 2), number(w[:5], 3)}
    for w, n in times.items():
        found.add(w)
        for tag, least in ((4, 2), (5, 4)):
            if n >= least:
                h = tk.mix(np.array([w], np.uint64) + tk.U64(tag << toxicity.BITS))
                found.add(int(h[0] >> np.uint64(64 - toxicity.BITS)))
    return found


def test_severity_equals_a_plain_sum_of_weights(spark):
    rows, labels = corpus(200)
    rows += [(900, None, None, None, 0), (901, "Vile vile vile, VILE! é été 12ab", None, None, 0)]
    df = fx.frame(spark, rows)
    model = toxicity.train_severity(df, labelled(spark, labels))
    got = {r["doc_id"]: r for r in toxicity.score_severity(df, labelled(spark, labels)).collect()}
    for i, text, *_ in rows:
        z = sum(float(model.weights[f]) for f in plain_features(text))
        p = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert got[i]["severity"] == pytest.approx(sum(p), abs=1e-4)
        assert got[i]["kept"] == (p[0] < model.reject) or abs(p[0] - model.reject) < 1e-6


def test_the_cut_has_the_fewest_wrong_verdicts():
    rng = np.random.default_rng(3)
    for n in (2, 7, 200):
        toxic = np.arange(n) % 2
        chance = np.clip(rng.normal(0.3 + 0.3 * toxic, 0.2), 0.01, 0.99).round(2)
        weight = (3.0, 1.0)
        wrong = lambda cut: sum(weight[0] if c >= cut and not t else weight[1] if c < cut and t else 0 for c, t in zip(chance, toxic, strict=True))  # noqa: E731, B023
        assert wrong(toxicity.best_cut(chance, toxic, weight)) == min(wrong(c) for c in [0, 1.1, *chance, *(chance + 0.005)])


def test_samples_are_bounded_and_do_not_hang_on_repeats(spark):
    from tidemark.llm import sampling

    rows = [(i, f"text {i}", "en", "s", 0) for i in range(50)] + [(3, f"other {i}", "en", "s", 0) for i in range(500)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(50)] + [(3, 1, 0)] * 400 + [(4, 1, 1)]
    df, known = fx.frame(spark, rows), labelled(spark, labels)
    got = [tuple(r) for r in sampling.labelled_texts(df, known, "toxic", 20).collect()]
    again = [tuple(r) for r in sampling.labelled_texts(df.repartition(7), known.repartition(3), "toxic", 20).collect()]
    assert sorted(got) == sorted(again)
    per = [sum(y == k for y, _ in got) for k in (0, 1)]
    assert 18 <= per[0] <= 20 and per[1] == 10 and "text 4" not in {t for _, t in got}
    assert sampling.labelled_texts(df, known, "toxic", 20, class_bytes=30).count() <= 8
    assert sum(t.startswith("other") for _, t in got) <= 1


def test_lines_inside_a_text_change_sides(spark):
    """Training knows documents only; junk documents hold clean lines, and the field learns where lines turn."""
    rng = random.Random(6)
    clean = lambda n: [fx.prose(rng, 12).replace("\n", " ") + "." for _ in range(n)]
    junk = lambda n: [" ".join(w.upper() + "!! ###" for w in fx.prose(rng, 12).split()) for _ in range(n)]
    rows, labels, truth = [], [], {}
    for i in range(300):
        lines = [(x, 0) for x in clean(rng.randrange(2, 6))] + [(x, 0) for x in clean(2)]
        bad = i % 3 == 0
        lines[2:2] = [(x, 1) for x in junk(rng.randrange(14, 20) if bad else rng.randrange(0, 2))]
        rows.append((i, "\n".join(x for x, _ in lines), "en", "s", 0))
        labels.append((i, int(not bad), 0))
        truth[i] = [k for _, k in lines]
    field = line_crf.train_field(fx.frame(spark, rows), labelled(spark, [r for r in labels if r[0] % 2]))
    right = total = 0
    for i, text, *_ in rows:
        if i % 2 == 0:
            data = np.frombuffer(text.encode(), np.uint8)
            x = line_crf.measure(data, np.array([0, len(data)]))
            right += (line_crf.decode(field, x.features, x.at) == truth[i]).sum()
            total += len(truth[i])
    assert right > 0.97 * total


def test_relabelled_lines_obey_their_document():
    rng = np.random.default_rng(8)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 200))])
    words, p, good = rng.integers(1, 20, at[-1]), rng.random(at[-1]), rng.random(200) < 0.5
    labels = line_crf.relabel(p, words, at, good, 0.5)
    for row, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
        held = words[i:j][labels[i:j] == line_crf.CONTENT].sum()
        assert (held >= 0.5 * words[i:j].sum()) == good[row]
