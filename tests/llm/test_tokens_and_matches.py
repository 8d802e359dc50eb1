"""Token stores round trip; benchmark passages against dynamic programming; the corpus pipeline."""

import random
import zlib

import numpy as np
import pytest

from tests.llm import fixtures as fx
from tidemark.llm import decontaminate, queries, token_store
from tidemark.llm.scratch import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")


def encoded(path, text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 1], "<u4").tobytes()


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, file):
    path = public_tokenizers.path(file)
    rows = fx.documents() + [(901, "It's DON'T <|endoftext|> ñ H̱ ÉCOLE!! x,y z\x1c1", None, None, None)]
    root = Scratch(spark, "t").root
    manifest = token_store.write_tokens(fx.frame(spark, rows).repartition(5), root, tokenizer=path, end_id=1, rows_per_shard=40)
    assert manifest.count() > 2
    got = token_store.read_tokens(spark, root).collect()
    want = sorted(((i is not None, i or 0, t is not None, (t or "").encode(), encoded(path, t)) for i, t, *_ in rows))
    start = 0
    for r, (known, i, _, _, ids) in zip(sorted(got, key=lambda r: r["start"]), want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i if known else None, start, len(ids) // 4, zlib.crc32(ids))
        assert np.array(r["ids"], "<u4").tobytes() == ids
        start += len(ids) // 4


def test_single_documents_and_foreign_dictionaries(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    root = f"file://{tmp_path}/store"
    token_store.write_tokens(fx.frame(spark, fx.documents()), root, tokenizer=path, end_id=1)
    shard = token_store.Shard(root, 0)
    assert shard.ids(5) == encoded(path, None if not shard.valid[5] else fx.documents()[list(shard.doc_ids)[5]][1])
    shard.close()
    (tmp_path / "store" / "dictionary.zdict").write_bytes(b"another dictionary")
    with pytest.raises(ValueError, match="dictionary"):
        token_store.Shard(root, 0)


def test_empty_store(spark):
    root = Scratch(spark, "t").root
    token_store.write_tokens(fx.empty(spark), root, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert token_store.read_tokens(spark, root).collect() == []


def test_words_equal_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_store.keeps_words_apart(path) and not token_store.keeps_words_apart(public_tokenizers.path("byte_bpe_50k.json"))
    e = token_store._Encoder(path, True)
    rng = random.Random(1)
    signs = ["a", "B", "é", "É", "'", "'s", "'T", "!", "...", ",", " ", "\n", "\x0b", "\x1c", "\x85", " ", " ", "1", "²",
             "<|endoftext|>", "<|EndOfText|>", "<", "|", "́", "ẖ", "H̱", "K", "İ", "Σ", "中", "\U0001f389", "_", "-", "ſ", "가"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert e.encode([t.encode() for t in texts]) == e.plain(texts)


def edits(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("qxz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("qxz"))
    return "".join(out)


def test_myers_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        assert decontaminate.myers(decontaminate._masks(p), len(p), t)[0] == fx.substring_distance(p, t)


def test_matches_equal_brute_force(spark):
    rng = random.Random(7)
    items = [(i, fx.prose(rng, n)) for i, n in enumerate([8, 15, 15, 30, 40, 60])]
    rows = fx.documents(40)
    for j in range(60):
        item = rng.choice(items)[1]
        k = decontaminate.budget(len(decontaminate.fold(item.encode())), 0.08, 12)
        near = edits(rng, item, rng.choice([0, 1, k // 2, k, k + 3, 2 * k + 4]))
        rows.append((500 + j, fx.prose(rng, 20) + " " + rng.choice([near, near.upper(), near.replace(" ", "\n ")]) + " " + fx.prose(rng, 9), "en", "s", 0))
    odd = [(97, None), (None, items[0][1]), (98, "short"), (99, ""), (3, items[3][1])]
    bench = spark.createDataFrame(items + odd, "item_id bigint, text string")
    for block_bytes in (1_000_000, 200):
        got = decontaminate.benchmark_matches(fx.frame(spark, rows).repartition(4), bench, block_bytes=block_bytes).collect()
        found = [(r["doc_id"], r["item_id"], r["distance"]) for r in got if r["doc_id"] is not None]
        want = []
        for doc_id, text, *_ in rows:
            folded = decontaminate.fold((text or "").encode())
            for item_id, item in [*items, (3, items[3][1]), (None, items[0][1])]:
                p = decontaminate.fold(item.encode())
                if doc_id is not None and len(folded) < 5000 and (d := fx.substring_distance(p, folded)) <= decontaminate.budget(len(p), 0.08, 12):
                    want.append((doc_id, item_id, d))
        assert sorted(map(str, found)) == sorted(map(str, want))
    assert len(found) > 30
    df = fx.frame(spark, rows)
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {f[0] for f in found}
    assert decontaminate.benchmark_matches(fx.empty(spark), bench).collect() == []
    assert decontaminate.benchmark_matches(df, bench.limit(0)).collect() == []


def test_short_items_occur_whole_and_exactly(spark):
    items = [(1, "Wer?"), (2, "2 + 2"), (3, "the capital"), (4, "ÄÖ ü"), (5, "a longer item of 24 let"), (6, "!?"), (7, "x")]
    texts = [
        "Wer", "wer 2, 2", "werk 2 21", "of the CAPITAL.", "thecapital the capitals", "äö", "an ÄÖ-ü", "ÄÖ üb", "a longer item of 24 let",
        "a longer item of 25 let", "x", "xx", "y x", None, "", "hot" * 3000 + " x",
    ]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block_bytes in (1_000_000, 10):
        got = decontaminate.benchmark_matches(fx.frame(spark, rows).repartition(3), bench, block_bytes=block_bytes).collect()
        want = []
        for i, t in enumerate(texts):
            folded = f" {decontaminate.fold((t or '').encode())} "
            for k, item in items:
                p = decontaminate.fold(item.encode())
                if p and f" {p} " in folded:
                    want.append((i, k, 0, len(p)))
        assert sorted((r["doc_id"], r["item_id"], r["distance"], r["item_bytes"]) for r in got) == sorted(want)
    assert {(0, 1), (1, 1), (1, 2), (3, 3), (8, 5), (10, 7), (15, 7)} <= {w[:2] for w in want}


def test_every_allowed_error_is_found_in_items_of_all_lengths():
    rng = random.Random(11)
    items = [(n, "".join(rng.choice("abcdefgh ") for _ in range(n)).strip().replace("  ", "a ") or "a") for n in range(1, 160)]
    items = [(n, decontaminate.fold(t.encode())) for n, t in items]
    matcher = decontaminate.Matcher([(n, t, decontaminate.budget(len(t), 0.08, 25)) for n, t in items]).build()
    texts, wanted = [], []
    for n, t in items:
        k = decontaminate.budget(len(t), 0.08, 25)
        near = decontaminate.fold(edits(rng, t, k).encode()) if k else t
        texts.append(decontaminate.fold(f"zz {near} zz".encode()))
        wanted.append((n, t, k))
    found = {row: dict.fromkeys(m[0] for m in matcher.find(texts[row], begins)) for row, begins in matcher.hits([t.encode("latin-1") for t in texts])}
    for row, (n, t, k) in enumerate(wanted):
        if fx.substring_distance(t, texts[row]) <= k:
            assert n in found[row], (n, t, texts[row])


def write_tables(spark, path, rows, items, labels):
    fx.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_stage_by_stage(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    rows = fx.documents(120)
    items = [(i, fx.prose(rng, 25)) for i in range(3)]
    rows[60] = (60, fx.prose(rng, 10) + " " + items[1][1], "en", "s1", 0)
    labels = []
    for i, (d, t, *rest) in enumerate(rows):
        if d is not None and i % 6 == 5 and t:
            rows[i] = (d, t + " vile zlur vile hatred zlur", *rest)
        labels.append((d, 1, int(bool(d is not None and i % 6 == 5 and t))))
    write_tables(spark, tmp_path, rows, items, labels)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = Scratch(spark, "t").save(stage(spark, docs, str(tmp_path)), "x")
        kept.append((before, docs.collect()))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = kept[0]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    toxic = {d for d, _, x in labels if x}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 2
    before, after = kept[1]
    ids = [r["doc_id"] for r in before]
    named = [(i if i is not None else 10**9, r["text"]) for i, r in zip(ids, before, strict=True)]
    leaders = {g[2] if g[1] else g[0] for g in fx.components(named)}
    assert sorted(r["doc_id"] if r["doc_id"] is not None else 10**9 for r in after) == sorted(leaders)
    before, after = kept[2]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == ({60} if any(r["doc_id"] == 60 for r in before) else set())
    before, after = kept[3]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) > len(before)
    before, after = kept[4]
    assert len(after) == len(before) and {r["n_tokens"] > 0 for r in after} == {True}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, after))


def test_queries_carry_their_names():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))


def test_dedup_stage_with_shared_and_missing_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    one, two, three = (fx.prose(rng, 40) for _ in range(3))
    rows = [(None, one), (None, two), (None, two), (5, three), (5, fx.prose(rng, 40)), (9, one), (7, None), (8, ""), (7, None)]
    got = corpus_pipeline.near_dedup(spark, fx.frame(spark, [(*r, "en", "s", 0) for r in rows]), "").collect()
    kept = [(r["doc_id"], r["text"]) for r in got]
    assert sorted(str(d) for d, _ in kept) == ["5", "5", "7", "8", "9", "None"] and (None, two) in kept and (9, one) in kept
    assert len({t for d, t in kept if d == 5}) == 2
