import random

import pytest

from tests.llm import fixtures as fx
from tidemark.llm import near_dedup
from tidemark.llm.components import components
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.scratch import Scratch


@pytest.mark.parametrize("block_rows", [2048, 4])
def test_groups_equal_all_pairs(spark, block_rows):
    rows = fx.documents()
    got = near_duplicates(fx.frame(spark, rows).repartition(5), block_rows=block_rows).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(fx.components(rows), key=key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert near_duplicates(fx.empty(spark)).collect() == []


def test_pigeonhole_finds_all_pairs_within_the_radius():
    """Signatures that differ in 19 of 60 symbols share a key, wherever the errors lie."""
    import numpy as np

    rng = np.random.default_rng(0)
    keep = near_dedup._places(6, 1)
    for _ in range(200):
        a = rng.integers(0, 65536, (1, 10, 6)).astype(np.uint16)
        b = a.copy()
        for p in rng.choice(60, 19, replace=False):
            b.reshape(-1)[p] ^= 1
        keys = [{(c, m, int(near_dedup._key(x, c, m, keep)[0])) for c in range(10) for m in range(6)} for x in (a, b)]
        assert keys[0] & keys[1]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 301), (301, 300)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t"), "c").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 180)) and got[301] == 300
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none, Scratch(spark, "t"), "n").count() == 0


def families(n, seed=4):
    """Rows without ids and with shared ones: a text with an id, a near copy, and four at about 75 percent, alike in signatures."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = fx.prose(rng, 120).split()
        rows.append((i, " ".join(base)))
        for j, changes in enumerate((2, 4, 4, 4, 4)):
            w = list(base)
            for at in rng.sample(range(2, 118), changes):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((None if j % 2 else 10**6, " ".join(w)))
    return [(d, t, "en", "s", 0) for d, t in rows]


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_rows_without_ids_are_judged_by_their_own_text(spark, block_rows):
    rows = families(30) + families(2)[:3]
    got = near_duplicates(fx.frame(spark, rows).repartition(6), block_rows=block_rows).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(fx.components(rows), key=key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == want


def test_one_row_of_each_group_stays(spark):
    rows = families(6) + families(2)[:3] + [(7, None, "en", "s", 0), (7, None, "de", "s", 0), (None, "", "en", "s", 0), (8, " ", None, None, None)]
    named = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = fx.frame(spark, rows).withColumnRenamed("node", "Row").withColumnRenamed("root", "id").withColumnRenamed("size", "hash")
    got = near_dedup.drop_near_duplicates(df.repartition(3))
    assert got.columns == df.columns
    kept = {}
    for i, (_, _, group) in enumerate(fx.components(named)):
        order = (rows[i][0] is None, rows[i][0] or 0)
        if group not in kept or order < kept[group]:
            kept[group] = order
    want = sorted((known, i) for known, i in kept.values())
    want.remove((False, 7))  # two rows alike in doc_id and text
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == want
    again = near_dedup.drop_near_duplicates(df.repartition(5))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert near_dedup.drop_near_duplicates(fx.empty(spark)).collect() == []
