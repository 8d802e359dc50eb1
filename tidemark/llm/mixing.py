"""Mixing sources to target weights by cutting a random order at each source's exact budget.

Every document gets a random key, a hash of its doc_id and its text, so that
different texts that share a doc_id, or have none, lie apart.  Keys are range-partitioned within each
source into ranges of a bounded expected size; range totals and their prefix
sums place every range before, across or behind the source's cut, so only the
one range that the cut falls into is sorted document by document.  Budgets over
a source's size repeat whole epochs first.  All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Keys have so many hexadecimal digits.
DIGITS = 15


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 16**DIGITS - 1 that hangs on seed, doc_id and text; also to be had in SQL."""
    parts = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, DIGITS), 16, 10).cast("bigint")


def targets(
    sizes: DataFrame, *, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size).

    Sources in code-point order, null last, take the weights in turn.  Together
    they get ``share`` of all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight.  That is a water level:
    sources sorted by cap / weight are capped up to the first whose cap the level
    reaches.  The window runs over sources, one row each.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = sizes.withColumn("turn", turn).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(every) * F.lit(float(share))
    leveled = weighted.withColumn("ratio", ratio).withColumn("level", (whole - before) / rest)
    settled = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return leveled.withColumn("settled", settled).select(
        "source",
        "n",
        "source_size",
        F.least("cap", F.coalesce(F.col("weight") * F.col("settled"), F.col("cap"))).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20,
    rows_per_range: int = 4096,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, key), a row for each row of ``docs``.

    ``size`` counts words (null text: 0).  ``taken`` is the number of words the mix
    takes from the document, repeats counted: whole epochs of its source, and one
    more in hash-random order until the source's budget, its target rounded down,
    is spent; the document at the cut gives the words that are left.  So the sum
    of ``taken`` over a source is exactly its budget.

    The order is a hash of ``seed``, doc_id and text, with ties by doc_id and size;
    rows alike in all three differ in nothing that is returned, so reruns give the
    same rows.
    A null source is a source of its own, the last; null doc_ids take part.
    Sources without words have target 0.  Other columns are not read; an empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col("text").cast("string")
    rows = scratch.save(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            word_count(text).alias("size"),
            random_key(F.col("doc_id"), text, seed).alias("key"),
        ),
        "rows",
    )
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    budgets = scratch.save(
        targets(sizes, weights=weights, share=share, most=most)
        .withColumn("budget", F.floor("target").cast("bigint"))
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size")))
            .otherwise(0)
            .cast("bigint"),
        )
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("n") / F.lit(rows_per_range)).cast("bigint")),
        "budgets",
    )
    # Keys as fractions; range r of R holds fractions r/R to (r + 1)/R.
    place = F.least(F.floor(F.col("key") / F.lit(16.0**DIGITS) * F.col("ranges")), F.col("ranges") - 1).cast("bigint")
    # Sources are few: with their budgets they come to every row without a shuffle of the rows
    # as long as Spark finds them small; else it shuffles.
    placed = rows.join(budgets, rows["source"].eqNullSafe(budgets["source"])).select(
        "doc_id", rows["source"], "size", "key", "source_size", "target", "epochs", "rest", place.alias("range")
    )
    totals = placed.groupBy("source", "range").agg(
        F.sum("size").alias("total"), F.first("rest").alias("left")
    )
    running = Window.partitionBy("source").orderBy("range")
    starts = scratch.save(
        totals.withColumn("start", F.sum("total").over(running) - F.col("total")), "starts"
    )
    cut = starts.filter("start < left AND start + total > left").select(
        F.col("source").alias("at"), F.col("range").alias("cut_range"), F.col("start").alias("cut_start")
    )
    # A source has one such range at most; ranges before it are taken whole, those behind not.
    done = starts.groupBy("source").agg(
        F.count(F.when(F.col("start") + F.col("total") <= F.col("left"), 1)).alias("whole")
    )
    bounds = scratch.save(
        done.join(cut, F.col("source").eqNullSafe(F.col("at")), "left").select(
            F.col("source").alias("of"),
            "cut_range",
            "cut_start",
            F.coalesce("cut_range", F.lit(2**62)).alias("first_not_whole"),
        ),
        "bounds",
    )
    located = placed.join(bounds, F.col("source").eqNullSafe(F.col("of")))
    inside = F.col("cut_range").isNotNull() & (F.col("range") == F.col("cut_range"))
    columns = ["doc_id", "source", "size", "source_size", "target", "key"]
    base = F.col("epochs") * F.col("size")
    fits = (F.col("range") < F.col("first_not_whole")) & (F.col("rest") > 0)
    outer = located.filter(~inside).select(
        *columns, (base + F.when(fits, F.col("size")).otherwise(0)).alias("taken")
    )
    by_key = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    before = F.col("cut_start") + F.sum("size").over(
        by_key.rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    inner = located.filter(inside).withColumn("more", more).select(*columns, (base + F.col("more")).alias("taken"))
    return outer.union(inner).select(*columns[:-1], "taken", "key")


def mixed_documents(docs: DataFrame, *, seed: int = 20, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, repeated as often as it takes them.

    A document is repeated once for every time the mix begins it; the one at a
    source's cut is not shortened, so a source exceeds its budget by less than one
    document.  Rows alike in doc_id, text and source share the number of times that
    the mix begins one of them: each gets the same share, and those that come first
    by their columns as JSON one more.
    """
    taken = (
        mix_sources(docs, seed=seed, **options)
        .groupBy("key", "source")
        .agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("n"))
        .filter("taken > 0")
        .select("key", "source", "n", F.ceil(F.col("taken") / F.col("size")).cast("bigint").alias("times"))
    )
    text = F.col("text").cast("string")
    # One column holds the row, so that no name clashes.
    named = docs.select(
        F.struct(*docs.columns).alias("row"),
        random_key(F.col("doc_id"), text, seed).alias("key"),
        F.col("source").cast("string").alias("source"),
    )
    rows = named.join(taken, (named["key"] == taken["key"]) & named["source"].eqNullSafe(taken["source"])).select(
        "row", taken["key"], taken["source"], "n", "times"
    )
    alike = Window.partitionBy("key", "source").orderBy(F.to_json("row"))
    one = rows.filter("n = 1").select("row", "times")
    several = rows.filter("n > 1").withColumn("turn", F.row_number().over(alike)).select(
        "row", F.expr("times div n + CASE WHEN turn <= times % n THEN 1 ELSE 0 END").alias("times")
    )
    return (
        one.union(several.filter("times > 0"))
        .select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
        .select("row.*")
    )


def oracle(weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 20) -> str:
    """DuckDB SQL for (doc_id, size, source_size, target, taken) of :func:`mix_sources` on the view ``documents``."""
    listed = ", ".join(str(float(w)) for w in weights)
    word = WORD
    return f"""
WITH rows AS MATERIALIZED (SELECT doc_id, source,
  coalesce(len(regexp_extract_all(text, '{word}')), 0)::BIGINT AS size,
  ('0x' || md5(concat('{seed}:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, ''))))[1:{DIGITS}])::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
w AS (SELECT *, [{listed}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}) + 1]::DOUBLE AS weight,
  source_size * {float(most)}::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * {float(share)}::DOUBLE
  - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(weight * max(level) FILTER (level <= ratio) OVER (), cap)) AS target FROM l),
b AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
o AS (SELECT rows.*, source_size, target, epochs, budget - epochs * source_size AS rest,
  sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM rows JOIN b ON rows.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o"""
