"""Bounded samples by hash: the same rows on every run, without gathering more than a few times their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts longer than this do not train, and a class trains on at most so many bytes of text.
LONGEST_BYTES, CLASS_BYTES = 1 << 20, 32 << 20


def fraction(*keys: Column | str) -> Column:
    """A hash of the keys as a number from 0 to 1."""
    return F.xxhash64(*keys, F.lit(11)) / F.lit(2.0**64) + 0.5


def least_by_hash(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """(by, key): at most ``n`` distinct keys of each group, the least by a hash of ``key``; all of a smaller group.

    However often a key occurs, it counts once.  Keys with a hash above three times
    the share that ``n`` asks for are dropped before the sort, so a group of any
    size sends about 3 n keys to it.
    """
    share = F.least(F.lit(1.0), F.lit(3.0 * n) / F.col("__n"))
    counts = rows.groupBy(F.col(by).alias("__by")).agg(F.approx_count_distinct(key).alias("__n"))
    near = (
        rows.select(by, key, fraction(key).alias("__h"))
        .join(counts.select("__by", share.alias("__share")), F.col(by) == F.col("__by"))
        .filter("__h <= __share")
        .select(by, key, "__h")
        .distinct()
    )
    order = Window.partitionBy(by).orderBy("__h", key)
    kept = near.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n)
    return kept.select(by, key)


def one_text_each(
    docs: DataFrame, chosen: DataFrame, on: list[str], cls: str, class_bytes: int, line_bytes: int = 0
) -> DataFrame:
    """(cls, text): for each chosen row one text of ``docs`` with the same ``on``, the least by hash where several have it.

    Texts over LONGEST_BYTES are left out, and of each class those beyond its first
    ``class_bytes`` by hash, where each newline counts ``line_bytes`` more.  ``chosen``
    is broadcast: callers bound its rows.
    """
    size = F.octet_length("text") + line_bytes * (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    found = (
        docs.filter(F.octet_length("text") <= LONGEST_BYTES)
        .join(F.broadcast(chosen), on)
        .groupBy(*on, *([cls] if cls not in on else []))
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    )
    order = Window.partitionBy(cls).orderBy(fraction(on[0]), on[0]).rowsBetween(Window.unboundedPreceding, 0)
    held = found.withColumn("__bytes", F.sum(size).over(order))
    return held.filter(F.col("__bytes") <= class_bytes).select(cls, "text")


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, class_bytes: int = CLASS_BYTES, line_bytes: int = 0
) -> DataFrame:
    """(label int, text): texts of at most ``rows_per_class`` labelled documents of class 0 and of class 1.

    Labels without doc_id or class are ignored, and so are documents labelled both
    ways.  See :func:`one_text_each` for repeated doc_ids and very long texts.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(
        "id IS NOT NULL AND label IN (0, 1)"
    )
    # Bounded by rows_per_class: two numbers a row.
    least = F.broadcast(least_by_hash(known, "label", "id", rows_per_class))
    clear = (
        known.join(least.select("id").distinct(), "id", "left_semi")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .select("id", "label")
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return one_text_each(texts, clear, ["id"], "label", class_bytes, line_bytes)
