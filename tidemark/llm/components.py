"""Connected components of a link table by alternating large-star and small-star steps.

Each step is an aggregation and a join on the node, so a node with very many
links is combined map-side and its join partition can be split.  Links never
leave the executors; only counts reach the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: what each node sees above it (or below it) is linked to the least node it sees."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low")
    )
    joined = seen.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            least.select("a", F.col("low").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node with a link; root is the least node of its component.

    Steps go on until one changes nothing; the two star operations are known to
    settle after a number of steps that grows as the square of log n at most.

    ``links`` has two bigint columns ``a`` and ``b`` in either order, without
    nulls; repeated links and self-links do no harm.  An empty table gives an
    empty result.
    """
    now = scratch.save(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        f"{name}-0",
    )
    state = None
    for i in count(1):
        step = scratch.save(_star(_star(now, large=True), large=False), f"{name}-{i}")
        after = step.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        scratch.drop(f"{name}-{i - 1}")
        now, before, state = step, state, (after["n"], after["x"])
        if state == before or not after["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
