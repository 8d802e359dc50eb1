"""Structured Streaming over observations: windowed counts, and filters that keep their state per series.

Parameters are frozen; a late revision of an old observation does not rewrite
the state - replay from the source does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The longest publication lag of the engine's catalogues, in days.
LATENESS = "60 days"


def read_observations(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """(code, published_at, value) from Parquet files as they arrive."""
    schema = "code string, published_at timestamp, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_means(obs: DataFrame, width: str = "1 day") -> DataFrame:
    """(window, code, n, mean) for tumbling windows; rows later than the watermark are dropped."""
    return (
        obs.withWatermark("published_at", LATENESS)
        .groupBy(F.window("published_at", width), "code")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    )


def local_level(obs: DataFrame, q: float, r: float, p0: float = 10.0) -> DataFrame:
    """(code, published_at, state, variance): an online local-level filter for each series."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p = state.get if state.exists else (0.0, p0)
        out = []
        for row in pd.concat(list(batches)).sort_values("published_at").itertuples():
            p += q
            if not pd.isna(row.value):
                g = p / (p + r)
                x, p = x + g * (row.value - x), (1 - g) * p
            out.append((key[0], row.published_at, x, p))
        state.update((x, p))
        yield pd.DataFrame(out, columns=["code", "published_at", "state", "variance"])

    return obs.groupBy("code").applyInPandasWithState(
        update, "code string, published_at timestamp, state double, variance double", "x double, p double", "append", GroupStateTimeout.NoTimeout
    )


def regime(obs: DataFrame, means: tuple[float, float], sd: float, stay: float) -> DataFrame:
    """(code, published_at, p_first): an online two-state Hamilton filter for each series."""
    from math import exp

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (a,) = state.get if state.exists else (0.5,)
        out = []
        for row in pd.concat(list(batches)).sort_values("published_at").itertuples():
            a = a * stay + (1 - a) * (1 - stay)
            if not pd.isna(row.value):
                e = [exp(-0.5 * ((row.value - m) / sd) ** 2) for m in means]
                a = a * e[0] / max(a * e[0] + (1 - a) * e[1], 1e-300)
            out.append((key[0], row.published_at, a))
        state.update((a,))
        yield pd.DataFrame(out, columns=["code", "published_at", "p_first"])

    return obs.groupBy("code").applyInPandasWithState(
        update, "code string, published_at timestamp, p_first double", "a double", "append", GroupStateTimeout.NoTimeout
    )
