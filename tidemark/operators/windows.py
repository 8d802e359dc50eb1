"""Window operators: recession indicators, runs, rolling portfolio paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.sizes import small


def series() -> WindowSpec:
    """Rows of a series in order of time."""
    return Window.partitionBy("code").orderBy("month_end")


def rolling_mean(x: str, rows: int, min_periods: int, w: WindowSpec | None = None) -> Column:
    frame = (w or series()).rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= min_periods, F.avg(x).over(frame))


def sahm_indicator(panel: DataFrame, x: str = "value") -> DataFrame:
    """``sahm`` = 3-month mean (2 known at least) minus its least over 12 rows, the current one included (6 at least)."""
    smooth = panel.withColumn("ma3", rolling_mean(x, 3, 2))
    year = series().rowsBetween(-11, 0)
    low = F.when(F.count("ma3").over(year) >= 6, F.min("ma3").over(year))
    return smooth.withColumn("sahm", F.col("ma3") - low)


def lead_label(y: str, h: int, w: WindowSpec) -> Column:
    return F.lead(y, h).over(w)


def delta(x: str, h: int, w: WindowSpec | None = None) -> Column:
    return F.col(x) - F.lag(x, h).over(w or series())


def label_runs(rows: DataFrame, y: str, order: str, by: list[str]) -> DataFrame:
    """``run``: 1, 2, ... for maximal stretches of equal ``y`` in order of ``order``."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.col(y).eqNullSafe(F.lag(y).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def regime_age(rows: DataFrame, y: str, order: str, by: list[str]) -> DataFrame:
    """``age``: how many rows the current state has lasted."""
    runs = label_runs(rows, y, order, by)
    return runs.withColumn("age", F.row_number().over(Window.partitionBy(*by, "run").orderBy(order)))


def onset_flag(y: str, w: WindowSpec) -> Column:
    return ((F.col(y) == 1) & (F.lag(y, 1, 0).over(w) == 0)).cast("int")


def cumprod(r: str, w: WindowSpec) -> Column:
    """Running product of 1 + r."""
    return F.product(1 + F.col(r)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(v: str, w: WindowSpec) -> Column:
    top = F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(F.col(v) - top, top)


def lagged_weight_return(rows: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """(month_end, gross, cost, net) from (month_end, asset, r, w): last month's weights earn this month's returns.

    The first month earns nothing; cost is the sum of absolute weight changes times ``cost_bps``.
    """
    by_asset = Window.partitionBy("asset").orderBy("month_end")
    moved = rows.withColumn("before", F.lag("w").over(by_asset))
    out = moved.groupBy("month_end").agg(
        F.coalesce(F.sum(F.col("before") * F.col("r")), F.lit(0.0)).alias("gross"),
        F.coalesce(F.sum(F.abs(F.col("w") - F.col("before"))), F.lit(0.0)).alias("turnover"),
    )
    cost = F.col("turnover") * (cost_bps / 1e4)
    return out.select("month_end", "gross", cost.alias("cost"), (F.col("gross") - cost).alias("net"), "turnover")


def circular_shift(rows: DataFrame, shifts: DataFrame, y: str, order: str, by: list[str]) -> DataFrame:
    """Each of ``shifts`` (shift) with the rows, ``y`` rotated by that many places within a group."""
    group = Window.partitionBy(*by)
    placed = rows.withColumn("_rn", F.row_number().over(group.orderBy(order)) - 1).withColumn("_n", F.count("*").over(group))
    turned = placed.crossJoin(small(shifts)).withColumn("_at", F.pmod(F.col("_rn") + F.col("shift"), F.col("_n")))
    source = placed.select(*by, F.col("_rn").alias("_at"), F.col(y).alias(f"{y}_shifted"))
    return turned.join(source, [*by, "_at"]).drop("_rn", "_n", "_at")


def average_rank(score: str, by: list[str]) -> Column:
    """Ranks from 1, ties at their mean."""
    least = F.rank().over(Window.partitionBy(*by).orderBy(score))
    return least + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2
