"""Resampling and alignment of irregular series onto a month-end panel.

Series come long: (code, obs_date, value[, tie]).  Everything groups and windows
by ``code``, so a panel of any number of series spreads over the cluster.
Missing is NULL, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_end(d: Column) -> Column:
    return F.last_day(d)


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def nan_to_null(x: Column) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def month_spine(obs: DataFrame, by: str = "code", date: str = "obs_date") -> DataFrame:
    """(code, month_end) for every month between a series' first and last."""
    ends = obs.groupBy(by).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).filter("lo IS NOT NULL")
    months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))
    return ends.select(by, F.explode(months).alias("first")).select(by, F.last_day("first").alias("month_end"))


def fill_months(monthly: DataFrame) -> DataFrame:
    """(code, month_end, value) with the months missing between a series' first and last as NULL.

    Every row brings the empty months up to the next one, so the rows are neither
    scanned twice nor joined, and stay partitioned and sorted by series.
    """
    w = Window.partitionBy("code").orderBy("month_end")
    first = F.trunc("month_end", "month")
    stop = F.coalesce(F.add_months(F.trunc(F.lead("month_end").over(w), "month"), -1), first)
    placed = monthly.withColumn("_first", first).withColumn("_stop", stop)
    months = F.sequence("_first", "_stop", F.expr("INTERVAL 1 MONTH"))
    return placed.select("code", F.posexplode(months).alias("_i", "_month"), "value").select(
        "code", F.last_day("_month").alias("month_end"), F.when(F.col("_i") == 0, F.col("value")).alias("value")
    )


def resample(obs: DataFrame, how: str = "last", tie: str | None = None) -> DataFrame:
    """(code, month_end, value) with empty months as NULL (``sum``: 0); rows without a date are ignored.

    ``last`` takes the last non-null value of the month by (obs_date, tie).
    """
    whole = tie is not None and dict(obs.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint")
    # As one number the order keeps to hash aggregation; a struct would sort all rows first.
    day = "CAST(unix_date(obs_date) AS DECIMAL(18,0)) * CAST(100000000000000000000 AS DECIMAL(21,0))"
    order = f"{day} + CAST({tie} AS DECIMAL(20,0))" if whole else f"struct(obs_date, {tie or 'value'})"
    value = {
        "last": F.expr(f"max_by(value, {order}) FILTER (WHERE value IS NOT NULL)"),
        "mean": F.avg("value"),
        "sum": F.sum("value"),
    }[how]
    dated = obs.filter("obs_date IS NOT NULL")
    filled = fill_months(dated.groupBy("code", F.last_day("obs_date").alias("month_end")).agg(value.alias("value")))
    return filled.fillna(0.0, ["value"]) if how == "sum" else filled


def quarterly_to_monthly(obs: DataFrame, compat: bool = False) -> DataFrame:
    """Quarterly values on the month spine: at their quarter's end, other months NULL.

    ``compat`` leaves a value in its own stamp's month instead.
    """
    at = F.last_day("obs_date") if compat else quarter_end(F.col("obs_date"))
    placed = obs.select("code", at.alias("obs_date"), "value")
    placed = placed.groupBy("code", "obs_date").agg(F.max("value").alias("value"))
    return fill_months(placed.withColumnRenamed("obs_date", "month_end"))


def align_panel(monthly: DataFrame) -> DataFrame:
    """Every code at every month between the panel's first and last month."""
    spine = (
        monthly.agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
        .filter("lo IS NOT NULL")
        .select(F.explode(F.expr("sequence(trunc(lo, 'month'), trunc(hi, 'month'), INTERVAL 1 MONTH)")).alias("d"))
        .select(F.last_day("d").alias("month_end"))
    )
    # Both sides are dimensions: months of the panel, and codes.
    grid = monthly.select("code").distinct().crossJoin(spine)
    return grid.join(monthly, ["code", "month_end"], "left")


def derive_spread(panel: DataFrame, name: str, minuend: str, subtrahend: str) -> DataFrame:
    """minuend - subtrahend by month; empty where a component is absent from the panel."""
    one = panel.filter(F.col("code") == minuend).select("month_end", F.col("value").alias("x"))
    two = panel.filter(F.col("code") == subtrahend).select("month_end", F.col("value").alias("y"))
    return one.join(two, "month_end").select(F.lit(name).alias("code"), "month_end", (F.col("x") - F.col("y")).alias("value"))


def quarter_mean(panel: DataFrame) -> DataFrame:
    """(code, quarter_end, value): means of the months that have values."""
    return (
        panel.filter("value IS NOT NULL")
        .groupBy("code", quarter_end(F.col("month_end")).alias("quarter_end"))
        .agg(F.avg("value").alias("value"))
    )


def as_of_grid(panel: DataFrame, step_months: int = 1) -> DataFrame:
    """(as_of): month ends from the panel's first to its last, ``step_months`` apart."""
    return (
        panel.agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
        .filter("lo IS NOT NULL")
        .select(
            F.explode(
                F.expr(f"sequence(trunc(lo, 'month'), trunc(hi, 'month'), INTERVAL {step_months} MONTH)")
            ).alias("d")
        )
        .select(F.last_day("d").alias("as_of"))
    )


def forward_fill(panel: DataFrame, value: str = "value", order: str = "month_end") -> DataFrame:
    """``value`` carried forward over NULLs within a code; for evaluation only, never before a fit."""
    w = Window.partitionBy("code").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(value, F.last(value, ignorenulls=True).over(w))


def outer_join_series(series: list[DataFrame]) -> DataFrame:
    """Frames (month_end, <name>) joined on every month that any has."""
    return reduce(lambda a, b: a.join(b, "month_end", "full"), series)
