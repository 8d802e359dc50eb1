"""Per-series transforms, standardisation and masks on (code, month_end, value) panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.sizes import small

ByMonth = Callable[[Column, WindowSpec], Column]


def series() -> WindowSpec:
    """Rows of a series in order of time."""
    return Window.partitionBy("code").orderBy("month_end")


def log_diff(x: Column, w: WindowSpec | None = None) -> Column:
    """ln(x / previous); NULL where either is missing or the ratio is not positive."""
    return F.ln(F.try_divide(x, F.lag(x).over(w or series())))


def diff(x: Column, w: WindowSpec | None = None) -> Column:
    return x - F.lag(x).over(w or series())


def pct_change(x: Column, w: WindowSpec | None = None) -> Column:
    """Change relative to the last value known, gaps padded: a gap itself counts as no change."""
    w = w or series()
    padded = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.try_divide(padded - before, before)


TRANSFORMS: dict[str, ByMonth] = {
    "none": lambda x, w: x,
    "log_diff": log_diff,
    "diff": diff,
    "pct_change": pct_change,
}


def apply_transform(panel: DataFrame, name: str = "transform") -> DataFrame:
    """``x`` = the transform that the row's column ``name`` asks for; an unknown name is an error."""
    x = F.raise_error(F.concat(F.lit("unknown transform "), F.col(name))).cast("double")
    for key, f in TRANSFORMS.items():
        x = F.when(F.col(name) == key, f(F.col("value"), series())).otherwise(x)
    return panel.withColumn("x", x)


def standardize_full(x: str = "x") -> Column:
    """(x - mean) / std over the whole series; std 0 or unknown: centred only. Sees the future by design."""
    w = Window.partitionBy("code")
    sd = F.stddev_samp(x).over(w)
    scale = F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd)
    return (F.col(x) - F.avg(x).over(w)) / scale


def expanding_zscore(x: str = "x", min_periods: int = 24) -> Column:
    """z-score against all rows up to the current one; NULL before ``min_periods`` observations.

    The value at a month never changes when later months are appended.
    """
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_samp(x).over(w)
    scale = F.when(sd.isNull() | (sd == 0), 1.0).otherwise(sd)
    return F.when(F.count(x).over(w) >= min_periods, (F.col(x) - F.avg(x).over(w)) / scale)


def apply_all_transforms(panel: DataFrame, catalogue: DataFrame, expanding: bool = True, min_periods: int = 24) -> DataFrame:
    """Transform every series as the catalogue says and standardise it: adds x and z."""
    named = panel.join(small(catalogue.select("code", "transform")), "code")
    z = expanding_zscore("x", min_periods) if expanding else standardize_full("x")
    return apply_transform(named).withColumn("z", z)


def min_obs_filter(panel: DataFrame, x: str = "x", least: int = 24) -> DataFrame:
    """Series with at least ``least`` values, and months in which any of them has one."""
    counted = panel.withColumn("_n", F.count(x).over(Window.partitionBy("code"))).filter(F.col("_n") >= least).drop("_n")
    return counted.join(counted.groupBy("month_end").agg(F.count(x).alias("_m")).filter("_m > 0"), "month_end", "left_semi")


def sparse_column_drop(panel: DataFrame, x: str = "value", most: float = 0.5) -> DataFrame:
    """Codes whose share of NULLs is at most ``most``."""
    share = F.avg(F.col(x).isNull().cast("double")).over(Window.partitionBy("code"))
    return panel.withColumn("_null", share).filter(F.col("_null") <= most).drop("_null")


def mean_impute(panel: DataFrame, x: str = "value") -> DataFrame:
    return panel.withColumn(x, F.coalesce(F.col(x), F.avg(x).over(Window.partitionBy("code"))))


def publication_date(date: Column, lag_days: Column) -> Column:
    return F.date_add(date, lag_days)


def ragged_edge_mask(panel: DataFrame, catalogue: DataFrame, as_of: Column, columns: list[str]) -> DataFrame:
    """Values not yet published at ``as_of`` become NULL; ``lag_days`` comes from the catalogue."""
    known = panel.join(small(catalogue.select("code", "lag_days")), "code")
    seen = publication_date(F.col("month_end"), F.col("lag_days")) <= as_of
    return known.withColumns({c: F.when(seen, F.col(c)) for c in columns}).drop("lag_days")


def raw_level_guard(panel: DataFrame, bounds: dict[str, tuple[float, float]], value: str = "value") -> DataFrame:
    """(code, lo, hi, ok): observed range of each bounded series, and whether it is in plausible units."""
    rows = [(c, float(a), float(b)) for c, (a, b) in bounds.items()]
    limits = panel.sparkSession.createDataFrame(rows, "code string, least double, most double")
    return (
        panel.join(small(limits), "code")
        .groupBy("code", "least", "most")
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        .select("code", "lo", "hi", F.coalesce((F.col("lo") >= F.col("least")) & (F.col("hi") <= F.col("most")), F.lit(True)).alias("ok"))
    )


def logistic_signal(x: Column, threshold: float, scale: float, sign: int = 1) -> Column:
    """1 / (1 + exp(-sign (x - threshold) / scale))."""
    return 1.0 / (1.0 + F.exp(-sign * (x - threshold) / scale))


def threshold_label(p: Column, at: float = 0.5) -> Column:
    return (p > at).cast("int")


def prob_clip(p: Column, margin: float = 1e-3) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(margin)), F.lit(1.0 - margin)))


def lag_features(panel: DataFrame, x: str, lags: int) -> DataFrame:
    return panel.withColumns({f"{x}_lag{k}": F.lag(x, k).over(series()) for k in range(1, lags + 1)}).withColumn("intercept", F.lit(1.0))


def numeric_or_null(x: Column) -> Column:
    """Strings that are no numbers become NULL; so do NaN and infinities."""
    return _finite(x.try_cast("double"))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
