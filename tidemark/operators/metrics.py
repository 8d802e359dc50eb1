"""Detection metrics, portfolio metrics and resampling plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizes import small
from tidemark.operators.windows import average_rank


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return x if empty is None else F.coalesce(x, F.lit(empty))


def roc_auc(rows: DataFrame, by: Sequence[str], y: str = "y", score: str = "p") -> DataFrame:
    """(by..., auc): rank statistic with mean ranks for ties; NULL with one class only; missing pairs dropped."""
    known = rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    ranked = known.withColumn("_r", average_rank(score, list(by)))
    n1, n = F.sum(F.col(y).cast("double")), F.count("*").cast("double")
    rank_sum = F.sum(F.when(F.col(y) == 1, F.col("_r")))
    return ranked.groupBy(*by).agg(
        F.try_divide(rank_sum - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc")
    )


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def log_loss(y: str = "y", p: str = "p", margin: float = 1e-3) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(margin)), F.lit(1 - margin))
    return -F.avg(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))


def confusion(rows: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn and accuracy, precision, recall, f1, false_alarm; 0 where a denominator is 0."""
    def n(a: int, b: int) -> Column:
        return F.count_if((F.col(y) == a) & (F.col(pred) == b))

    c = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_alarm"),
    )


def months_between_ends(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def detection_lags(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., onset, last, detected, lag): each onset of y = 1 and the first prediction at or after it.

    An onset that is never detected waits to the last labelled month.
    """
    w = Window.partitionBy(*by).orderBy("month_end")
    found = (
        rows.withColumn("_on", (F.col("y") == 1) & (F.lag("y", 1, 0).over(w) == 0))
        .withColumn("_hit", F.min(F.when(F.col("pred") == 1, F.col("month_end"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_end", F.max(F.when(F.col("y") == 1, F.col("month_end"))).over(Window.partitionBy(*by)))
    )
    stop = F.coalesce("_hit", "_end")
    return found.filter("_on").select(
        *by, F.col("month_end").alias("onset"), F.col("_hit").alias("detected"), months_between_ends(stop, F.col("month_end")).alias("lag")
    )


def reliability_bins(rows: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(bin, n, mean_p, rate) for every one of ``bins`` equal bins, empty ones included."""
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    own = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(own.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate")
    )
    return small(spine, bins).join(found, "bin", "left").fillna(0, ["n"])


def latest_published(rows: DataFrame, by: Sequence[str], value: str = "value", date: str = "month_end", fallback: float = 0.5) -> DataFrame:
    """Last value that is not missing, and its date; ``fallback`` and NULL without any."""
    return rows.groupBy(*by).agg(
        F.expr(f"coalesce(max_by({value}, {date}) FILTER (WHERE {value} IS NOT NULL), {fallback}D)").alias("latest"),
        F.expr(f"max({date}) FILTER (WHERE {value} IS NOT NULL)").alias("observed_at"),
    )


def weighted_blend(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """(month_end, p): sum of weight times signal, unknown signals at 0.5, clipped to [0, 1]; a missing weight is 0."""
    joined = signals.join(small(weights), "signal", "left")
    total = F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("p", F.lit(0.5)))
    return joined.groupBy("month_end").agg(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)).alias("p"))


def percentile_ci(draws: DataFrame, by: Sequence[str], x: str, alpha: float = 0.05, least: int = 20) -> DataFrame:
    """lo, hi, share_positive, share_negative of draws; NULL bounds with fewer than ``least``."""
    n = F.count(x)
    return draws.groupBy(*by).agg(
        n.alias("n"),
        F.when(n >= least, F.percentile(x, F.lit(alpha / 2))).alias("lo"),
        F.when(n >= least, F.percentile(x, F.lit(1 - alpha / 2))).alias("hi"),
        F.avg((F.col(x) > 0).cast("double")).alias("share_positive"),
        F.avg((F.col(x) < 0).cast("double")).alias("share_negative"),
    )


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def median_spacing(rows: DataFrame, by: Sequence[str], date: str = "month_end") -> DataFrame:
    """Median day gap and periods a year."""
    gap = F.datediff(date, F.lag(date).over(Window.partitionBy(*by).orderBy(date)))
    return rows.withColumn("_gap", gap).groupBy(*by).agg(
        F.median("_gap").alias("median_days"), (365.25 / F.median("_gap")).alias("periods_per_year")
    )


def portfolio_metrics(rows: DataFrame, by: Sequence[str], r: str = "net", periods: float = 12.0) -> DataFrame:
    """Total and annual return and Sharpe ratio (ddof 1, no risk-free rate) of periodic returns."""
    n, total = F.count(r), F.product(1 + F.col(r)) - 1
    return rows.groupBy(*by).agg(
        n.alias("n"),
        total.alias("total_return"),
        (F.pow(1 + total, periods / n) - 1).alias("annual_return"),
        F.coalesce(F.try_divide(F.avg(r), F.stddev_samp(r)) * (periods**0.5), F.lit(0.0)).alias("sharpe"),
    )


def fold_edges(spark, n: int, splits: int, min_train: int) -> DataFrame:
    """(fold, test_lo, test_hi): contiguous test blocks over the tail, test_hi exclusive."""
    first = max(min_train, n // (splits + 1))
    return spark.range(splits).select(
        F.col("id").cast("int").alias("fold"),
        ((F.lit(first * splits) + F.col("id") * (n - first)) / splits).cast("bigint").alias("test_lo"),
        ((F.lit(first * splits) + (F.col("id") + 1) * (n - first)) / splits).cast("bigint").alias("test_hi"),
    ).filter("test_hi > test_lo")


def folds(rows: DataFrame, edges: DataFrame, rn: str = "rn", expanding: bool = True) -> DataFrame:
    """(fold, rn, role): test rows and training rows, those before the test block or, not ``expanding``, all others."""
    i = F.col(rn)
    test = (i >= F.col("test_lo")) & (i < F.col("test_hi"))
    train = i < F.col("test_lo") if expanding else ~test
    role = F.when(test, "test").when(train, "train")
    return rows.select(rn).crossJoin(small(edges)).withColumn("role", role).filter("role IS NOT NULL").select("fold", rn, "role")


def _test_block(folds: DataFrame, rn: str) -> DataFrame:
    i = F.when(F.col("role") == "test", F.col(rn))
    return folds.groupBy("fold").agg(F.min(i).alias("_first"), F.max(i).alias("_last"))


def purge(folds: DataFrame, horizon: int, rn: str = "rn") -> DataFrame:
    """Folds (fold, rn, role) without training rows whose label window meets the test block's.

    Row i is labelled over [i, i + horizon], the test block over [first, last +
    horizon]; training rows may lie on either side.  No horizon purges nothing.
    """
    if horizon <= 0:
        return folds
    i = F.col(rn)
    meets = (i + horizon >= F.col("_first")) & (i <= F.col("_last") + horizon)
    joined = folds.join(_test_block(folds, rn), "fold")
    return joined.filter((F.col("role") == "test") | ~F.coalesce(meets, F.lit(False))).select("fold", rn, "role")


def embargo(folds: DataFrame, rows: int, rn: str = "rn") -> DataFrame:
    """Folds (fold, rn, role) without training rows among the ``rows`` right after the test block."""
    i = F.col(rn)
    near = (i > F.col("_last")) & (i <= F.col("_last") + rows)
    joined = folds.join(_test_block(folds, rn), "fold")
    return joined.filter((F.col("role") == "test") | ~F.coalesce(near, F.lit(False))).select("fold", rn, "role")


def purged_folds(rows: DataFrame, edges: DataFrame, horizon: int = 1, embargoed: int = 0, rn: str = "rn") -> DataFrame:
    """(fold, rn, role): expanding training rows before each test block, purged and embargoed."""
    return embargo(purge(folds(rows, edges, rn), horizon, rn), embargoed, rn)


def episode_breakdown(rows: DataFrame, spans: DataFrame, by: Sequence[str], months: int = 6) -> DataFrame:
    """How each span was told, from (by..., month_end, y, p, pred) within ``months`` of it.

    (by..., peak, months, recall, lag, mean_p, max_p, mean_before, false_before,
    false_after): ``lag`` is from the peak to the first detection, or all of the
    span's months where there is none; false alarms are those outside it.
    """
    near = rows.join(
        small(spans.select("peak", "trough")),
        (F.col("month_end") >= F.add_months("peak", -months)) & (F.col("month_end") <= F.add_months("trough", months)),
    )
    inside, hit = F.col("y") == 1, F.col("pred") == 1
    before = (F.col("month_end") < F.col("peak")) & (F.col("y") == 0)
    after = (F.col("month_end") > F.col("trough")) & (F.col("y") == 0)
    found = near.groupBy(*by, "peak").agg(
        F.count_if(inside).alias("months"),
        F.count_if(inside & hit).alias("detected"),
        F.min(F.when(inside & hit, F.col("month_end"))).alias("first"),
        F.avg(F.when(inside, F.col("p"))).alias("mean_p"),
        F.max(F.when(inside, F.col("p"))).alias("max_p"),
        F.avg(F.when(before, F.col("p"))).alias("mean_before"),
        F.count_if(before & hit).alias("false_before"),
        F.count_if(after & hit).alias("false_after"),
    )
    lag = F.coalesce(months_between_ends(F.col("first"), F.col("peak")), F.col("months")).cast("bigint")
    return found.filter("months > 0").select(
        *by, "peak", "months", ratio(F.col("detected"), F.col("months")).alias("recall"), lag.alias("lag"),
        "mean_p", "max_p", "mean_before", "false_before", "false_after",
    )
