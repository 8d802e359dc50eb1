"""Metrics, resampling plans, portfolios and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import fitted, joins, metrics, windows
from tidemark.operators.sizes import small
from tidemark.plans import models, nowcast
from tidemark.queries import fixtures as fx
from tidemark.queries.fixtures import r6, s6, with_
from tidemark.queries.relational import _PORT, _UP
from tidemark.registry import Registry

HORIZONS = (0, 3, 6, 9, 12, 18)

reg = Registry()
Q = reg.query

SCORED = with_(fx.PANEL, fx.LABELS, fx.SIGNAL)
PRED = "pred AS (SELECT signal, month_end, y, (p > 0.5)::INT AS pred FROM scored WHERE p IS NOT NULL)"


def predicted(spark, sf):
    return fx.scored(spark, sf).filter("p IS NOT NULL").withColumn("pred", (F.col("p") > 0.5).cast("int"))


_AUC = "known AS (SELECT * FROM {t} WHERE y IS NOT NULL AND p IS NOT NULL), ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2 AS r FROM known)"
_AUC_VALUE = "(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)"


@Q(SCORED + ", " + _AUC.format(t="scored", by="signal") + f" SELECT signal, {s6(_AUC_VALUE)} AS auc FROM ranked GROUP BY signal")
def roc_auc(spark, sf):
    return metrics.roc_auc(fx.scored(spark, sf), ["signal"]).select("signal", r6("auc").alias("auc"))


@Q(SCORED + f"SELECT signal, {s6('avg((p - y) ** 2)')} AS brier FROM scored WHERE p IS NOT NULL GROUP BY signal")
def brier(spark, sf):
    return fx.scored(spark, sf).filter("p IS NOT NULL").groupBy("signal").agg(r6(metrics.brier()).alias("brier"))


@Q(SCORED + f"SELECT signal, {s6('-avg(y * ln(greatest(least(p, 0.999), 0.001)) + (1 - y) * ln(1 - greatest(least(p, 0.999), 0.001)))')} AS log_loss FROM scored WHERE p IS NOT NULL GROUP BY signal")
def log_loss(spark, sf):
    return fx.scored(spark, sf).filter("p IS NOT NULL").groupBy("signal").agg(r6(metrics.log_loss()).alias("log_loss"))


_CONF = "c AS (SELECT signal, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM pred GROUP BY signal)"


@Q(SCORED + ", " + PRED + ", " + _CONF + f"SELECT signal, tp, fp, fn, tn, {s6('coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)')} AS accuracy, {s6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {s6('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {s6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {s6('coalesce(fp / nullif(fp + tn, 0), 0)')} AS false_alarm FROM c")
def confusion(spark, sf):
    c = metrics.confusion(predicted(spark, sf), ["signal"])
    return c.select("signal", "tp", "fp", "fn", "tn", *[r6(x).alias(x) for x in ("accuracy", "precision", "recall", "f1", "false_alarm")])


_LAG = "d AS (SELECT *, y = 1 AND lag(y, 1, 0) OVER w = 0 AS onset, min(CASE WHEN pred = 1 THEN month_end END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hit, max(CASE WHEN y = 1 THEN month_end END) OVER (PARTITION BY signal) AS fin FROM pred WINDOW w AS (PARTITION BY signal ORDER BY month_end)), lags AS (SELECT signal, month_end AS onset, hit AS detected, ((year(coalesce(hit, fin)) - year(month_end)) * 12 + month(coalesce(hit, fin)) - month(month_end))::INT AS lag FROM d WHERE onset)"


@Q(SCORED + ", " + PRED + ", " + _LAG + f"SELECT signal, {s6('avg(lag)')} AS mean_lag, count(*) AS onsets FROM lags GROUP BY signal")
def detection_lag(spark, sf):
    lags = metrics.detection_lags(predicted(spark, sf), ["signal"])
    return lags.groupBy("signal").agg(r6(F.avg("lag")).alias("mean_lag"), F.count("*").alias("onsets"))


@Q(SCORED + ", " + PRED + ", " + _LAG + "SELECT signal, onset, detected, lag FROM lags")
def detection_lag_episode(spark, sf):
    return metrics.detection_lags(predicted(spark, sf), ["signal"]).select("signal", "onset", "detected", F.col("lag").cast("int").alias("lag"))


@Q(SCORED + f", b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM scored WHERE p IS NOT NULL GROUP BY ALL) SELECT s.bin::INT AS bin, coalesce(n, 0) AS n, {s6('m')} AS mean_p, {s6('r')} AS rate FROM (SELECT unnest(range(10)) AS bin) s LEFT JOIN b ON b.bin = s.bin")
def reliability_bins(spark, sf):
    out = metrics.reliability_bins(fx.scored(spark, sf))
    return out.select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


_NEAR = "near AS (SELECT signal, peak, trough, month_end, y, p, (p > 0.5)::INT AS pred FROM scored JOIN spans ON month_end >= peak - INTERVAL 6 MONTH AND month_end <= trough + INTERVAL 6 MONTH WHERE p IS NOT NULL)"
_TOLD = "told AS (SELECT signal, peak, count(*) FILTER (y = 1) AS months, count(*) FILTER (y = 1 AND pred = 1) AS detected, min(month_end) FILTER (y = 1 AND pred = 1) AS first, avg(p) FILTER (y = 1) AS mean_p, max(p) FILTER (y = 1) AS max_p, avg(p) FILTER (month_end < peak AND y = 0) AS mean_before, count(*) FILTER (month_end < peak AND y = 0 AND pred = 1) AS false_before, count(*) FILTER (month_end > trough AND y = 0 AND pred = 1) AS false_after FROM near GROUP BY ALL)"


@Q(SCORED + f", {_NEAR}, {_TOLD} SELECT signal, peak, months, {s6('detected / months')} AS recall, coalesce((year(first) - year(peak)) * 12 + month(first) - month(peak), months) AS lag, {s6('mean_p')} AS mean_p, {s6('max_p')} AS max_p, {s6('mean_before')} AS mean_before, false_before, false_after FROM told WHERE months > 0")
def episode_breakdown(spark, sf):
    """Recall, lag, probabilities and the false alarms around each span, by signal."""
    out = metrics.episode_breakdown(predicted(spark, sf), fx.spans(spark), ["signal"])
    rounded = [r6(c).alias(c) if c in ("recall", "mean_p", "max_p", "mean_before") else c for c in out.columns]
    return out.select(*rounded)


@Q(SCORED + f"SELECT signal, {s6('coalesce(arg_max(p, month_end) FILTER (p IS NOT NULL), 0.5)')} AS latest, max(month_end) FILTER (p IS NOT NULL) AS observed_at FROM signals GROUP BY signal")
def latest_published(spark, sf):
    out = metrics.latest_published(fx.signals(spark, sf), ["signal"], "p")
    return out.select("signal", r6("latest").alias("latest"), "observed_at")


_WEIGHT = "wt(signal, weight) AS (VALUES ('probit', 0.5), ('cfnai', 0.3), ('rsm', 0.2))"


def _weights(spark):
    return spark.createDataFrame(fx.WEIGHTS, "signal string, weight double")


@Q(SCORED + ", " + _WEIGHT + " SELECT min(observed_at) AS as_of FROM (SELECT signal, max(month_end) FILTER (p IS NOT NULL) AS observed_at FROM signals GROUP BY signal) JOIN wt USING (signal) WHERE weight > 0")
def staleness_min(spark, sf):
    out = metrics.latest_published(fx.signals(spark, sf), ["signal"], "p")
    return out.join(small(_weights(spark)), "signal").agg(F.min(F.when(F.col("weight") > 0, F.col("observed_at"))).alias("as_of"))


_BLEND = "blend AS (SELECT month_end, least(greatest(sum(coalesce(weight, 0) * coalesce(p, 0.5)), 0), 1) AS p FROM signals LEFT JOIN wt USING (signal) GROUP BY month_end)"


@Q(SCORED + ", " + _WEIGHT + ", " + _BLEND + f" SELECT month_end, {s6('p')} AS p FROM blend")
def weighted_blend(spark, sf):
    return metrics.weighted_blend(fx.signals(spark, sf), _weights(spark)).select("month_end", r6("p").alias("p"))


@Q(SCORED + ", " + _WEIGHT + ", " + _BLEND + f" SELECT month_end, {s6('p')} AS recession, {s6('1 - p')} AS expansion FROM blend")
def ensemble_history(spark, sf):
    p = metrics.weighted_blend(fx.signals(spark, sf), _weights(spark))
    return p.select("month_end", r6("p").alias("recession"), r6(1 - F.col("p")).alias("expansion"))


@Q(SCORED + f"SELECT month_end, {s6('stddev_pop(p)')} AS dispersion FROM signals GROUP BY month_end")
def signal_dispersion(spark, sf):
    return fx.signals(spark, sf).groupBy("month_end").agg(r6(F.stddev_pop("p")).alias("dispersion"))


@Q(with_(fx.PANEL) + f"SELECT a.code AS a, b.code AS b, {s6('corr(a.x, b.x)')} AS r FROM panel a JOIN panel b USING (month_end) WHERE a.code < b.code AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL")
def corr_matrix(spark, sf):
    p = fx.panel(spark, sf).filter("x IS NOT NULL").select("month_end", "code", "x")
    q = p.select("month_end", F.col("code").alias("b"), F.col("x").alias("y"))
    # A self-join on the month gives the pairs of series of one month, not of all rows.
    return p.join(q, "month_end").filter("code < b").groupBy(F.col("code").alias("a"), "b").agg(r6(F.corr("x", "y")).alias("r"))


@Q(SCORED + f"SELECT signal, {s6('corr(p, y)')} AS ic FROM scored WHERE p IS NOT NULL GROUP BY signal")
def corr_pair(spark, sf):
    return fx.scored(spark, sf).filter("p IS NOT NULL").groupBy("signal").agg(r6(F.corr("p", "y")).alias("ic"))


@Q(SCORED + f", f AS (SELECT *, (ntile(5) OVER (PARTITION BY signal ORDER BY month_end))::INT AS fold FROM scored WHERE p IS NOT NULL), t AS (SELECT a.signal, a.fold, avg(b.y) AS m FROM (SELECT DISTINCT signal, fold FROM f) a JOIN f b ON a.signal = b.signal AND b.fold < a.fold GROUP BY ALL) SELECT f.signal, f.fold, {s6('1 - sum((y - p) ** 2) / nullif(sum((y - m) ** 2), 0)')} AS r2 FROM f JOIN t ON f.signal = t.signal AND f.fold = t.fold GROUP BY ALL")
def r2_vs_train_mean(spark, sf):
    w = Window.partitionBy("signal").orderBy("month_end")
    f = fx.scored(spark, sf).filter("p IS NOT NULL").withColumn("fold", F.ntile(5).over(w))
    per = f.groupBy("signal", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    before = Window.partitionBy("signal").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    t = per.select("signal", "fold", F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("m")).filter("m IS NOT NULL")
    r2 = 1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("p"), 2)), F.sum(F.pow(F.col("y") - F.col("m"), 2)))
    return f.join(t, ["signal", "fold"]).groupBy("signal", "fold").agg(r6(r2).alias("r2"))


@Q(with_(fx.PANEL) + f"SELECT code, count(x) AS n, {s6('quantile_cont(x, 0.025)', 4)} AS lo, {s6('quantile_cont(x, 0.975)', 4)} AS hi, {s6('avg((x > 0)::INT)')} AS share_positive, {s6('avg((x < 0)::INT)')} AS share_negative FROM panel GROUP BY code")
def percentile_ci(spark, sf):
    out = metrics.percentile_ci(fx.panel(spark, sf), ["code"], "x")
    return out.select("code", "n", r6("lo", 4).alias("lo"), r6("hi", 4).alias("hi"), r6("share_positive").alias("share_positive"), r6("share_negative").alias("share_negative"))


@Q(with_(fx.PANEL) + "SELECT code, quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0 AS excludes FROM panel GROUP BY code")
def ci_excludes_zero(spark, sf):
    out = metrics.percentile_ci(fx.panel(spark, sf), ["code"], "x")
    return out.select("code", metrics.excludes_zero(F.col("lo"), F.col("hi")).alias("excludes"))


@Q(with_(fx.SPARSE) + f", g AS (SELECT code, (obs_date - lag(obs_date) OVER (PARTITION BY code ORDER BY obs_date, tie)) AS gap FROM obs), m AS (SELECT code, median(gap) AS d FROM g GROUP BY code) SELECT code, d::DOUBLE AS median_days, {s6('365.25 / d')} AS periods_per_year FROM m WHERE d > 0")
def median_spacing(spark, sf):
    out = fx.sparse_obs(spark, sf)
    gap = F.datediff("obs_date", F.lag("obs_date").over(Window.partitionBy("code").orderBy("obs_date", "tie")))
    m = out.withColumn("gap", gap).groupBy("code").agg(F.median("gap").alias("median_days")).filter("median_days > 0")
    return m.select("code", "median_days", r6(365.25 / F.col("median_days")).alias("periods_per_year"))


@Q(with_(fx.MONTHLY, fx.RETURNS, _PORT) + f", n AS (SELECT gross - turnover * 0.001 AS net FROM port), t AS (SELECT count(*) AS n, exp(sum(ln(1 + net))) - 1 AS total, avg(net) / stddev_samp(net) * sqrt(12) AS sharpe FROM n) SELECT n, {s6('total')} AS total_return, {s6('(1 + total) ** (12.0 / n) - 1')} AS annual_return, {s6('sharpe')} AS sharpe FROM t")
def portfolio_metrics(spark, sf):
    out = metrics.portfolio_metrics(windows.lagged_weight_return(fx.weights(spark, sf)), [])
    return out.select("n", *[r6(c).alias(c) for c in ("total_return", "annual_return", "sharpe")])


@Q(with_(fx.PANEL) + f"SELECT code, {s6('avg((abs(x) >= 0.5)::INT)')} AS share, {s6('quantile_cont(abs(x), 0.95)', 4)} AS q95, {s6('max(abs(x))', 4)} AS top FROM panel WHERE x IS NOT NULL GROUP BY code")
def share_bands(spark, sf):
    x = F.abs("x")
    return fx.panel(spark, sf).filter("x IS NOT NULL").groupBy("code").agg(
        r6(F.avg((x >= 0.5).cast("double"))).alias("share"), r6(F.percentile(x, F.lit(0.95)), 4).alias("q95"), r6(F.max(x), 4).alias("top")
    )


@Q(with_(fx.OBS) + "SELECT code, count(DISTINCT obs_date) AS days, count(DISTINCT obs_date) < 2 AS constant FROM obs GROUP BY code")
def distinct_count(spark, sf):
    n = F.countDistinct("obs_date")
    return fx.obs(spark, sf).groupBy("code").agg(n.alias("days"), (n < 2).alias("constant"))


_MOVES = "moves AS (SELECT code, regime_rank AS from_rank, 1 AS to_rank, to_low AS p FROM ranked UNION ALL SELECT code, regime_rank, 2, to_high FROM ranked)"
_RANKED = with_(fx.REGIMES.split(",\nfw AS")[0])


@Q(_RANKED + f", {_MOVES} SELECT code, from_rank, to_rank::INT AS to_rank, {s6('p')} AS p FROM moves")
def transition_matrix(spark, sf):
    """Transition probabilities of every series' regimes, in the order of their means."""
    return fitted.transition_rows(fx.ranked_regimes(spark, sf)).select("code", "from_rank", "to_rank", r6("p").alias("p"))


@Q(_RANKED + f", t AS (SELECT code, max(to_low) FILTER (regime_rank = 1) AS stay, max(to_low) FILTER (regime_rank = 2) AS enter, sum(n) AS n FROM ranked GROUP BY code) SELECT code, {s6('stay')} AS stay, {s6('CASE WHEN stay < 1 THEN least(1 / (1 - stay), n) ELSE n END')} AS duration, {s6('enter')} AS enter FROM t")
def transition_features(spark, sf):
    """Persistence and expected duration (at most the sample) of the lowest regime, and the chance to enter it from the highest."""
    ranked = fx.ranked_regimes(spark, sf)
    months = ranked.groupBy("code").agg(F.sum("n").alias("n"))
    out = fitted.transition_features(fitted.transition_rows(ranked), months)
    return out.select("code", r6("stay").alias("stay"), r6("duration").alias("duration"), r6("enter").alias("enter"))


@Q(fx.recursive(fx.REGIMES) + f"SELECT d.code, month_end, {s6('f')} AS p FROM fw JOIN dens d ON d.code = fw.code AND d.t = fw.t")
def recession_prob(spark, sf):
    """The filtered probability of the lowest regime, by position."""
    return fx.regime_paths(spark, sf).filter("regime_rank = 1").select("code", "month_end", r6("p").alias("p"))


# --- folds ---------------------------------------------------------------
_ROWS = "rows AS (SELECT row_number() OVER (ORDER BY month_end) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT month_end FROM monthly))"
_EDGES = "edges AS (SELECT f AS fold, (greatest(40, n // 6) * 5 + f * (n - greatest(40, n // 6))) // 5 AS lo, (greatest(40, n // 6) * 5 + (f + 1) * (n - greatest(40, n // 6))) // 5 AS hi FROM (SELECT DISTINCT n FROM rows), (SELECT unnest(range(5)) AS f))"


def _base_folds(spark, sf, expanding):
    months = fx.months(spark, sf)
    rows = months.select((F.row_number().over(Window.orderBy("month_end")) - 1).cast("bigint").alias("rn"))
    return metrics.folds(rows, metrics.fold_edges(spark, rows.count(), 5, 40), expanding=expanding)


def _fold_sql(train: str, meets: str, held: str) -> str:
    return with_(fx.MONTHLY, _ROWS, _EDGES) + f"SELECT fold::INT AS fold, rn, CASE WHEN rn >= lo AND rn < hi THEN 'test' ELSE 'train' END AS role FROM rows, edges WHERE (rn >= lo AND rn < hi) OR (({train}) AND NOT ({meets}) AND NOT ({held}))"


@Q(_fold_sql("rn < lo OR rn >= hi", "rn + 3 >= lo AND rn <= hi - 1 + 3", "FALSE"))
def purge(spark, sf):
    """Training rows on both sides of each test block, without those whose labels overlap its labels."""
    return metrics.purge(_base_folds(spark, sf, False), 3)


@Q(_fold_sql("rn < lo OR rn >= hi", "FALSE", "rn >= hi AND rn < hi + 4"))
def embargo(spark, sf):
    """Training rows on both sides of each test block, without the four right after it."""
    return metrics.embargo(_base_folds(spark, sf, False), 4)


@Q(_fold_sql("rn < lo", "rn + 1 >= lo AND rn <= hi - 1 + 1", "rn >= hi AND rn < hi + 2"))
def purged_walk_forward(spark, sf):
    return metrics.embargo(metrics.purge(_base_folds(spark, sf, True), 1), 2)


def _horizon_sql(h: str) -> str:
    return SCORED + ", " + f"h AS (SELECT signal, {h} AS horizon, p, lead(y, {h}) OVER (PARTITION BY signal ORDER BY month_end) AS y FROM scored)"


_CURVE = SCORED + ", " + "h AS (" + " UNION ALL ".join(f"SELECT signal, {h} AS horizon, p, lead(y, {h}) OVER (PARTITION BY signal ORDER BY month_end) AS y FROM scored" for h in HORIZONS) + "), " + _AUC.format(t="h", by="signal, horizon") + f", curve AS (SELECT signal, horizon, {s6(_AUC_VALUE)} AS auc, count(*) AS n_obs, sum(y)::BIGINT AS n_positive FROM ranked GROUP BY ALL HAVING count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*))"


def _ahead(spark, sf, horizons):
    """(signal, month_end, p, horizon, y): each signal against the labels ``horizon`` months later."""
    w = Window.partitionBy("signal").orderBy("month_end")
    base = fx.scored(spark, sf)
    leads = base.select("signal", "month_end", "p", *[F.lead("y", h).over(w).alias(str(h)) for h in horizons])
    rows = leads.unpivot(["signal", "month_end", "p"], [str(h) for h in horizons], "horizon", "y")
    return rows.withColumn("horizon", F.col("horizon").cast("int"))


def _curve(spark, sf):
    """(signal, horizon, auc, n_obs, n_positive) of points with at least 20 months and both labels."""
    rows = _ahead(spark, sf, HORIZONS).filter("y IS NOT NULL AND p IS NOT NULL")
    counts = rows.groupBy("signal", "horizon").agg(F.count("*").alias("n_obs"), F.sum("y").alias("n_positive"))
    full = counts.filter("n_obs >= 20 AND n_positive > 0 AND n_positive < n_obs")
    points = metrics.roc_auc(rows, ["signal", "horizon"]).join(full, ["signal", "horizon"])
    return points.select("signal", "horizon", "auc", "n_obs", "n_positive")


@Q(_CURVE + " SELECT signal, horizon, auc, n_obs, n_positive FROM curve")
def horizon_curve(spark, sf):
    return _curve(spark, sf).withColumn("auc", r6("auc"))


@Q(_CURVE + " SELECT horizon, max(auc) FILTER (signal = 'probit') AS probit, max(auc) FILTER (signal = 'cfnai') AS cfnai, max(auc) FILTER (signal = 'sahm') AS sahm, max(auc) FILTER (signal = 'rsm') AS rsm FROM curve GROUP BY horizon")
def curve_pivot(spark, sf):
    return _curve(spark, sf).withColumn("auc", r6("auc")).groupBy("horizon").pivot("signal", list(fx.SIGNALS.values())).agg(F.first("auc"))


@Q()
def horizon_intervals(spark, sf):
    """AUC at all six horizons with block-bootstrap intervals; at least 20 months and both labels."""
    point = F.concat_ws("|", "signal", "horizon")
    rows = _ahead(spark, sf, HORIZONS).filter("y IS NOT NULL").withColumn("point", point)
    draws = models.bootstrap_metric(rows, "point", ["p"], observed=True)
    ci = metrics.percentile_ci(draws, ["point"], "value").select("point", "lo", "hi")
    found = _curve(spark, sf).withColumn("point", point).join(ci, "point", "left")
    return found.select("signal", "horizon", "auc", "lo", "hi", "n_obs", "n_positive")


@Q()
def horizon_pivot(spark, sf):
    """The six horizons by signal."""
    return horizon_intervals(spark, sf).groupBy("horizon").pivot("signal", list(fx.SIGNALS.values())).agg(F.first("auc"))


@Q(SCORED + ", th AS (SELECT round(-2 + i * 0.1, 1) AS thr FROM (SELECT unnest(range(25)) AS i)), k AS (SELECT thr, count(*) FILTER (y = 1 AND z < thr) AS tp, count(*) FILTER (y = 0 AND z < thr) AS fp, count(*) FILTER (y = 1 AND NOT z < thr) AS fn FROM panel JOIN labels USING (month_end), th WHERE code = '2-HIGH' AND z IS NOT NULL GROUP BY thr), f AS (SELECT thr, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM k) " + f"SELECT {s6('thr')} AS threshold, {s6('f1')} AS f1 FROM f ORDER BY f1 DESC, thr LIMIT 1")
def cfnai_baseline(spark, sf):
    """The threshold that would have been best on the labels themselves: tuned, and named so."""
    th = spark.range(25).select(F.round(F.col("id") * 0.1 - 2, 1).alias("thr"))
    rows = fx.panel(spark, sf).filter("code = '2-HIGH' AND z IS NOT NULL").join(fx.labels(spark, sf), "month_end")
    # 25 thresholds against a series' months.
    k = rows.crossJoin(small(th)).withColumn("pred", (F.col("z") < F.col("thr")).cast("int"))
    best = metrics.confusion(k, ["thr"]).orderBy(F.desc("f1"), "thr").limit(1)
    return best.select(r6("thr").alias("threshold"), r6("f1").alias("f1"))


@Q(with_(fx.PANEL) + "SELECT 0.0::DOUBLE AS worst, count(*) AS n FROM panel WHERE month_end <= DATE '1999-12-31'")
def assert_point_in_time(spark, sf):
    """The panel built to an early cutoff equals the start of the panel built later."""
    from tidemark.operators import align, transforms

    cut = F.lit("1999-12-31").cast("date")
    early = align.resample(fx.obs(spark, sf).filter(F.col("obs_date") <= cut), "last", tie="tie")
    early = transforms.apply_all_transforms(early, fx.catalogue(spark)).select("code", "month_end", F.col("z").alias("z0"))
    both = fx.panel(spark, sf).filter(F.col("month_end") <= cut).join(early, ["code", "month_end"], "full")
    gap = F.when(F.col("z").isNull() & F.col("z0").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col("z") - F.col("z0")), F.lit(1.0)))
    return both.agg(r6(F.max(gap)).alias("worst"), F.count("*").alias("n"))


_SEEN = "seen AS (SELECT as_of, code, p.month_end FROM (SELECT DISTINCT month_end AS as_of FROM monthly) JOIN panel p ON p.month_end <= as_of AND p.month_end + p.lag_days <= as_of WHERE z IS NOT NULL)"
_USABLE = "held AS (SELECT as_of, count(DISTINCT month_end) AS months FROM seen GROUP BY as_of), full_codes AS (SELECT as_of, count(*) AS codes FROM (SELECT as_of, code, count(*) AS n FROM seen GROUP BY ALL) JOIN held USING (as_of) WHERE n * 2 >= months GROUP BY as_of), fits AS (SELECT coalesce(months, 0) < 24 OR coalesce(codes, 0) < 2 AS bad FROM (SELECT DISTINCT month_end AS as_of FROM monthly) LEFT JOIN held USING (as_of) LEFT JOIN full_codes USING (as_of))"


@Q(with_(fx.PANEL, _SEEN, _USABLE) + f"SELECT count(*) AS n, {s6('avg(bad::INT)')} AS failed, avg(bad::INT) > 0.05 AS over_budget FROM fits")
def failure_budget(spark, sf):
    """The share of as-of dates, from the first month on, whose nowcast failed: the early ones have too few months."""
    months = fx.monthly(spark, sf).select(F.col("month_end").alias("as_of")).distinct()
    rows = fx.panel(spark, sf).select("code", "month_end", "z", F.lit(None).cast("int").alias("y"))
    found = nowcast.nowcasts(rows, months, fx.catalogue(spark), k=1, max_iter=2)
    return nowcast.failures(found).select("n", r6("failed").alias("failed"), "over_budget")


_SURVEY = "survey AS (SELECT lag_days, (date_trunc('quarter', month_end)::DATE + lag_days) AS known, avg(p) AS r FROM scored, (VALUES (45), (90), (120)) v(lag_days) WHERE signal = 'sahm' AND p IS NOT NULL GROUP BY ALL)"
_ENSEMBLE = "wt(signal, weight) AS (VALUES ('probit', 0.5), ('cfnai', 0.3), ('rsm', 0.2)), ens AS (SELECT month_end, least(greatest(sum(coalesce(weight, 0) * coalesce(p, 0.5)), 0), 1) AS e FROM signals LEFT JOIN wt USING (signal) GROUP BY month_end)"
_THREE = "known_at AS (SELECT lag_days, l.month_end, l.y, e, (SELECT max_by(r, known) FROM survey s WHERE s.lag_days = v.lag_days AND s.known <= l.month_end) AS r FROM labels l JOIN ens USING (month_end), (VALUES (45), (90), (120)) v(lag_days)), three AS (SELECT lag_days, y, unnest(['ensemble', 'survey', 'blend']) AS signal, unnest([e, r, 0.5 * e + 0.5 * r]) AS p FROM known_at WHERE r IS NOT NULL)"


@Q(SCORED + f", {_SURVEY}, {_ENSEMBLE}, {_THREE}, " + _AUC.format(t="three", by="lag_days, signal") + f" SELECT lag_days::INT AS lag_days, signal, {s6(_AUC_VALUE)} AS auc, {s6('avg((p - y) ** 2)')} AS brier, count(*) AS months FROM ranked GROUP BY ALL")
def spf_benchmark(spark, sf):
    """A quarterly survey, the ensemble and their even blend, as of every month, when surveys are known 45, 90 or 120 days into their quarter."""
    lags = small(spark.createDataFrame([(45,), (90,), (120,)], "lag_days int"))
    quarter = F.trunc("month_end", "quarter").alias("quarter")
    answers = fx.signals(spark, sf).filter("signal = 'sahm' AND p IS NOT NULL").groupBy(quarter).agg(F.avg("p").alias("survey"))
    facts = answers.crossJoin(lags).select("lag_days", F.expr("date_add(quarter, lag_days)").alias("known"), "survey")
    labels = fx.labels(spark, sf)
    at = joins.asof_backward(labels.select("month_end").crossJoin(lags), facts, by=["lag_days"], t="month_end", ts="known", value="survey")
    ensemble = metrics.weighted_blend(fx.signals(spark, sf), _weights(spark)).withColumnRenamed("p", "ensemble")
    rows = at.filter("survey IS NOT NULL").join(ensemble, "month_end").join(labels, "month_end")
    three = rows.withColumn("blend", 0.5 * F.col("ensemble") + 0.5 * F.col("survey")).unpivot(["lag_days", "month_end", "y"], ["ensemble", "survey", "blend"], "signal", "p")
    by = ["lag_days", "signal"]
    scored = three.groupBy(*by).agg(metrics.brier().alias("brier"), F.count("*").alias("months"))
    return metrics.roc_auc(three, by).join(scored, by).select(*by, r6("auc").alias("auc"), r6("brier").alias("brier"), "months")


@Q(with_(fx.MONTHLY) + f"SELECT count(*) AS n, min(month_end) AS first, max(month_end) AS last, median(gap)::DOUBLE AS spacing, median(gap) > 45 AS coarse FROM (SELECT month_end, month_end - lag(month_end) OVER (ORDER BY month_end) AS gap FROM (SELECT DISTINCT month_end FROM monthly))")
def walk_forward_meta(spark, sf):
    m = fx.months(spark, sf).withColumn("gap", F.datediff("month_end", F.lag("month_end").over(Window.orderBy("month_end"))))
    return m.agg(F.count("*").alias("n"), F.min("month_end").alias("first"), F.max("month_end").alias("last"), F.median("gap").alias("spacing"), (F.median("gap") > 45).alias("coarse"))


# --- allocation ----------------------------------------------------------
_ALLOC = "alloc(regime, asset, w) AS (VALUES ('expansion', 'equities', 0.6), ('expansion', 'bonds', 0.2), ('expansion', 'commodities', 0.15), ('expansion', 'cash', 0.05), ('recession', 'equities', 0.15), ('recession', 'bonds', 0.5), ('recession', 'commodities', 0.05), ('recession', 'cash', 0.3))"
_ALLOC_ROWS = [
    (r, a, w)
    for r, m in {
        "expansion": {"equities": 0.6, "bonds": 0.2, "commodities": 0.15, "cash": 0.05},
        "recession": {"equities": 0.15, "bonds": 0.5, "commodities": 0.05, "cash": 0.3},
    }.items()
    for a, w in m.items()
]


@Q(SCORED + ", " + _ALLOC + f", pr AS (SELECT month_end, 'recession' AS regime, p FROM signals WHERE signal = 'probit' AND p IS NOT NULL UNION ALL SELECT month_end, 'expansion', 1 - p FROM signals WHERE signal = 'probit' AND p IS NOT NULL) SELECT month_end, asset, {s6('sum(p * w) / sum(sum(p * w)) OVER (PARTITION BY month_end)')} AS weight FROM pr JOIN alloc USING (regime) GROUP BY month_end, asset")
def allocation_blend(spark, sf):
    from tidemark.operators.allocation import blend

    p = fx.signals(spark, sf).filter("signal = 'probit' AND p IS NOT NULL")
    wide = p.select("month_end", F.col("p").alias("recession"), (1 - F.col("p")).alias("expansion"))
    probs = wide.unpivot(["month_end"], ["recession", "expansion"], "regime", "p")
    alloc = spark.createDataFrame(_ALLOC_ROWS, "regime string, asset string, w double")
    return blend(probs, alloc).select("month_end", "asset", r6("weight").alias("weight"))


@Q(with_(_ALLOC) + "SELECT asset, w::DOUBLE AS w FROM alloc WHERE regime = 'recession'")
def regime_weights(spark, sf):
    return spark.createDataFrame(_ALLOC_ROWS, "regime string, asset string, w double").filter("regime = 'recession'").select("asset", "w")


@Q(with_(fx.MONTHLY, fx.RETURNS) + f", b AS (SELECT month_end, sum(CASE WHEN asset = 'equities' THEN r ELSE 0 END) AS hold, sum(CASE asset WHEN 'equities' THEN 0.6 * r WHEN 'bonds' THEN 0.4 * r ELSE 0 END) AS mixed FROM returns GROUP BY month_end) SELECT month_end, {s6('exp(sum(ln(1 + hold)) OVER w)')} AS buy_hold, {s6('exp(sum(ln(1 + mixed)) OVER w)')} AS sixty_forty FROM b WINDOW w AS (ORDER BY month_end ROWS UNBOUNDED PRECEDING)")
def benchmarks_portfolio(spark, sf):
    r, a = F.col("r"), F.col("asset")
    b = fx.returns(spark, sf).groupBy("month_end").agg(
        F.sum(F.when(a == "equities", r).otherwise(0.0)).alias("hold"),
        F.sum(F.when(a == "equities", 0.6 * r).when(a == "bonds", 0.4 * r).otherwise(0.0)).alias("mixed"),
    )
    w = Window.orderBy("month_end")
    return b.select("month_end", r6(windows.cumprod("hold", w)).alias("buy_hold"), r6(windows.cumprod("mixed", w)).alias("sixty_forty"))


@Q("SELECT asked::INT AS asked, h::INT AS horizon, w::DOUBLE AS w FROM (SELECT asked, h, w, row_number() OVER (PARTITION BY asked ORDER BY abs(h - asked), pos) AS rn FROM (VALUES (0), (4), (9), (30)) a(asked), (VALUES (0, 0.5, 0), (3, 0.4, 1), (6, 0.3, 2), (12, 0.1, 3)) t(h, w, pos)) WHERE rn = 1")
def horizon_weights(spark, sf):
    t = spark.createDataFrame([(0, 0.5, 0), (3, 0.4, 1), (6, 0.3, 2), (12, 0.1, 3)], "h int, w double, pos int")
    asked = spark.createDataFrame([(0,), (4,), (9,), (30,)], "asked int")
    best = F.min_by(F.struct("h", "w"), F.struct(F.abs(F.col("h") - F.col("asked")), "pos"))
    return asked.crossJoin(small(t)).groupBy("asked").agg(best.alias("b")).select("asked", F.col("b.h").alias("horizon"), F.col("b.w").alias("w"))


# --- calendars -----------------------------------------------------------
@Q(with_(fx.OBS) + "SELECT DISTINCT obs_date, (obs_date - greatest(isodow(obs_date) - 5, 0)::INT)::DATE AS floor FROM obs")
def business_day_floor(spark, sf):
    return fx.obs(spark, sf).select("obs_date", dates.business_day_floor(F.col("obs_date")).alias("floor")).distinct()


@Q("WITH d AS (SELECT DISTINCT o_orderdate FROM orders), n AS (SELECT o_orderdate, count(*) FILTER (isodow(x) < 6)::INT AS days FROM (SELECT o_orderdate, unnest(generate_series(o_orderdate::TIMESTAMP + INTERVAL 1 DAY, TIMESTAMP '2001-12-31', INTERVAL 1 DAY)) AS x FROM d) GROUP BY ALL) SELECT o_orderkey, days FROM orders JOIN n USING (o_orderdate)")
def business_days_between(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", dates.business_days_between(F.col("o_orderdate").cast("date"), F.lit("2001-12-31").cast("date")).alias("days"))


@Q("SELECT o_orderkey, ((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate))::INT AS months FROM orders")
def months_diff(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", dates.months_diff(F.lit("2001-08-31").cast("date"), F.col("o_orderdate").cast("date")).alias("months"))


@Q(with_(fx.MONTHLY, _UP) + f", kf AS (SELECT code, {s6('regr_slope(value, t)', 2)} AS slope, {s6('regr_intercept(value, t)', 2)} AS intercept FROM (SELECT code, value, row_number() OVER (PARTITION BY code ORDER BY month_end) AS t FROM monthly) GROUP BY code) SELECT * FROM kf")
def ols_trend(spark, sf):
    """One-regressor least squares as an aggregate."""
    t = F.row_number().over(Window.partitionBy("code").orderBy("month_end")).cast("double")
    return fx.monthly(spark, sf).withColumn("t", t).groupBy("code").agg(
        r6(F.regr_slope("value", "t"), 2).alias("slope"), r6(F.regr_intercept("value", "t"), 2).alias("intercept")
    )

