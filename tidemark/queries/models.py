"""Estimators over the engine's panels.  Iterative ones have no SQL; tests check them on simulations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import align, fitted, metrics, transforms
from tidemark.operators.sizes import small
from tidemark.plans import models, nowcast
from tidemark.queries import fixtures as fx
from tidemark.queries.evaluation import SCORED
from tidemark.queries.fixtures import r6, s6, with_
from tidemark.registry import Registry
from tidemark.storage import fresh_path

#: Factors and EM steps of the registered fits.
FACTORS, ITERATIONS = 4, 200

reg = Registry()
Q = reg.query


def panel(spark, sf):
    """Fifteen monthly series: order totals by priority and status, log changes, expanding z-scores."""
    o = fx.table(spark, sf, "orders")
    raw = o.select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("code"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.col("o_totalprice").alias("value"),
    )
    m = align.resample(raw, "mean").withColumn("x", transforms.log_diff(F.col("value")))
    return m.withColumn("z", transforms.expanding_zscore("x", 12)).select("code", "month_end", "z")


def lagged(spark, sf):
    rows = panel(spark, sf).select("code").distinct()
    return rows.withColumn("lag_days", (F.dense_rank().over(Window.orderBy("code")) * 4).cast("int"))


def signals_wide(spark, sf):
    """(g, month_end, probit, cfnai, sahm, rsm, y) as one group."""
    s = fx.scored(spark, sf)
    wide = s.groupBy("month_end", "y").pivot("signal", list(fx.SIGNALS.values())).agg(F.first("p"))
    return wide.withColumn("g", F.lit("all"))


_K = """series AS (SELECT code, value / 1e6 AS y, row_number() OVER (PARTITION BY code ORDER BY month_end) AS t FROM monthly),
k AS (SELECT code, 0::BIGINT AS t, 0.0::DOUBLE AS x, 10.0::DOUBLE AS p FROM (SELECT DISTINCT code FROM series)
  UNION ALL SELECT s.code, s.t, CASE WHEN y IS NULL THEN x ELSE x + (p + 1) / (p + 5) * (y - x) END,
  CASE WHEN y IS NULL THEN p + 1 ELSE (1 - (p + 1) / (p + 5)) * (p + 1) END FROM k JOIN series s ON s.code = k.code AND s.t = k.t + 1)"""


@Q("WITH RECURSIVE " + fx.MONTHLY + ", " + _K + f" SELECT code, {s6('arg_max(x, t)')} AS state, {s6('arg_max(p, t)')} AS variance FROM k GROUP BY code")
def kalman_filter_scalar(spark, sf):
    m = fx.monthly(spark, sf).withColumn("y", F.col("value") / 1e6)
    out = models.local_level_fold(m, "y", 1.0, 4.0)
    return out.select("code", r6("state").alias("state"), r6("variance").alias("variance"))


@Q("WITH RECURSIVE " + fx.MONTHLY + ", " + _K + f" SELECT code, {s6('arg_max(x, t)')} AS filtered FROM k GROUP BY code")
def kalman_filter(spark, sf):
    """The matrix kernel on a scalar model ends where the fold does."""
    m = fx.monthly(spark, sf).withColumn("y", F.col("value") / 1e6)
    out = models.local_level(m, "y", 1.0, 4.0)
    return out.groupBy("code").agg(r6(F.max_by("filtered", "month_end")).alias("filtered"))


_RTS = """fw AS MATERIALIZED (SELECT k.*, s.month_end FROM k JOIN (SELECT code, month_end, row_number() OVER (PARTITION BY code ORDER BY month_end) AS t FROM monthly) s ON s.code = k.code AND s.t = k.t),
b AS (SELECT code, t, x AS m FROM fw WHERE (code, t) IN (SELECT code, max(t) FROM fw GROUP BY code)
  UNION ALL SELECT fw.code, fw.t, fw.x + fw.p / (fw.p + 1) * (m - fw.x) FROM b JOIN fw ON fw.code = b.code AND fw.t = b.t - 1)"""


@Q("WITH RECURSIVE " + fx.MONTHLY + ", " + _K + ", " + _RTS + f" SELECT fw.code, month_end, {s6('x')} AS filtered, {s6('m')} AS smoothed, {s6('p')} AS variance FROM fw JOIN b ON fw.code = b.code AND fw.t = b.t")
def rts_smoother(spark, sf):
    m = fx.monthly(spark, sf).withColumn("y", F.col("value") / 1e6)
    out = models.local_level(m, "y", 1.0, 4.0)
    return out.select("code", "month_end", *[r6(c).alias(c) for c in ("filtered", "smoothed", "variance")])


_H = """series AS (SELECT code, x, row_number() OVER (PARTITION BY code ORDER BY month_end) AS t FROM (SELECT code, month_end, z AS x FROM panel)),
k AS (SELECT code, 0::BIGINT AS t, 0.5::DOUBLE AS a FROM (SELECT DISTINCT code FROM series)
  UNION ALL SELECT code, t, CASE WHEN x IS NULL THEN b ELSE b * exp(-0.5 * (x + 1) ** 2) / greatest(b * exp(-0.5 * (x + 1) ** 2) + (1 - b) * exp(-0.5 * (x - 0.5) ** 2), 1e-300) END
  FROM (SELECT s.code, s.t, s.x, a * 0.9 + (1 - a) * (1 - 0.9) AS b FROM k JOIN series s ON s.code = k.code AND s.t = k.t + 1))"""


@Q("WITH RECURSIVE " + fx.PANEL + ", " + _H + f" SELECT code, {s6('arg_max(a, t)')} AS p_first FROM k GROUP BY code")
def hamilton_filter(spark, sf):
    out = models.hamilton_fold(fx.panel(spark, sf), "z", (-1.0, 0.5), 1.0, 0.9)
    return out.select("code", r6("p_first").alias("p_first"))


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('-0.5 * (ln(2 * pi()) + z * z)')} AS logp FROM panel")
def gaussian_density(spark, sf):
    z = F.col("z")
    return fx.panel(spark, sf).select("code", "month_end", r6(-0.5 * (F.ln(2 * F.pi()) + z * z)).alias("logp"))


@Q()
def dfm_em(spark, sf):
    return models.fit_factors(models.one_group(panel(spark, sf)), "z", FACTORS, ITERATIONS)


@Q()
def mm_cumulator(spark, sf):
    """The same with one quarterly series, which loads on three months."""
    p = panel(spark, sf)
    q = "1-URGENT/F"
    keep = F.when((F.col("code") != q) | (F.month("month_end") % 3 == 0), F.col("z"))
    return models.fit_factors(models.one_group(p.withColumn("z", keep)), "z", FACTORS, ITERATIONS, quarterly=(q,))


@Q()
def varimax(spark, sf):
    return models.factor_loadings(models.one_group(panel(spark, sf)), "z", FACTORS, ITERATIONS)


@Q()
def factor_naming(spark, sf):
    anchors = {"urgent": ["1-URGENT/F", "1-URGENT/O"], "low": ["5-LOW/F", "5-LOW/O"]}
    out = models.fit_factors(models.one_group(panel(spark, sf)), "z", FACTORS, ITERATIONS, anchors=anchors)
    return out.groupBy("as_of", "factor").agg(F.first("quality").alias("quality"), F.count("*").alias("months"))


@Q()
def hmm_em_univariate(spark, sf):
    return models.fit_regimes(fx.panel(spark, sf), "code", "z", 2)


@Q()
def probit_fit(spark, sf):
    return models.probit(signals_wide(spark, sf), "g", ["probit", "cfnai", "rsm"], "y")


@Q()
def probit_coefs(spark, sf):
    return models.probit_coefficients(signals_wide(spark, sf), "g", ["probit", "cfnai", "rsm"], "y")


@Q()
def probit_cv_lambda(spark, sf):
    return models.probit_cv(signals_wide(spark, sf), "g", ["probit", "cfnai", "rsm"], "y")


@Q()
def yield_probit(spark, sf):
    """One feature, labels twelve months ahead."""
    rows = signals_wide(spark, sf)
    ahead = rows.withColumn("y12", F.lead("y", 12).over(Window.partitionBy("g").orderBy("month_end")))
    return models.probit(ahead, "g", ["rsm"], "y12")


@Q()
def calibrate(spark, sf):
    return models.calibrated(fx.scored(spark, sf), "signal", "y", "p", "isotonic")


@Q()
def calibrate_platt(spark, sf):
    return models.calibrated(fx.scored(spark, sf), "signal", "y", "p", "platt")


_GDP = """q AS (SELECT last_day(date_trunc('quarter', month_end)::DATE + INTERVAL 2 MONTH) AS quarter_end, avg(value) FILTER (code = '1-URGENT') / 1e5 AS x, avg(value) FILTER (code = '2-HIGH') / 1e5 AS y FROM monthly GROUP BY ALL),
last_q AS (SELECT coalesce(arg_max(coalesce(x, 0), quarter_end), 0) AS x0, max(quarter_end) AS q0 FROM q WHERE x IS NOT NULL OR y IS NOT NULL),
known AS (SELECT x, y FROM q, last_q WHERE quarter_end < q0 AND x IS NOT NULL AND y IS NOT NULL),
fit AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS m, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM known),
se AS (SELECT a + b * x0 AS point, sqrt((syy - b * sxy) / (n - 2)) * sqrt(1 + 1.0::DOUBLE / n + (x0 - m) ** 2 / sxx) AS s, n FROM fit, last_q),
ci AS (SELECT CASE WHEN n < 20 THEN 2.5 ELSE point END AS point, 1.645::DOUBLE * greatest(CASE WHEN n < 20 THEN 1.5 ELSE s END, 0.5) AS half FROM se)"""


@Q(with_(fx.MONTHLY, _GDP) + f"SELECT {s6('point')} AS point, {s6('point - half')} AS lo, {s6('point + half')} AS hi FROM ci")
def ols_gdp(spark, sf):
    """The last quarter of one series from another's, fitted on the quarters before."""
    q = align.quarter_mean(fx.monthly(spark, sf)).filter("code IN ('1-URGENT', '2-HIGH')")
    wide = q.groupBy("quarter_end").pivot("code", ["1-URGENT", "2-HIGH"]).agg(F.first("value"))
    g = wide.select("quarter_end", (F.col("`1-URGENT`") / 1e5).alias("f1"), (F.col("`2-HIGH`") / 1e5).alias("y"))
    return models.gdp(g, ["f1"], "y").select(*[r6(c).alias(c) for c in ("point", "lo", "hi")])


def _cv(spark, sf, model):
    rows = signals_wide(spark, sf).withColumn("rn", (F.row_number().over(Window.partitionBy("g").orderBy("month_end")) - 1).cast("bigint"))
    rows = rows.withColumn("target", F.lead("sahm", 1).over(Window.partitionBy("g").orderBy("month_end")))
    edges = metrics.fold_edges(spark, rows.count(), 4, 40)
    return models.cross_validated(rows, metrics.purged_folds(rows, edges, 1, 1), ["probit", "cfnai", "rsm"], "target", model)


@Q()
def ridge_purged(spark, sf):
    return _cv(spark, sf, "ridge")


@Q()
def gbm(spark, sf):
    return _cv(spark, sf, "gbm")


@Q()
def fold_ic(spark, sf):
    return _cv(spark, sf, "ridge").select("fold", "ic")


@Q()
def null_ic(spark, sf):
    return models.null_ic(fx.scored(spark, sf), "signal", "p", "y")


@Q()
def block_bootstrap_auc(spark, sf):
    draws = models.bootstrap_metric(fx.scored(spark, sf).filter("signal = 'probit'"), "signal", ["p"], "auc")
    return metrics.percentile_ci(draws, ["signal"], "value")


@Q()
def paired_bootstrap(spark, sf):
    draws = models.bootstrap_metric(signals_wide(spark, sf), "g", ["probit", "cfnai"], "brier")
    return metrics.percentile_ci(draws, ["g"], "value")


@Q(with_(fx.FACTORS) + f"SELECT factor, code, {s6('l')} AS loading FROM loadings")
def sign_convention(spark, sf):
    """Loadings of two principal components, each turned so that they sum to a non-negative number."""
    return fx.components(spark, sf)[0].select("factor", "code", r6("loading").alias("loading"))


@Q(with_(fx.FACTORS) + f"SELECT factor, {s6('strength')} AS strength, strength < 0.01 AS empty FROM strengths")
def factor_strength(spark, sf):
    loadings, scores = fx.components(spark, sf)
    return fitted.factor_strengths(scores, loadings).select("factor", r6("strength").alias("strength"), "empty")


_NAMED = """sc AS (SELECT factor, avg(abs(l)) FILTER (code IN ('1-URGENT', '2-HIGH')) AS act, avg(abs(l)) FILTER (code = '5-LOW') AS pri, quantile_cont(abs(l), 0.9) AS q FROM loadings GROUP BY factor),
straight AS (SELECT a.act + b.pri >= a.pri + b.act AS yes FROM sc a, sc b WHERE a.factor = 'factor_1' AND b.factor = 'factor_2'),
who AS (SELECT *, yes = (factor = 'factor_1') AS is_act FROM sc, straight),
named AS (SELECT factor, CASE WHEN is_act THEN 'activity' ELSE 'prices' END AS name, CASE WHEN is_act THEN act ELSE pri END / greatest(q, 1e-12) AS quality FROM who),
k1 AS (SELECT *, name = 'activity' AS k FROM named JOIN strengths USING (factor)),
k2 AS (SELECT * REPLACE (CASE WHEN bool_or(k AND strength >= 0.01) OVER () THEN k AND strength >= 0.01 ELSE k END AS k) FROM k1),
k3 AS (SELECT * REPLACE (CASE WHEN bool_or(k AND quality >= 1) OVER () THEN k AND quality >= 1 ELSE k END AS k) FROM k2),
k4 AS (SELECT *, bool_or(k) OVER () AS any_k FROM k3)"""


@Q(with_(fx.FACTORS, _NAMED) + f"SELECT factor, name, {s6('strength')} AS strength, {s6('quality')} AS quality FROM k4 WHERE k OR NOT any_k")
def rsm_input_select(spark, sf):
    """The factors that a regime model is fitted on: by name, not empty, and borne out by their loadings."""
    loadings, scores = fx.components(spark, sf)
    named = models.named_factors(loadings, {"activity": ["1-URGENT", "2-HIGH"], "prices": ["5-LOW"]})
    rows = named.join(fitted.factor_strengths(scores, loadings), ["as_of", "factor"])
    return fitted.regime_inputs(rows, ["activity"]).select("factor", "name", r6("strength").alias("strength"), r6("quality").alias("quality"))


def labelled(spark, sf):
    return panel(spark, sf).join(fx.labels(spark, sf), "month_end", "left")


def dates(spark, sf, step):
    return align.as_of_grid(fx.monthly(spark, sf), step).filter("as_of >= DATE '1998-12-31'")


def published_signals(spark, sf):
    """(code, month_end, value, lag_days): the signals cfnai and sahm with their series' publication lags."""
    lags = {name: lag for code, _, _, _, lag in fx.CATALOGUE if (name := fx.SIGNALS.get(code)) in ("cfnai", "sahm")}
    lag = F.create_map(*[F.lit(x) for kv in lags.items() for x in kv])
    rows = fx.signals(spark, sf).filter(F.col("signal").isin(*lags))
    return rows.select(F.col("signal").alias("code"), "month_end", F.col("p").alias("value"), F.element_at(lag, F.col("signal")).alias("lag_days"))


def gdp_growth(spark, sf):
    """(month_end, value, lag_days): annualised quarterly log growth of the series that ols_gdp predicts, 60 days after the quarter."""
    q = align.quarter_mean(fx.monthly(spark, sf)).filter("code = '2-HIGH'")
    before = F.lag("value").over(Window.partitionBy("code").orderBy("quarter_end"))
    return q.select(F.col("quarter_end").alias("month_end"), (400 * F.log(F.try_divide("value", before))).alias("value"), F.lit(60).alias("lag_days"))


def _nowcasts(spark, sf, at):
    return nowcast.nowcasts(
        panel(spark, sf), at, lagged(spark, sf), spans=fx.spans(spark), signals=published_signals(spark, sf), growth=gdp_growth(spark, sf),
        k=FACTORS, max_iter=ITERATIONS,
    )


@Q()
def nowcast_run(spark, sf):
    """A nowcast at the panel's last month."""
    last = dates(spark, sf, 1).agg(F.max("as_of").alias("as_of"))
    return _nowcasts(spark, sf, last)


def _walk(spark, sf, step):
    return _nowcasts(spark, sf, dates(spark, sf, step))


@Q()
def walk_forward(spark, sf):
    """Point-in-time features, a fit for each month end."""
    return _walk(spark, sf, 1)


@Q()
def backtest_expanding(spark, sf):
    """Out-of-sample probabilities of every third month against labels."""
    p = _walk(spark, sf, 3).select(F.col("as_of").alias("month_end"), F.col("p_recession").alias("p"))
    scored = p.join(fx.labels(spark, sf), "month_end").withColumn("pred", (F.col("p") > 0.5).cast("int")).withColumn("g", F.lit("all"))
    return metrics.confusion(scored, ["g"])


@Q()
def backtest_insample(spark, sf):
    """Full-sample probabilities against labels."""
    p = models.probit(signals_wide(spark, sf), "g", ["probit", "cfnai", "rsm"], "y").withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return metrics.confusion(p.join(fx.labels(spark, sf), "month_end"), ["g"])


@Q()
def sink_model(spark, sf):
    """All parameters of the factors and of their regimes, written, read back and used to score the panel."""
    path = fresh_path(spark, "model")
    panels = models.one_group(panel(spark, sf))
    models.fitted_parameters(panels).write.parquet(path)
    return models.score_stored(panels, spark.read.parquet(path))


@Q(with_(fx.FACTORS) + f"SELECT factor, month_end, {s6('s')} AS score FROM scores")
def pca_init(spark, sf):
    """Scores of the first two principal components, turned as their loadings are."""
    loadings, scores = models.pca(models.one_group(fx.panel(spark, sf).select("code", "month_end", "z"))), None
    scores = models.scores_of(loadings).join(fitted.factor_signs(models.loadings_of(loadings)), ["as_of", "factor"])
    return scores.select("factor", "month_end", r6(F.col("score") * F.col("sign")).alias("score"))


@Q(with_(fx.MONTHLY) + "SELECT (SELECT max(month_end) FROM monthly) AS as_of, i::INT AS i, j::INT AS j, (i = j)::INT::DOUBLE AS value FROM (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)")
def identify_state(spark, sf):
    """After identification the state's loadings have orthonormal columns: their cross-product is the identity."""
    found = models.state_identity(models.one_group(panel(spark, sf)))
    return found.select("as_of", "i", "j", r6("value").alias("value"))


@Q()
def divergence_guard(spark, sf):
    """Fits of a flat panel and of a sound one: the first reports its state instead of failing."""
    p = models.one_group(panel(spark, sf))
    flat = p.withColumn("z", F.lit(1.0)).withColumn("as_of", F.date_add("as_of", 1))
    both = models.fit_factors(p.unionByName(flat), "z", 1, 10)
    return both.groupBy("as_of").agg(F.first("status").alias("status"))


@Q()
def factor_transform(spark, sf):
    return models.project_factors(models.one_group(panel(spark, sf)))


@Q()
def hmm_em_multivariate(spark, sf):
    p = fx.panel(spark, sf)
    return models.panel_regimes(models.one_group(p.select("code", "month_end", "z")))


@Q()
def rsm_fit_dispatch(spark, sf):
    p = fx.panel(spark, sf).select("code", "month_end", "z")
    return models.panel_regimes(models.one_group(p), multivariate=False)


@Q(fx.recursive(fx.SMOOTHED) + f"SELECT d.code, month_end, {s6('s')} AS p_smoothed FROM bw JOIN dens d ON d.code = bw.code AND d.t = bw.t")
def kim_smoother(spark, sf):
    """Smoothed probabilities of each series' lowest regime."""
    return fx.regime_paths(spark, sf).filter("regime_rank = 1").select("code", "month_end", r6("p_smoothed").alias("p_smoothed"))


@Q(fx.recursive(fx.REGIMES) + f"SELECT d.code, month_end, r::INT AS regime_rank, {s6('CASE r WHEN 1 THEN f ELSE 1 - f END')} AS p FROM fw JOIN dens d ON d.code = fw.code AND d.t = fw.t, (VALUES (1), (2)) v(r)")
def regime_probs(spark, sf):
    """Filtered probabilities of both regimes."""
    return fx.regime_paths(spark, sf).select("code", "month_end", "regime_rank", r6("p").alias("p"))


@Q("SELECT * FROM (VALUES (1, 'recession'), (2, 'expansion')) v(regime_rank, regime)")
def label_order_guard(spark, sf):
    names = models.check_label_order(["recession", "expansion"])
    return spark.createDataFrame(list(enumerate(names, 1)), "regime_rank int, regime string")


@Q()
def probit_predict(spark, sf):
    return probit_fit(spark, sf).select("month_end", "p")


_ENSEMBLE = SCORED + ", wt(signal, weight) AS (VALUES ('probit', 0.5), ('cfnai', 0.3), ('rsm', 0.2)), e AS (SELECT month_end, least(greatest(sum(coalesce(weight, 0) * coalesce(p, 0.5)), 0), 1) AS p FROM signals LEFT JOIN wt USING (signal) GROUP BY month_end), c AS (SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND NOT p > 0.5) AS fn, count(*) FILTER (y = 0 AND NOT p > 0.5) AS tn FROM e JOIN labels USING (month_end))"


@Q(_ENSEMBLE + f" SELECT tp, fp, fn, tn, {s6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM c")
def backtest_ensemble(spark, sf):
    """The weighted ensemble over the full sample against labels."""
    weights = spark.createDataFrame(fx.WEIGHTS, "signal string, weight double")
    e = metrics.weighted_blend(fx.signals(spark, sf), weights).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    c = metrics.confusion(e.join(fx.labels(spark, sf), "month_end").withColumn("g", F.lit(1)), ["g"])
    return c.select("tp", "fp", "fn", "tn", r6("accuracy").alias("accuracy"))


@Q()
def oos_rename(spark, sf):
    """A feature panel as probability columns by month."""
    p = walk_forward(spark, sf)
    return p.select(F.col("as_of").alias("month_end"), F.col("p_recession").alias("p_ensemble"), *[f"p_{s}" for s in nowcast.SIGNALS])


@Q()
def oos_report(spark, sf):
    """AUC and Brier score of every out-of-sample signal."""
    p = oos_rename(spark, sf).unpivot(["month_end"], ["p_ensemble", *[f"p_{s}" for s in nowcast.SIGNALS]], "signal", "p")
    rows = p.join(fx.labels(spark, sf), "month_end")
    return metrics.roc_auc(rows, ["signal"]).join(rows.groupBy("signal").agg(metrics.brier().alias("brier")), "signal")


_REPORT = ", k AS (SELECT * FROM scored WHERE p IS NOT NULL), a AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY p) + (count(*) OVER (PARTITION BY signal, p) - 1) / 2 AS r, y, p FROM k)"


@Q(SCORED + _REPORT + f" SELECT signal, {s6('(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)')} AS auc, {s6('avg((p - y) ** 2)')} AS brier, count(*) AS months FROM a GROUP BY signal")
def recession_main(spark, sf):
    """The report on every signal: AUC, Brier score, months."""
    rows = fx.scored(spark, sf).filter("p IS NOT NULL")
    return (
        metrics.roc_auc(rows, ["signal"])
        .join(rows.groupBy("signal").agg(metrics.brier().alias("brier"), F.count("*").alias("months")), "signal")
        .select("signal", r6("auc").alias("auc"), r6("brier").alias("brier"), "months")
    )


_LAGS = "SELECT d AS lag_days, avg((p - y) ** 2) AS b, count(*) AS n FROM (VALUES (45), (90), (120)) v(d) JOIN (SELECT month_end, y FROM labels) l ON TRUE JOIN LATERAL (SELECT max_by(p, month_end) AS p FROM scored s WHERE s.signal = 'probit' AND s.p IS NOT NULL AND s.month_end + d <= l.month_end) x ON TRUE WHERE p IS NOT NULL GROUP BY d"


@Q(SCORED + f" SELECT lag_days::INT AS lag_days, {s6('b')} AS brier, n FROM ({_LAGS})")
def spf_main(spark, sf):
    """A signal known only 45, 90 or 120 days later, as of every month, against labels."""
    from tidemark.operators.joins import asof_backward

    lags = spark.createDataFrame([(45,), (90,), (120,)], "lag_days int")
    months = fx.labels(spark, sf)
    grid = months.select("month_end").crossJoin(small(lags))
    known = fx.signals(spark, sf).filter("signal = 'probit' AND p IS NOT NULL").crossJoin(small(lags))
    facts = known.select("lag_days", F.expr("date_add(month_end, lag_days)").alias("known"), "p")
    at = asof_backward(grid, facts, by=["lag_days"], t="month_end", ts="known", value="p").filter("p IS NOT NULL")
    return at.join(months, "month_end").groupBy("lag_days").agg(r6(metrics.brier()).alias("brier"), F.count("*").alias("n"))


@Q(with_(fx.CAT) + "SELECT code, frequency, category, transform, lag_days FROM catalogue")
def series_info(spark, sf):
    return fx.catalogue(spark)
