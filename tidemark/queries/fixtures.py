"""The engine's logical tables on top of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import align, transforms

CATALOGUE = [
    ("1-URGENT", "daily", "activity", "log_diff", 1),
    ("2-HIGH", "daily", "activity", "diff", 5),
    ("3-MEDIUM", "weekly", "credit", "log_diff", 17),
    ("4-NOT SPECIFIED", "monthly", "credit", "none", 35),
    ("5-LOW", "quarterly", "prices", "pct_change", 60),
]
SPANS = [
    ("1998-02-01", "1998-07-01", "1998-06-15", "1999-02-10"),
    ("2001-03-01", "2001-11-01", "2001-07-20", "2002-07-17"),
]
SIGNALS = {"1-URGENT": "probit", "2-HIGH": "cfnai", "3-MEDIUM": "sahm", "4-NOT SPECIFIED": "rsm"}
WEIGHTS = [("probit", 0.5), ("cfnai", 0.3), ("rsm", 0.2)]
ASSETS = {"1-URGENT": "equities", "2-HIGH": "bonds", "3-MEDIUM": "commodities", "4-NOT SPECIFIED": "cash"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str, n: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), n) + F.lit(0.0)


def _quoted(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "code string, frequency string, category string, transform string, lag_days int")


def spans(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(SPANS, "peak string, trough string, peak_announced string, trough_announced string")
    return raw.select(*[F.col(c).cast("date").alias(c) for c in raw.columns])


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as an irregular series for each priority."""
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("code"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("tie"),
    )


def sparse_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a series for each customer: gaps everywhere."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("code"),
        F.col("o_orderdate").cast("date").alias("obs_date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("tie"),
    )


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return align.resample(obs(spark, sf), "last", tie="tie")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(code, month_end, value, transform, x, z)."""
    return transforms.apply_all_transforms(monthly(spark, sf), catalogue(spark))


def months(spark: SparkSession, sf: str) -> DataFrame:
    """(month_end): the panel's months, from the series' first and last days alone."""
    return align.month_spine(obs(spark, sf)).select("month_end").distinct()


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(month_end, y) over the panel's months."""
    from tidemark.operators.joins import interval_label

    return interval_label(months(spark, sf), spans(spark))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """(month_end, signal, p): logistic of four series' z-scores; NULL where z is."""
    names = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    return panel(spark, sf).filter(F.col("code").isin(*SIGNALS)).select(
        "month_end", F.element_at(names, F.col("code")).alias("signal"), transforms.logistic_signal(F.col("z"), 0.0, 1.0).alias("p")
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(signal, month_end, p, y)."""
    return signals(spark, sf).join(labels(spark, sf), "month_end")


def components(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Loadings under the sign convention and scores (before it) of the panel's first two principal components."""
    from tidemark.operators import fitted
    from tidemark.plans import models

    parts = models.pca(models.one_group(panel(spark, sf).select("code", "month_end", "z")))
    return fitted.oriented(models.loadings_of(parts)), models.scores_of(parts)


def ranked_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """(code, regime, mean, var, n, to_low, to_high, regime_rank) of every series' z-scores."""
    from tidemark.operators import fitted

    return fitted.rank_regimes(fitted.split_regimes(panel(spark, sf), "z"))


def regime_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(code, month_end, regime_rank, p, p_smoothed)."""
    from tidemark.plans import models

    return models.regime_probabilities(panel(spark, sf), ranked_regimes(spark, sf), "z")


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """(month_end, asset, r): damped symmetric changes of four series."""
    names = F.create_map(*[F.lit(x) for kv in ASSETS.items() for x in kv])
    w = Window.partitionBy("code").orderBy("month_end")
    before = F.lag("value").over(w)
    return (
        monthly(spark, sf)
        .withColumn("r", F.try_divide(F.col("value") - before, F.col("value") + before) * 0.1)
        .filter(F.col("code").isin(*ASSETS) & F.col("r").isNotNull())
        .select("month_end", F.element_at(names, F.col("code")).alias("asset"), "r")
    )


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """(month_end, asset, r, w): a rule that alternates between two allocations by quarter."""
    even = F.quarter("month_end") % 2 == 0
    w = F.element_at(
        F.create_map(*[F.lit(x) for kv in {"equities": 0.6, "bonds": 0.2, "commodities": 0.15, "cash": 0.05}.items() for x in kv]),
        F.col("asset"),
    )
    v = F.element_at(
        F.create_map(*[F.lit(x) for kv in {"equities": 0.15, "bonds": 0.5, "commodities": 0.05, "cash": 0.3}.items() for x in kv]),
        F.col("asset"),
    )
    return returns(spark, sf).withColumn("w", F.when(even, w).otherwise(v))


# The same in SQL, as common table expressions.
OBS = """obs AS (SELECT o_orderpriority AS code, o_orderdate::DATE AS obs_date, o_totalprice AS value, o_orderkey AS tie FROM orders)"""
SPARSE = """obs AS (SELECT o_custkey::VARCHAR AS code, o_orderdate::DATE AS obs_date, o_totalprice AS value, o_orderkey AS tie FROM orders)"""
SPINE = """ends AS (SELECT code, min(obs_date) AS lo, max(obs_date) AS hi FROM obs GROUP BY code),
spine AS (SELECT code, last_day(d::DATE) AS month_end FROM (SELECT code, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM ends))"""
MONTHLY = OBS + ", " + SPINE + """,
month0 AS (SELECT code, last_day(obs_date) AS month_end, arg_max(value, {'d': obs_date, 't': tie}) AS value FROM obs GROUP BY ALL),
monthly AS (SELECT s.code, s.month_end, m.value FROM spine s LEFT JOIN month0 m USING (code, month_end))"""
CAT = f"""catalogue(code, frequency, category, transform, lag_days) AS (VALUES {_quoted(CATALOGUE)})"""
PANEL = MONTHLY + ", " + CAT + """,
pad AS (SELECT m.*, c.transform, c.lag_days, lag(value) OVER w AS before,
  last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padded,
  last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS padded_before
  FROM monthly m JOIN catalogue c USING (code) WINDOW w AS (PARTITION BY code ORDER BY month_end)),
xs AS (SELECT code, month_end, value, transform, lag_days, CASE transform WHEN 'none' THEN value
  WHEN 'log_diff' THEN ln(value / before) WHEN 'diff' THEN value - before
  WHEN 'pct_change' THEN (padded - padded_before) / padded_before END AS x FROM pad),
panel AS (SELECT *, CASE WHEN count(x) OVER w >= 24 THEN (x - avg(x) OVER w)
  / (CASE WHEN coalesce(stddev_samp(x) OVER w, 0) = 0 THEN 1 ELSE stddev_samp(x) OVER w END) END AS z
  FROM xs WINDOW w AS (PARTITION BY code ORDER BY month_end ROWS UNBOUNDED PRECEDING))"""
SPAN = "spans AS (SELECT peak::DATE AS peak, trough::DATE AS trough, pa::DATE AS peak_announced, ta::DATE AS trough_announced FROM (VALUES " + _quoted(SPANS) + ") v(peak, trough, pa, ta))"
LABELS = SPAN + """,
labels AS (SELECT month_end, max(CASE WHEN peak IS NULL THEN 0 ELSE 1 END)::INT AS y
  FROM (SELECT DISTINCT month_end FROM monthly) LEFT JOIN spans ON month_end BETWEEN peak AND trough GROUP BY month_end)"""
SIGNAL = """names(code, signal) AS (VALUES """ + _quoted(SIGNALS.items()) + """),
signals AS (SELECT month_end, signal, 1 / (1 + exp(-z)) AS p FROM panel JOIN names USING (code)),
scored AS (SELECT signal, month_end, p, y FROM signals JOIN labels USING (month_end))"""
RETURNS = """assets(code, asset) AS (VALUES """ + _quoted(ASSETS.items()) + """),
returns AS (SELECT month_end, asset, r FROM (SELECT code, month_end, (value - before) / (value + before) * 0.1 AS r
  FROM (SELECT *, lag(value) OVER (PARTITION BY code ORDER BY month_end) AS before FROM monthly)) JOIN assets USING (code) WHERE r IS NOT NULL),
weights AS (SELECT *, CASE WHEN quarter(month_end) % 2 = 0
  THEN CASE asset WHEN 'equities' THEN 0.6 WHEN 'bonds' THEN 0.2 WHEN 'commodities' THEN 0.15 ELSE 0.05 END
  ELSE CASE asset WHEN 'equities' THEN 0.15 WHEN 'bonds' THEN 0.5 WHEN 'commodities' THEN 0.05 ELSE 0.3 END END::DOUBLE AS w FROM returns)"""


#: Squarings of a matrix, after which one eigenvector is all that is left of it.
SQUARINGS = 26


def _leading(name: str, start: str) -> str:
    """The leading eigenvector (code, l) of the matrix ``start`` (i, j, v) as the table ``name``."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {start} WHERE i = j) AS v FROM {start})"]
    for n in range(1, SQUARINGS + 1):
        q = f"{name}_{n - 1}"
        out.append(
            f"{name}_{n} AS MATERIALIZED (SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM "
            f"(SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {q} a JOIN {q} b ON a.j = b.i GROUP BY ALL))"
        )
    q = f"{name}_{SQUARINGS}"
    at = f"(SELECT arg_max(i, v) FROM {q} WHERE i = j)"
    out.append(f"{name} AS MATERIALIZED (SELECT i AS code, v / sqrt((SELECT max(v) FROM {q} WHERE i = j)) AS l FROM {q} WHERE j = {at})")
    return ",\n".join(out)


# Two principal components of the scaled panel: loadings (factor, code, l) under the sign convention, scores (factor, month_end, s).
FACTORS = PANEL + """,
zmonths AS (SELECT DISTINCT month_end FROM panel WHERE z IS NOT NULL),
zs AS MATERIALIZED (SELECT code, month_end, coalesce((z - avg(z) OVER (PARTITION BY code)) / nullif(stddev_pop(z) OVER (PARTITION BY code), 0), 0) AS v
  FROM zmonths CROSS JOIN (SELECT DISTINCT code FROM panel) LEFT JOIN panel USING (code, month_end)),
cov1 AS MATERIALIZED (SELECT a.code AS i, b.code AS j, sum(a.v * b.v) AS v FROM zs a JOIN zs b USING (month_end) GROUP BY ALL),
""" + _leading("one", "cov1") + """,
lambda1 AS (SELECT sum(x.l * v * y.l) AS l FROM cov1 JOIN one x ON i = x.code JOIN one y ON j = y.code),
cov2 AS MATERIALIZED (SELECT i, j, v - (SELECT l FROM lambda1) * x.l * y.l AS v FROM cov1 JOIN one x ON i = x.code JOIN one y ON j = y.code),
""" + _leading("two", "cov2") + """,
unsigned AS (SELECT 'factor_1' AS factor, code, l FROM one UNION ALL SELECT 'factor_2', code, l FROM two),
turn AS (SELECT factor, CASE WHEN (CASE WHEN abs(sum(l)) > 1e-8 THEN sum(l) ELSE arg_max(l, abs(l)) END) < 0 THEN -1 ELSE 1 END AS side FROM unsigned GROUP BY factor),
loadings AS MATERIALIZED (SELECT factor, code, l * side AS l FROM unsigned JOIN turn USING (factor)),
scores AS (SELECT factor, month_end, sum(v * l) AS s FROM zs JOIN loadings USING (code) GROUP BY ALL),
strengths AS (SELECT factor, v * n / sum(v * n) OVER () AS strength FROM (SELECT factor, var_pop(s) AS v FROM scores GROUP BY factor)
  JOIN (SELECT factor, sum(l * l) AS n FROM loadings GROUP BY factor) USING (factor))"""

# Two regimes of every series: ranked (code, regime, regime_rank, mean, var, to_low, to_high, n) and, by recursion, fw (code, t, pred, f).
REGIMES = PANEL + """,
rx AS MATERIALIZED (SELECT code, month_end, z AS x, row_number() OVER (PARTITION BY code ORDER BY month_end) AS t FROM panel WHERE z IS NOT NULL),
rside AS (SELECT *, x > (SELECT quantile_cont(x, 0.5) FROM rx m WHERE m.code = rx.code) AS high FROM rx),
rnext AS (SELECT *, lead(high) OVER (PARTITION BY code ORDER BY t) AS nxt FROM rside),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY code ORDER BY mean, regime)::INT AS regime_rank FROM (
  SELECT code, CASE WHEN high THEN 'above' ELSE 'below' END AS regime, avg(x) AS mean, greatest(var_pop(x), 1e-4) AS var, count(*) AS n,
  (count(*) FILTER (NOT nxt) + 1) / (count(nxt) + 2) AS to_low, (count(*) FILTER (nxt) + 1) / (count(nxt) + 2) AS to_high FROM rnext GROUP BY code, high)),
rm AS MATERIALIZED (SELECT a.code, a.mean AS m1, a.var AS v1, a.to_low AS p11, a.to_high AS p12, b.mean AS m2, b.var AS v2, b.to_low AS p21, b.to_high AS p22
  FROM ranked a JOIN ranked b USING (code) WHERE a.regime_rank = 1 AND b.regime_rank = 2),
dens AS MATERIALIZED (SELECT rx.code, month_end, t, p11, p12, p21, p22, exp(-0.5 * (x - m1) ** 2 / v1) / sqrt(v1) AS e1, exp(-0.5 * (x - m2) ** 2 / v2) / sqrt(v2) AS e2
  FROM rx JOIN rm ON rx.code = rm.code),
fw AS (SELECT code, t, 0.5::DOUBLE AS pred, e1 / (e1 + e2) AS f FROM dens WHERE t = 1
  UNION ALL SELECT code, t, pr, pr * e1 / greatest(pr * e1 + (1 - pr) * e2, 1e-300) FROM (
    SELECT d.code, d.t, d.e1, d.e2, fw.f * d.p11 + (1 - fw.f) * d.p21 AS pr FROM fw JOIN dens d ON d.code = fw.code AND d.t = fw.t + 1))"""
SMOOTHED = REGIMES + """,
fws AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT code, t, f AS s FROM fws WHERE (code, t) IN (SELECT code, max(t) FROM fws GROUP BY code)
  UNION ALL SELECT code, t, a / greatest(a + b, 1e-300) FROM (
    SELECT c.code, c.t, c.f * (d.p11 * bw.s / n.pred + d.p12 * (1 - bw.s) / (1 - n.pred)) AS a, (1 - c.f) * (d.p21 * bw.s / n.pred + d.p22 * (1 - bw.s) / (1 - n.pred)) AS b
    FROM bw JOIN fws n ON n.code = bw.code AND n.t = bw.t JOIN fws c ON c.code = bw.code AND c.t = bw.t - 1 JOIN dens d ON d.code = bw.code AND d.t = 1))"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def s6(x: str, n: int = 6) -> str:
    return f"round(({x})::DOUBLE, {n}) + 0.0"


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "
