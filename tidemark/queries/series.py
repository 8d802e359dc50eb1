"""Scans, resampling, alignment, transforms and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import align, joins, transforms
from tidemark.operators.sizes import small
from tidemark.queries import fixtures as fx
from tidemark.queries.fixtures import r6, s6, with_
from tidemark.registry import Registry
from tidemark.sources import series as src

reg = Registry()
Q = reg.query

_VINTAGES = """vintages AS (SELECT l_returnflag AS code, l_shipdate::DATE AS obs_date, l_shipdate::DATE + l_linenumber AS realtime_start,
  l_extendedprice AS value FROM lineitem)"""


def vintages(spark: SparkSession, sf: str) -> DataFrame:
    ship = F.col("l_shipdate").cast("date")
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("code"),
        ship.alias("obs_date"),
        F.date_add(ship, F.col("l_linenumber")).alias("realtime_start"),
        F.lit(None).cast("date").alias("realtime_end"),
        F.col("l_extendedprice").alias("value"),
    )


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('z')} AS z FROM panel WHERE value IS NOT NULL")
def flagship_panel(spark, sf):
    """Monthly panel, transformed and standardised without looking ahead."""
    return fx.panel(spark, sf).filter("value IS NOT NULL").select("code", "month_end", r6("z").alias("z"))


@Q(with_(fx.OBS) + f"SELECT code, obs_date, tie, {s6('value', 2)} AS value FROM obs WHERE code = '1-URGENT' AND obs_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def scan_series(spark, sf):
    rows = src.scan_series(fx.obs(spark, sf), "1-URGENT", "1997-01-01", "1998-12-31")
    return rows.select("code", "obs_date", "tie", r6("value", 2).alias("value"))


@Q(with_(_VINTAGES) + f"SELECT code, obs_date, {s6('arg_max(value, {d: realtime_start, v: value})', 2)} AS value FROM vintages WHERE realtime_start <= DATE '1998-06-30' GROUP BY ALL")
def scan_vintage(spark, sf):
    snap = joins.vintage_snapshot(vintages(spark, sf), F.lit("1998-06-30").cast("date"))
    return snap.select("code", "obs_date", r6("value", 2).alias("value"))


@Q(with_(fx.OBS) + "SELECT code, count(*) AS n, min(obs_date) AS lo, max(obs_date) AS hi FROM obs WHERE obs_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' GROUP BY code")
def slice_dates(spark, sf):
    rows = fx.obs(spark, sf).filter(F.col("obs_date").between(F.lit("1996-03-01").cast("date"), F.lit("1996-03-31").cast("date")))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"))


@Q(
    "SELECT code, vintage, CASE WHEN vintage IS NULL THEN age >= 1 ELSE FALSE END AS stale FROM "
    "(VALUES ('A', NULL, 0.5), ('B', NULL, 1.0), ('C', '2020-01-01', 9.0), ('D', NULL, 30.0)) v(code, vintage, age)"
)
def cache_ttl(spark, sf):
    rows = spark.createDataFrame(
        [("A", None, 0.5), ("B", None, 1.0), ("C", "2020-01-01", 9.0), ("D", None, 30.0)], "code string, vintage string, age double"
    )
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    fetched = rows.withColumn("fetched_at", F.timestamp_seconds(F.unix_timestamp(now) - F.col("age") * 86400))
    return src.fresh(fetched, now, 1.0).select("code", "vintage", "stale")


@Q(with_(fx.OBS, fx.CAT) + "SELECT code, category, count(*) AS n, FALSE AS missing FROM obs JOIN catalogue USING (code) GROUP BY ALL UNION ALL SELECT 'ABSENT', 'none', 0, TRUE")
def scan_all(spark, sf):
    extra = spark.createDataFrame([("ABSENT", "daily", "none", "none", 1)], fx.catalogue(spark).schema)
    found, missing = src.scan_all(fx.obs(spark, sf), fx.catalogue(spark).union(extra))
    counted = found.groupBy("code", "category").agg(F.count("*").alias("n"))
    return counted.withColumn("missing", F.lit(False)).union(
        missing.select("code", "category", F.lit(0).cast("bigint"), F.lit(True))
    )


@Q("SELECT make_date(y, (q - 1) * 3 + 1, 1) AS survey_quarter, round(a / 100.0, 6)::DOUBLE AS recess1, round(b / 100.0, 6)::DOUBLE AS recess2 FROM (VALUES (1999, 1, 12.5, 20.0), (1999, 2, NULL, 31.25), (2001, 4, 82.5, 40.0)) v(y, q, a, b)")
def scan_xlsx_survey(spark, sf):
    rows = [(1999, 1, "12.5", "20.0"), (1999, 2, "#N/A", "31.25"), (2001, 4, "82.5", "40.0")]
    sheet = spark.createDataFrame(rows, "YEAR int, QUARTER int, RECESS1 string, RECESS2 string")
    sheet = sheet.withColumns({f"RECESS{i}": F.lit(None).cast("string") for i in (3, 4, 5)})
    return src.survey_rows(sheet).select("survey_quarter", r6("recess1").alias("recess1"), r6("recess2").alias("recess2"))


_CALENDAR = ["1990 Q1 2/1/90 2/24/90", "     Q2 5/1/90* 5/24/90*", "     Q3 8/1/90 8/23/90", "", "1991 Q1 2/4/91 2/16/91*", "     Q2 5/3/91 5/18/91", "* late release"]


@Q("SELECT q::DATE AS survey_quarter, d::DATE AS release_date FROM (VALUES ('1990-01-01', '1990-02-24'), ('1990-04-01', '1990-05-24'), ('1990-07-01', '1990-08-23'), ('1991-01-01', '1991-02-16'), ('1991-04-01', '1991-05-18')) v(q, d)")
def scan_release_dates(spark, sf):
    return src.release_dates(spark.createDataFrame(list(enumerate(_CALENDAR)), "n int, line string"))


_PUBLISHED = "pub AS (SELECT obs_date, max((value > 150000)::INT) AS v FROM obs WHERE code = '3-MEDIUM' AND obs_date >= DATE '1997-03-01' AND month(obs_date) % 2 = 1 GROUP BY ALL), pm AS (SELECT last_day(obs_date) AS month_end, arg_max(v, obs_date) AS v FROM pub GROUP BY ALL)"


@Q(with_(fx.MONTHLY, fx.LABELS, _PUBLISHED) + "SELECT month_end, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING), y)::INT AS y FROM labels LEFT JOIN pm USING (month_end)")
def scan_usrec(spark, sf):
    """A published indicator with gaps, carried over them; before its first value the table of turning points."""
    raw = fx.obs(spark, sf).filter("code = '3-MEDIUM' AND obs_date >= DATE '1997-03-01' AND month(obs_date) % 2 = 1")
    published = raw.groupBy("obs_date").agg(F.max((F.col("value") > 150000).cast("int")).alias("value"))
    return src.published_indicator(published, fx.monthly(spark, sf), fx.labels(spark, sf))


@Q("SELECT code, transform, lag_days FROM (VALUES ('A', 'none', 1), ('B', 'diff', 30)) v(code, transform, lag_days)")
def scan_yaml(spark, sf):
    text = "series:\n- {code: A, frequency: daily, publication_lag_days: 1}\n- {code: B, frequency: monthly, transform: diff, publication_lag_days: 30}\n"
    return src.catalogue_from_yaml(spark, text).select("code", "transform", "lag_days")


@Q(with_(fx.SPARSE, fx.SPINE, "month0 AS (SELECT code, last_day(obs_date) AS month_end, arg_max(value, {'d': obs_date, 't': tie}) AS value FROM obs GROUP BY ALL)") + f"SELECT s.code, s.month_end, {s6('value', 2)} AS value FROM spine s LEFT JOIN month0 USING (code, month_end)")
def resample_last(spark, sf):
    return align.resample(fx.sparse_obs(spark, sf), "last", tie="tie").select("code", "month_end", r6("value", 2).alias("value"))


@Q(with_(fx.SPARSE, fx.SPINE, "month0 AS (SELECT code, last_day(obs_date) AS month_end, avg(value) AS value FROM obs GROUP BY ALL)") + f"SELECT s.code, s.month_end, {s6('value', 6)} AS value FROM spine s LEFT JOIN month0 USING (code, month_end)")
def resample_mean(spark, sf):
    return align.resample(fx.sparse_obs(spark, sf), "mean").select("code", "month_end", r6("value", 6).alias("value"))


@Q(with_(fx.SPARSE, fx.SPINE, "month0 AS (SELECT code, last_day(obs_date) AS month_end, sum(value) AS value FROM obs GROUP BY ALL)") + f"SELECT s.code, s.month_end, {s6('coalesce(value, 0)', 4)} AS value FROM spine s LEFT JOIN month0 USING (code, month_end)")
def resample_sum(spark, sf):
    return align.resample(fx.sparse_obs(spark, sf), "sum").select("code", "month_end", r6("value", 4).alias("value"))


@Q(with_(fx.SPARSE, fx.SPINE) + "SELECT code, month_end FROM spine")
def gap_fill(spark, sf):
    return align.month_spine(fx.sparse_obs(spark, sf))


_QUARTERLY = "obs AS (SELECT l_returnflag AS code, date_trunc('quarter', l_shipdate)::DATE AS obs_date, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL)"


def _quarterly(spark, sf):
    return (
        fx.table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("code"), F.trunc("l_shipdate", "quarter").alias("obs_date"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    )


@Q(with_(_QUARTERLY, "placed AS (SELECT code, last_day(obs_date + INTERVAL 2 MONTH) AS obs_date, value FROM obs), ends AS (SELECT code, min(obs_date) AS lo, max(obs_date) AS hi FROM placed GROUP BY code), spine AS (SELECT code, last_day(d::DATE) AS month_end FROM (SELECT code, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM ends))") + f"SELECT s.code, s.month_end, {s6('value', 2)} AS value FROM spine s LEFT JOIN placed p ON s.code = p.code AND s.month_end = p.obs_date")
def quarterly_to_monthly(spark, sf):
    return align.quarterly_to_monthly(_quarterly(spark, sf)).select("code", "month_end", r6("value", 2).alias("value"))


@Q(with_(fx.SPARSE, "month0 AS (SELECT code, last_day(obs_date) AS month_end, arg_max(value, {'d': obs_date, 't': tie}) AS value FROM obs GROUP BY ALL), ends AS (SELECT min(month_end) AS lo, max(month_end) AS hi FROM month0), grid AS (SELECT c.code, last_day(d::DATE) AS month_end FROM (SELECT DISTINCT code FROM month0) c, (SELECT unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM ends))") + f"SELECT code, month_end, {s6('value', 2)} AS value FROM grid LEFT JOIN month0 USING (code, month_end)")
def align_panel(spark, sf):
    order = F.expr("max_by(value, struct(obs_date, tie))")
    months = fx.sparse_obs(spark, sf).groupBy("code", F.last_day("obs_date").alias("month_end")).agg(order.alias("value"))
    return align.align_panel(months).select("code", "month_end", r6("value", 2).alias("value"))


@Q(with_(fx.MONTHLY) + f"SELECT 'SPREAD' AS code, a.month_end, {s6('a.value - b.value', 2)} AS value FROM monthly a JOIN monthly b USING (month_end) WHERE a.code = '1-URGENT' AND b.code = '5-LOW'")
def derive_spread(spark, sf):
    return align.derive_spread(fx.monthly(spark, sf), "SPREAD", "1-URGENT", "5-LOW").select("code", "month_end", r6("value", 2).alias("value"))


@Q(with_(fx.OBS) + "SELECT DISTINCT obs_date, last_day(obs_date) AS month_end, last_day(date_trunc('quarter', obs_date)::DATE + INTERVAL 2 MONTH) AS quarter_end FROM obs")
def month_end_roll(spark, sf):
    d = F.col("obs_date")
    return fx.obs(spark, sf).select(d, align.month_end(d).alias("month_end"), align.quarter_end(d).alias("quarter_end")).distinct()


@Q(with_(fx.MONTHLY) + f"SELECT code, last_day(date_trunc('quarter', month_end)::DATE + INTERVAL 2 MONTH) AS quarter_end, {s6('avg(value)', 6)} AS value FROM monthly WHERE value IS NOT NULL GROUP BY ALL")
def quarter_mean(spark, sf):
    return align.quarter_mean(fx.monthly(spark, sf)).select("code", "quarter_end", r6("value", 6).alias("value"))


@Q(with_(fx.MONTHLY) + "SELECT last_day(d::DATE) AS as_of FROM (SELECT unnest(generate_series(date_trunc('month', min(month_end))::TIMESTAMP, date_trunc('month', max(month_end))::TIMESTAMP, INTERVAL 3 MONTH)) AS d FROM monthly)")
def eval_dates(spark, sf):
    return align.as_of_grid(fx.monthly(spark, sf), 3)


@Q(with_(fx.SPARSE, fx.SPINE, "month0 AS (SELECT code, last_day(obs_date) AS month_end, arg_max(value, {'d': obs_date, 't': tie}) AS value FROM obs GROUP BY ALL)") + f"SELECT s.code, s.month_end, {s6('last_value(value IGNORE NULLS) OVER (PARTITION BY s.code ORDER BY s.month_end ROWS UNBOUNDED PRECEDING)', 2)} AS value FROM spine s LEFT JOIN month0 m ON s.code = m.code AND s.month_end = m.month_end")
def forward_fill_regime(spark, sf):
    filled = align.forward_fill(align.resample(fx.sparse_obs(spark, sf), "last", tie="tie"))
    return filled.select("code", "month_end", r6("value", 2).alias("value"))


def _one(name: str, sql: str):
    def f(spark, sf):
        x = transforms.TRANSFORMS[name](F.col("value"), transforms.series())
        return fx.monthly(spark, sf).select("code", "month_end", r6(x).alias("x"))

    f.__name__ = name
    return Q(with_(fx.MONTHLY) + f"SELECT code, month_end, {s6(sql)} AS x FROM monthly WINDOW w AS (PARTITION BY code ORDER BY month_end)")(f)


log_diff = _one("log_diff", "ln(value / lag(value) OVER w)")
diff = _one("diff", "value - lag(value) OVER w")


@Q(with_(fx.SPARSE, fx.SPINE, "month0 AS (SELECT code, last_day(obs_date) AS month_end, arg_max(value, {'d': obs_date, 't': tie}) AS value FROM obs GROUP BY ALL), m AS (SELECT s.code, s.month_end, value FROM spine s LEFT JOIN month0 USING (code, month_end)), p AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY code ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, last_value(value IGNORE NULLS) OVER (PARTITION BY code ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m)") + f"SELECT code, month_end, {s6('(a - b) / b')} AS x FROM p")
def pct_change(spark, sf):
    monthly = align.resample(fx.sparse_obs(spark, sf), "last", tie="tie")
    return monthly.select("code", "month_end", r6(transforms.pct_change(F.col("value"))).alias("x"))


@Q(with_(fx.MONTHLY) + f"SELECT code, month_end, {s6('(value - avg(value) OVER w) / stddev_samp(value) OVER w')} AS z FROM monthly WINDOW w AS (PARTITION BY code)")
def standardize_full(spark, sf):
    return fx.monthly(spark, sf).select("code", "month_end", r6(transforms.standardize_full("value")).alias("z"))


@Q(with_(fx.PANEL) + f"SELECT code, month_end, transform, {s6('x')} AS x FROM panel")
def apply_transform(spark, sf):
    named = fx.monthly(spark, sf).join(small(fx.catalogue(spark)), "code")
    return transforms.apply_transform(named).select("code", "month_end", "transform", r6("x").alias("x"))


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('x')} AS x, {s6('z')} AS z FROM panel")
def apply_all_transforms(spark, sf):
    return fx.panel(spark, sf).select("code", "month_end", r6("x").alias("x"), r6("z").alias("z"))


@Q(with_(fx.SPARSE, "m AS (SELECT code, last_day(obs_date) AS month_end, max(value) AS x FROM obs GROUP BY ALL), k AS (SELECT *, count(x) OVER (PARTITION BY code) AS n FROM m)") + f"SELECT code, month_end, {s6('x', 2)} AS x FROM k WHERE n >= 12")
def min_obs_filter(spark, sf):
    m = fx.sparse_obs(spark, sf).groupBy("code", F.last_day("obs_date").alias("month_end")).agg(F.max("value").alias("x"))
    return transforms.min_obs_filter(m, "x", 12).select("code", "month_end", r6("x", 2).alias("x"))


_SPARSE_MONTHS = fx.SPARSE + ", " + fx.SPINE + ", month0 AS (SELECT code, last_day(obs_date) AS month_end, arg_max(value, {'d': obs_date, 't': tie}) AS value FROM obs GROUP BY ALL), m AS (SELECT s.code, s.month_end, value FROM spine s LEFT JOIN month0 USING (code, month_end))"


@Q(with_(_SPARSE_MONTHS) + f"SELECT code, month_end, {s6('value', 2)} AS value FROM (SELECT *, avg((value IS NULL)::INT) OVER (PARTITION BY code) AS gone FROM m) WHERE gone <= 0.8")
def sparse_column_drop(spark, sf):
    m = align.resample(fx.sparse_obs(spark, sf), "last", tie="tie")
    return transforms.sparse_column_drop(m, "value", 0.8).select("code", "month_end", r6("value", 2).alias("value"))


@Q(with_(_SPARSE_MONTHS) + f"SELECT code, month_end, {s6('coalesce(value, avg(value) OVER (PARTITION BY code))', 6)} AS value FROM m")
def mean_impute(spark, sf):
    m = align.resample(fx.sparse_obs(spark, sf), "last", tie="tie")
    return transforms.mean_impute(m).select("code", "month_end", r6("value", 6).alias("value"))


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('CASE WHEN month_end + lag_days <= DATE ' + chr(39) + '2000-06-30' + chr(39) + ' THEN z END')} AS z FROM panel")
def ragged_edge_mask(spark, sf):
    masked = transforms.ragged_edge_mask(fx.panel(spark, sf), fx.catalogue(spark), F.lit("2000-06-30").cast("date"), ["z"])
    return masked.select("code", "month_end", r6("z").alias("z"))


@Q(with_(fx.MONTHLY, fx.CAT) + "SELECT code, month_end, month_end + lag_days AS published FROM monthly JOIN catalogue USING (code)")
def publication_date(spark, sf):
    m = fx.monthly(spark, sf).join(small(fx.catalogue(spark)), "code")
    return m.select("code", "month_end", transforms.publication_date(F.col("month_end"), F.col("lag_days")).alias("published"))


@Q(with_(fx.MONTHLY) + f"SELECT code, {s6('min(value)', 2)} AS lo, {s6('max(value)', 2)} AS hi, min(value) >= 0 AND max(value) <= lim AS ok FROM monthly JOIN (VALUES ('1-URGENT', 1e9), ('5-LOW', 30.0)) v(code, lim) USING (code) GROUP BY code, lim")
def raw_level_guard(spark, sf):
    out = transforms.raw_level_guard(fx.monthly(spark, sf), {"1-URGENT": (0, 1e9), "5-LOW": (0, 30)})
    return out.select("code", r6("lo", 2).alias("lo"), r6("hi", 2).alias("hi"), "ok")


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('1 / (1 + exp((z + 0.7) / 0.3))')} AS p FROM panel")
def logistic_signal(spark, sf):
    p = transforms.logistic_signal(F.col("z"), -0.7, 0.3, -1)
    return fx.panel(spark, sf).select("code", "month_end", r6(p).alias("p"))


@Q(with_(fx.PANEL, fx.LABELS, fx.SIGNAL) + "SELECT signal, month_end, (p > 0.5)::INT AS pred FROM signals")
def threshold_label(spark, sf):
    return fx.signals(spark, sf).select("signal", "month_end", transforms.threshold_label(F.col("p")).alias("pred"))


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('CASE WHEN z IS NOT NULL THEN least(greatest(z, 0.001), 0.999) END')} AS p FROM panel")
def prob_clip(spark, sf):
    return fx.panel(spark, sf).select("code", "month_end", r6(transforms.prob_clip(F.col("z"))).alias("p"))


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('lag(x, 1) OVER w')} AS x_lag1, {s6('lag(x, 2) OVER w')} AS x_lag2, {s6('lag(x, 3) OVER w')} AS x_lag3, 1.0::DOUBLE AS intercept FROM xs WINDOW w AS (PARTITION BY code ORDER BY month_end)")
def lag_features(spark, sf):
    out = transforms.lag_features(fx.panel(spark, sf), "x", 3)
    return out.select("code", "month_end", *[r6(f"x_lag{k}").alias(f"x_lag{k}") for k in (1, 2, 3)], "intercept")


@Q("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS t FROM events")
def to_numeric_coerce(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", transforms.numeric_or_null(F.get_json_object("props", "$.k")).alias("k"), transforms.numeric_or_null(F.col("event_type")).alias("t"))


@Q(with_(fx.OBS) + "SELECT DISTINCT last_day(obs_date) AS month_end FROM obs WHERE code = '1-URGENT' INTERSECT SELECT DISTINCT last_day(obs_date) FROM obs WHERE code = '2-HIGH' AND obs_date > DATE '1999-01-01'")
def set_intersect_dates(spark, sf):
    o = fx.obs(spark, sf)
    a = o.filter("code = '1-URGENT'").select(F.last_day("obs_date").alias("month_end"))
    b = o.filter("code = '2-HIGH' AND obs_date > DATE '1999-01-01'").select(F.last_day("obs_date").alias("month_end"))
    return a.intersect(b)


@Q(with_(fx.OBS) + "SELECT last_day(obs_date) AS month_end FROM obs WHERE code = '1-URGENT' AND obs_date < DATE '1997-01-01' UNION SELECT last_day(obs_date) FROM obs WHERE code = '2-HIGH' AND obs_date > DATE '2000-01-01'")
def set_union_dates(spark, sf):
    o = fx.obs(spark, sf)
    a = o.filter("code = '1-URGENT' AND obs_date < DATE '1997-01-01'").select(F.last_day("obs_date").alias("month_end"))
    b = o.filter("code = '2-HIGH' AND obs_date > DATE '2000-01-01'").select(F.last_day("obs_date").alias("month_end"))
    return a.union(b).distinct()


@Q(with_(fx.OBS, fx.CAT) + "SELECT code FROM (SELECT code FROM catalogue UNION ALL SELECT 'ABSENT') EXCEPT SELECT code FROM obs")
def set_except_missing(spark, sf):
    wanted = fx.catalogue(spark).select("code").union(spark.createDataFrame([("ABSENT",)], "code string"))
    return wanted.exceptAll(fx.obs(spark, sf).select("code").distinct()).distinct()


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('z', 4)} AS z FROM panel WHERE z IS NOT NULL ORDER BY code, month_end")
def expanding_zscore(spark, sf):
    z = fx.panel(spark, sf).filter("z IS NOT NULL")
    return z.select("code", "month_end", r6("z", 4).alias("z"))


