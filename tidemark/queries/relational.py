"""Joins, windows, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fitted, joins, windows
from tidemark.operators.sizes import small
from tidemark.queries import fixtures as fx
from tidemark.queries.fixtures import r6, s6, with_
from tidemark.registry import Registry

reg = Registry()
Q = reg.query

BY_CODE = "WINDOW w AS (PARTITION BY code ORDER BY month_end)"


def _two(spark, sf):
    m = fx.monthly(spark, sf)
    a = m.filter("code = '1-URGENT' AND month_end < DATE '2000-01-01'").select("month_end", F.col("value").alias("a"))
    b = m.filter("code = '2-HIGH' AND month_end > DATE '1997-01-01'").select("month_end", F.col("value").alias("b"))
    return a, b


_TWO = "a AS (SELECT month_end, value AS a FROM monthly WHERE code = '1-URGENT' AND month_end < DATE '2000-01-01'), b AS (SELECT month_end, value AS b FROM monthly WHERE code = '2-HIGH' AND month_end > DATE '1997-01-01')"


def _join(name, how, sql):
    def f(spark, sf):
        a, b = _two(spark, sf)
        return a.join(b, "month_end", how).select("month_end", r6("a", 2).alias("a"), r6("b", 2).alias("b"))

    f.__name__ = name
    return Q(with_(fx.MONTHLY, _TWO) + f"SELECT month_end, {s6('a', 2)} AS a, {s6('b', 2)} AS b FROM a {sql} JOIN b USING (month_end)")(f)


_join("join_outer_date", "full", "FULL")
_join("join_inner_date", "inner", "")
_join("join_left_reindex", "left", "LEFT")

_GRID = "grid AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS t FROM (SELECT DISTINCT user_id FROM events))"


@Q(with_(_GRID, "clicks AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click')") + f"SELECT g.user_id, g.t::DATE AS day, {s6('arg_max(c.value, {t: c.ts, e: c.event_id})', 4)} AS value FROM grid g LEFT JOIN clicks c ON c.user_id = g.user_id AND c.ts <= g.t GROUP BY ALL")
def asof_backward(spark, sf):
    """For every user and day, the latest click known at midnight."""
    e = fx.table(spark, sf, "events")
    days = F.expr("explode(sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-30 00:00:00', INTERVAL 1 DAY))")
    grid = e.select("user_id").distinct().select("user_id", days.alias("t"))
    out = joins.asof_backward(grid, e.filter("event_type = 'click'"), by=["user_id"], t="t", ts="ts", value="value", tie="event_id")
    return out.select("user_id", F.col("t").cast("date").alias("day"), r6("value", 4).alias("value"))


@Q(with_(fx.MONTHLY, "k AS (SELECT month_end, month_end + 60 AS knowable_at FROM monthly WHERE code = '1-URGENT')") + "SELECT k.month_end, k.knowable_at, min(m.month_end) AS entry FROM k JOIN (SELECT DISTINCT month_end FROM monthly) m ON m.month_end >= k.knowable_at GROUP BY ALL")
def asof_forward(spark, sf):
    m = fx.monthly(spark, sf)
    rows = m.filter("code = '1-URGENT'").select("month_end", F.date_add("month_end", 60).alias("knowable_at"))
    return joins.asof_forward(rows, m.select("month_end").distinct(), known="knowable_at", day="month_end")


@Q("SELECT q::DATE AS survey_quarter, coalesce(d::DATE, q::DATE + 45) AS knowable_at FROM (VALUES ('1990-01-01', '1990-02-24'), ('1990-04-01', NULL), ('1990-07-01', '1990-08-23')) v(q, d)")
def knowable_date(spark, sf):
    q = spark.createDataFrame([("1990-01-01",), ("1990-04-01",), ("1990-07-01",)], "q string").select(F.col("q").cast("date").alias("survey_quarter"))
    rel = spark.createDataFrame([("1990-01-01", "1990-02-24"), ("1990-07-01", "1990-08-23")], "q string, d string").select(
        F.col("q").cast("date").alias("survey_quarter"), F.col("d").cast("date").alias("release_date")
    )
    return joins.knowable_date(q, rel, "survey_quarter", "release_date", 45).select("survey_quarter", "knowable_at")


@Q(with_(fx.MONTHLY, fx.LABELS) + "SELECT month_end, y FROM labels")
def interval_label(spark, sf):
    return fx.labels(spark, sf)


@Q(with_(fx.MONTHLY, fx.SPAN, "seen AS (SELECT peak, CASE WHEN trough_announced <= DATE '2001-08-31' THEN trough END AS trough FROM spans WHERE peak_announced <= DATE '2001-08-31')") + "SELECT month_end, max((peak IS NOT NULL)::INT)::INT AS y FROM (SELECT DISTINCT month_end FROM monthly WHERE month_end <= DATE '2001-08-31') LEFT JOIN seen ON month_end >= peak AND month_end <= coalesce(trough, DATE '2001-08-31') GROUP BY month_end HAVING month_end <= (SELECT last_day(max(coalesce(trough, DATE '2001-08-31'))) FROM seen)")
def interval_label_asof(spark, sf):
    months = fx.months(spark, sf)
    return joins.interval_label_asof(months, fx.spans(spark), F.lit("2001-08-31").cast("date"))


@Q(with_(fx.MONTHLY, fx.SPAN) + f"SELECT peak, CASE WHEN month_end < peak THEN 'before' WHEN month_end > trough THEN 'after' ELSE 'during' END AS phase, count(*) AS n, {s6('avg(value)')} AS mean FROM monthly JOIN spans ON month_end >= peak - INTERVAL 6 MONTH AND month_end <= last_day(trough + INTERVAL 6 MONTH) GROUP BY ALL")
def window_around_event(spark, sf):
    near = joins.window_around_event(fx.monthly(spark, sf), fx.spans(spark))
    return near.groupBy("peak", "phase").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@Q(with_(fx.MONTHLY) + "SELECT DISTINCT month_end AS as_of FROM monthly WHERE month_end NOT IN (SELECT month_end FROM monthly WHERE code = '5-LOW' AND month_end < DATE '2000-01-01')")
def anti_resume(spark, sf):
    m = fx.monthly(spark, sf).withColumnRenamed("month_end", "as_of")
    done = m.filter("code = '5-LOW' AND as_of < DATE '2000-01-01'")
    return joins.anti_resume(m.select("as_of").distinct(), done, "as_of")


@Q(with_(fx.OBS) + f"SELECT code, obs_date, tie, {s6('value', 2)} AS value FROM obs QUALIFY row_number() OVER (PARTITION BY code, obs_date ORDER BY tie DESC) = 1")
def dedup_keep_last(spark, sf):
    return joins.dedup_keep_last(fx.obs(spark, sf), ["code", "obs_date"], ["tie"]).select("code", "obs_date", "tie", r6("value", 2).alias("value"))


@Q(f"SELECT signal, h AS horizon FROM (VALUES {', '.join(repr((s,)).replace(',)', ')') for s in fx.SIGNALS.values())}) a(signal), (VALUES (0), (3), (6), (9), (12), (18)) b(h)")
def cross_grid(spark, sf):
    s = spark.createDataFrame([(x,) for x in fx.SIGNALS.values()], "signal string")
    h = spark.createDataFrame([(x,) for x in (0, 3, 6, 9, 12, 18)], "horizon int")
    return s.crossJoin(small(h))


@Q(with_(fx.SPAN) + "SELECT peak, trough FROM spans WHERE peak <= DATE '1999-01-01' AND trough >= DATE '1998-03-01'")
def span_overlap(spark, sf):
    d = lambda x: F.lit(x).cast("date")
    return joins.span_overlap(fx.spans(spark), d("1998-03-01"), d("1999-01-01")).select("peak", "trough")


@Q(with_(fx.SPAN) + "SELECT last_day(max(trough)) AS cutoff FROM spans")
def label_cutoff(spark, sf):
    return fx.spans(spark).agg(F.last_day(F.max("trough")).alias("cutoff"))


_SAHM = """ma AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY code ORDER BY month_end ROWS 2 PRECEDING) >= 2 THEN avg(value) OVER (PARTITION BY code ORDER BY month_end ROWS 2 PRECEDING) END AS ma3 FROM monthly),
sahm AS (SELECT *, ma3 - CASE WHEN count(ma3) OVER (PARTITION BY code ORDER BY month_end ROWS 11 PRECEDING) >= 6 THEN min(ma3) OVER (PARTITION BY code ORDER BY month_end ROWS 11 PRECEDING) END AS sahm FROM ma)"""


@Q(with_(fx.MONTHLY, _SAHM) + f"SELECT code, month_end, {s6('ma3', 4)} AS ma3 FROM sahm")
def rolling_mean_min_periods(spark, sf):
    return fx.monthly(spark, sf).select("code", "month_end", r6(windows.rolling_mean("value", 3, 2), 4).alias("ma3"))


@Q(with_(fx.MONTHLY, _SAHM) + f"SELECT code, month_end, {s6('sahm', 4)} AS sahm FROM sahm")
def sahm_indicator(spark, sf):
    return windows.sahm_indicator(fx.monthly(spark, sf)).select("code", "month_end", r6("sahm", 4).alias("sahm"))


@Q(with_(fx.MONTHLY, _SAHM) + "SELECT code, month_end, coalesce((sahm >= 100000)::INT, 0) AS signal FROM sahm")
def sahm_signal(spark, sf):
    s = windows.sahm_indicator(fx.monthly(spark, sf))
    return s.select("code", "month_end", F.coalesce((F.col("sahm") >= 100000).cast("int"), F.lit(0)).alias("signal"))


@Q(with_(fx.PANEL, fx.LABELS, fx.SIGNAL) + "SELECT * FROM (SELECT signal, month_end, lead(y, 3) OVER (PARTITION BY signal ORDER BY month_end) AS target FROM scored) WHERE target IS NOT NULL")
def lead_label(spark, sf):
    w = Window.partitionBy("signal").orderBy("month_end")
    return fx.scored(spark, sf).select("signal", "month_end", windows.lead_label("y", 3, w).alias("target")).filter("target IS NOT NULL")


@Q(with_(fx.PANEL) + f"SELECT code, month_end, {s6('x - lag(x, 1) OVER w')} AS d1, {s6('x - lag(x, 3) OVER w')} AS d3, {s6('x - lag(x, 6) OVER w')} AS d6 FROM xs {BY_CODE}")
def delta_h(spark, sf):
    p = fx.panel(spark, sf)
    return p.select("code", "month_end", *[r6(windows.delta("x", h)).alias(f"d{h}") for h in (1, 3, 6)])


_UP = "up AS (SELECT code, month_end, (value > avg(value) OVER (PARTITION BY code))::INT AS y FROM monthly), flag AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND y IS NOT DISTINCT FROM lag(y) OVER w THEN 0 ELSE 1 END AS c FROM up " + BY_CODE + "), runs AS (SELECT code, month_end, y, sum(c) OVER w AS run FROM flag " + BY_CODE + ")"


def _up(spark, sf):
    m = fx.monthly(spark, sf)
    return m.select("code", "month_end", (F.col("value") > F.avg("value").over(Window.partitionBy("code"))).cast("int").alias("y"))


@Q(with_(fx.MONTHLY, _UP) + "SELECT code, month_end, y, run::BIGINT AS run FROM runs")
def label_runs(spark, sf):
    return windows.label_runs(_up(spark, sf), "y", "month_end", ["code"]).select("code", "month_end", "y", F.col("run").cast("bigint").alias("run"))


@Q(with_(fx.MONTHLY, _UP) + "SELECT code, month_end, y, row_number() OVER (PARTITION BY code, run ORDER BY month_end) AS age FROM runs")
def regime_age(spark, sf):
    return windows.regime_age(_up(spark, sf), "y", "month_end", ["code"]).select("code", "month_end", "y", F.col("age").cast("bigint").alias("age"))


@Q(with_(fx.MONTHLY, _UP) + "SELECT code, month_end, coalesce((y = 1 AND lag(y, 1, 0) OVER w = 0)::INT, 0) AS onset FROM up " + BY_CODE)
def onset_flag(spark, sf):
    w = Window.partitionBy("code").orderBy("month_end")
    return _up(spark, sf).select("code", "month_end", F.coalesce(windows.onset_flag("y", w), F.lit(0)).alias("onset"))


@Q(with_(fx.MONTHLY, fx.RETURNS) + f"SELECT asset, month_end, {s6('exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY month_end ROWS UNBOUNDED PRECEDING))')} AS equity FROM returns")
def cumprod_equity(spark, sf):
    w = Window.partitionBy("asset").orderBy("month_end")
    return fx.returns(spark, sf).select("asset", "month_end", r6(windows.cumprod("r", w)).alias("equity"))


@Q(with_(fx.MONTHLY) + f"SELECT code, {s6('min((value - top) / top)')} AS max_drawdown FROM (SELECT *, max(value) OVER (PARTITION BY code ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS top FROM monthly) GROUP BY code")
def cummax_drawdown(spark, sf):
    w = Window.partitionBy("code").orderBy("month_end")
    return fx.monthly(spark, sf).withColumn("dd", windows.drawdown("value", w)).groupBy("code").agg(r6(F.min("dd")).alias("max_drawdown"))


_PORT = """moved AS (SELECT *, lag(w) OVER (PARTITION BY asset ORDER BY month_end) AS before FROM weights),
port AS (SELECT month_end, coalesce(sum(before * r), 0) AS gross, coalesce(sum(abs(w - before)), 0) AS turnover FROM moved GROUP BY month_end)"""


@Q(with_(fx.MONTHLY, fx.RETURNS, _PORT) + f"SELECT month_end, {s6('gross')} AS gross, {s6('turnover * 0.001')} AS cost, {s6('gross - turnover * 0.001')} AS net FROM port")
def lagged_weight_return(spark, sf):
    out = windows.lagged_weight_return(fx.weights(spark, sf))
    return out.select("month_end", r6("gross").alias("gross"), r6("cost").alias("cost"), r6("net").alias("net"))


@Q(with_(fx.PANEL, fx.LABELS, fx.SIGNAL, "k AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY month_end) - 1 AS rn, count(*) OVER (PARTITION BY signal) AS n FROM scored)") + "SELECT a.signal, a.month_end, shift, b.y AS y_shifted FROM k a CROSS JOIN (VALUES (7), (20), (41)) s(shift) JOIN k b ON a.signal = b.signal AND b.rn = (a.rn + shift) % a.n")
def circular_shift(spark, sf):
    shifts = spark.createDataFrame([(7,), (20,), (41,)], "shift int")
    out = windows.circular_shift(fx.scored(spark, sf), shifts, "y", "month_end", ["signal"])
    return out.select("signal", "month_end", "shift", "y_shifted")


@Q("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS r FROM lineitem")
def rank_ties(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", windows.average_rank("l_quantity", ["l_returnflag"]).alias("r"))


@Q(with_(fx.MONTHLY) + f"SELECT code, month_end, {s6('value', 2)} AS value FROM monthly WHERE value IS NOT NULL ORDER BY month_end, code")
def sort_time(spark, sf):
    return fx.monthly(spark, sf).filter("value IS NOT NULL").orderBy("month_end", "code").select("code", "month_end", r6("value", 2).alias("value"))


@Q(with_(fx.OBS) + "SELECT code, obs_date, tie FROM obs QUALIFY row_number() OVER (PARTITION BY code ORDER BY obs_date DESC, tie DESC) <= 3")
def topn_recent(spark, sf):
    w = Window.partitionBy("code").orderBy(F.desc("obs_date"), F.desc("tie"))
    return fx.obs(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("code", "obs_date", "tie")


@Q(fx.recursive(fx.REGIMES) + "SELECT d.code, month_end, CASE WHEN f >= 0.5 THEN 1 ELSE 2 END::INT AS regime_rank FROM fw JOIN dens d ON d.code = fw.code AND d.t = fw.t WHERE (d.code, d.t) IN (SELECT code, max(t) FROM rx GROUP BY code)")
def argmax_regime(spark, sf):
    """The most probable regime at every series' last month."""
    return fitted.likeliest_regime(fx.regime_paths(spark, sf))


@Q(with_(fx.REGIMES.split(",\nfw AS")[0]) + f"SELECT code, regime, {s6('mean')} AS mean, regime_rank FROM ranked")
def rank_regimes(spark, sf):
    """Two regimes of every series, ranked by their means."""
    return fx.ranked_regimes(spark, sf).select("code", "regime", r6("mean").alias("mean"), "regime_rank")


@Q(with_(fx.FACTORS) + f"SELECT factor, {s6('quantile_cont(abs(l), 0.9)')} AS q90 FROM loadings GROUP BY factor")
def quantile90_loading(spark, sf):
    return fitted.loading_quantile(fx.components(spark, sf)[0]).select("factor", r6("q90").alias("q90"))


@Q(with_(fx.MONTHLY, _TWO) + f"SELECT month_end, {s6('abs(a - b)', 2)} AS diff FROM a JOIN b USING (month_end) WHERE abs(a - b) > 1e-8 ORDER BY abs(a - b) DESC, month_end LIMIT 10")
def top_offenders(spark, sf):
    a, b = _two(spark, sf)
    d = F.abs(F.col("a") - F.col("b"))
    return a.join(b, "month_end").select("month_end", d.alias("d")).filter("d > 1e-8").orderBy(F.desc("d"), "month_end").limit(10).select("month_end", r6("d", 2).alias("diff"))


_PRICES = "days AS (SELECT obs_date AS d, avg(value) AS price FROM obs GROUP BY ALL), entries AS (SELECT DISTINCT last_day(d) AS entry FROM days)"


@Q(with_(fx.OBS, _PRICES, "j AS (SELECT entry, d, price, ln(price / lag(price) OVER (PARTITION BY entry ORDER BY d)) AS lr, max(price) OVER (PARTITION BY entry ORDER BY d ROWS UNBOUNDED PRECEDING) AS top, first_value(price) OVER (PARTITION BY entry ORDER BY d) AS p0 FROM entries JOIN days ON d > entry AND d <= last_day(entry + INTERVAL 3 MONTH))") + f"SELECT entry, {s6('arg_max(price, d) / min(p0) - 1')} AS fwd_return, {s6('CASE WHEN count(lr) > 5 THEN stddev_samp(lr) * sqrt(252) END')} AS fwd_vol, {s6('min((price - top) / top)')} AS fwd_drawdown FROM j GROUP BY entry")
def forward_window_targets(spark, sf):
    """Return, volatility and drawdown over three months from each month end."""
    days = fx.obs(spark, sf).groupBy(F.col("obs_date").alias("d")).agg(F.avg("value").alias("price"))
    entries = days.select(F.last_day("d").alias("entry")).distinct()
    # An equi-join on the months that a window covers, not a nested loop over all days.
    spread = entries.select("entry", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("entry", F.last_day(F.add_months("entry", F.col("k"))).alias("m"))
    w = Window.partitionBy("entry").orderBy("d")
    j = spread.join(days.withColumn("m", F.last_day("d")), "m").select(
        "entry",
        "d",
        "price",
        F.ln(F.col("price") / F.lag("price").over(w)).alias("lr"),
        windows.drawdown("price", w).alias("dd"),
        F.first("price").over(w).alias("p0"),
    )
    return j.groupBy("entry").agg(
        r6(F.max_by("price", "d") / F.min("p0") - 1).alias("fwd_return"),
        r6(F.when(F.count("lr") > 5, F.stddev_samp("lr") * F.sqrt(F.lit(252.0)))).alias("fwd_vol"),
        r6(F.min("dd")).alias("fwd_drawdown"),
    )
