"""Plans: invariance under appended data and partitions, edge cases, streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import align, fitted, joins, metrics, transforms, windows
from tidemark.plans import models, nowcast
from tidemark.queries import evaluation as qe
from tidemark.queries import fixtures as fx
from tidemark.queries import models as qm
from tidemark.sources import series as src
from tidemark.sources import sinks
from tidemark.streaming import online

SF = "/root/testdata/sf0.001"


def day(x):
    return dt.date.fromisoformat(x)


def panel_of(spark, values, code="A", start="2000-01-31"):
    ends = pd.date_range(start, periods=len(values), freq="ME").date
    return spark.createDataFrame([(code, d, v) for d, v in zip(ends, values, strict=True)], "code string, month_end date, value double")


def test_resample_gaps_and_nulls(spark):
    rows = [("A", day("2000-01-05"), 1.0), ("A", day("2000-01-20"), None), ("A", day("2000-03-02"), 3.0)]
    obs = spark.createDataFrame(rows, "code string, obs_date date, value double")
    last = {r["month_end"]: r["value"] for r in align.resample(obs).collect()}
    assert last == {day("2000-01-31"): 1.0, day("2000-02-29"): None, day("2000-03-31"): 3.0}
    total = {r["month_end"]: r["value"] for r in align.resample(obs, "sum").collect()}
    assert total[day("2000-02-29")] == 0.0
    assert align.resample(obs.limit(0)).count() == 0


def test_quarter_lands_on_its_end_or_its_stamp(spark):
    obs = spark.createDataFrame([("G", day("2000-01-01"), 1.0), ("G", day("2000-04-01"), 2.0)], "code string, obs_date date, value double")
    at = lambda c: sorted(r["month_end"] for r in align.quarterly_to_monthly(obs, c).filter("value is not null").collect())
    assert at(False) == [day("2000-03-31"), day("2000-06-30")] and at(True) == [day("2000-01-31"), day("2000-04-30")]


def test_zscore_is_prefix_invariant(spark):
    p = fx.monthly(spark, SF)
    full = p.withColumn("x", F.col("value")).withColumn("z", transforms.expanding_zscore())
    cut = p.filter("month_end <= DATE '1999-06-30'").withColumn("x", F.col("value")).withColumn("z0", transforms.expanding_zscore())
    gap = cut.join(full, ["code", "month_end"]).select(F.max(F.abs(F.col("z") - F.col("z0")))).first()[0]
    assert gap == 0.0


def test_unknown_transform_is_an_error(spark):
    p = panel_of(spark, [1.0, 2.0]).withColumn("transform", F.lit("cube"))
    with pytest.raises(Exception, match="unknown transform"):
        transforms.apply_transform(p).collect()


def test_sahm_counts_the_current_month(spark):
    s = windows.sahm_indicator(panel_of(spark, [4.0] * 11 + [4.3, 4.6, 5.2])).orderBy("month_end").collect()
    assert s[-1]["sahm"] == pytest.approx((4.3 + 4.6 + 5.2) / 3 - 4.0) and s[4]["sahm"] is None


def test_asof_joins(spark):
    grid = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    facts = spark.createDataFrame([("a", 1, 10.0), ("a", 3, None), ("a", 9, 7.0)], "k string, ts int, v double")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof_backward(grid, facts, by=["k"], t="t", ts="ts", value="v").collect()}
    assert got == {("a", 1): 10.0, ("a", 5): 10.0, ("b", 5): None}


def test_labels_as_of_do_not_know_the_future(spark):
    months = panel_of(spark, [0.0] * 60, start="1998-01-31").select("month_end")
    got = {r["month_end"]: r["y"] for r in joins.interval_label_asof(months, fx.spans(spark), F.lit("2001-08-31").cast("date")).collect()}
    assert got[day("2001-08-31")] == 1 and got[day("1998-08-31")] == 0 and max(got) == day("2001-08-31")


def test_business_days(spark):
    rows = [(day("2024-01-05"), day("2024-01-08")), (day("2024-01-06"), day("2024-01-07")), (day("2024-01-08"), day("2024-01-05"))]
    df = spark.createDataFrame(rows, "a date, b date")
    assert [r[0] for r in df.select(dates.business_days_between(F.col("a"), F.col("b"))).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(dates.business_day_floor(F.col("b"))).collect()] == [day("2024-01-08"), day("2024-01-05"), day("2024-01-05")]


def test_folds_do_not_touch(spark):
    rows = spark.range(120).select(F.col("id").alias("rn"))
    folds = metrics.purged_folds(rows, metrics.fold_edges(spark, 120, 5, 40), 3, 2).collect()
    for fold in range(5):
        test = [r["rn"] for r in folds if r["fold"] == fold and r["role"] == "test"]
        train = [r["rn"] for r in folds if r["fold"] == fold and r["role"] == "train"]
        assert test and max(train) + 3 < min(test)


def test_release_years_turn_at_69(spark):
    lines = spark.createDataFrame([(0, "1968 Q4 12/1/68"), (1, "1999 Q1 2/1/99*")], "n int, line string")
    got = [r["release_date"] for r in src.release_dates(lines).orderBy("survey_quarter").collect()]
    assert got == [day("2068-12-01"), day("1999-02-01")]


def test_features_resume_and_vintages_replace(spark, tmp_path):
    rows = panel_of(spark, [1.0, 2.0]).select(F.col("month_end").alias("as_of"), "value", F.lit(1).alias("knowable_at"))
    path = f"file://{tmp_path}/f"
    sinks.append_features(rows.limit(1), path)
    assert sinks.append_features(rows, path).count() == 2 and sinks.append_features(rows, path).count() == 2
    wide = panel_of(spark, [1.0, None]).select("month_end", F.col("value").alias("A"))
    for _ in range(2):
        sinks.save_vintage(wide, f"file://{tmp_path}/v", "2001-01-01")
    assert sinks.vintages(spark, f"file://{tmp_path}/v").count() == 2


def test_walk_forward_does_not_change_when_data_is_appended(spark):
    p, lags = qm.labelled(spark, SF).cache(), qm.lagged(spark, SF)
    at = spark.createDataFrame([(day("1999-12-31"),), (day("2000-06-30"),)], "as_of date")
    early = nowcast.nowcasts(p.filter("month_end <= DATE '2000-06-30'"), at, lags)
    late = nowcast.nowcasts(p.repartition(7), at, lags)
    got = nowcast.largest_difference(early, late, ["p_recession", "factor_1", "p_rsm"]).first()
    assert got["n"] == 2 and got["worst"] < 1e-8
    assert nowcast.failures(late).first()["over_budget"] is False


def test_walk_forward_has_every_month(spark):
    months = {r[0] for r in fx.monthly(spark, SF).filter("month_end >= DATE '1998-12-31'").select("month_end").distinct().collect()}
    got = [r["as_of"] for r in qm.walk_forward(spark, SF).select("as_of").collect()]
    assert sorted(got) == sorted(months)
    c = qm.backtest_expanding(spark, SF).first()
    assert c["tp"] + c["fp"] + c["fn"] + c["tn"] == len(months) // 3


def test_nowcasts_use_announced_labels_and_have_all_columns(spark):
    at = spark.createDataFrame([(day(d),) for d in ("1998-05-31", "1999-01-31", "1999-02-28", "2001-07-31")], "as_of date")
    months = fx.monthly(spark, SF).select("month_end").distinct()
    many = {(r["as_of"], r["month_end"], r["y"]) for r in joins.interval_labels_asof(months, fx.spans(spark), at).collect()}
    single = set()
    for (d,) in at.collect():
        single |= {(d, r["month_end"], r["y"]) for r in joins.interval_label_asof(months, fx.spans(spark), F.lit(d)).collect()}
    assert many == single and (day("1999-01-31"), day("1998-12-31"), 1) in many
    two = at.filter("as_of IN (DATE '1999-01-31', DATE '2001-07-31')")
    other = fx.spans(spark).withColumn("trough", F.when(F.year("trough") == 1998, F.lit("1998-11-01").cast("date")).otherwise(F.col("trough")))

    def run(spans):
        return nowcast.nowcasts(
            qm.panel(spark, SF), two, qm.lagged(spark, SF), spans=spans, signals=qm.published_signals(spark, SF), growth=qm.gdp_growth(spark, SF)
        ).orderBy("as_of").collect()

    a, b = run(fx.spans(spark)), run(other)
    # The trough of 1998 was announced in February 1999, so its month cannot matter in January, but does later.
    assert a[0] == b[0] and a[1]["p_probit"] != b[1]["p_probit"]
    for r in a:
        assert all(v is not None for v in r)
        parts = [r["p_rsm"], r["p_probit"], r["p_cfnai"], r["p_sahm"]]
        assert r["p_recession"] == pytest.approx((r["p_probit"] + r["p_cfnai"]) / 2)
        assert r["dispersion"] == pytest.approx(pd.Series(parts).std(ddof=0)) and r["gdp_ci_width"] >= 1.645
    assert {"factor_2_d6m", "p_recession_d3m", "gdp_nowcast"} <= set(a[0].asDict())
    p = {r["month_end"]: r["value"] for r in qm.published_signals(spark, SF).filter("code = 'sahm'").collect()}
    assert a[0]["p_sahm"] == p[day("1998-12-31")]


def test_bootstrap_does_not_hang_on_tasks(spark):
    rows = fx.scored(spark, SF).filter("signal = 'probit'")
    a = models.bootstrap_metric(rows, "signal", ["p"], draws=60, per_task=7).toPandas().sort_values("draw")["value"].tolist()
    b = models.bootstrap_metric(rows, "signal", ["p"], draws=60, per_task=60).toPandas().sort_values("draw")["value"].tolist()
    assert a == b


def test_horizons_have_intervals_and_2000_draws(spark):
    got = {(r["signal"], r["horizon"]): r for r in qe.horizon_intervals(spark, SF).collect()}
    assert set(got) == {(s, h) for s in fx.SIGNALS.values() for h in (0, 3, 6, 9, 12, 18)}
    for r in qe.horizon_curve(spark, SF).collect():
        assert round(got[r["signal"], r["horizon"]]["auc"], 6) == r["auc"]
    assert all(r["lo"] <= r["auc"] <= r["hi"] and 0 < r["n_positive"] < r["n_obs"] for r in got.values())
    assert 500 < qm.block_bootstrap_auc(spark, SF).first()["n"] <= 2000
    assert 500 < qm.paired_bootstrap(spark, SF).first()["n"] <= 2000


def test_stream_equals_batch(spark, tmp_path):
    p = panel_of(spark, [1.0, 2.0, None, 4.0, 3.0]).select("code", F.col("month_end").cast("timestamp").alias("published_at"), "value")
    p.repartition(1).write.parquet(f"{tmp_path}/in")
    q = online.local_level(online.read_observations(spark, f"{tmp_path}/in"), 1.0, 4.0)
    run = q.writeStream.format("memory").queryName("levels").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.table("levels").orderBy(F.desc("published_at")).first()
    fold = models.local_level_fold(panel_of(spark, [1.0, 2.0, None, 4.0, 3.0]), "value", 1.0, 4.0).first()
    assert last["state"] == pytest.approx(fold["state"]) and last["variance"] == pytest.approx(fold["variance"])
    counted = online.daily_means(online.read_observations(spark, f"{tmp_path}/in"), "7 days")
    run = counted.writeStream.format("memory").queryName("weeks").option("checkpointLocation", f"{tmp_path}/ck2").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("weeks").agg(F.sum("n")).first()[0] == 4


def test_clients_may_fail(tmp_path):
    from tidemark.functions.narrative import narrative

    def get(code):
        if code == "bad":
            raise TimeoutError("gone")
        return [(day("2000-01-01"), 1.0)]

    assert src.fetch(["a", "bad", "b"], get, 0.0) == [("a", day("2000-01-01"), 1.0), ("b", day("2000-01-01"), 1.0)]

    def read(url):
        if "x" in url:
            raise OSError("no")
        return b"1"

    assert src.download({"f": "http://a", "g": "http://x"}, str(tmp_path), read) == ["f"]
    assert narrative("p", "recession", 0.25) == "Regime recession with probability 25.0%. No narrative model is configured."
    assert narrative("p", "recession", 0.25, lambda prompt: prompt * 2) == "pp"


def test_label_order():
    assert models.check_label_order(["recession", "slow", "expansion"])
    with pytest.raises(ValueError):
        models.check_label_order(["expansion", "recession"])


def test_purge_and_embargo_on_both_sides(spark):
    rows = spark.range(60).select(F.col("id").alias("rn"))
    edges = metrics.fold_edges(spark, 60, 4, 12)
    base = metrics.folds(rows, edges, expanding=False)
    for horizon, held in ((0, 0), (3, 0), (0, 4), (2, 5)):
        got = {(r["fold"], r["rn"], r["role"]) for r in metrics.embargo(metrics.purge(base, horizon), held).collect()}
        want = set()
        for fold, lo, hi in edges.collect():
            for i in range(60):
                if lo <= i < hi:
                    want.add((fold, i, "test"))
                    continue
                meets = horizon > 0 and bool(set(range(i, i + horizon + 1)) & set(range(lo, hi + horizon)))
                if not meets and not hi <= i < hi + held:
                    want.add((fold, i, "train"))
        assert got == want


def test_forward_join_over_years_without_days(spark):
    rng = np.random.default_rng(5)
    day = lambda n: dt.date(1990, 1, 1) + dt.timedelta(days=int(n))
    days = sorted({day(n) for n in [*rng.integers(0, 900, 30), *rng.integers(2600, 4000, 20)]})
    asked = [(i, day(n)) for i, n in enumerate(rng.integers(-800, 4400, 200))]
    got = joins.asof_forward(
        spark.createDataFrame(asked, "i int, at date"), spark.createDataFrame([(d,) for d in days], "d date"), known="at", day="d"
    ).collect()
    want = {i: next((d for d in days if d >= a), None) for i, a in asked}
    assert {r["i"]: r["entry"] for r in got} == {i: d for i, d in want.items() if d}


def test_published_indicator_is_carried_and_falls_back(spark):
    d = dt.date
    obs = spark.createDataFrame([("u", d(2000, 3, 5), 1.0), ("u", d(2000, 3, 20), 0.0), ("u", d(2000, 5, 1), 1.0), ("u", d(2000, 6, 1), None)], "code string, obs_date date, value double")
    months = spark.createDataFrame([(d(2000, m, 28 + (m != 2) * 2 + (m in (1, 3, 5, 7))),) for m in range(1, 8)], "month_end date").select(F.last_day("month_end").alias("month_end"))
    table = months.withColumn("y", F.lit(1))
    got = [r["y"] for r in src.published_indicator(obs, months, table).orderBy("month_end").collect()]
    assert got == [1, 1, 0, 0, 1, 1, 1]
    assert {r["y"] for r in src.published_indicator(obs.limit(0), months, table).collect()} == {1}


def test_regime_inputs_fall_back(spark):
    def chosen(rows, wanted):
        df = spark.createDataFrame([(dt.date(2000, 1, 31), *r) for r in rows], "as_of date, factor string, name string, strength double, quality double")
        return sorted(r["factor"] for r in fitted.regime_inputs(df, wanted).collect())

    rows = [("f1", "a", 0.5, 1.2), ("f2", "b", 0.004, 1.5), ("f3", "c", 0.3, 0.5), ("f4", "d", None, None)]
    assert chosen(rows, ["a", "b", "c", "d"]) == ["f1", "f4"]
    assert chosen(rows, ["b"]) == ["f2"] and chosen(rows, ["c"]) == ["f3"] and chosen(rows, ["b", "c"]) == ["f3"]
    assert chosen(rows, ["none"]) == ["f1", "f2", "f3", "f4"]


def test_stored_model_scores_as_the_fitted_one(spark):
    from tidemark.kernels import statespace

    panels = models.one_group(qm.panel(spark, SF))
    stored = models.fitted_parameters(panels, k=2, max_iter=30)
    w = models._wide(panels.toPandas(), "z")
    model, _, _ = statespace.fit_factors(w.to_numpy(float), 2, (), 30)
    want = model.transform(w.to_numpy(float))
    got = {(r["month_end"], r["factor"]): r for r in models.score_stored(panels, stored).collect()}
    for i, month in enumerate(w.index):
        for j in range(2):
            assert abs(got[month, f"factor_{j + 1}"]["score"] - want[i, j]) < 1e-6
    assert all(0 <= r["p_first"] <= 1 for (_, f), r in got.items() if f == "factor_1")
    parts = {(r["model"], r["part"]) for r in stored.select("model", "part").distinct().collect()}
    assert {("factors", x) for x in ("A", "C", "Q", "R", "mean", "std", "rotation", "loadings")} | {("regimes", x) for x in ("means", "covs", "P")} <= parts
