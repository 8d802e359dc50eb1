"""Grouped-map stages over long panels.

Each group - an as-of date, a series, a fold or a draw - is independent, so a
stage spreads over as many executors as there are groups.  A group holds one
panel of months times series, which is small by nature.  Rows are sorted inside
each stage, so results do not hang on partitions.  Failed fits return a status,
not an exception.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sizes import small
from tidemark.kernels import bootstrap, regimes, regression, statespace


def one_group(panel: DataFrame) -> DataFrame:
    """A panel as one group whose as-of date is its last month."""
    last = panel.agg(F.max("month_end").alias("as_of"))
    return panel.crossJoin(F.broadcast(last))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over as many tasks as there are cores: groups are small in bytes but long to fit, and
    by their bytes adaptive execution would join them into one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def as_of_panels(panel: DataFrame, dates: DataFrame, catalogue: DataFrame, columns: list[str]) -> DataFrame:
    """For each as-of date the rows up to it, with what was not yet published as NULL."""
    joined = panel.join(small(catalogue.select("code", "lag_days")), "code", "left")
    rows = joined.crossJoin(small(dates.select("as_of"))).filter("month_end <= as_of")
    seen = F.date_add("month_end", F.coalesce("lag_days", F.lit(0))) <= F.col("as_of")
    return rows.withColumns({c: F.when(seen, F.col(c)) for c in columns}).drop("lag_days")


def _wide(pdf: pd.DataFrame, value: str) -> pd.DataFrame:
    w = pdf.pivot_table(index="month_end", columns="code", values=value, aggfunc="last", dropna=False)
    w = w.sort_index().sort_index(axis=1).dropna(how="all")
    return w.loc[:, w.isna().mean() <= 0.5] if len(w) else w


def _clean(x) -> list:
    return [None if v is None or not np.isfinite(v) else float(v) for v in np.ravel(x)]


def local_level(panel: DataFrame, value: str, q: float, r: float, p0: float = 10.0) -> DataFrame:
    """(code, month_end, filtered, smoothed, variance) of a local-level model for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_end")
        one = np.eye(1)
        f = statespace.kalman_filter(pdf[[value]].to_numpy(float), one, one, q * one, np.array([r]), p0=p0)
        s, _, _ = statespace.rts_smoother(f, one)
        return pd.DataFrame(
            {"code": pdf["code"], "month_end": pdf["month_end"], "filtered": f.mean[:, 0], "smoothed": s[:, 0], "variance": f.cov[:, 0, 0]}
        )

    schema = "code string, month_end date, filtered double, smoothed double, variance double"
    return panel.select("code", "month_end", value).groupBy("code").applyInPandas(run, schema)


def local_level_fold(panel: DataFrame, value: str, q: float, r: float, p0: float = 10.0) -> DataFrame:
    """The same filter's last state (code, state, variance) as a fold over an ordered array, without Python."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(float(p0)).alias("p"))

    def step(s: Column, y: Column) -> Column:
        p = s["p"] + q
        g = p / (p + r)
        seen = F.struct((s["x"] + g * (y["v"] - s["x"])).alias("x"), ((1 - g) * p).alias("p"))
        return F.when(y["v"].isNull(), F.struct(s["x"].alias("x"), p.alias("p"))).otherwise(seen)

    rows = F.array_sort(F.collect_list(F.struct("month_end", F.col(value).alias("v"))))
    folded = panel.groupBy("code").agg(F.aggregate(rows, start, step).alias("s"))
    return folded.select("code", F.col("s.x").alias("state"), F.col("s.p").alias("variance"))


def fit_factors(
    panels: DataFrame, value: str = "z", k: int = 2, max_iter: int = 60, quarterly: tuple[str, ...] = (),
    anchors: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Factors for each as-of date: (as_of, month_end, factor, filtered, smoothed, quality, status)."""
    names = {f"factor_{i + 1}": [] for i in range(k)} if anchors is None else anchors

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, as_of = _wide(pdf, value), pdf["as_of"].iloc[0]
        if len(w) < 12 or w.shape[1] < 2:
            return pd.DataFrame([(as_of, None, None, None, None, None, "too_few_rows")], columns=columns)
        q = [i for i, c in enumerate(w.columns) if c in quarterly]
        model, f, s = statespace.fit_factors(w.to_numpy(float), k, q, max_iter)
        found, quality = statespace.name_factors(model.loadings, list(w.columns), names)
        out = [
            pd.DataFrame(
                {"as_of": as_of, "month_end": w.index, "factor": found[j], "filtered": f[:, j], "smoothed": s[:, j],
                 "quality": float(quality[j]), "status": model.status}
            )
            for j in range(model.k)
        ]
        return pd.concat(out)[columns]

    columns = ["as_of", "month_end", "factor", "filtered", "smoothed", "quality", "status"]
    schema = "as_of date, month_end date, factor string, filtered double, smoothed double, quality double, status string"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def factor_loadings(panels: DataFrame, value: str = "z", k: int = 2, max_iter: int = 60) -> DataFrame:
    """(as_of, code, factor, loading, strength): the parameters that scoring needs later."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _wide(pdf, value)
        model, _, s = statespace.fit_factors(w.to_numpy(float), k, (), max_iter)
        share = statespace.factor_strength(s * model.scale_std, model.loadings)
        rows = [
            (pdf["as_of"].iloc[0], c, f"factor_{j + 1}", float(model.loadings[i, j]), float(share[j]))
            for i, c in enumerate(w.columns)
            for j in range(model.k)
        ]
        return pd.DataFrame(rows, columns=["as_of", "code", "factor", "loading", "strength"])

    schema = "as_of date, code string, factor string, loading double, strength double"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def pca(panels: DataFrame, value: str = "z", k: int = 2) -> DataFrame:
    """(as_of, kind, name, month_end, factor, value): principal components of the mean-filled, scaled panel.

    Rows of kind ``loading`` carry a code as their name, rows of kind ``score`` a
    month.  A component's sign is arbitrary: see :func:`tidemark.operators.fitted.oriented`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, as_of = _wide(pdf, value), pdf["as_of"].iloc[0]
        if len(w) < 2 or not w.shape[1]:
            return pd.DataFrame([], columns=columns)
        z = (w - w.mean()) / w.std(ddof=0).replace(0, 1.0)
        score, load = statespace.pca_init(z.to_numpy(float), k)
        rows = [(as_of, "loading", c, None, f"factor_{j + 1}", float(load[i, j])) for i, c in enumerate(w.columns) for j in range(load.shape[1])]
        rows += [(as_of, "score", None, m, f"factor_{j + 1}", float(score[i, j])) for i, m in enumerate(w.index) for j in range(load.shape[1])]
        return pd.DataFrame(rows, columns=columns)

    columns = ["as_of", "kind", "name", "month_end", "factor", "value"]
    schema = "as_of date, kind string, name string, month_end date, factor string, value double"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def loadings_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'loading'").select("as_of", F.col("name").alias("code"), "factor", F.col("value").alias("loading"))


def scores_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'score'").select("as_of", "month_end", "factor", F.col("value").alias("score"))


def named_factors(loadings: DataFrame, anchors: dict[str, list[str]]) -> DataFrame:
    """(as_of, factor, name, quality): names by anchors, and how well loadings bear them out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot(index="code", columns="factor", values="loading").sort_index().sort_index(axis=1)
        names, quality = statespace.name_factors(w.to_numpy(float), list(w.index), anchors)
        return pd.DataFrame({"as_of": pdf["as_of"].iloc[0], "factor": list(w.columns), "name": names, "quality": quality})

    return loadings.groupBy("as_of").applyInPandas(run, "as_of date, factor string, name string, quality double")


def regime_probabilities(rows: DataFrame, ranked: DataFrame, value: str) -> DataFrame:
    """(code, month_end, regime_rank, p, p_smoothed) of each code under its ranked regimes (mean, var, to_low, to_high)."""

    def run(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        own, model = own.dropna(subset=[value]).sort_values("month_end"), model.sort_values("regime_rank")
        if not len(own) or not len(model):
            return pd.DataFrame([], columns=columns)
        k = len(model)
        fitted = regimes.RegimeModel(
            model["mean"].to_numpy(float)[:, None], model["var"].to_numpy(float)[:, None, None], model[["to_low", "to_high"]].to_numpy(float)[:, :k], 0.0, 0, False
        )
        f, s = fitted.filter(own[value].to_numpy(float))
        out = [
            pd.DataFrame({"code": own["code"], "month_end": own["month_end"], "regime_rank": j + 1, "p": f[:, j], "p_smoothed": s[:, j]}) for j in range(k)
        ]
        return pd.concat(out)[columns]

    columns = ["code", "month_end", "regime_rank", "p", "p_smoothed"]
    schema = "code string, month_end date, regime_rank int, p double, p_smoothed double"
    left = rows.select("code", "month_end", value).groupBy("code")
    return left.cogroup(ranked.select("code", "regime_rank", "mean", "var", "to_low", "to_high").groupBy("code")).applyInPandas(run, schema)


def fitted_parameters(panels: DataFrame, value: str = "z", k: int = 2, max_iter: int = 200) -> DataFrame:
    """(as_of, model, part, i, j, name, value): every parameter of a factor model and of the regimes of its first factor.

    Matrices have a row for each entry; what belongs to a series carries its code.
    :func:`score_stored` needs nothing else.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, as_of = _wide(pdf, value), pdf["as_of"].iloc[0]
        model, f, _ = statespace.fit_factors(w.to_numpy(float), k, (), max_iter)
        found = regimes.fit_regimes(f[:, 0], 2)
        rows = []

        def add(kind: str, part: str, x, names=None) -> None:
            x = np.atleast_2d(np.asarray(x, float))
            x = x.T if names is not None and x.shape[0] == 1 else x
            for i in range(x.shape[0]):
                for j in range(x.shape[1]):
                    rows.append((as_of, kind, part, i, j, names[i] if names is not None else None, float(x[i, j])))

        codes = list(w.columns)
        for part in ("A", "Q", "rotation", "scale_mean", "scale_std"):
            add("factors", part, getattr(model, part))
        for part in ("C", "R", "mean", "std", "loadings"):
            add("factors", part, getattr(model, part), codes)
        add("factors", "loglik", model.loglik)
        add("regimes", "means", found.means)
        add("regimes", "covs", found.covs.reshape(len(found.covs), -1))
        add("regimes", "P", found.P)
        return pd.DataFrame(rows, columns=["as_of", "model", "part", "i", "j", "name", "value"])

    schema = "as_of date, model string, part string, i int, j int, name string, value double"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def score_stored(panels: DataFrame, parameters: DataFrame, value: str = "z") -> DataFrame:
    """(as_of, month_end, factor, score, p_first) of new rows under stored parameters.

    ``p_first`` is the filtered probability of the lowest regime, on rows of the
    first factor.  Codes that the model does not know are left out, those missing
    here are unobserved.
    """

    def run(own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(stored):
            return pd.DataFrame([], columns=columns)

        def part(kind: str, name: str) -> np.ndarray:
            x = stored[(stored["model"] == kind) & (stored["part"] == name)]
            return x.pivot(index="i", columns="j", values="value").to_numpy(float)

        C = stored[(stored["part"] == "C") & (stored["j"] == 0)].sort_values("i")
        w = own.pivot_table(index="month_end", columns="code", values=value, aggfunc="last", dropna=False).sort_index().reindex(columns=C["name"])
        w = w.dropna(how="all")
        k = len(part("factors", "rotation"))
        model = statespace.FactorModel(
            part("factors", "A"), part("factors", "C"), part("factors", "Q"), part("factors", "R")[:, 0], part("factors", "mean")[:, 0], part("factors", "std")[:, 0],
            part("factors", "rotation"), k, part("factors", "loadings"), part("factors", "scale_mean")[0], part("factors", "scale_std")[0], 0.0, 0, "stored",
        )
        score = model.transform(w.to_numpy(float))
        means = part("regimes", "means")
        found = regimes.RegimeModel(means, part("regimes", "covs").reshape(len(means), means.shape[1], -1), part("regimes", "P"), 0.0, 0, False)
        p, _ = found.filter(score[:, 0])
        out = [
            pd.DataFrame({"as_of": own["as_of"].iloc[0], "month_end": w.index, "factor": f"factor_{j + 1}", "score": score[:, j], "p_first": p[:, 0] if j == 0 else np.nan})
            for j in range(k)
        ]
        return pd.concat(out)[columns]

    columns = ["as_of", "month_end", "factor", "score", "p_first"]
    schema = "as_of date, month_end date, factor string, score double, p_first double"
    left = panels.select("as_of", "code", "month_end", value).groupBy("as_of")
    return left.cogroup(parameters.groupBy("as_of")).applyInPandas(run, schema)


def state_identity(panels: DataFrame, value: str = "z", k: int = 2, max_iter: int = 30) -> DataFrame:
    """(as_of, i, j, value): the cross-product of the state's loadings, the identity after identification."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, _, _ = statespace.fit_factors(_wide(pdf, value).to_numpy(float), k, (), max_iter)
        G = model.C[:, : model.k].T @ model.C[:, : model.k]
        rows = [(pdf["as_of"].iloc[0], i, j, float(G[i, j])) for i in range(model.k) for j in range(model.k)]
        return pd.DataFrame(rows, columns=["as_of", "i", "j", "value"])

    schema = "as_of date, i int, j int, value double"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def project_factors(panels: DataFrame, train_share: float = 0.7, value: str = "z", k: int = 2, max_iter: int = 30) -> DataFrame:
    """(as_of, month_end, factor, score): factors of all months under parameters fitted on the first ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _wide(pdf, value)
        model, _, _ = statespace.fit_factors(w.iloc[: int(len(w) * train_share)].to_numpy(float), k, (), max_iter)
        score = model.transform(w.to_numpy(float))
        out = [pd.DataFrame({"as_of": pdf["as_of"].iloc[0], "month_end": w.index, "factor": f"factor_{j + 1}", "score": score[:, j]}) for j in range(model.k)]
        return pd.concat(out)

    schema = "as_of date, month_end date, factor string, score double"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def panel_regimes(panels: DataFrame, value: str = "z", k: int = 2, multivariate: bool = True) -> DataFrame:
    """(as_of, month_end, regime_rank, p_filtered, p_smoothed) of a whole panel.

    ``multivariate`` models the columns jointly, scaled only where their standard
    deviation is further than 0.3 from 1; otherwise the first principal component is
    used, oriented to the panel's mean.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _wide(pdf, value).ffill().dropna()
        x = w.to_numpy(float)
        if multivariate and x.shape[1] > 1:
            sd = x.std(axis=0)
            x = x / np.where((np.abs(sd - 1) > 0.3) & (sd > 0), sd, 1.0)
        elif x.shape[1] > 1:
            score, _ = statespace.pca_init(x - x.mean(axis=0), 1)
            side = np.corrcoef(score[:, 0], x.mean(axis=1))[0, 1]
            x = score * (-1.0 if side < 0 else 1.0)
        f, s = regimes.fit_regimes(x, k).filter(x)
        out = [
            pd.DataFrame({"as_of": pdf["as_of"].iloc[0], "month_end": w.index, "regime_rank": j + 1, "p_filtered": f[:, j], "p_smoothed": s[:, j]})
            for j in range(k)
        ]
        return pd.concat(out)

    schema = "as_of date, month_end date, regime_rank int, p_filtered double, p_smoothed double"
    return panels.select("as_of", "code", "month_end", value).groupBy("as_of").applyInPandas(run, schema)


def check_label_order(labels: list[str]) -> list[str]:
    """Regimes are ranked by ascending mean, so ``recession`` comes first; the reverse order is an error."""
    low = [x.lower() for x in labels]
    if len(set(low)) != len(low) or "expansion" in low[:1] or "recession" in low[1:]:
        raise ValueError(f"labels must run from the lowest regime to the highest, not {labels}")
    return labels


def fit_regimes(rows: DataFrame, by: str, value: str, k: int = 2, restarts: int = 3) -> DataFrame:
    """(by, month_end, regime_rank, p_filtered, p_smoothed): regimes in ascending order of their mean, from 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values("month_end")
        if len(pdf) < 12:
            return pd.DataFrame([], columns=columns)
        x = pdf[value].to_numpy(float)
        model = regimes.fit_regimes((x - x.mean()) / (x.std() or 1.0), k, restarts=restarts)
        f, s = model.filter((x - x.mean()) / (x.std() or 1.0))
        out = [
            pd.DataFrame({by: pdf[by], "month_end": pdf["month_end"], "regime_rank": j + 1, "p_filtered": f[:, j], "p_smoothed": s[:, j]})
            for j in range(k)
        ]
        return pd.concat(out)[columns]

    columns = [by, "month_end", "regime_rank", "p_filtered", "p_smoothed"]
    kind = dict(rows.dtypes)[by]
    schema = f"`{by}` {kind}, month_end date, regime_rank int, p_filtered double, p_smoothed double"
    return rows.select(by, "month_end", value).groupBy(by).applyInPandas(run, schema)


def hamilton_fold(rows: DataFrame, value: str, means: tuple[float, float], sd: float, stay: float) -> DataFrame:
    """P(first regime) at the last month of each code under fixed parameters, as a fold without Python."""
    start = F.struct(F.lit(0.5).alias("a"))

    def step(s: Column, y: Column) -> Column:
        a = s["a"] * stay + (1 - s["a"]) * (1 - stay)
        e = [F.exp(-0.5 * F.pow((y["v"] - m) / sd, 2)) for m in means]
        new = a * e[0] / F.greatest(a * e[0] + (1 - a) * e[1], F.lit(1e-300))
        return F.struct(F.when(y["v"].isNull(), a).otherwise(new).alias("a"))

    ordered = F.array_sort(F.collect_list(F.struct("month_end", F.col(value).alias("v"))))
    return rows.groupBy("code").agg(F.aggregate(ordered, start, step)["a"].alias("p_first"))


def probit(rows: DataFrame, by: str, features: list[str], y: str, lam: float = 1.0) -> DataFrame:
    """(by, month_end, p, status): a penalised probit for each group, fitted on rows with a label, applied to all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_end")
        known = pdf[y].notna().to_numpy()
        X, t = pdf[features].to_numpy(float), pdf[y].to_numpy(float)
        model = regression.probit_fit(X[known], t[known], lam, names=features)
        return pd.DataFrame({by: pdf[by], "month_end": pdf["month_end"], "p": model.predict(X), "status": model.status})

    schema = f"`{by}` {dict(rows.dtypes)[by]}, month_end date, p double, status string"
    return rows.select(by, "month_end", *features, y).groupBy(by).applyInPandas(run, schema)


def probit_coefficients(rows: DataFrame, by: str, features: list[str], y: str, lam: float = 1.0) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values("month_end")
        model = regression.probit_fit(pdf[features].to_numpy(float), pdf[y].to_numpy(float), lam, names=features)
        return pd.DataFrame([(pdf[by].iloc[0], k, v) for k, v in model.coefficients().items()], columns=[by, "name", "beta"])

    schema = f"`{by}` {dict(rows.dtypes)[by]}, name string, beta double"
    return rows.select(by, "month_end", *features, y).groupBy(by).applyInPandas(run, schema)


def probit_cv(rows: DataFrame, by: str, features: list[str], y: str) -> DataFrame:
    """(by, lambda, log_loss) over the grid, by forward chaining."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y]).sort_values("month_end")
        found = regression.probit_cv(pdf[features].to_numpy(float), pdf[y].to_numpy(float))
        return pd.DataFrame([(pdf[by].iloc[0], a, None if np.isnan(b) else b) for a, b in found], columns=[by, "lambda", "log_loss"])

    schema = f"`{by}` {dict(rows.dtypes)[by]}, lambda double, log_loss double"
    return rows.select(by, "month_end", *features, y).groupBy(by).applyInPandas(run, schema)


def calibrated(rows: DataFrame, by: str, y: str, p: str, how: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[y, p]).sort_values("month_end")
        f = regression.calibrate(pdf[p], pdf[y], how)
        return pd.DataFrame({by: pdf[by], "month_end": pdf["month_end"], "p": f(pdf[p].to_numpy(float))})

    schema = f"`{by}` {dict(rows.dtypes)[by]}, month_end date, p double"
    return rows.select(by, "month_end", y, p).groupBy(by).applyInPandas(run, schema)


def bootstrap_metric(
    rows: DataFrame, by: str, scores: list[str], metric: str = "auc", draws: int = 2000, seed: int = 0, per_task: int = 100,
    observed: bool = False,
) -> DataFrame:
    """(by, draw, value): a metric, or the difference of two, on label runs drawn with replacement.

    Draws go out in groups of ``per_task``; a draw's generator is seeded by (seed, draw).
    Draws with one class are left out; rows with a missing score drop out after the draw,
    with ``observed`` before it, though runs are those of all rows.
    """
    f = bootstrap.METRICS[metric]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_end")
        y = pdf["y"].to_numpy(float)
        p = [pdf[s].to_numpy(float) for s in scores]
        blocks = bootstrap.runs(y)
        if observed:
            ok = ~np.any([np.isnan(q) for q in p], axis=0)
            blocks = [b[ok[b]] for b in blocks if ok[b].any()]
        out = []
        if not blocks:
            return pd.DataFrame(out, columns=[by, "draw", "value"])
        for draw in range(key[1] * per_task, min((key[1] + 1) * per_task, draws)):
            i = bootstrap.resample(blocks, seed, draw)
            keep = ~np.any([np.isnan(q[i]) for q in p], axis=0)
            v = [f(y[i][keep], q[i][keep]) for q in p]
            value = v[0] - v[1] if len(v) > 1 else v[0]
            if np.isfinite(value):
                out.append((key[0], draw, float(value)))
        return pd.DataFrame(out, columns=[by, "draw", "value"])

    tasks = rows.sparkSession.range(-(-draws // per_task)).select(F.col("id").cast("int").alias("task"))
    # A row for each task of draws: ``draws / per_task`` copies, 20 of them by default.
    dealt = spread(rows.select(by, "month_end", "y", *scores).crossJoin(F.broadcast(tasks)), by, "task")
    schema = f"`{by}` {dict(rows.dtypes)[by]}, draw int, value double"
    return dealt.groupBy(by, "task").applyInPandas(run, schema)


def null_ic(rows: DataFrame, by: str, x: str, y: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(by, observed, share): the correlation and the share of circular shifts of y that reach it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_end")
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        T = len(a)
        low, high = min(60, T // 4), T - min(60, T // 4)
        seen = bootstrap.ic(a, b)
        shifts = np.random.default_rng(seed).integers(low, max(high, low + 1), draws)
        null = np.array([bootstrap.ic(a, np.roll(b, -s)) for s in shifts])
        null = null[np.isfinite(null)]
        share = float((null >= seen).mean()) if len(null) and np.isfinite(seen) else None
        return pd.DataFrame([(pdf[by].iloc[0], None if np.isnan(seen) else seen, share)], columns=[by, "observed", "share"])

    schema = f"`{by}` {dict(rows.dtypes)[by]}, observed double, share double"
    return rows.select(by, "month_end", x, y).groupBy(by).applyInPandas(run, schema)


def cross_validated(rows: DataFrame, folds: DataFrame, features: list[str], y: str, model: str) -> DataFrame:
    """(fold, ic, r2) of ridge or boosted trees over a fold table (fold, rn, role)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[*features, y]).sort_values("rn")
        a, b = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        if len(a) < 10 or len(b) < 3:
            return pd.DataFrame([], columns=["fold", "ic", "r2"])
        X, t = a[features].to_numpy(float), a[y].to_numpy(float)
        if model == "ridge":
            n = len(X)
            inner = [(np.arange(0, n * i // 4), np.arange(n * i // 4 + 1, n * (i + 1) // 4)) for i in range(1, 4)]
            predict = regression.ridge_purged(X, t, [f for f in inner if len(f[0]) > 2 and len(f[1]) > 0])
        else:
            predict = regression.boost(X, t)
        p, truth = predict(b[features].to_numpy(float)), b[y].to_numpy(float)
        rest = ((truth - t.mean()) ** 2).sum()
        found = [int(pdf["fold"].iloc[0]), bootstrap.ic(p, truth), float(1 - ((truth - p) ** 2).sum() / rest) if rest > 0 else None]
        return pd.DataFrame([[found[0], *_clean([x if x is not None else np.nan for x in found[1:]])]], columns=["fold", "ic", "r2"])

    return rows.join(folds, "rn").groupBy("fold").applyInPandas(run, "fold int, ic double, r2 double")


def gdp(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """(point, lo, hi) for the last quarter from rows (quarter_end, features, y); the last one is held out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("quarter_end")
        known = pdf.iloc[:-1].dropna(subset=[*features, y])
        now = pdf[features].iloc[-1].fillna(0.0).to_numpy(float)
        out = regression.gdp_nowcast(known[features].to_numpy(float), known[y].to_numpy(float), now)
        return pd.DataFrame([(out["point"], out["lo"], out["hi"])], columns=["point", "lo", "hi"])

    # One regression over quarters: one group by nature.
    return rows.groupBy(F.lit(1).alias("g")).applyInPandas(lambda pdf: run(pdf), "point double, lo double, hi double")
