"""One nowcast for each as-of date, and the point-in-time feature panel built from them."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.kernels import regimes, regression, statespace
from tidemark.operators.joins import interval_labels_asof
from tidemark.operators.sizes import small
from tidemark.plans.models import _clean, _wide, as_of_panels, spread

DELTAS = (1, 3, 6)
SIGNALS = ("rsm", "probit", "cfnai", "sahm")
WEIGHTS = {"rsm": 0.0, "probit": 0.5, "cfnai": 0.5, "sahm": 0.0}


def schema(k: int) -> str:
    """Columns of a nowcast with ``k`` factors."""
    moving = ["p_recession", *[f"factor_{j + 1}" for j in range(k)]]
    deltas = [f"{c}_d{h}m" for c in moving for h in DELTAS]
    rest = [f"p_{s}" for s in SIGNALS] + ["dispersion", "persistence", "duration", "p_to_first", "gdp_nowcast", "gdp_ci_width"]
    numbers = ", ".join(f"{c} double" for c in moving + deltas + rest)
    return f"as_of date, state_month date, knowable_at date, status string, regime_age int, {numbers}"


def _deltas(name: str, x) -> dict:
    return {f"{name}_d{h}m": _clean([x[-1] - x[-1 - h]])[0] if len(x) > h else None for h in DELTAS}


def _gdp(f, months, growth: pd.DataFrame) -> dict:
    """Growth in the state's quarter from the factors, fitted on published quarters before it."""
    quarters = pd.PeriodIndex(pd.to_datetime(pd.Index(months)), freq="Q")
    mean = pd.DataFrame(f, index=quarters).groupby(level=0).mean()
    y = pd.Series(growth["value"].to_numpy(float), index=pd.PeriodIndex(pd.to_datetime(growth["month_end"]), freq="Q")).dropna()
    both = mean.index.intersection(y.index).sort_values()
    both = both[both < quarters[-1]]
    found = regression.gdp_nowcast(mean.loc[both].to_numpy(float), y.loc[both].to_numpy(float), f[-1])
    return {"gdp_nowcast": found["point"], "gdp_ci_width": found["hi"] - found["lo"]}


def _one(pdf: pd.DataFrame, k: int, max_iter: int, weights: dict[str, float], knowable_days: int) -> pd.DataFrame:
    as_of = pdf["as_of"].iloc[0]
    out = dict.fromkeys([c.split()[0] for c in schema(k).split(", ")])
    out |= {"as_of": as_of, "knowable_at": as_of + timedelta(days=knowable_days), "status": "too_few_rows"}
    kinds = {kind: pdf[pdf["kind"] == kind] for kind in ("z", "y", "signal", "gdp")}
    w = _wide(kinds["z"], "value")
    if len(w) >= 24 and w.shape[1] >= 2:
        model, f, _ = statespace.fit_factors(w.to_numpy(float), k, (), max_iter)
        out["status"] = model.status
        if model.status not in ("degenerate", "diverged"):
            out["state_month"] = w.index[-1]
            for j in range(f.shape[1]):
                out |= {f"factor_{j + 1}": _clean(f[-1, j])[0]} | _deltas(f"factor_{j + 1}", f[:, j])
            rsm = regimes.fit_regimes(f[:, 0], 2, max_iter=60)
            p, _ = rsm.filter(f[:, 0])
            state = p.argmax(axis=1)
            age = 1
            while age < len(state) and state[-1 - age] == state[-1]:
                age += 1
            stay, duration, first = regimes.transition_features(rsm.P, len(rsm.P) - 1, len(f))
            labels = kinds["y"].groupby("month_end")["value"].max().reindex(w.index)
            known = labels.notna().to_numpy()
            probit = regression.probit_fit(f[known], labels[known].to_numpy(float), 1.0)
            paths = {"rsm": p[:, 0], "probit": probit.predict(f) if probit.status == "ok" else np.full(len(f), 0.5)}
            signals = {s: float(x[-1]) for s, x in paths.items()}
            for s in ("cfnai", "sahm"):
                # The last published value counts; without any, the signal says 0.5.
                own = kinds["signal"][kinds["signal"]["code"] == s].dropna(subset=["value"]).set_index("month_end")["value"].sort_index()
                signals[s] = float(own.iloc[-1]) if len(own) else 0.5
                paths[s] = own.reindex(w.index).fillna(0.5).to_numpy(float)
            blend = np.clip(sum(weights.get(s, 0.0) * paths[s] for s in SIGNALS), 0, 1)
            out |= {f"p_{s}": v for s, v in signals.items()} | _deltas("p_recession", blend) | _gdp(f, w.index, kinds["gdp"])
            out |= {
                "dispersion": float(np.std(list(signals.values()))),
                "p_recession": float(np.clip(sum(weights.get(s, 0.0) * v for s, v in signals.items()), 0, 1)),
                "persistence": stay, "duration": duration, "p_to_first": first, "regime_age": age,
            }
    return pd.DataFrame([out])


def nowcasts(
    panel: DataFrame, dates: DataFrame, catalogue: DataFrame, *, spans: DataFrame | None = None, signals: DataFrame | None = None,
    growth: DataFrame | None = None, k: int = 2, max_iter: int = 40, weights: dict[str, float] | None = None, knowable_days: int = 60,
) -> DataFrame:
    """A row for each as-of date from (code, month_end, z, y); all dates are fitted independently, in parallel.

    The z-scores must be prefix-invariant: they are computed once and only masked by
    publication here.  With ``spans`` labels are those announced by the as-of date;
    else ``y`` holds the labels as they are known; NULL is unknown.  ``signals``
    (code, month_end, value, lag_days): probabilities named cfnai or sahm, of which the
    last published one counts, 0.5 without any.  ``growth`` (month_end, value, lag_days):
    GDP growth at quarter ends; under 20 published quarters the nowcast is the trend.
    """
    shares = weights or WEIGHTS
    rows = as_of_panels(panel, dates, catalogue, ["z"])
    if spans is None:
        labels = rows.groupBy("as_of", "month_end").agg(F.max("y").alias("y"))
    else:
        labels = interval_labels_asof(panel.select("month_end").distinct(), spans, dates)

    def part(df: DataFrame, kind: str, value: str, code: str | None = None) -> DataFrame:
        return df.select("as_of", F.lit(kind).alias("kind"), (F.col(code) if code else F.lit("")).alias("code"), "month_end", F.col(value).cast("double").alias("value"))

    def published(df: DataFrame) -> DataFrame:
        return df.crossJoin(small(dates.select("as_of"))).filter(F.date_add("month_end", F.col("lag_days")) <= F.col("as_of"))

    parts = part(rows, "z", "z", "code").union(part(labels, "y", "y"))
    if signals is not None:
        parts = parts.union(part(published(signals), "signal", "value", "code"))
    if growth is not None:
        parts = parts.union(part(published(growth), "gdp", "value"))
    return spread(parts, "as_of").groupBy("as_of").applyInPandas(lambda pdf: _one(pdf, k, max_iter, shares, knowable_days), schema(k))


def failures(panel: DataFrame, most: float = 0.05) -> DataFrame:
    """(n, failed, over_budget) of a feature panel."""
    bad = F.avg((~F.col("status").isin("converged", "max_iter")).cast("double"))
    return panel.agg(F.count("*").alias("n"), bad.alias("failed"), (bad > most).alias("over_budget"))


def largest_difference(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """(n, worst): the largest difference on the as-of dates that both panels have."""
    both = one.alias("a").join(two.alias("b"), "as_of")
    gap = [F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")), F.when(F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull(), 0.0).otherwise(1.0)) for c in columns]
    return both.agg(F.count("*").alias("n"), F.max(F.greatest(*gap) if len(gap) > 1 else gap[0]).alias("worst"))
