"""Relational steps on the rows of fitted models: loadings, factor paths, regimes and their probabilities.

Rows come as tables - loadings (as_of, code, factor, loading), scores (as_of,
month_end, factor, score), regimes (code, regime, mean, ...), probabilities
(code, month_end, regime_rank, p) - so the steps spread over their groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Below this share of explained variance a factor is empty; below this quality its name has no evidence.
EMPTY, EVIDENCE = 0.01, 1.0


def factor_signs(loadings: DataFrame) -> DataFrame:
    """(as_of, factor, sign): +1 or -1, so that loadings sum to a non-negative number; near zero the largest decides."""
    total = F.sum("loading")
    largest = F.max_by("loading", F.abs("loading"))
    side = F.signum(F.when(F.abs(total) > 1e-8, total).otherwise(largest))
    return loadings.groupBy("as_of", "factor").agg(F.when(side < 0, -1.0).otherwise(1.0).alias("sign"))


def oriented(loadings: DataFrame) -> DataFrame:
    """The loadings under the sign convention."""
    return loadings.join(factor_signs(loadings), ["as_of", "factor"]).withColumn("loading", F.col("loading") * F.col("sign")).drop("sign")


def factor_strengths(scores: DataFrame, loadings: DataFrame) -> DataFrame:
    """(as_of, factor, strength, empty): each factor's share of var(score) times squared norm of its loadings."""
    spread = scores.groupBy("as_of", "factor").agg(F.var_pop("score").alias("v"))
    norm = loadings.groupBy("as_of", "factor").agg(F.sum(F.col("loading") * F.col("loading")).alias("n"))
    v = F.col("v") * F.col("n")
    share = v / F.greatest(F.sum(v).over(Window.partitionBy("as_of")), F.lit(1e-12))
    both = spread.join(norm, ["as_of", "factor"]).withColumn("strength", share)
    return both.select("as_of", "factor", "strength", (F.col("strength") < EMPTY).alias("empty"))


def loading_quantile(loadings: DataFrame, q: float = 0.9) -> DataFrame:
    """(as_of, factor, q90): the quantile of a factor's absolute loadings."""
    return loadings.groupBy("as_of", "factor").agg(F.percentile(F.abs("loading"), F.lit(q)).alias("q90"))


def regime_inputs(factors: DataFrame, wanted: list[str]) -> DataFrame:
    """The factors that a regime model is fitted on, from (as_of, factor, name, strength, quality).

    Those with a wanted name, without the empty ones unless all are, and of these
    without names that loadings do not bear out unless that holds for all.  Where
    no wanted name is there, all factors.  A missing strength or quality speaks
    against nothing.
    """
    every = Window.partitionBy("as_of")

    def unless_all(keep: str, ok) -> object:
        """``keep`` and ``ok``, or ``keep`` alone where that leaves nothing."""
        both = F.col(keep) & ok
        return F.when(F.max(both.cast("int")).over(every) == 1, both).otherwise(F.col(keep))

    named = factors.withColumn("_keep", F.col("name").isin(*wanted))
    full = named.withColumn("_keep", unless_all("_keep", F.coalesce(F.col("strength") >= EMPTY, F.lit(True))))
    sure = full.withColumn("_keep", unless_all("_keep", F.coalesce(F.col("quality") >= EVIDENCE, F.lit(True))))
    none = F.max(F.col("_keep").cast("int")).over(every) == 0
    return sure.withColumn("_keep", F.col("_keep") | none).filter("_keep").drop("_keep")


def split_regimes(rows: DataFrame, value: str) -> DataFrame:
    """(code, regime, mean, var, n, to_low, to_high): two regimes, below and above a series' median.

    The closed-form start of a switching model: moments of each side, with a floor
    under the variance, and counted moves with one of each kind added.
    """
    known = rows.filter(F.col(value).isNotNull()).select("code", "month_end", F.col(value).alias("x"))
    w = Window.partitionBy("code").orderBy("month_end")
    middle = F.percentile("x", F.lit(0.5)).over(Window.partitionBy("code"))
    side = known.withColumn("high", F.col("x") > middle).withColumn("next", F.lead("high").over(w))
    found = side.groupBy("code", "high").agg(
        F.avg("x").alias("mean"),
        F.greatest(F.var_pop("x"), F.lit(1e-4)).alias("var"),
        F.count("*").alias("n"),
        F.count_if(~F.col("next")).alias("low"),
        F.count_if(F.col("next")).alias("up"),
    )
    moves = F.col("low") + F.col("up") + 2
    return found.select(
        "code", F.when(F.col("high"), "above").otherwise("below").alias("regime"), "mean", "var", "n",
        ((F.col("low") + 1) / moves).alias("to_low"), ((F.col("up") + 1) / moves).alias("to_high"),
    )


def rank_regimes(regimes: DataFrame) -> DataFrame:
    """``regime_rank``: 1, 2, ... by ascending mean within a code, ties by name."""
    return regimes.withColumn("regime_rank", F.row_number().over(Window.partitionBy("code").orderBy("mean", "regime")))


def transition_rows(ranked: DataFrame) -> DataFrame:
    """(code, from_rank, to_rank, p) of two-regime models."""
    return ranked.select(
        "code", F.col("regime_rank").alias("from_rank"), F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("to_low").alias("p")), F.struct(F.lit(2).alias("k"), F.col("to_high").alias("p")))).alias("m")
    ).select("code", "from_rank", F.col("m.k").alias("to_rank"), F.col("m.p").alias("p"))


def transition_features(moves: DataFrame, months: DataFrame) -> DataFrame:
    """(code, stay, duration, enter): persistence of the first regime, its expected duration, P(first | last regime).

    The duration is at most ``months`` (code, n): a sample bears out no longer one.
    """
    last = F.max("from_rank").over(Window.partitionBy("code"))
    p = moves.withColumn("last", last).groupBy("code").agg(
        F.max(F.expr("CASE WHEN from_rank = 1 AND to_rank = 1 THEN p END")).alias("stay"),
        F.max(F.expr("CASE WHEN from_rank = last AND to_rank = 1 THEN p END")).alias("enter"),
    )
    holding = F.when(F.col("stay") < 1, F.least(1 / (1 - F.col("stay")), F.col("n").cast("double"))).otherwise(F.col("n").cast("double"))
    return p.join(months, "code").select("code", "stay", holding.alias("duration"), "enter")


def likeliest_regime(probabilities: DataFrame) -> DataFrame:
    """(code, month_end, regime_rank): the most probable regime at each code's last month; ties go to the lower one."""
    order = F.struct("month_end", "p", -F.col("regime_rank"))
    return probabilities.groupBy("code").agg(F.max("month_end").alias("month_end"), F.max_by("regime_rank", order).alias("regime_rank"))
