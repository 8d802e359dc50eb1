"""Asset weights from regime probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizes import small


def blend(probs: DataFrame, weights: DataFrame) -> DataFrame:
    """(month_end, asset, weight) from (month_end, regime, p) and (regime, asset, w).

    Probabilities are normalised; regimes without weights add nothing; weights are
    normalised again.  A month whose weights sum to nothing is an error.
    """
    share = F.col("p") / F.sum("p").over(Window.partitionBy("month_end"))
    mixed = (
        probs.withColumn("share", share)
        .join(small(weights), "regime")
        .groupBy("month_end", "asset")
        .agg(F.sum(F.col("share") * F.col("w")).alias("raw"))
    )
    total = F.sum("raw").over(Window.partitionBy("month_end"))
    weight = F.when(total > 0, F.col("raw") / total).otherwise(F.raise_error(F.lit("weights sum to nothing")).cast("double"))
    return mixed.select("month_end", "asset", weight.alias("weight"))
