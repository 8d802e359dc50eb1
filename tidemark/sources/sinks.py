"""Sinks: vintages, feature panels, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_vintage(panel: DataFrame, path: str, vintage: str) -> None:
    """Write a wide panel (month_end, series...) long under its vintage; saving again replaces it."""
    codes = [c for c in panel.columns if c != "month_end"]
    long = panel.unpivot(["month_end"], codes, "code", "value").withColumn("vintage_date", F.lit(vintage))
    long.write.partitionBy("vintage_date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_vintage(spark: SparkSession, path: str, vintage: str, codes: list[str]) -> DataFrame:
    """A vintage as a wide panel; the partition filter prunes all other vintages."""
    rows = vintages(spark, path).filter(F.col("vintage_date") == vintage)
    return rows.groupBy("month_end").pivot("code", codes).agg(F.first("value"))


def vintages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("month_end date, code string, value double, vintage_date string").parquet(path)


def list_vintages(spark: SparkSession, path: str) -> DataFrame:
    return vintages(spark, path).select("vintage_date").distinct().orderBy("vintage_date")


def append_features(rows: DataFrame, path: str) -> DataFrame:
    """Write rows by as_of, skipping dates that are there already; returns the whole panel."""
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why) and "UNABLE_TO_INFER_SCHEMA" not in str(why):
            raise
        have = None
    if have is not None and "knowable_at" not in have.columns:
        have = None  # a panel of an older layout is written anew
    new = rows if have is None else rows.join(have.select("as_of").distinct(), "as_of", "left_anti")
    new.write.partitionBy("as_of").mode("overwrite" if have is None else "append").parquet(path)
    return spark.read.parquet(path)


def as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))
