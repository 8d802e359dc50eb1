"""Streams over the table ``events``, run to the end of what has arrived, against the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries import fixtures as fx
from tidemark.queries.fixtures import r6, s6
from tidemark.registry import Registry
from tidemark.storage import fresh_path
from tidemark.streaming import online

reg = Registry()
Q = reg.query


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """(code, published_at, value): the mean value of every event type and day, known at the day's end."""
    e = fx.table(spark, sf, "events")
    day = F.date_add(F.col("ts").cast("date"), 1).cast("timestamp")
    return e.groupBy(F.col("event_type").alias("code"), day.alias("published_at")).agg(F.avg("value").alias("value"))


def drained(spark: SparkSession, rows: DataFrame, stage, mode: str) -> DataFrame:
    """What ``stage`` makes of ``rows`` as a stream of files, written batch by batch, after the last of them."""
    root = fresh_path(spark, "stream")
    rows.write.parquet(f"{root}/in")
    out = stage(online.read_observations(spark, f"{root}/in"))
    schema = out.schema

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that runs again replaces what it wrote; in complete mode the last one holds all.
        at = f"{root}/out/batch={0 if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(at)

    run = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out").select(*schema.names)


_OBS = "obs AS (SELECT event_type AS code, ts::DATE + 1 AS day, avg(value) AS v FROM events GROUP BY ALL)"


@Q(f"WITH {_OBS} SELECT code, time_bucket(INTERVAL 7 DAY, day, DATE '1970-01-01') AS week, count(v) AS n, {s6('avg(v)', 4)} AS mean FROM obs GROUP BY ALL")
def stream_weekly_means(spark, sf):
    """Tumbling weeks under a watermark of the longest publication lag."""
    found = drained(spark, observations(spark, sf), lambda obs: online.daily_means(obs, "7 days"), "complete")
    return found.select("code", F.col("window.start").cast("date").alias("week"), "n", r6("mean", 4).alias("mean"))


_LEVEL = """series AS (SELECT code, day, v / 100 AS y, row_number() OVER (PARTITION BY code ORDER BY day) AS t FROM obs),
k AS (SELECT code, 0::BIGINT AS t, NULL::DATE AS day, 0.0::DOUBLE AS x, 10.0::DOUBLE AS p FROM (SELECT DISTINCT code FROM series)
  UNION ALL SELECT s.code, s.t, s.day, x + (p + 1) / (p + 5) * (y - x), (1 - (p + 1) / (p + 5)) * (p + 1) FROM k JOIN series s ON s.code = k.code AND s.t = k.t + 1)"""


@Q(f"WITH RECURSIVE {_OBS}, {_LEVEL} SELECT code, day, {s6('x')} AS state, {s6('p')} AS variance FROM k WHERE t > 0")
def stream_local_level(spark, sf):
    """An online local level for each event type, its state kept from batch to batch."""
    rows = observations(spark, sf).withColumn("value", F.col("value") / 100)
    found = drained(spark, rows.repartition(1), lambda obs: online.local_level(obs, 1.0, 4.0), "append")
    return found.select("code", F.col("published_at").cast("date").alias("day"), r6("state").alias("state"), r6("variance").alias("variance"))
