"""Sources: observation tables, survey sheets, release calendars, catalogues."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.sizes import small

log = logging.getLogger(__name__)


def scan_series(obs: DataFrame, code: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One series between two dates, both included; the filters reach the scan of a code-partitioned table."""
    out = obs.filter(F.col("code") == code)
    if start:
        out = out.filter(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col("obs_date") <= F.lit(end).cast("date"))
    return out


def scan_all(obs: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All catalogued observations, and the catalogue's codes that have none."""
    found = obs.join(small(catalogue), "code")
    return found, catalogue.join(obs.select("code").distinct(), "code", "left_anti")


def read_panel_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def survey_rows(sheet: DataFrame) -> DataFrame:
    """(survey_quarter, recess1..recess5) from a sheet (YEAR, QUARTER, RECESS1..RECESS5 in percent)."""
    start = F.make_date("YEAR", (F.col("QUARTER") - 1) * 3 + 1, F.lit(1))
    return sheet.select(
        start.alias("survey_quarter"),
        *[(F.col(f"RECESS{i}").try_cast("double") / 100).alias(f"recess{i}") for i in range(1, 6)],
    )


def release_dates(lines: DataFrame) -> DataFrame:
    """(survey_quarter, release_date) from lines (n, line) of a release calendar.

    A line reads ``[year] Qk mm/dd/yy[*] mm/dd/yy``; the year stands on the first line of
    its block and is carried forward; the last date of the line is the release.
    """
    year = F.regexp_extract("line", r"^\s*(\d{4})\b", 1)
    quarter = F.regexp_extract("line", r"\bQ([1-4])\b", 1)
    dates = F.regexp_extract_all("line", F.lit(r"(\d{1,2}/\d{1,2}/\d{2})\*?"), 1)
    # A calendar is a text of some hundred lines, one window over it is its size.
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("year", F.last(F.when(year != "", year.try_cast("int")), ignorenulls=True).over(w))
    rows = rows.withColumn("q", F.when(quarter != "", quarter.try_cast("int"))).withColumn("dates", dates)
    return rows.filter("q IS NOT NULL AND year IS NOT NULL AND size(dates) > 0").select(
        F.make_date("year", (F.col("q") - 1) * 3 + 1, F.lit(1)).alias("survey_quarter"),
        _short_date(F.element_at("dates", -1)).alias("release_date"),
    )


def _short_date(text: Column) -> Column:
    """m/d/yy with years 69 to 99 in the 1900s and the others in the 2000s."""
    part = F.split(text, "/")
    year = part[2].cast("int")
    return F.make_date(F.when(year >= 69, year + 1900).otherwise(year + 2000), part[0].cast("int"), part[1].cast("int"))


def fetch(codes: Iterable[str], get: Callable[[str], list[tuple]], gap_seconds: float = 0.25) -> list[tuple]:
    """Rows of all codes from a remote client, at most one call each ``gap_seconds``; failures are logged and skipped."""
    out: list[tuple] = []
    for code in codes:
        try:
            out += [(code, *row) for row in get(code)]
        except Exception as why:  # a client may fail in any way; the run goes on without the series
            log.warning("no data for %s: %s", code, why)
        time.sleep(gap_seconds)
    return out


def fresh(manifest: DataFrame, now: Column, max_age_days: float | None = 1.0) -> DataFrame:
    """Adds ``stale`` to (code, fetched_at, vintage): None pins all, 0 refetches all, vintages never expire."""
    if max_age_days is None:
        return manifest.withColumn("stale", F.lit(False))
    age = (F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 86400.0
    return manifest.withColumn("stale", F.col("vintage").isNull() & (age >= max_age_days))


def catalogue_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """(code, name, frequency, category, transform, lag_days) from a catalogue in YAML."""
    import yaml

    rows = [
        (e["code"], e.get("name", e["code"]), e["frequency"], e.get("category"), e.get("transform", "none"), int(e.get("publication_lag_days", 0)))
        for e in yaml.safe_load(text)["series"]
    ]
    return spark.createDataFrame(rows, "code string, name string, frequency string, category string, transform string, lag_days int")


def download(urls: dict[str, str], folder: str, get: Callable[[str], bytes] | None = None) -> list[str]:
    """Fetch files by name into ``folder``; returns the names that came.  ``get`` stands in for the network in tests."""
    from pathlib import Path
    from urllib.request import urlopen

    def default(url: str) -> bytes:
        with urlopen(url, timeout=30) as answer:
            return answer.read()

    Path(folder).mkdir(parents=True, exist_ok=True)
    came = []
    for name, url in urls.items():
        try:
            data = (get or default)(url)
        except OSError as why:
            log.warning("no file from %s: %s", url, why)
            continue
        (Path(folder) / name).write_bytes(data)
        came.append(name)
    return came


def published_indicator(obs: DataFrame, months: DataFrame, fallback: DataFrame) -> DataFrame:
    """(month_end, y): a published 0/1 indicator, the last of each month, carried over months without one.

    ``obs`` (code, obs_date, value) holds one series; months before its first
    value, and all where it is empty, take ``fallback`` (month_end, y).
    """
    own = obs.filter("value IS NOT NULL").groupBy(F.last_day("obs_date").alias("month_end")).agg(F.max_by("value", "obs_date").alias("_v"))
    # One series of months.
    held = F.last("_v", ignorenulls=True).over(Window.orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0))
    grid = months.select("month_end").distinct().join(own, "month_end", "left").withColumn("_held", held)
    return grid.join(fallback.select("month_end", "y"), "month_end", "left").select("month_end", F.coalesce(F.col("_held").cast("int"), "y").alias("y"))
