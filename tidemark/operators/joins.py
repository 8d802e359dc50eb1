"""As-of, interval and calendar joins.

As-of joins are a union of both sides and one window, which sorts by key and
time and spreads over keys; a lateral subquery would plan as a nested loop.
Interval joins compare with span tables of a few rows, which are broadcast
behind a check of their number (:func:`tidemark.operators.sizes.small`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sizes import small


def asof_backward(grid: DataFrame, facts: DataFrame, *, by: list[str], t: str, ts: str, value: str, tie: str | None = None) -> DataFrame:
    """Adds to each row of ``grid`` (by..., t) the latest ``value`` with ts <= t, or NULL.

    Facts are ordered by ``ts`` - when they became known - and then by ``tie``.  A
    null value hides nothing: the latest known one counts.
    """
    tie_col = F.col(tie) if tie else F.lit(0)
    kind = dict(facts.dtypes)[tie] if tie else "int"
    left = grid.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_tie"), F.lit(None).cast("double").alias("_v"))
    right = facts.select(*by, F.col(ts).alias("_t"), F.lit(0).alias("_side"), tie_col.alias("_tie"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.union(right).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return filled.filter("_side = 1").select(*by, F.col("_t").alias(t), value)


def asof_forward(rows: DataFrame, calendar: DataFrame, *, known: str, day: str) -> DataFrame:
    """Adds to each row the first ``day`` of ``calendar`` on or after ``known``; rows without one are dropped.

    Rows meet the days of their own year in one window for each year; for those
    behind a year's last day the first day of a later year counts, from a table of
    one row for each year.
    """
    columns = rows.columns
    days = calendar.select(F.col(day).alias("_d")).distinct()
    left = rows.select(F.struct(*columns).alias("_row"), F.col(known).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("date").alias("_d"))
    right = days.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("_d").alias("_t"), F.lit(1).alias("_side"), "_d")
    both = left.union(right).withColumn("_year", F.year("_t"))
    w = Window.partitionBy("_year").orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    own = both.withColumn("_own", F.first("_d", ignorenulls=True).over(w)).filter("_side = 0")
    # A dimension: one row for each year that is asked for or has days.
    years = both.groupBy("_year").agg(F.min("_d").alias("_first"))
    later = Window.orderBy("_year").rowsBetween(1, Window.unboundedFollowing)
    ahead = years.select("_year", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    joined = own.join(small(ahead), "_year").withColumn("entry", F.coalesce("_own", "_later"))
    return joined.filter("entry IS NOT NULL").select("_row.*", "entry")


def knowable_date(rows: DataFrame, releases: DataFrame, quarter: str, release: str, assumed_days: int) -> DataFrame:
    """``knowable_at`` = the known release date, else the quarter's start and an assumed lag."""
    return rows.join(small(releases), quarter, "left").withColumn("knowable_at", F.coalesce(F.col(release), F.date_add(quarter, assumed_days)))


def interval_label(months: DataFrame, spans: DataFrame) -> DataFrame:
    """(month_end, y): 1 where peak <= month_end <= trough for some span (peak, trough)."""
    hit = months.join(small(spans.select("peak", "trough")), F.col("month_end").between(F.col("peak"), F.col("trough")), "left")
    return hit.groupBy("month_end").agg(F.max(F.col("peak").isNotNull().cast("int")).alias("y"))


def interval_label_asof(months: DataFrame, spans: DataFrame, as_of: Column) -> DataFrame:
    """Labels as they were known at ``as_of``: only announced turning points count.

    A span whose trough is not announced yet runs to ``as_of``.  Months after the
    last announced turning point, and not in an open span, are unknown and left
    out.  A missing announcement date is taken as twelve months after the event.
    """
    p = F.coalesce("peak_announced", F.add_months("peak", 12))
    t = F.coalesce("trough_announced", F.add_months("trough", 12))
    known = spans.select(
        "peak", F.when(t <= as_of, F.col("trough")).alias("trough"), (p <= as_of).alias("seen")
    ).filter("seen")
    edge = known.agg(F.max(F.coalesce("trough", as_of)).alias("edge"))
    hit = months.filter(F.col("month_end") <= as_of).join(
        small(known), (F.col("month_end") >= F.col("peak")) & (F.col("month_end") <= F.coalesce("trough", as_of)), "left"
    )
    labels = hit.groupBy("month_end").agg(F.max(F.col("peak").isNotNull().cast("int")).alias("y"))
    return labels.crossJoin(small(edge, 1)).filter("month_end <= last_day(edge)").drop("edge")


def interval_labels_asof(months: DataFrame, spans: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, month_end, y): :func:`interval_label_asof` for each ``as_of`` of ``dates``."""
    p = F.coalesce("peak_announced", F.add_months("peak", 12))
    t = F.coalesce("trough_announced", F.add_months("trough", 12))
    days = dates.select("as_of").distinct()
    end = F.when(t <= F.col("as_of"), F.col("trough"))
    known = days.crossJoin(small(spans)).filter(p <= F.col("as_of")).select(F.col("as_of").alias("_at"), "peak", F.coalesce(end, "as_of").alias("_end"))
    edge = known.groupBy(F.col("_at").alias("as_of")).agg(F.last_day(F.max("_end")).alias("_edge"))
    grid = months.crossJoin(small(days)).join(edge, "as_of").filter("month_end <= as_of AND month_end <= _edge")
    hit = grid.join(known, (F.col("as_of") == F.col("_at")) & F.col("month_end").between(F.col("peak"), F.col("_end")), "left")
    return hit.groupBy("as_of", "month_end").agg(F.max(F.col("peak").isNotNull().cast("int")).alias("y"))


def window_around_event(rows: DataFrame, spans: DataFrame, months: int = 6) -> DataFrame:
    """Rows within ``months`` of a span, with its peak and their phase: before, during or after."""
    near = rows.join(
        small(spans.select("peak", "trough")),
        (F.col("month_end") >= F.add_months("peak", -months)) & (F.col("month_end") <= F.last_day(F.add_months("trough", months))),
    )
    phase = F.when(F.col("month_end") < F.col("peak"), "before").when(F.col("month_end") > F.col("trough"), "after").otherwise("during")
    return near.withColumn("phase", phase)


def anti_resume(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def dedup_keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def vintage_snapshot(vintages: DataFrame, as_of: Column) -> DataFrame:
    """(code, obs_date, value) as known at ``as_of``; the latest vintage wins."""
    seen = vintages.filter((F.col("realtime_start") <= as_of) & (as_of <= F.coalesce("realtime_end", as_of)))
    return seen.groupBy("code", "obs_date").agg(F.expr("max_by(value, struct(realtime_start, value))").alias("value"))


def span_overlap(spans: DataFrame, lo: Column, hi: Column) -> DataFrame:
    return spans.filter((F.col("peak") <= hi) & (F.col("trough") >= lo))
