"""Calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_day_floor(d: Column) -> Column:
    """Saturday and Sunday become the Friday before."""
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def business_days_between(start: Column, end: Column) -> Column:
    """Mondays to Fridays in (start, end]; 0 unless start < end.  Closed form, no sequence of days."""
    def count(d: Column) -> Column:
        # Weekdays from Monday 1970-01-05 up to and including d.
        n = F.datediff(d, F.lit("1970-01-05").cast("date")) + 1
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.when(start < end, count(end) - count(start)).otherwise(0).cast("int")


def months_diff(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
