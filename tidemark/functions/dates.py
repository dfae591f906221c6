"""Date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names by Spark's dayofweek, 1 = Sunday.
WEEKDAYS = {1: "Dom", 2: "Lun", 3: "Mar", 4: "Mer", 5: "Gio", 6: "Ven", 7: "Sab"}


# Further spellings that are tried in this order, month before day.
DATE_FORMATS = (
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy",
    "MMM d, yyyy", "yyyyMMdd",
)


def coerce_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Parse text to a timestamp: the ISO forms, then `formats`; other text becomes null instead of an error."""
    bare = F.trim(col)
    return F.coalesce(F.try_to_timestamp(bare), *[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def month_bucket(col: Column) -> Column:
    """First day of the month as text."""
    return F.date_format(col, "yyyy-MM-01")


def weekday_label(weekday: Column) -> Column:
    pairs = [F.lit(v) for kv in WEEKDAYS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), weekday)
