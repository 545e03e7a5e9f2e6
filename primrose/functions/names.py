"""Times in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time layout of split snapshots and of feed files.
SPLIT_STAMP = "MM-dd-yyyy_HH-mm"
FEED_STAMP = "MM-dd-yyyy_HH_mm"


def stamp_name(ts: Column, layout: str = SPLIT_STAMP) -> Column:
    return F.date_format(ts, layout)


def parse_snapshot_time(name: Column) -> Column:
    """The time between ``@`` and the next ``.``; null when it is not a time."""
    stamp = F.regexp_extract(name, r"@([^.]*)", 1)
    return F.try_to_timestamp(stamp, F.lit(SPLIT_STAMP))
