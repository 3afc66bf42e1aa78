"""Joins of points with the intervals that hold them, as equalities.

An interval of days is put on the level of its length, a power of two, whose buckets are as wide as that: so it lies in
one or two of them, be it a day or years.  A point is put on every level, in the one bucket that holds it.  Rows meet by
level and bucket and are then held against the interval's ends; rows follow the numbers of intervals and points, not
the days between them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of up to 2^16 days, 179 years; longer intervals lie in more than two buckets of the last.
LEVELS = 17


def _place(level: Column, bucket: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), bucket.cast("long").alias("bucket"))


def interval_places(start: Column, end: Column) -> Column:
    """Where to look for points in start..end, both included; null for an interval that holds no day."""
    length = F.datediff(end, start) + 1
    level = F.least(F.ceil(F.log2(F.when(length >= 1, length))), F.lit(LEVELS - 1))
    bucket = lambda d: F.floor(F.unix_date(d) / F.pow(F.lit(2.0), level))
    return F.when(length >= 1, F.transform(F.sequence(bucket(start), bucket(end)), lambda b: _place(level, b)))


def point_places(at: Column) -> Column:
    """Where a point stands on every level."""
    return F.array(*[_place(F.lit(k), F.floor(F.unix_date(at) / F.lit(float(2**k)))) for k in range(LEVELS)])
