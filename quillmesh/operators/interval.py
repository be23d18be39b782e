"""Interval joins: points with the ranges that hold them, by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the ranges of their keys that touch their bin: what interval_join() looks at. A point falls into one
    bin; a range [start, end) is copied to those that it touches, so it should be no longer than some widths."""
    if width < 1:
        raise ValueError("a bin is at least 1 wide")
    bin_of = lambda c: F.floor(F.col(c) / width)
    last = F.floor((F.col(end) - 1) / width)
    own = ranges.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(bin_of(start), last)))
    return points.withColumn("_bin", bin_of(at)).join(own, [*keys, "_bin"], how).drop("_bin")


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points and ranges with equal keys and start <= at < end, by an equal join on keys and bins of `width`. The work is
    that of the points, the ranges' bins and the matches, not of points times ranges. Columns other than the keys must
    have different names; null keys and places match nothing."""
    return binned(points, ranges, keys, at, start, end, width).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))


def first_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, order: str, take: str, name: str) -> DataFrame:
    """Each point with `take` of the first range (by `order`) that holds it as `name`; null where none does. Equal points
    become one."""
    found = binned(points, ranges.select(*keys, start, end, order, take), keys, at, start, end, width, "left")
    inside = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    return found.groupBy(*points.columns).agg(F.min_by(F.when(inside, F.col(take)), F.when(inside, F.col(order))).alias(name))
