"""Interval operators: merging, point-in-interval, as-of and overlap joins. Intervals are half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adds ``island``: intervals of one key that overlap, directly or through others; touching ones don't."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    return spans.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def merged(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """One row per island: its hull and the number of intervals in it."""
    return islands(spans, key, start, end).groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans"))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def as_of(points: DataFrame, marks: DataFrame, key: list[str], at: str, mark: str, value: str) -> DataFrame:
    """Adds to each point the value of the last mark at or before it, or of the first mark if there is none.

    A union and one window instead of a range join: the cost doesn't grow with marks times points.
    """
    rest = [c for c in points.columns if c not in key and c != at]
    a = points.select(*key, F.col(at).alias("__at"), F.lit(1).alias("__is"), F.struct(*[F.col(c) for c in [at, *rest]]).alias("__row"), F.lit(None).cast(marks.schema[value].dataType).alias("__v"))
    b = marks.select(*key, F.col(mark).alias("__at"), F.lit(0).alias("__is"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(*key).orderBy("__at", "__is", F.col("__v").asc_nulls_last())
    both = a.union(b)
    last = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.select(*key, "__is", "__row", F.coalesce(last, first).alias(value)).where("__is = 1").select(*key, "__row.*", value)


def containing(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str = "start", end: str = "end", bucket: int = 4096) -> DataFrame:
    """Left join of points with the intervals of their key that hold them, by an equi-join on buckets of the line."""
    spread = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.greatest(F.floor((F.col(end) - 1) / bucket), F.floor(F.col(start) / bucket)))))
    placed = points.withColumn("__b", F.floor(F.col(at) / bucket))
    a, b = placed.alias("a"), spread.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*key, "__b"]] + [F.col(f"a.{at}") >= F.col(f"b.{start}"), F.col(f"a.{at}") < F.col(f"b.{end}")]
    keep = [F.col(f"a.{c}") for c in points.columns] + [F.col(f"b.{c}") for c in spans.columns if c not in key]
    return a.join(b, cond, "left").select(*keep)
