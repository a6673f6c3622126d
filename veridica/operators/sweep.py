"""Sweeps over ordered points: prefix sums that are spread over tasks, and what holds at given cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridica.operators.frames import settle


def running_sums(points: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """points with each of values replaced by its sum over all rows up to and including the row, in the given order.

    Rows are partitioned by ranges of the order and summed up within each range; the sums of the ranges
    before, one row a partition, are added. No task sees more than its range. Order must tell rows apart.
    """
    ranged = settle(points.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over as many rows as there are partitions
    before = totals.select("_part", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = ranged.select("_part", *[c for c in points.columns if c not in values], *[F.sum(v).over(upto).alias(v) for v in values])
    return inside.join(before, "_part").select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in values else F.col(c) for c in points.columns])


def as_of(intervals: DataFrame, cutoffs: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(cutoff, visible, ended) for every distinct cutoff, null ones excepted.

    visible: intervals that start at the cutoff or before, or have no start; ended: those of them whose end lies before it. Every
    interval is counted once where it becomes visible and once where it has ended, equal points are added up before
    they move, and cut-offs are points of the same sweep that read the sums. So the work is a sort of the distinct
    points, for any number of cut-offs. An interval that ends before its start has ended as soon as it is visible.
    """
    s, e = F.col(start), F.col(end)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    # at one point, what holds from the point on comes first, then cut-offs, then what holds after it
    point = lambda at, turn, visible, ended: F.struct(at.alias("at"), F.lit(turn).alias("turn"), visible.alias("visible"), ended.alias("ended"))
    begun = F.when(s.isNotNull(), point(s, 0, one, none))
    past = F.when(e.isNotNull(), F.when(s > e, point(s, 0, none, one)).otherwise(point(e, 2, none, one)))
    undated = intervals.where(s.isNull()).agg(F.count("*").alias("always"))
    changes = intervals.select(F.explode(F.array_compact(F.array(begun, past))).alias("p")).select("p.*").groupBy("at", "turn").agg(F.sum("visible").alias("visible"), F.sum("ended").alias("ended"))
    looks = cutoffs.where("cutoff is not null").select(F.col("cutoff").alias("at"), F.lit(1).alias("turn"), none.alias("visible"), none.alias("ended")).distinct()
    summed = running_sums(changes.unionByName(looks), ["at", "turn"], ["visible", "ended"]).where("turn = 1")
    return summed.crossJoin(F.broadcast(undated)).select(F.col("at").alias("cutoff"), (F.col("visible") + F.col("always")).alias("visible"), "ended")
