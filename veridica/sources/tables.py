"""Keyed Parquet tables maintained by batches of changes, and the graph projection kept in two of them.

A table is a folder partitioned by the hash of its key into a fixed number of buckets. A batch reads and replaces the buckets
that its keys fall into; other buckets keep their files. The new rows of those buckets are first written whole under
`<table>/_merged/<batch>`, then put in place: a batch given again, after a crash or by a restarted stream, finds them there and only
puts them in place once more, until a later batch has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridica.operators.frames import drop, settle


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def read(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of a table; none where it has not been written yet or all its rows are gone."""
    there = exists(spark, table)
    rows = spark.read.schema(schema).parquet(table) if there else spark.createDataFrame([], schema)
    return rows.select(spark.createDataFrame([], schema).columns)


def upsert(changes: DataFrame, table: str, key: str, order: str, batch: int, buckets: int = 64) -> None:
    """Applies changes (columns of the table, `order`, deleted) to the table: of each key's changes the one of largest `order`
    counts, which takes the key's place or removes it.

    Of equal `order` a deletion wins, then the largest row. Null keys are left out; a null `deleted` is false. Batches are numbered
    upwards; one below the last is refused, the last one may come again. Columns must be orderable (no maps), and `buckets` stays
    what it was, as it is part of the partitions' name.
    """
    spark = changes.sparkSession
    bucket = f"bucket_of_{buckets}"
    columns = [c for c in changes.columns if c not in (key, order, "deleted")]
    merged, done = f"{table}/_merged/{batch}", []
    fs, folder = _fs(spark, f"{table}/_merged")
    if fs.exists(folder):
        done = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(s.getPath().suffix("/_SUCCESS")))
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after batch {done[-1]}")
    schema = changes.select(key, *columns).schema
    if batch not in done:
        # dealt before they are grouped, changes are sorted once, not on both sides of the shuffle
        last = changes.where(F.col(key).isNotNull()).repartition(key).groupBy(key).agg(F.max(F.struct(order, F.coalesce("deleted", F.lit(False)).alias("deleted"), *columns)).alias("c"))
        last = last.select(key, "c.deleted", *[F.col("c")[c].alias(c) for c in columns], F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(bucket))
        last = settle(last, "zstd")
        touched = sorted(r[0] for r in last.select(bucket).distinct().collect())
        rows = last.where("not deleted").select(key, *columns, bucket)
        if any(exists(spark, f"{table}/{bucket}={b}") for b in touched):
            old = spark.read.schema(schema.add(bucket, "integer")).option("basePath", table).parquet(*[p for b in touched if exists(spark, p := f"{table}/{bucket}={b}")])
            rows = old.join(last.select(key), key, "left_anti").select(rows.columns).unionByName(rows)
        # a null row keeps each touched bucket, also one that has lost all its rows
        marks = spark.createDataFrame([(b,) for b in touched], f"{bucket} int")
        rows.unionByName(marks, allowMissingColumns=True).withColumn("kept", F.col(key).isNotNull()).write.mode("overwrite").parquet(merged, compression="zstd")
        drop(last)
    out = spark.read.parquet(merged)
    emptied = [r[0] for r in out.groupBy(bucket).agg(F.bool_or("kept").alias("any")).where("not any").collect()]
    out.where("kept").drop("kept").repartition(bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(table, compression="zstd")
    for b in emptied:
        _remove(spark, f"{table}/{bucket}={b}")
    for number in done:
        if number != batch:
            _remove(spark, f"{table}/_merged/{number}")


NODES = "id string, label string, name string, confidence_score double"
EDGES = "id string, type string, source_id string, target_id string, confidence_score double"


def project(spark: SparkSession, path: str, entities: DataFrame, relationships: DataFrame, batch: int, buckets: int = 64) -> None:
    """Brings the projection under `path` (nodes, edges) up to date with changed entities (id, type, name, confidence_score, seq,
    deleted) and relationships (id, type, source_id, target_id, confidence_score, seq, deleted).

    Entities come first: a deleted one takes its edges along, and a relationship is taken only where both ends are there. A batch may come again.
    """
    label = F.array_join(F.transform(F.split("type", "_"), lambda p: F.initcap(p)), "")
    upsert(entities.select("id", label.alias("label"), "name", "confidence_score", "seq", "deleted"), f"{path}/nodes", "id", "seq", batch, buckets)
    nodes, edges = read(spark, f"{path}/nodes", NODES), read(spark, f"{path}/edges", EDGES)
    ends = lambda rows, how: rows.join(nodes.select(F.col("id").alias("source_id")), "source_id", how)
    other = lambda rows, how: rows.join(nodes.select(F.col("id").alias("target_id")), "target_id", how)
    lost = ends(edges.select("id", "source_id"), "left_anti").select("id").unionByName(other(edges.select("id", "target_id"), "left_anti").select("id"))
    none = lambda c: F.lit(None).cast(edges.schema[c].dataType).alias(c)
    cut = lost.select("id", none("type"), none("source_id"), none("target_id"), none("confidence_score"), F.lit(None).cast("bigint").alias("seq"), F.lit(True).alias("deleted"))
    given = relationships.select("id", "type", "source_id", "target_id", "confidence_score", F.col("seq").cast("bigint").alias("seq"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    joined = other(ends(given.where("not deleted"), "left_semi"), "left_semi").unionByName(given.where("deleted"))
    columns = ["id", "type", "source_id", "target_id", "confidence_score", "seq", "deleted"]
    upsert(joined.select(columns).unionByName(cut.select(columns)), f"{path}/edges", "id", "seq", batch, buckets)
