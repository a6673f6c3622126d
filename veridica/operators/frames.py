"""Writes intermediate frames of iterative operators to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def drop(*frames: DataFrame) -> None:
    """Delete what settle() wrote, once nothing reads it any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir (a temporary folder where unset, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        root = _OWN[app]
    return f"{root.rstrip('/')}/frame-{uuid.uuid4().hex}"


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written to a new path and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task groups at once.
ROWS = 500_000


def parts(df: DataFrame, rows: int = ROWS) -> int:
    """Parts of about `rows` rows that df, which is counted for it, is to be dealt into; at least as many as Spark makes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """df dealt by its keys into parts(): the memory of a task does not grow with the input."""
    return df.repartition(parts(df, rows), *keys)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """In a task: the rows of each value of the keys, which come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1][c][-1] != batch[c][0] for c in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        change = np.zeros(batch.num_rows - 1, bool)
        for c in keys:
            change |= pc.not_equal(batch[c].slice(1), batch[c].slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
