"""Vector code compression: product codes found with per-dimension value dictionaries.

A vector of integers is cut into equal parts; a part's code is the index of the nearest entry (squared
Euclidean distance, ties to the lower index) of that part's codebook. Per batch and dimension the
distinct integers form a dictionary, and the squared differences of each of them to all entries a
table; a part's distances are then gathered from the tables by dictionary code and added. So the
arithmetic grows with the distinct values, all else is gathers and adds, in exact integers.

Codebooks start as the parts of the vectors with the smallest ids. A round of training assigns all parts
and replaces every entry by the componentwise floor of its parts' mean. Each task returns counts and sums by
(part, entry, dimension), bounded by the size of the codebooks whatever the number of vectors;
Spark adds them up, and only codebooks (entries x dimensions integers) reach the driver and the tasks.
All rows take part in every round. Nothing but those sums is shuffled.

Defined results: vectors that are null, hold a null or non-finite component, or have another length than
the first kept one (smallest id, nulls last, then least vector) are dropped. Repeated rows count each. With fewer
vectors than entries, the codebooks have fewer entries; without any there are none, and no codes. The
length must be a multiple of the parts. Scaled components of 2**24 or more in magnitude are an
error: distances would not fit a long. Other columns are passed through, the names codes and error excepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the totals of a group, so that the rows of a hot one spread over as many tasks.
SALTS = 32


def usable(vectors: DataFrame, column: str = "embedding", length: int | None = None) -> DataFrame:
    """Vectors of finite components; those of one length only, if it is given."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col(column).isNotNull() & finite)
    return kept if length is None else kept.where(F.size(column) == length)


def _integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * component)."""
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() >= 1 << 24:
        raise ValueError("scaled components must lie under 2**24 in magnitude")
    return out.astype(np.int64).reshape(len(vectors), -1)


def nearest(rows: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance) of every part of every row. codebooks: parts x entries x width."""
    parts, entries, width = codebooks.shape
    codes, distances = np.empty((len(rows), parts), np.int64), np.empty((len(rows), parts), np.int64)
    for part in range(parts):
        total = np.zeros((len(rows), entries), dtype=np.int64)
        for i in range(width):
            values, at = np.unique(rows[:, part * width + i], return_inverse=True)
            total += np.square(values[:, None] - codebooks[part, :, i][None, :])[at]
        codes[:, part] = total.argmin(axis=1)
        distances[:, part] = total.min(axis=1)
    return codes, distances


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sums(codebooks: np.ndarray, scale: int):
    """Counts and sums of the rows nearest to each entry, one row per (part, entry, dimension) and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in _slices(batches):
            rows = _integers(batch.column(0), scale)
            codes, _ = nearest(rows, codebooks)
            for part in range(parts):
                counts[part] += np.bincount(codes[:, part], minlength=entries)
                np.add.at(sums[part], codes[:, part], rows[:, part * width : (part + 1) * width])
        part, entry = np.nonzero(counts)
        cells = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), np.repeat(counts[part, entry], width), sums[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["part", "entry", "place", "n", "total"])

    return run


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, column: str = "embedding", order: str = "vec_id") -> np.ndarray:
    """Codebooks, an integer array of parts x entries x width."""
    first = usable(vectors, column).orderBy(F.col(order).asc_nulls_last(), F.col(column)).select(F.transform(column, lambda x: x.cast("double")).alias("v")).limit(entries).collect()
    first = [r.v for r in first if len(r.v) == len(first[0].v)] if first else []
    if not first:
        return np.empty((parts, 0, 0), np.int64)
    length = len(first[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    kept = usable(vectors, column, length)
    if len(first) < entries:  # vectors of another length were among the first
        first = [r.v for r in kept.orderBy(F.col(order).asc_nulls_last(), F.col(column)).select(F.transform(column, lambda x: x.cast("double")).alias("v")).limit(entries).collect()]
    start = _integers(pa.array(first, pa.list_(pa.float64())), scale)
    codebooks = np.ascontiguousarray(start.reshape(len(start), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        partial = kept.select(column).mapInArrow(_sums(codebooks, scale), "part bigint, entry bigint, place bigint, n bigint, total bigint")
        codebooks = codebooks.copy()
        for r in partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            codebooks[r.part, r.entry, r.place] = r.total // r.n
    return codebooks


def encode(vectors: DataFrame, codebooks: np.ndarray, scale: int = 256, column: str = "embedding") -> DataFrame:
    """The other columns of vectors, plus codes (array of a code per part) and error (squared distance to the coded vector)."""
    parts, entries, width = codebooks.shape
    others = [c for c in vectors.columns if c not in (column, "codes", "error")]
    kept = usable(vectors, column, parts * width if entries else None).select(*others, F.col(column).alias("codes"))
    kept = kept if entries else kept.where("false")
    schema = kept.select(*others, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, distances = nearest(_integers(batch.column("codes"), scale), codebooks)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), lists, pa.array(distances.sum(axis=1), pa.int64())], names=[*others, "codes", "error"])

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, codebooks: np.ndarray, scale: int = 256) -> DataFrame:
    """coded plus decoded: the vector of the coded entries, scaled back."""
    parts, entries, width = codebooks.shape
    names = coded.columns
    schema = coded.select("*", F.array().cast("array<double>").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes = np.asarray(batch.column("codes").flatten()).reshape(batch.num_rows, parts)
            values = codebooks[np.arange(parts)[None, :], codes].reshape(batch.num_rows, parts * width) / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, parts * width), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "decoded"])

    return coded.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, group: str, name: str) -> DataFrame:
    """coded plus name: error summed over the rows of an equal group, nulls together. coded is read twice: write it first.

    The rows of a group meet its total by (group, salt), so that a group of any size spreads over SALTS tasks.
    """
    coded = coded.drop(name, "_group", "_salt", "_own")
    totals = coded.groupBy(F.col(group).alias("_group")).agg(F.sum("error").alias(name)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_own", F.pmod(F.xxhash64(*[c for c in coded.columns if c != group]), F.lit(SALTS)).cast("int"))
    return salted.join(totals, (F.col("_own") == F.col("_salt")) & F.col(group).eqNullSafe(F.col("_group"))).drop("_group", "_salt", "_own")


def _oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every distance of every part to every entry by plain sums of squares, a pair of tables per round."""
    steps = [
        f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS (SELECT vec_id, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS place, v[i + 1] AS val FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM k)),
b0 AS (SELECT part, entry, place, val FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) USING (vec_id) WHERE entry < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
  SELECT x.vec_id, x.part, b.entry, sum((x.val - b.val) * (x.val - b.val)) AS d FROM x JOIN b{r} b ON x.part = b.part AND x.place = b.place GROUP BY ALL) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS (SELECT o.part, o.entry, o.place, coalesce(m.val, o.val) AS val FROM b{r} o LEFT JOIN (
  SELECT part, entry, place, floor(sum(val) / count(*))::BIGINT AS val FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place))""")
    return (
        ",\n".join(steps)
        + f""",
c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN c USING (vec_id)"""
    )


ORACLE_SQL = _oracle()
