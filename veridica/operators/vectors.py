"""Nearest vectors by cosine: random-hyperplane hashing with multi-probe search and exact re-ranking.

Each of `tables` tables has its own hyperplanes; the sides on which a vector lies are its bucket there. A query
looks into every bucket whose cost is at most a radius: the cost of a bucket is the sum of the squared
distances of the query to the hyperplanes that part it from the bucket. So a query close to some planes looks
into more buckets than one that is far from all.

The radius is not a constant: a sample of at most `sample` vectors is compared with all vectors, and the
radius is the least that finds the share `target` of their true neighbours in some table. Buckets hold
about `bucket` vectors, whatever the number of vectors. All vectors are in the index, candidates
meet by (table, group), a group being the buckets that agree in their first planes. A task holds one group and the
queries that look into it; costs and exact cosines there are matrix products, and only the best rows of
each query leave it. So no pair is ever a row of a shuffle.

Equal vectors are one entry that keeps the k + 1 smallest ids, more of which no query can return. So a vector
that a third of all rows share is one row of the index.

Defined results: vectors that are null, zero, or hold a null or non-finite component are neither found nor asked
for; neighbours of another length are an error; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridica.operators.frames import settle


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): vectors of length 1."""
    fit = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(fit).select(F.col(key).alias("id"), F.transform(column, lambda x: x.cast("double")).alias("v")).withColumn("norm", F.sqrt(dot("v", "v"))).where("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): distinct vectors with the k + 1 smallest ids that bear each."""
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("key"), "v", "ids")


def hyperplanes(tables: int, bits: int, length: int, seed: int = 7) -> np.ndarray:
    planes = np.random.default_rng(seed).normal(size=(tables, bits, length))
    return planes / np.linalg.norm(planes, axis=2, keepdims=True)


def costs(queries: np.ndarray, others: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Of each pair of a query and another vector, the least cost over the tables of the other's bucket."""
    margin = np.einsum("tbd,nd->ntb", planes, queries)
    apart = (margin > 0) != (np.einsum("tbd,nd->ntb", planes, others) > 0)
    return (np.square(margin) * apart).sum(axis=2).min(axis=1)


def probes(margins: np.ndarray, radius: float) -> np.ndarray:
    """The masks of all sets of planes whose squared distances add up to at most the radius; the empty one first."""
    squares = np.square(margins)
    masks, sums = np.zeros(1, dtype=np.int64), np.zeros(1)
    for i in np.argsort(squares):
        more = sums + squares[i]
        fits = more <= radius
        if not fits[0]:  # the empty set plus this plane is beyond it, and so is any later one
            break
        masks, sums = np.concatenate([masks, masks[fits] | (1 << int(i))]), np.concatenate([sums, more[fits]])
    return masks


def tune(entries: DataFrame, planes: np.ndarray, k: int, target: float, sample: int) -> float:
    """The least radius that finds the share `target` of the k nearest of at most `sample` entries, all entries compared."""
    asked = entries.orderBy(F.xxhash64("key")).select("key", "v").limit(sample).collect()
    own, at = np.array([r.key for r in asked]), np.array([r.v for r in asked])

    def top_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = pd.DataFrame({"query": [], "cosine": [], "v": []})
        for frame in frames:
            found = np.stack(frame["v"].to_numpy())
            cosine = found @ at.T
            cosine[frame["key"].to_numpy()[:, None] == own[None, :]] = -2
            rows = np.argsort(-cosine, axis=0, kind="stable")[:k]
            new = pd.DataFrame({"query": np.tile(np.arange(len(own)), len(rows)), "cosine": np.take_along_axis(cosine, rows, 0).ravel(), "v": list(found[rows.ravel()])})
            top = (pd.concat([top, new]) if len(top) else new).sort_values("cosine", ascending=False).groupby("query").head(k)
        yield top.astype({"query": "int64", "cosine": "float64"})

    near = entries.select("key", "v").mapInPandas(top_of, "query bigint, cosine double, v array<double>").where("cosine > -2")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine")))
    true = near.withColumn("place", place).where(F.col("place") <= k).select("query", "v").collect()  # at most sample * k rows
    if not true:
        return 0.0
    found = np.sort(costs(at[[r["query"] for r in true]], np.array([r.v for r in true]), planes))
    return float(found[min(len(found) - 1, math.ceil(target * len(found)) - 1)]) + 1e-12


def buckets(rows: DataFrame, planes: np.ndarray, radius: float | None = None) -> DataFrame:
    """(key, table, bucket): the bucket of a vector in each table, and all those within the radius if it is given."""
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            margin = np.einsum("tbd,nd->ntb", planes, np.stack(frame["v"].to_numpy())) if len(frame) else np.zeros((0, *planes.shape[:2]))
            home = (margin > 0) @ weights
            if radius is None:
                n, tables = home.shape
                yield pd.DataFrame({"key": np.repeat(frame["key"].to_numpy(), tables), "table": np.tile(np.arange(tables), n), "bucket": home.ravel()})
                continue
            for key, own, near in zip(frame["key"], home, margin, strict=True):
                found = [own[t] ^ probes(near[t], radius) for t in range(len(own))]
                yield pd.DataFrame({"key": key, "table": np.repeat(np.arange(len(own)), [len(f) for f in found]), "bucket": np.concatenate(found)})

    return rows.select("key", "v").mapInPandas(run, "key bigint, table int, bucket bigint")


def best(cosine: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best by cosine in five digits, ties to the smaller key; -inf is no candidate."""
    rounded = np.floor(cosine * 1e5 + 0.5)
    if cosine.shape[1] > k:
        floor = np.partition(rounded, -k, axis=1)[:, -k][:, None]
        row, column = np.nonzero((rounded >= floor) & (rounded > -np.inf))
    else:
        row, column = np.nonzero(rounded > -np.inf)
    order = np.lexsort((keys[column], -rounded[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def exact(vectors: DataFrame, queries: DataFrame, k: int, block: int = 8192, asked: int = 2048) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k rows of (vec_id, embedding) of largest cosine to each query of the same form, itself excepted.

    Blocks of rows meet blocks of queries, a pair of blocks in a task; the k best of each leave it. A null vector, one with a
    null component or of another length has a null cosine, which comes last; a cosine that is no number comes first.
    """
    rows_of = lambda df, size: max(1, -(-df.count() // size))
    n_rows, n_asked = rows_of(vectors, block), rows_of(queries, asked)
    whole = F.when(F.forall("embedding", lambda x: x.isNotNull()), F.col("embedding")).alias("v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(F.col("vec_id").alias("key"), whole, F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int").alias("b")).withColumn("q", every(n_asked))
    right = queries.select(F.col("vec_id").alias("key"), whole, F.pmod(F.xxhash64("vec_id"), F.lit(n_asked)).cast("int").alias("q")).withColumn("b", every(n_rows))

    def run(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        have, want = rows["v"].to_numpy(), wanted["v"].to_numpy()
        sizes, asked_sizes = (np.array([0 if v is None else len(v) for v in values], dtype=np.int64) for values in (have, want))
        keys, ids = rows["key"].to_numpy(), wanted["key"].to_numpy()
        for size in np.unique(asked_sizes):
            of = np.flatnonzero(asked_sizes == size)
            usable = np.flatnonzero((sizes == size) & (size > 0))
            x = np.array([have[i] for i in usable], dtype=np.float64).reshape(len(usable), size)
            norm = np.sqrt((x * x).sum(axis=1))
            for part in np.array_split(of, max(1, -(-len(of) // 256))):
                cosine = np.full((len(part), len(keys)), -1e9)  # a null, but a candidate
                if len(usable):
                    y = np.array([want[i] for i in part], dtype=np.float64)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        value = (y @ x.T) / (np.sqrt((y * y).sum(axis=1))[:, None] * norm)
                    cosine[:, usable] = np.where(np.isnan(value), 1e9, value)
                cosine[ids[part][:, None] == keys] = -np.inf
                row, column = best(cosine, keys, k)
                found.append(pd.DataFrame({"query_id": ids[part][row], "vec_id": keys[column], "cosine": cosine[row, column]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": ids[:0], "vec_id": keys[:0], "cosine": np.zeros(0)})

    met = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(run, "query_id bigint, vec_id bigint, cosine double")
    value = F.when(F.col("cosine") > 2, float("nan")).when(F.col("cosine") >= -2, F.round("cosine", 5))
    scored = met.select("query_id", "vec_id", value.alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, target: float = 0.97, tables: int = 8, bucket: int = 16, sample: int = 64, group: int = 16384) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest of (vec_id, embedding) to each query of the same form, itself excepted."""
    spark = vectors.sparkSession
    entries = settle(distinct(unit(vectors), k))
    n = entries.count()
    empty = "query_id bigint, vec_id bigint, cosine double, rank int"
    if not n:
        return spark.createDataFrame([], empty)
    planes = hyperplanes(tables, max(1, round(math.log2(max(2, n / bucket)))), len(entries.first().v))
    radius = tune(entries, planes, k, target, sample)
    asked = unit(queries).select(F.col("id").alias("key"), "v")
    bits = planes.shape[1]
    first = min(bits, max(0, math.ceil(math.log2(max(1, n / group)))))  # planes that make a group
    index = buckets(entries, planes).withColumn("group", F.col("bucket").bitwiseAND(F.lit((1 << first) - 1)).cast("int"))
    held = index.join(entries.select("key", "v"), "key")
    looks = buckets(asked, planes[:, :first], radius).select("key", "table", F.col("bucket").cast("int").alias("group")).join(asked, "key")

    def run(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, dtype=np.int64), "key": np.zeros(0, dtype=np.int64), "cosine": np.zeros(0)})
        if not len(rows) or not len(wanted):
            return none
        x, keys, ids = np.stack(rows["v"].to_numpy()), rows["key"].to_numpy(), wanted["key"].to_numpy()
        sides = (rows["bucket"].to_numpy()[:, None] >> np.arange(bits) & 1).astype(np.float64)
        found = [none]
        for part in np.array_split(np.arange(len(ids)), -(-len(ids) // 256)):
            y = np.stack(wanted["v"].to_numpy()[part])
            margin = y @ planes[int(wanted["table"].iloc[0])].T
            square, own = np.square(margin), margin > 0
            cost = (square * own).sum(axis=1)[:, None] + (square * (1 - 2.0 * own)) @ sides.T
            cosine = np.where(cost <= radius + 1e-9, y @ x.T, -np.inf)
            row, column = best(cosine, keys, k + 1)  # one of them can be the query's own
            found.append(pd.DataFrame({"query_id": ids[part][row], "key": keys[column], "cosine": cosine[row, column]}))
        return pd.concat(found)

    met = held.groupBy("table", "group").cogroup(looks.groupBy("table", "group")).applyInPandas(run, "query_id bigint, key bigint, cosine double")
    once = met.groupBy("query_id", "key").agg(F.round(F.max("cosine"), 5).alias("cosine"))
    few = once.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "key"))).where(F.col("place") <= k + 1)
    scored = few.join(entries.select("key", "ids"), "key").select("query_id", F.explode("ids").alias("vec_id"), "cosine").where("vec_id <> query_id")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k)
