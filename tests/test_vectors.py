"""Recall of the hyperplane index against all cosines."""

import numpy as np
import pytest

from veridica.operators import vectors


def exact(ids, data, asked, k):
    """Top k as (cosine, id), with all rows of an equal rounded cosine in the order of ids."""
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    out = {}
    for q in asked:
        cosine = np.round(unit @ unit[np.flatnonzero(ids == q)[0]], 5)
        order = sorted((-c, i) for c, i in zip(cosine, ids, strict=True) if i != q)
        out[q] = {int(i) for _, i in order[:k]}
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(got.get(q, set()) & ids) for q, ids in want.items()) / sum(len(ids) for ids in want.values())


def test_recall_on_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    found = vectors.nearest(table, table.where("vec_id % 100 = 0"), 10).collect()
    assert recall(found, exact(ids, data, ids[ids % 100 == 0], 10)) >= 0.9


def clustered(n, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, 32))
    return centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, 32))


def test_clusters_need_few_candidates_and_copies_none(spark):
    data = clustered(6000)
    data[3000:5000] = data[7]  # a third of all rows are copies
    ids = np.arange(len(data))
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, data, strict=True)], "vec_id long, embedding array<double>, key string").repartition(4)
    extra = spark.createDataFrame([(9001, None, "x"), (9002, [0.0] * 32, "x"), (9003, [float("nan")] * 32, "x"), (9004, [None] * 32, "x")], df.schema)
    queries = df.where("vec_id % 100 = 0").unionByName(extra)
    found = vectors.nearest(df.unionByName(extra), queries, 10).collect()
    asked = ids[ids % 100 == 0]
    assert recall(found, exact(ids, data, asked, 10)) >= 0.9
    assert {r.vec_id for r in found if r.query_id == 3100} == {7, *range(3000, 3009)}
    entries = vectors.distinct(vectors.unit(df), 10)
    assert entries.count() == 4000 and entries.where("size(ids) > 11").count() == 0
    planes = vectors.hyperplanes(8, 8, 32)
    radius = vectors.tune(entries, planes, 10, 0.97, 64)
    looks = vectors.buckets(vectors.unit(queries).withColumnRenamed("id", "key"), planes, radius).withColumnRenamed("key", "query_id")
    pairs = looks.join(vectors.buckets(entries, planes), ["table", "bucket"]).select("query_id", "key").distinct().count()
    assert pairs < 0.25 * len(asked) * 4000


def test_probes():
    rng = np.random.default_rng(2)
    for bits in (1, 4, 9):
        margins, radius = rng.normal(size=bits), 1.5
        masks = vectors.probes(margins, radius).tolist()
        every = [m for m in range(1 << bits) if sum(margins[i] ** 2 for i in range(bits) if m >> i & 1) <= radius]
        assert sorted(masks) == every


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert vectors.nearest(empty, empty, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert vectors.nearest(one, one, 3).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_small_tables_are_exact(spark, k):
    data = np.eye(6)[:, :4] + 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = vectors.nearest(df, df, k).collect()
    assert recall(found, exact(np.arange(6), data, range(6), k)) == 1


def test_pairs_of_blocks_agree_with_all_pairs(spark):
    """Both searches with many small blocks and groups; no join has pairs of vectors as rows."""
    data = clustered(1200)
    data[300:400] = data[7]
    ids = np.arange(len(data))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, data, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    odd = spark.createDataFrame([(9001, None), (9002, [1.0, None] * 16), (9003, [1.0])], df.schema)
    queries, asked = df.where("vec_id % 100 = 0"), ids[ids % 100 == 0]
    want = exact(ids, data, asked, 10)
    found = vectors.exact(df.unionByName(odd), queries, 10, block=100, asked=5)
    assert recall(found.collect(), want) == 1.0
    last = [(r.vec_id, r.cosine) for r in vectors.exact(df.limit(3).unionByName(odd), queries.limit(1), 9).orderBy("rank").collect()]
    assert last[-3:] == [(9001, None), (9002, None), (9003, None)]
    near = vectors.nearest(df, queries, 10, group=64)
    assert recall(near.collect(), want) >= 0.9
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
