"""Product codes against plain loops over all entries."""

import math
import random
from collections import defaultdict

import pytest

from veridica.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, error double, total string, _salt int"


def brute(rows, parts, entries, rounds):
    first = None
    kept = []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == (first or len(r[1])):
            first = first or len(r[1])
            kept.append((r[0], [math.floor(256 * x) for x in r[1]], r[2]))
    width = first // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    pick = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            near = defaultdict(list)
            for _, v, _ in kept:
                near[pick(v, p)[1]].append(cut(v, p))
            for i, members in near.items():
                new[p][i] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books = new
    out, totals = [], defaultdict(int)
    for i, v, label in kept:
        found = [pick(v, p) for p in range(parts)]
        totals[label] += sum(d for d, _ in found)
        out.append((i, label, [c for _, c in found], sum(d for d, _ in found)))
    return books, [(*r, totals[r[1]]) for r in out]


def vectors(n, seed, length=8):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.003, rng.gauss(0, 1)]) for _ in range(length)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(5)] + [(1000, rows[0][1], 1)] * 3  # copies, ties
    bad = [None, [None] + [0.0] * (length - 1), [math.nan] * length, [math.inf] + [0.0] * (length - 1), [0.0] * (length + 4), []]
    rows += [(-1 if i < 4 else 500 + i, b, 2) for i, b in enumerate(bad)] + [(None, [0.1] * length, None), (None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(90, 4, 16, 2), (90, 2, 64, 0), (9, 8, 64, 3)])
def test_codes_match_brute_force(spark, n, parts, entries, rounds):
    rows = vectors(n, n + parts)
    df = spark.createDataFrame([(*r, "x", 0.5, "y", 1) for r in rows], SCHEMA).repartition(3)
    books = vector_codes.train(df, parts, entries, rounds)
    coded = vector_codes.encode(df, books)
    got = vector_codes.with_group_error(coded, "label", "total").collect()
    want_books, want = brute(rows, parts, entries, rounds)
    assert books.tolist() == want_books
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2:])
    assert sorted([(r.vec_id, r.label, r.codes, r.error, r.total) for r in got], key=key) == sorted(want, key=key)
    decoded = vector_codes.decode(coded.select("vec_id", "codes", "error"), books).where("vec_id = 7").first()
    assert decoded.decoded == [x / 256 for p, c in enumerate(decoded.codes) for x in want_books[p][c]]


def test_codes_without_vectors(spark):
    df = spark.createDataFrame([(1, None, 1, "x", 0.5, "y", 1)], SCHEMA)
    books = vector_codes.train(df)
    assert books.shape[1] == 0 and vector_codes.encode(df, books).count() == 0
    assert vector_codes.with_group_error(vector_codes.encode(df, books), "label", "total").count() == 0


def test_codes_out_of_range(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="magnitude"):
        vector_codes.train(df, parts=2)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.train(df, parts=16)
