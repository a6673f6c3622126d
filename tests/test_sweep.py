"""Prefix sums and cut-offs against plain loops."""

import random
from datetime import date, timedelta

from veridica.operators import sweep


def test_as_of(spark):
    rng = random.Random(3)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(60)) if rng.random() < 0.85 else None
    rows = [(day(), day(), "x") for _ in range(600)] + [(date(2024, 1, 9), date(2024, 1, 9), "y")] * 300
    cuts = [date(2023, 12, 25) + timedelta(days=i) for i in range(90)]
    df = spark.createDataFrame(rows, "start_date date, end_date date, turn string").repartition(5)
    cutoffs = spark.createDataFrame([(c,) for c in [*cuts, *cuts[:5], None]], "cutoff date")
    got = {r.cutoff: (r.visible, r.ended) for r in sweep.as_of(df, cutoffs).collect()}
    seen = lambda c: [e for s, e, _ in rows if s is None or s <= c]
    assert got == {c: (len(seen(c)), sum(e is not None and e < c for e in seen(c))) for c in cuts}
    assert {(r.visible, r.ended) for r in sweep.as_of(df.limit(0), cutoffs).collect()} == {(0, 0)}
    assert sweep.as_of(df, cutoffs.limit(0)).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(-5, 9)) for i in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "k int, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: r.v for r in sweep.running_sums(df, ["k"], ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want
