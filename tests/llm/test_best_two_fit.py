"""Packing against the same rule applied piece by piece, and the ids against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veridica.llm import best_two_fit


def brute(lengths, capacity):
    """Bins of best-two-fit, one piece at a time."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while fitting := [x for x in left if x <= gap]:
            own.append(fitting[-1])
            left.remove(fitting[-1])
            gap -= fitting[-1]
        if gap and len(own) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[:i] if own[-1] < a + b <= gap + own[-1]]
            if pairs:
                _, a, b = max(pairs)
                left = sorted([*left, own.pop()])
                left.remove(a)
                left.remove(b)
                own += [a, b]
        bins.append(sorted(own, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_matches_packing_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 10, 60, 100])
    few = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
    lengths = [rng.choice(few) if seed % 2 else rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    bins = best_two_fit.plan(Counter(lengths), capacity)
    got = [b for b, times in bins for _ in range(times)]
    assert got == brute(lengths, capacity)


def test_two_fit_replaces():
    """Greedy alone fills 6 + 3; 2 + 2 in place of the 3 is full."""
    assert best_two_fit.plan(Counter([6, 3, 2, 2]), 10) == [([6, 2, 2], 1), ([3], 1)]


def test_plan_is_bounded():
    """A million times the pieces take hardly more patterns, and few more bins than their ids fill."""
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 1024) for _ in range(20_000))
    small, large = best_two_fit.plan(counts, 1024), best_two_fit.plan({k: n * 1_000_000 for k, n in counts.items()}, 1024)
    assert len(large) <= 1024 * 34 and len(large) < 4 * len(small)
    assert sum(t for _, t in small) <= 1.01 * sum(k * n for k, n in counts.items()) / 1024 + 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_pack(spark, partitions):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "word", "é", "漢字", "x1"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "ab " * 9000), (903, " ".join(["word"] * 2047)), (903, texts[0]), (None, "null id"), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, 3, 4, "x") for i, t in rows], "doc_id long, text string, length int, rank int, task string").repartition(partitions)
    for encoder in ((public.path("byte_bpe_50k.tiktoken"), public.PATTERN), (public.path("byte_bpe_50k.json"),)):
        got = best_two_fit.pack(docs, encoder).collect()
        ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, t in rows]
        want = Counter()
        for i, x in ids:
            starts = np.cumsum([0, *best_two_fit.cut(len(x), 1024)])
            want.update((i, k, int(a), int(b - a), zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            places.sort()
            assert [a for a, _ in places] == list(np.cumsum([0, *[n for _, n in places]])[:-1]) and sum(n for _, n in places) <= 1024
        assert sorted(sorted((n for _, n in b), reverse=True) for b in bins.values()) == sorted(brute([r.length for r in got], 1024))
    assert best_two_fit.pack(docs.limit(0), encoder).count() == 0
