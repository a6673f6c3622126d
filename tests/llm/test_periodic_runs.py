"""Runs against a direct search over all periods."""

import random

import numpy as np
import pytest

from veridica.llm import periodic_runs


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    out = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "x\x0b" * 40, "a\x85b " * 9, "é 漢字 " * 30, "word " * 30_000, "a b " * 20 + "a b c " * 20]
    for kind in range(120):
        vocab = [chr(97 + i) for i in range(rng.choice([1, 2, 3, 30]))]
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(1, 4)):
            block = [rng.choice(vocab) for _ in range(rng.randint(1, 45))]
            block = block * rng.randint(1, 2)  # blocks that are no smallest period
            words += (block * rng.randint(2, 7))[: rng.randint(4, 400)] + [rng.choice(vocab) for _ in range(rng.randint(0, 8))]
        if kind % 3 == 0:  # words like those of Thue and Morse, which polynomial hashes confuse
            words += [vocab[bin(i).count("1") % 2 % len(vocab)] for i in range(64)] * 5
        out.append(" ".join(words))
    return out + out[3:6]


@pytest.mark.parametrize("batch_bytes", [1, 4 << 20])
def test_runs_match_brute_force(spark, batch_bytes):
    rows = [(i // 2, t, "x", 7, "y") for i, t in enumerate(texts())] + [(None, "b " * 9, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, length int, start string").repartition(3)
    got = periodic_runs.periodic_runs(docs, batch_bytes=batch_bytes)
    assert got.columns == ["doc_id", "length", "start", "n_words", "runs", "collapsed"]
    want = []
    for doc_id, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = [(0, len(words), 1)] if len(words) > 10_000 else brute_runs(words)
        want.append((doc_id, len(words), runs, brute_collapse(words, runs)))
    key = lambda x: (x[0] is None, *((v or 0) if i == 0 else v for i, v in enumerate(x)))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()], key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("scan", [1, 2, 8, 64])
def test_scales_agree(scan):
    """Every split between lag scans and minimizers gives the same runs."""
    for text in texts()[10:]:
        words = (text or "").split()
        codes = np.array([*(sorted(set(words)).index(w) for w in words), len(words)], dtype=np.int64)
        assert [tuple(r) for r in periodic_runs.find_runs(codes, np.array([len(words)]), scan=scan).tolist()] == brute_runs(words)
