"""Best-two-fit packing of token sequences.

A bin is filled greedily, longest document first, until none of the unpacked ones fits. Then its
smallest document is put back if two unpacked ones fit the gap that it leaves more tightly, the best
such pair taking its place. Only documents longer than a bin are cut, into full pieces after a first one
that may be shorter.

A bin depends on the lengths alone. So the plan is made from the number of pieces of each length, at most
`capacity` numbers: a bin's lengths are a pattern, repeated for as long as none of its lengths runs short, as packing
bin by bin would. Each repetition at least halves the pieces left of one length, so that a plan has at most
capacity * log2(pieces) patterns, whatever the number of documents. The plan is global: there is one
last bin, not one a worker.

Pieces get their place by (length, rank). A task ranks its pieces of each length as it
tokenises; pieces are written with task and rank, tasks' counts are added up along the tasks of each length,
and the sum tells the first global rank of a task's pieces. A piece finds its pattern, repetition and
place by a binary search in the plan. Texts never move; pieces (some 60 bytes) are joined once to the counts.

Defined results: null text is empty and gives the end id alone; very long texts are tokenised whole; repeated
rows are packed each; ids that do not cast to a long are null; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridica.llm.common import materialize
from veridica.llm.packing import json_encoder, rank_encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
_SHIFT = 48


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of n ids: only what is longer than a bin is cut, the first piece takes the rest."""
    full, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def tokenise(docs: DataFrame, encoder: tuple, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with the task that made it and its rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_encoder(encoder[0]) if len(encoder) == 1 else rank_encoder(*encoder)
        task, ranks = TaskContext.get().partitionId(), Counter()
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(np.array(encode(text.as_py() or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                start = 0
                for piece, length in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, ranks[length]))
                    ranks[length] += 1
                    start += length
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.expr("try_cast(doc_id as bigint)").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _pair(lengths: list[int], left: dict[int, int], most: int, least: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum up to `most` and over `least`; of equal sums the one with the longest."""
    low, high = 0, bisect.bisect_right(lengths, most) - 1
    best, found = least, None
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > most or low == high and left[lengths[low]] < 2:
            high -= 1
        else:
            if total > best:
                best, found = total, (lengths[high], lengths[low])
            low += 1
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin in descending order, number of such bins) for counts of pieces by length."""
    left = {length: n for length, n in counts.items() if n > 0}
    lengths, bins = sorted(left), []
    while lengths:
        own, gap, open_, unpacked = [], capacity, list(lengths), dict(left)

        def take(length: int, open_: list[int] = open_, unpacked: dict[int, int] = unpacked) -> None:
            unpacked[length] -= 1
            if not unpacked[length]:
                open_.pop(bisect.bisect_left(open_, length))

        while at := bisect.bisect_right(open_, gap):
            own.append(open_[at - 1])
            gap -= own[-1]
            take(own[-1])
        if gap and len(own) > 1 and (pair := _pair(open_, unpacked, gap + own[-1], own[-1])):
            own[-1:] = pair
        used = Counter(own)
        times = max(1, min((left[length] - 1) // n for length, n in used.items()))
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                lengths.pop(bisect.bisect_left(lengths, length))
        bins.append((sorted(own, reverse=True), times))
    return bins


def segments(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length and first rank as one key, pieces per bin, first bin, offset of the first), by key."""
    rows, ranks, first = [], Counter(), 0
    for own, times in bins:
        offset = 0
        for length, n in Counter(own).items():
            rows.append(((length << _SHIFT) + ranks[length], n, first, offset))
            ranks[length] += n * times
            offset += n * length
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            key = (length << _SHIFT) + rank
            at = np.searchsorted(table[:, 0], key, "right") - 1
            turn, slot = np.divmod(key - table[at, 0], table[at, 1])
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(table[at, 2] + turn), pa.array(table[at, 3] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PACKED.split(", ")])

    return run


def pack(docs: DataFrame, encoder: tuple, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    encoder: (path of a tokenizers JSON file,) or (path of a rank file, its split pattern).
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = materialize(tokenise(docs, encoder, capacity, end_id), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(_place(segments(plan(histogram, capacity))), PACKED)
