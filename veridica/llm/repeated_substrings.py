"""Removal of repeated substrings by prefix-free parsing.

A rolling-hash trigger is the smallest k-gram hash among the k-grams of a string of `size` bytes
(the rightmost of equal ones), so every such string has one trigger, and equal strings have it at
the same place. All strings around one trigger form a phrase: their union, cut by content alone
at both ends. The parse lists each document's phrases; the dictionary holds each distinct phrase
once with its number of occurrences.

A string of `size` bytes lies inside one phrase, so the corpus order of strings is needed among the
phrases of one trigger only, and of the parse no more than how often it has each phrase. A phrase
that occurs twice repeats all its strings. Phrases that occur once but share a trigger with others
are compared in the dictionary: the suffix array of their bytes, by prefix doubling, ranks every
suffix by its first `size` bytes; strings of equal rank at equal distance from one trigger are
equal, byte by byte, and so repeats. Unique regions of the corpus drop out at the trigger count,
so the work follows the repetitive part. Phrases are told apart by 64-bit BLAKE2b digests within
a trigger. Triggers with more than `wide` distinct phrases are compared by a distributed group-by
of two 64-bit hashes of each string rather than in one task; results are the same.

Defined results: null is empty text; texts under `size` bytes lose nothing; a repeated row is a
second occurrence of all its strings; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridica.llm.common import BASE, discard, materialize, mix64, powers, row_slices, utf8_bytes

GRAM = 24
_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of a text that are parsed at a time; must stay under 2 ** 24.
_CHUNK = 4 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on; GRAM = 16 + 8."""
    h, base = _BYTE_VALUE[data], BASE
    eight = None
    for step in (1, 2, 4, 8):
        if step == 8:
            eight = h
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
    # h covers 16 bytes, eight covers 8; base is BASE ** 16
    n = len(data) - GRAM + 1
    power8 = np.uint64(pow(BASE, 8, 1 << 64))
    return mix64(h[:n] * power8 + eight[16 : 16 + n])


def triggers(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger position, its hash, first and last start of the strings of `size` bytes that have it)."""
    n = len(data) - size + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    grams = _gram_hashes(data)
    best = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    width, have = size - GRAM + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if width > have:
        best = np.minimum(best[: n], best[width - have : width - have + n])
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], n) - 1
    place = (_PLACE - (best[first] & _PLACE)).astype(np.int64)
    return place, grams[place], first, last


def _chunked(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """triggers() of a long text, chunk by chunk; chunks overlap by size - 1 bytes, so a start is in one chunk."""
    for at in range(0, max(1, len(data) - size + 1), _CHUNK):
        yield tuple(x if x.dtype == np.uint64 else x + at for x in triggers(data[at : at + _CHUNK + size - 1], size))


def _pair(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _text_id(raw: bytes) -> tuple[int, int]:
    return _pair(hashlib.blake2b(raw, digest_size=16).digest())


PARSE = "t1 bigint, t2 bigint, place bigint, before int, after int, trigger bigint, phrase bigint"


def _parse(size: int):
    names = [x.split()[0] for x in PARSE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.blake2b
        for batch in batches:
            for part in row_slices(batch, "text", 4 << 20):
                data, offsets = utf8_bytes(part.column("text"))
                columns: list[list] = [[] for _ in names]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if b - a < size:
                        continue
                    raw = data[a:b].tobytes()
                    t1, t2 = _text_id(raw)
                    for place, trigger, first, last in _chunked(data[a:b], size):
                        phrase = b"".join([digest(raw[i : j + size], digest_size=8).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)])
                        n = len(place)
                        for c, x in zip(columns, (np.full(n, t1), np.full(n, t2), place, (place - first).astype(np.int32), (last - place).astype(np.int32), trigger.view(np.int64), np.frombuffer(phrase, dtype=np.int64)), strict=True):
                            c.append(x)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return run


def _texts(once: bool):
    """Texts with their ids, compressed for the shuffle; once: equal texts of a partition leave it as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in row_slices(batch, "text", 4 << 20):
                data, offsets = utf8_bytes(part.column("text"))
                out: list[tuple] = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    raw = data[a:b].tobytes()
                    key = _text_id(raw)
                    if once and key in seen:
                        continue
                    if once:
                        seen.add(key)
                    out.append((doc_id, *key, pack(raw)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names=["doc_id", "t1", "t2", "packed"])

    return run


TEXTS = "doc_id bigint, t1 bigint, t2 bigint, packed binary"
DICTIONARY = "trigger bigint, phrase bigint, n bigint, t1 bigint, t2 bigint, place bigint, before int, after int, bytes binary"


def _contents(size: int):
    """Phrases' bytes from their texts; each row has a text and an array of phrases to take from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DICTIONARY.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for t1, t2, packed, want in zip(*(batch.column(c) for c in ("t1", "t2", "packed", "want")), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
                one, two = t1.as_py(), t2.as_py()
                for w in want.as_py():
                    at = w["place"]
                    out.append((w["trigger"], w["phrase"], w["n"], one, two, at, w["before"], w["after"], raw[at - w["before"] : at + w["after"] + size]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 9, kinds, strict=True)], names=names)

    return run


def suffix_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes of data by their first `size` bytes: equal ranks, equal bytes (a suffix that ends earlier is smaller).

    Prefix doubling: the ranks of the first k bytes of i and of i + k give those of 2 k bytes, the
    last step overlapping so that it ends at exactly `size`.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    width = min(7, size)
    key = np.zeros(n, dtype=np.uint64)  # 7 bytes, each plus one, so that the end is smaller than any byte
    for j in range(width):
        key *= np.uint64(257)
        key[: n - j] += data[j:].astype(np.uint64) + np.uint64(1)
    ranks = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while width < size:
        step = min(width, size - width)
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = ranks[step:] + 1
        ranks = np.unique(ranks * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        width += step
    return ranks


def _strings(row_start: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase row, bytes from the string's start to the trigger, start) of every string in the phrases."""
    count = before.astype(np.int64) + after + 1
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, before[row].astype(np.int64) - step, row_start[row] + step


def _string_hashes(blob: np.ndarray, start: np.ndarray, size: int, base: int) -> np.ndarray:
    up, down = powers(len(blob), base), powers(len(blob), pow(base, -1, 1 << 64))
    sums = np.zeros(len(blob) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[blob] * up[:-1], out=sums[1:])
    return mix64((sums[start + size] - sums[start]) * down[start])


def _blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]


RUNS = "t1 bigint, t2 bigint, first bigint, last bigint"


def _runs(t1, t2, place, row, lead) -> pa.RecordBatch:
    """Repeated strings (phrase row, lead) as runs of starts; strings are in order of row, then falling lead."""
    if not len(row):
        none = np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(none)] * 4, names=["t1", "t2", "first", "last"])
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lead[1:] != lead[:-1] - 1)])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(row)) - 1
    at = row[a]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[at], t2[at], place[at] - lead[a], place[at] - lead[b])], names=["t1", "t2", "first", "last"])


def _compare(size: int):
    """Ranks the strings of each trigger's phrases; the rows of a trigger follow each other."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        col = {c: np.asarray(table.column(c).combine_chunks()) for c in ("trigger", "n", "t1", "t2", "place", "before", "after")}
        blob, starts = _blob(table.column("bytes").combine_chunks())
        row, lead, start = _strings(starts, col["before"], col["after"])
        group = np.cumsum(np.concatenate([[0], col["trigger"][1:] != col["trigger"][:-1]]))[row]
        rank = suffix_ranks(blob, size)[start]
        order = np.lexsort((rank, lead, group))
        same = (rank[order][1:] == rank[order][:-1]) & (lead[order][1:] == lead[order][:-1]) & (group[order][1:] == group[order][:-1])
        repeated = np.zeros(len(row), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        repeated &= col["n"][row] == 1  # the others are repeated as a whole
        return _runs(col["t1"], col["t2"], col["place"], row[repeated], lead[repeated])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        held_rows = 0
        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = pa.Table.from_batches([batch.slice(at, 4000)])
                trigger = np.asarray(part.column("trigger").combine_chunks())
                turns = np.flatnonzero(trigger[1:] != trigger[:-1])
                if len(turns) and held_rows + len(part) >= 4000:
                    cut = int(turns[-1]) + 1  # the last trigger may go on
                    yield emit(pa.concat_tables([*held, part.slice(0, cut)]))
                    held, held_rows, part = [], 0, part.slice(cut)
                held.append(part)
                held_rows += len(part)
        if held_rows:
            yield emit(pa.concat_tables(held))

    return run


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                col = {c: np.asarray(part.column(c)) for c in ("trigger", "n", "t1", "t2", "place", "before", "after")}
                blob, starts = _blob(part.column("bytes"))
                row, lead, start = _strings(starts, col["before"], col["after"])
                one, two = (_string_hashes(blob, start, size, base).view(np.int64) for base in (BASE, BASE ^ (1 << 40)))
                cells = [col["trigger"][row], lead.astype(np.int32), one, two, col["t1"][row], col["t2"][row], col["place"][row] - lead, col["n"][row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["trigger", "lead", "h1", "h2", "t1", "t2", "start", "n"])

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<struct<first:bigint,end:bigint>>"


def _remove(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), span]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, runs in zip(*(batch.column(c) for c in ("doc_id", "packed", "runs")), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py()) if len(packed.as_py()) else b""
                kept, removed, at, spans = [], 0, 0, []
                if runs.is_valid:
                    first, last = (np.asarray(runs.values.field(k)) for k in ("first", "last"))
                    order = np.argsort(first, kind="stable")
                    a, b = first[order], np.maximum.accumulate(last[order] + size)
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    for i, j in zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True):
                        kept.append(raw[at:i])
                        removed += j - i
                        at = j
                        spans.append({"first": i, "end": j})
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((doc_id.as_py(), len(raw), removed, len(spans), hashlib.sha256(rest).hexdigest(), rest if with_text else None, spans))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, size: int = 200, wide: int = 20_000, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans.

    Removes each byte covered by a string of `size` bytes that also starts anywhere else in the
    input. Runs two jobs that write to the shared folder (the parse, and the dictionary's
    runs); the rest is lazy.
    """
    if size <= GRAM:
        raise ValueError(f"size must exceed {GRAM}")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parse = materialize(rows.mapInArrow(_parse(size), PARSE), "parse")
    alike = parse.groupBy("trigger").agg(F.count("*").alias("k")).where("k > 1")
    shared = parse.join(alike.select("trigger"), "trigger")
    columns = ["place", "t1", "t2", "before", "after"]
    phrases = materialize(shared.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), *[F.min_by(c, F.struct("t1", "t2", "place")).alias(c) for c in columns]), "phrases")
    several = phrases.groupBy("trigger").agg(F.count("*").alias("variants"), F.min("n").alias("least")).where("variants > 1 and least = 1")
    open_ = phrases.join(several, "trigger")
    want = open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("trigger", "phrase", "n", "place", "before", "after")).alias("want"))
    one_text = rows.mapInArrow(_texts(True), TEXTS).select("t1", "t2", "packed").join(want, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    dictionary = one_text.mapInArrow(_contents(size), DICTIONARY).join(several.where(F.col("variants") > wide).select("trigger", F.lit(True).alias("is_wide")), "trigger", "left")
    dictionary = materialize(dictionary, "dictionary")
    narrow = dictionary.where("is_wide is null").repartition("trigger").sortWithinPartitions("trigger", "phrase")
    runs = narrow.mapInArrow(_compare(size), RUNS)
    strings = dictionary.where("is_wide").mapInArrow(_fingerprints(size), "trigger bigint, lead int, h1 bigint, h2 bigint, t1 bigint, t2 bigint, start bigint, n bigint")
    twice = strings.groupBy("trigger", "lead", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1")
    wide_runs = strings.where("n = 1").join(twice, ["trigger", "lead", "h1", "h2"], "left_semi").select("t1", "t2", F.col("start").alias("first"), F.col("start").alias("last"))
    whole = parse.join(phrases.where("n > 1").select("trigger", "phrase"), ["trigger", "phrase"]).select("t1", "t2", (F.col("place") - F.col("before")).alias("first"), (F.col("place") + F.col("after")).alias("last"))
    every = whole.unionByName(runs).unionByName(wide_runs)
    per_text = materialize(every.groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")
    discard(parse, phrases, dictionary)
    return rows.mapInArrow(_texts(False), TEXTS).join(per_text, ["t1", "t2"], "left").mapInArrow(_remove(size, with_text), RESULT)
