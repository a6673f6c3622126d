"""Harmonic packing of token sequences.

A document's ids are cut into full sequences of the capacity and a rest; the rest is cut into
power-of-two lengths (up to ten pieces a document, one for each bit of the rest), so that each piece
is the longest of a reciprocal-capacity class: class k takes lengths in (capacity / (k + 1),
capacity / k], k a power of two, and its bins have no padding. A bin of class k holds
exactly k pieces. Each worker fills its own bins; what is left of a class in the end (fewer than
k pieces) is put together, again in descending lengths, so that only the worker's last bin may
need padding. There is no shuffle and no state beyond fewer than `capacity` open pieces a worker.

Defined results: null text is empty and gives the end id alone; very long texts are tokenised
whole; repeated rows are packed each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@functools.cache
def rank_encoder(path: str, pattern: str):
    """The byte-level BPE of a rank file: the ids of the tokenizers file beside it (same name, .json), at three times its speed.

    Texts are split at that file's added tokens. What the rank library cannot encode (its pattern
    search gives up on runs of some 100,000 blanks) goes to the tokenizers file itself.
    """
    import tiktoken

    beside = os.path.splitext(path)[0] + ".json"
    added = {}
    if os.path.exists(beside):
        with open(beside, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except BaseException as error:  # a panic of the library is no Exception
            if not (isinstance(error, ValueError) or type(error).__name__ == "PanicException") or not os.path.exists(beside):
                raise
            return json_encoder(beside)(text)

    return encode


@functools.cache
def json_encoder(path: str):
    """The tokenizer of a JSON file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of n ids: full sequences, then the rest's powers of two in descending order."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def leftovers(open_: dict[int, list], capacity: int) -> Iterator[list]:
    """Bins from the unfilled classes: descending powers of two leave no gap before a bin is full."""
    rows, used = [], 0
    for length in sorted(open_, reverse=True):
        for row in open_[length]:
            if used + length > capacity:
                yield rows
                rows, used = [], 0
            rows.append(row)
            used += length
    if rows:
        yield rows


def _pack(encoder: tuple, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_encoder(encoder[0]) if len(encoder) == 1 else rank_encoder(*encoder)
        open_: dict[int, list] = {}
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def close(rows: list) -> None:
            nonlocal sequence
            at = 0
            for row in rows:
                out.append((*row, sequence, at))
                at += row[2]
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            names = [x.split()[0] for x in PIECES.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(np.array(encode(text.as_py() or ""), dtype="<u4"), np.uint32(end_id)).astype("<u4")
                start = 0
                for length in cut(len(ids), capacity):
                    row = (doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids))
                    start += length
                    have = open_.setdefault(length, [])
                    have.append(row)
                    if len(have) * length == capacity:
                        close(have)
                        open_[length] = []
                if len(out) >= 20_000:
                    yield flush()
        for rows in leftovers(open_, capacity):
            close(rows)
        yield flush()

    return run


def pack(docs: DataFrame, encoder: tuple, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    encoder: (path of a tokenizers JSON file,) or (path of a rank file, its split pattern).
    capacity must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(encoder, capacity, end_id), PIECES)
