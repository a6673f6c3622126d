"""Periodic run detection: multi-scale minimizers, seed extension and direct lag scans.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least max(min_length, min_exponent * q) that no neighbouring word extends keeping q.

Scale P (a power of two) looks for the periods from P to 2P - 1:

* Every stretch of 2P words gets an exact name, by naming pairs of names of half the length. Inside
  a run of period q < 2P, equally named stretches lie a multiple of q apart: two that were closer
  would give the run a smaller period.
* Of every window of P stretches the least (by a hash of its name, then by place) is a minimizer.
  A run of four periods holds a window and the same window q words on, hence the same minimizer
  twice, q apart and with no equal one between. So of the minimizers with equal names only neighbours
  are compared, and those P to 2P - 1 apart are seeds.
* A seed is extended in both directions by comparing words q apart. Its two stretches already repeat
  for more than two periods, so that chance seeds hardly occur; seeds inside a run that is
  known are skipped.

Periods below `scan` are found by comparing all words q apart. Names are exact, so no run is lost to
a collision. Min_exponent must be at least 4, which is what the windows need.

Work is proportional to the words times the logarithm of the longest document. Documents of a batch are
handled together, longest first, so that a scale reads a prefix of the batch. Nothing is shuffled.

Defined results: null and blank texts have no words, no runs and collapse to the empty text; very long
texts are searched whole (a document is one row, its words are held in one task); repeated rows give
repeated rows; other columns are passed through, the names n_words, runs and collapsed excepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridica.llm.common import mix64, row_slices

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from `at` on, in the direction of step (1 or -1), equal those lag places on."""
    n, chunk = 0, 64
    room = len(words) - lag - at if step > 0 else at + 1
    while n < room:
        size = min(chunk, room - n)
        low = at + n if step > 0 else at - n - size + 1
        differ = words[low : low + size] != words[low + lag : low + lag + size]
        if differ.any():
            return n + int(np.argmax(differ if step > 0 else differ[::-1]))
        n, chunk = n + size, chunk * 2
    return n


def _seeds(names: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of neighbouring equal minimizers that lie scale to 2 * scale - 1 apart."""
    low = np.uint64((1 << 32) - 1)
    order = (mix64(names.astype(np.uint64) + np.uint64(1)) & ~low) | np.arange(len(names), dtype=np.uint64)
    width = 1
    while width < scale:  # least of every window of `scale` places
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    places = (order & low).astype(np.int64)
    places = places[np.flatnonzero(np.diff(places, prepend=-1))]
    places = places[np.argsort(names[places], kind="stable")]
    period = np.diff(places)
    found = (np.diff(names[places]) == 0) & (period >= scale) & (period < 2 * scale)
    return places[:-1][found], period[found]


def find_runs(words: np.ndarray, lengths: np.ndarray, min_length: int = 6, min_exponent: int = 4, scan: int = 8) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; no run crosses documents.

    words: codes of the words of all documents, each document followed by a code of its own, longest
    document first. lengths: words of each document. scan: a power of two.
    """
    if min_exponent < 4 or scan < 1 or scan & (scan - 1):
        raise ValueError("runs need an exponent of 4 or more, scan must be a power of two")
    ends = np.cumsum(lengths + 1)
    prefix = lambda least: int(ends[np.searchsorted(-lengths, -least, "right") - 1]) if len(lengths) and lengths[0] >= least else 0
    found: list[np.ndarray] = [np.empty((0, 3), np.int64)]
    for q in range(1, scan):
        least = max(min_length, min_exponent * q)
        part = words[: prefix(least)]
        starts, stops = _stretches(part[:-q] == part[q:])
        long = stops - starts + q >= least
        found.append(np.stack([starts[long], stops[long] + q - starts[long], np.full(long.sum(), q)], axis=1))
    names, span, scale = pd.factorize(words)[0].astype(np.int64), 1, scan
    while size := prefix(max(min_length, min_exponent * scale)):
        part = words[:size]
        names = names[: size - span + 1]
        while span < 2 * scale:
            pairs = names[:-span] * np.int64(len(words) + 1) + names[span:]
            names, span = pd.factorize(pairs)[0].astype(np.int64), 2 * span
        places, periods = _seeds(names, scale)
        order = np.lexsort((places, periods))
        runs, known = [], (0, 0)  # (period, end) of the run found last
        for at, q in zip(places[order].tolist(), periods[order].tolist(), strict=True):
            if known[0] == q and at + q < known[1]:
                continue
            start = at + 1 - _reach(part, at, q, -1)
            stop = at + _reach(part, at, q, 1) + q
            known = (q, stop)
            if stop - start >= max(min_length, min_exponent * q):
                runs.append((start, stop - start, q))
        if runs:
            found.append(np.array(runs, dtype=np.int64))
        scale *= 2
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), dtype=bool)
    smallest[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batch(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n_words, runs, collapsed) of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, owner = split.flatten(), np.asarray(pc.list_parent_indices(split))
    full = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(full), owner[np.asarray(full)]
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))

    codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    by_length = np.argsort(-counts, kind="stable")
    lengths = counts[by_length]
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))
    words = np.empty(begin[-1], dtype=np.int64)
    words[begin[1:] - 1] = len(codes) + np.arange(len(lengths))
    inside = np.ones(len(words), dtype=bool)
    inside[begin[1:] - 1] = False
    # places of the batch's words, document by document in the order of lengths
    place = np.repeat(first[by_length] - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths) + np.arange(len(codes))
    words[inside] = codes[place]

    runs = find_runs(words, lengths, min_length, min_exponent)
    slot = np.searchsorted(begin, runs[:, 0], "right") - 1
    row, start = by_length[slot], runs[:, 0] - begin[slot]
    order = np.lexsort((runs[:, 2], start, row))
    row, start, length, period = row[order], start[order], runs[order, 1], runs[order, 2]

    cover = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(cover, first[row] + start + period, 1)
    np.add.at(cover, first[row] + start + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    left = np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=len(texts)))))
    lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), flat.filter(pa.array(kept)))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts)))))
    structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
    return pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), collapsed.cast(pa.string())


def periodic_runs(docs: DataFrame, column: str = "text", min_length: int = 6, min_exponent: int = 4, batch_bytes: int = 4 << 20) -> DataFrame:
    """docs without the column, plus n_words, runs (array of start, length, period; by start, then period) and collapsed.

    collapsed: the words left once every run is cut to its first period, joined by one space.
    """
    others = [c for c in docs.columns if c not in (column, "n_words", "runs", "collapsed")]
    rows = docs.select(*others, F.col(column).cast("string").alias("collapsed"))
    schema = rows.select(*others, F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), "collapsed").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "collapsed", batch_bytes):
                made = _batch(part.column("collapsed"), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *made], names=[*others, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)


#: Runs by joining equal triples of words within a document, without minimizers. A stretch of triples
#: equal at lag q is a run's length less q and 2; of equal stretches the smallest lag counts.
ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: list_transform(range(8), lambda b: (ascii(c)::BIGINT >> b::INT) & 1)))),
           lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
m AS (SELECT doc_id, h, h // 10 AS g, w, len(w) AS n FROM s),
c AS (SELECT doc_id, h, g, w, n, CASE WHEN n > 0 THEN g % n END AS a FROM m),
p AS (SELECT doc_id, n, w, a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM c),
t AS (SELECT doc_id, n, CASE WHEN p IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
u AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
k AS (SELECT doc_id, n, i, word, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o AS triple FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.triple = y.triple AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
f AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM f GROUP BY doc_id, q, island HAVING count(*) + 2 + q >= greatest(6, 4 * q)),
v AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
z AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
        first(start ORDER BY length DESC, start, period) AS start, first(period ORDER BY length DESC, start, period) AS period, max(length) AS length FROM v GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM v),
l AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_over FROM u ANTI JOIN d USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN l USING (doc_id)
"""
