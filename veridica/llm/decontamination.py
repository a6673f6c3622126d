"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed in blocks: every token of a block has a posting list of its
word positions, and the index of the whole corpus is stored in the shared folder; it knows nothing
of the tests and serves any benchmark. A search goes over the blocks in parallel. Test windows are
filed under the term that is rarest in the benchmark; in a block only the windows filed under
terms of the block are looked at. Of each, the term with the shortest list in the block gives the
candidates, and the offset-adjusted lists of the other terms are intersected with them, for all
windows at once. Exact phrases and proximity matches (every term within `slop` words of its place)
are returned. Documents are never shuffled.

Test windows: `size` consecutive words of an item; an item of fewer words, but not none, is one
window. Words: runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII. Words are compared
by 64-bit hashes; a phrase of ten is as good as certain, a window of one word is not quite.

Defined results: null or empty text has no words and no hits; null items and items without words
never match; rows of a repeated item_id count as one item; repeated documents each get their row;
extra columns are ignored. doc_id must cast to a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridica.llm.common import materialize, row_slices, utf8_bytes, words

INDEX = "block bigint, doc_ids array<bigint>, text_hashes array<bigint>, first array<bigint>, terms array<bigint>, ends array<bigint>, positions array<int>"
SPANS = "array<struct<first:bigint,last:bigint>>"
_HITS = f"block bigint, place bigint, doc_id bigint, text_hash bigint, n_words bigint, items array<string>, spans {SPANS}, near {SPANS}"
_SPAN_LIST = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
#: Candidates that are checked at a time.
_CANDIDATES = 1 << 20


def _index(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in row_slices(batch, "text", block_bytes):
                h, first = words(*utf8_bytes(part.column("text")))
                order = np.argsort(h, kind="stable")
                terms, n = np.unique(h[order], return_counts=True)
                cells = [part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), first.astype(np.int64), terms.view(np.int64), np.cumsum(n), order.astype(np.int32)]
                kinds = [pa.int64()] * 5 + [pa.int32()]
                names = ["doc_ids", "text_hashes", "first", "terms", "ends", "positions"]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([c], pa.list_(k)) for c, k in zip(cells, kinds, strict=True)]], names=["block", *names])
                block += 1

    return run


def build_index(docs: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """Postings of every token of every document, one row per block of documents, stored in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return materialize(rows.mapInArrow(_index(block_bytes), INDEX), "postings")


class Tests:
    """Items as numbers of their terms, and their windows filed under the term rarest in the benchmark."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        hashes = [words(*utf8_bytes(pa.array([t])))[0] for _, t in items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.terms, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        self.ids = ids.astype(np.int32)
        length = np.array([len(h) for h in hashes], dtype=np.int64)
        begin = np.cumsum(length) - length
        width = np.minimum(length, size)
        n = np.where(length > 0, length - width + 1, 0)
        owner = np.repeat(np.arange(len(items)), n)
        self.start = begin[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.width, self.owner = width[owner], owner
        self.names = [i for i, _ in items]
        rare = np.full(len(self.start), -1, dtype=np.int64)
        for m in np.unique(self.width):
            at = np.flatnonzero(self.width == m)
            for a in range(0, len(at), 1 << 16):
                own = self.ids[self.start[at[a : a + (1 << 16)]][:, None] + np.arange(m)]
                rare[at[a : a + (1 << 16)]] = own[np.arange(len(own)), counts[own].argmin(axis=1)]
        self.order = np.argsort(rare, kind="stable")  # windows by term, and each term's first one
        self.first = np.searchsorted(rare[self.order], np.arange(len(self.terms) + 1))


def _matches(tests: Tests, windows: np.ndarray, m: int, local: np.ndarray, begin: np.ndarray, count: np.ndarray, positions: np.ndarray, keys: np.ndarray, stride: int, slop: int):
    """(window, start, exact) of all matches of windows of m terms; local: a test term's number in the block, or -1."""
    term = local[tests.ids[tests.start[windows][:, None] + np.arange(m)]]
    whole = (term >= 0).all(axis=1)
    windows, term = windows[whole], term[whole]
    n = count[term]
    rank = np.argsort(n, axis=1, kind="stable")
    total = np.concatenate([[0], np.cumsum(n.min(axis=1, initial=np.iinfo(np.int64).max))]) if len(windows) else np.zeros(1, dtype=np.int64)
    at = 0
    while at < len(windows):  # the rarest terms' lists, in parts of bounded size
        stop = max(at + 1, int(np.searchsorted(total, total[at] + _CANDIDATES, side="right")) - 1)
        t, r = term[at:stop], rank[at:stop]
        rows = np.arange(len(t))
        least = r[:, 0]
        lists = count[t[rows, least]]
        w = np.repeat(rows, lists)
        inside = np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists)
        start = positions[begin[t[w, least[w]]] + inside].astype(np.int64) - least[w]
        exact = np.ones(len(w), dtype=bool)
        for k in range(1, m):
            j = r[w, k]
            base = t[w, j].astype(np.int64) * stride
            want = start + j
            low = base + np.clip(want - slop, 0, stride - 1)
            found = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            ok = (keys[found] >= low) & (keys[found] <= base + np.clip(want + slop, -1, stride - 1))
            w, start, exact, j, base, want = w[ok], start[ok], exact[ok], j[ok], base[ok], want[ok]
            if not len(w):
                break
            place = np.minimum(np.searchsorted(keys, base + np.maximum(want, 0)), len(keys) - 1)
            exact &= (want >= 0) & (keys[place] == base + want)
        yield windows[at:stop][w], start, exact
        at = stop


def _runs(hit: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The runs of hit words of each document, cut where documents end."""
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[:-1] = hit
    begins = edge[:-1].copy()
    begins[1:] &= ~hit[:-1]
    cuts = first[:-1][first[:-1] < len(hit)]
    begins[cuts] = hit[cuts]
    ends = hit & ~edge[1:]
    last = first[1:][first[1:] > 0] - 1
    ends[last] = hit[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    doc = np.searchsorted(first, a, side="right") - 1
    spans: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for d, x, y in zip(doc.tolist(), a - first[doc], b - first[doc], strict=True):
        spans[d].append({"first": int(x), "last": int(y)})
    return spans


def _search(sent, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = sent.value
        for batch in batches:
            for row in range(len(batch)):
                ids, hashes = (batch.column(c)[row].values for c in ("doc_ids", "text_hashes"))
                first, terms, ends, positions = (np.asarray(batch.column(c)[row].values) for c in ("first", "terms", "ends", "positions"))
                terms, n_docs, n_words = terms.view(np.uint64), len(ids), int(first[-1])
                edges = np.zeros((2, n_words + 1), dtype=np.int32)
                items: list[set[str]] = [set() for _ in range(n_docs)]
                if len(terms) and len(tests.terms):
                    place = np.minimum(np.searchsorted(terms, tests.terms), len(terms) - 1)
                    local = np.where(terms[place] == tests.terms, place, -1)
                    count = np.diff(ends, prepend=0)
                    begin, stride = ends - count, n_words + 1
                    keys = np.repeat(np.arange(len(terms), dtype=np.int64), count) * stride + positions
                    have = np.flatnonzero(local >= 0)
                    sizes = tests.first[have + 1] - tests.first[have]
                    filed = tests.order[np.repeat(tests.first[have] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                    for m in np.unique(tests.width[filed]):
                        for w, start, exact in _matches(tests, filed[tests.width[filed] == m], int(m), local, begin, count, positions, keys, stride, slop):
                            ok = (start >= 0) & (start + m <= n_words)
                            w, start, exact = w[ok], start[ok], exact[ok]
                            doc = np.searchsorted(first, start, side="right") - 1
                            ok = start + m <= first[doc + 1]
                            w, start, exact, doc = w[ok], start[ok], exact[ok], doc[ok]
                            for kind, chosen in ((0, exact), (1, ~exact)):
                                np.add.at(edges[kind], start[chosen], 1)
                                np.add.at(edges[kind], start[chosen] + m, -1)
                            for d, i in np.unique(np.stack([doc[exact], tests.owner[w[exact]]]), axis=1).T.tolist():
                                items[d].add(tests.names[i])
                hit = np.cumsum(edges[0])[:-1] > 0
                near = (np.cumsum(edges[1])[:-1] > 0) & ~hit
                block = pa.array(np.full(n_docs, batch.column("block")[row].as_py()))
                cells = [block, pa.array(np.arange(n_docs)), ids, hashes, pa.array(np.diff(first)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(_runs(hit, first), _SPAN_LIST), pa.array(_runs(near, first), _SPAN_LIST)]
                yield pa.RecordBatch.from_arrays(cells, names=["block", "place", "doc_id", "text_hash", "n_words", "items", "spans", "near"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from its rows of all parts of a benchmark (spans and near: arrays of arrays)."""
    for batch in batches:
        both: tuple[list, list] = ([], [])
        for n, *lists in zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "near")), strict=True):
            hit = np.zeros((2, n), dtype=bool)
            for kind, parts in enumerate(lists):
                for span in (s for part in parts for s in part):
                    hit[kind, span["first"] : span["last"] + 1] = True
            hit[1] &= ~hit[0]
            for out, h in zip(both, hit, strict=True):
                out.append(_runs(h, np.array([0, n]))[0] if n else [])
        kept = ["block", "place", "doc_id", "text_hash", "n_words", "items"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(x, _SPAN_LIST) for x in both]], names=[*kept, "spans", "near"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 2, max_test_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_near, items (sorted ids), spans (word ranges hit), text_hash.

    The benchmark is a query set. It is dealt by item into parts of about max_test_bytes, each of
    which is broadcast and searched in the one stored index; what the parts find is put together
    by document, so that a benchmark of any size gives the same result.
    """
    spark = docs.sparkSession
    tests = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    held = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-held // max_test_bytes))
    index = build_index(docs)
    found: DataFrame | None = None
    for part in range(parts):
        own = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        sent = spark.sparkContext.broadcast(Tests([(r["item_id"], r["text"]) for r in own], size))
        hits = index.mapInArrow(_search(sent, slop), _HITS)
        if parts > 1:
            hits = materialize(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    if parts > 1:
        items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        found = found.groupBy("block", "place", "doc_id", "text_hash", "n_words").agg(items.alias("items"), F.collect_list("spans").alias("spans"), F.collect_list("near").alias("near")).mapInArrow(_merged, _HITS)

    def covered(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)

    return found.select("doc_id", "n_words", covered("spans").alias("n_hit"), covered("near").alias("n_near"), "items", "spans", "text_hash")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM g),
dw AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m),
hits AS (SELECT doc_id, p, dw.m, item_id FROM dw JOIN g ON g.m = dw.m AND g.g = array_to_string(w[p : p + dw.m - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
