"""N-gram Jaccard join with a MinHash LSH forest.

Documents with equal sets of word shingles collapse to one class representative. Each set gets a
path of `depth` MinHashes in each of `trees` tries. A trie is the sorted list of its paths, dealt
to tasks by the prefix of the depth searched, so that the sets below a trie node follow each
other. The search starts from long prefixes and shortens them by one until the target recall is
reached: the agreement of two sets' 128 MinHash bits estimates their Jaccard similarity j, a pair
of similarity j meets at depth k with chance 1 - (1 - j ** k) ** trees, and the sum of the
reciprocal chances over the pairs met estimates how many there are in all. At the latest it stops
at the depth where pairs of exactly the threshold reach the target.

Sets below a node whose bits agree well enough (about 4 standard deviations under the threshold)
are joined into groups; a task writes a spanning forest of a node, never its pairs. Groups are
connected components of these. Inside groups every pair of sets is compared exactly, on whole
shingle sets, block by block: a block pair gives the number of links of each set and a spanning
forest of its links. Components of these are the classes. Neither a trie node nor a group is
gathered whole: both are dealt into pairs of blocks.

Words: runs of 0-9, A-Z (lower-cased), a-z and characters beyond ASCII. A text of fewer words than
`shingle`, but not none, is one shingle.

Defined results: documents without words have no links and are classes of their own; a repeated
doc_id with different texts gets one row each; null ids are kept; extra columns are ignored.
n_links counts the other shingle sets that reach the threshold, each pair of a group compared
exactly, plus the other documents of the same set. doc_id must cast to a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridica.llm.common import BASE, discard, materialize, mix64, row_slices, utf8_bytes, words
from veridica.llm.graph import connected_components

#: MinHash bits that are compared before shingles are.
BITS = 128


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each n-word shingle, first shingle of each row plus the total)."""
    h, first = words(data, offsets)
    count = np.diff(first)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(count)), shingles)
    at = first[row] + np.arange(start[-1]) - start[row]
    length = np.minimum(count, n)[row]
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(n, dtype=np.uint64)])
    for j in range(n):
        out = np.where(j < length, mix64(out * np.uint64(BASE) + padded[at + j]), out)
    return out, start


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix whose trees reach the recall at the threshold."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sets(n: int, trees: int, depth: int, floor: int):
    """Texts to their set's id, size, MinHash bits and, per tree, hashes of the prefixes of depths floor to depth."""
    salts = mix64(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(BASE))
    levels = depth - floor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                data, offsets = utf8_bytes(part.column("text"))
                hashes, start = shingle_hashes(data, offsets, n)
                rows = np.flatnonzero(np.diff(start))
                starts = start[:-1][rows]
                keys = np.zeros((len(part), trees, levels), dtype=np.uint64)
                bits = np.zeros((2, len(rows)), dtype=np.uint64)
                for tree in range(trees):
                    prefix = np.full(len(rows), np.uint64(tree + 1))
                    for level in range(depth):
                        place = tree * depth + level
                        salt = salts[place]
                        low = np.minimum.reduceat((hashes ^ salt) * (salt | np.uint64(1)), starts) if len(rows) else np.zeros(0, np.uint64)
                        prefix = mix64(prefix * np.uint64(BASE) + low)
                        if level + 1 >= floor:
                            keys[rows, tree, level + 1 - floor] = prefix
                        if place < BITS:
                            bits[place // 64] |= (mix64(low) & np.uint64(1)) << np.uint64(place % 64)
                sizes, ids = np.zeros(len(part), dtype=np.int64), np.zeros((2, len(part)), dtype=np.int64)
                for r in rows:
                    own = np.unique(hashes[start[r] : start[r + 1]])
                    sizes[r] = len(own)
                    ids[:, r] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                mask = sizes == 0

                def spread(values: np.ndarray, rows=rows, total=len(part), mask=mask) -> pa.Array:
                    full = np.zeros(total, dtype=np.int64)
                    full[rows] = values.view(np.int64)
                    return pa.array(full, mask=mask)

                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), trees * levels).cast(pa.list_(pa.int64()))
                cells = [part.column("doc_id"), part.column("text_hash"), pa.array(ids[0], mask=mask), pa.array(ids[1], mask=mask), pa.array(sizes), spread(bits[0]), spread(bits[1]), lists]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "text_hash", "s1", "s2", "n", "b1", "b2", "keys"])

    return run


def _shingles(n: int):
    """Texts to their sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                hashes, start = shingle_hashes(*utf8_bytes(part.column("text")), n)
                out = []
                for a, b in zip(start[:-1], start[1:], strict=True):
                    own = np.unique(hashes[a:b]).tobytes()
                    key = hashlib.blake2b(own, digest_size=16).digest()
                    if b > a and key not in seen:  # a set leaves a partition once
                        seen.add(key)
                        out.append((*np.frombuffer(key, dtype=np.int64).tolist(), own))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["s1", "s2", "shingles"])

    return run


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of the components of a symmetric boolean matrix: a forest of stars, each row expanded once."""
    n = len(linked)
    root = np.full(n, -1)
    for first in np.flatnonzero(linked.any(axis=1)):
        if root[first] >= 0:
            continue
        root[first] = first
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[front] = first
    member = np.flatnonzero((root >= 0) & (root != np.arange(n)))
    return root[member], member


def _held_groups(columns: list[str], n_keys: int, emit: Callable[[dict[str, np.ndarray], np.ndarray], list[pa.RecordBatch]]):
    """Calls emit with whole groups: rows with equal first n_keys columns, which follow each other; small groups are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = {c: table.column(c).combine_chunks() for c in columns}
            keys = [np.asarray(cells[c]) for c in columns[:n_keys]]
            new = np.zeros(len(table), dtype=bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            yield from emit(cells, np.append(np.flatnonzero(new), len(table)))

        for batch in batches:
            if not len(batch):
                continue
            turns = np.zeros(len(batch), dtype=bool)
            for c in columns[:n_keys]:
                k = np.asarray(batch.column(c))
                turns[1:] |= k[1:] != k[:-1]
                turns[0] |= bool(held) and held[-1].column(c)[-1].as_py() != k[0]
            cuts = np.flatnonzero(turns)
            if len(cuts):  # the last group may go on
                ready = [*held, batch.slice(0, cuts[-1])]
                held = []
                if sum(len(x) for x in ready):
                    yield from whole(pa.Table.from_batches(ready))
                batch = batch.slice(cuts[-1])
            held.append(batch)
        if held:
            yield from whole(pa.Table.from_batches(held))

    return run


def _walk(most: int, small: int):
    """Sets below the trie nodes whose bits differ in at most `most`: spanning links, and counts of pairs by differing bits.

    Rows: bucket, lo, hi, own, s1, s2, n, b1, b2, sorted by bucket, lo, hi. Nodes of at most `small` sets are
    compared together, by shifts of the sorted list; larger ones by a matrix for each pair of blocks.
    """

    def emit(cells: dict, cuts: np.ndarray) -> list[pa.RecordBatch]:
        col = {c: np.asarray(v) for c, v in cells.items()}
        b = np.stack([col["b1"].view(np.uint64), col["b2"].view(np.uint64)])
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = sizes[group] <= small
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(BITS + 1, dtype=np.int64)
        for shift in range(1, small):
            x = np.flatnonzero(few[:-shift] & (group[:-shift] == group[shift:])) if len(group) > shift else np.zeros(0, dtype=np.int64)
            if not len(x):
                break
            y = x + shift
            meet = (col["lo"][x] == col["hi"][x]) | (col["own"][x] != col["own"][y])
            x, y = x[meet], y[meet]
            differ = np.bitwise_count(b[:, x] ^ b[:, y]).sum(axis=0, dtype=np.int64)
            counts += np.bincount(differ, minlength=BITS + 1)
            near = differ <= most
            pairs.append((x[near], y[near]))
        for g in np.flatnonzero(sizes > small):
            rows = np.arange(cuts[g], cuts[g + 1])
            differ = np.bitwise_count(b[0, rows][:, None] ^ b[0, rows]) + np.bitwise_count(b[1, rows][:, None] ^ b[1, rows])
            if col["lo"][rows[0]] != col["hi"][rows[0]]:
                own = col["own"][rows]
                differ[own[:, None] == own] = 255
            else:
                np.fill_diagonal(differ, 255)
            seen = np.bincount(differ[np.triu_indices(len(rows), 1)] if len(rows) < 64 else differ.ravel(), minlength=256)[: BITS + 1]
            counts += seen if len(rows) < 64 else seen // 2
            root, member = spanning(differ <= most)
            pairs.append((rows[root], rows[member]))
        x, y = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64) for i in (0, 1))
        found = [pa.array(v) for v in (col["s1"][x], col["s2"][x], col["s1"][y], col["s2"][y])]
        names = ["a1", "a2", "b1", "b2", "differ", "pairs"]
        out = [pa.RecordBatch.from_arrays([*found, pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64())], names=names)]
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        out.append(pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at), pa.array(counts[at])], names=names))
        return out

    return _held_groups(["bucket", "lo", "hi", "own", "s1", "s2", "b1", "b2"], 3, emit)


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Common elements of each set of x with each of y, by products of 0/1 matrices of `width` columns."""
    values, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in [*x, *y]])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(x), len(y)))
    for first in range(0, len(values), width):
        a, b = np.searchsorted(column, [first, first + width])
        cells = np.zeros((len(x) + len(y), width), dtype=np.float32)
        cells[row[a:b], column[a:b] - first] = 1
        both += cells[: len(x)] @ cells[len(x) :].T
    return both


def _compare(threshold: float):
    """Links and their spanning forest inside each pair of blocks of a group, exactly."""

    def emit(cells: dict, cuts: np.ndarray) -> list[pa.RecordBatch]:
        lo, hi, own, s1, s2 = (np.asarray(cells[c]) for c in ("lo", "hi", "own", "s1", "s2"))
        shingles = cells["shingles"]
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = np.arange(a, b)
            if lo[a] == hi[a]:
                left = right = rows
            else:
                left, right = rows[own[rows] == lo[a]], rows[own[rows] == hi[a]]
            if len(rows) < 2 or not len(left) or not len(right):
                continue
            sets = {r: np.frombuffer(shingles[int(r)].as_buffer(), dtype=np.uint64) for r in rows}
            n = {r: len(v) for r, v in sets.items()}
            x, y = [sets[r] for r in left], [sets[r] for r in right]
            if len(rows) <= 6:
                both = np.array([[len(np.intersect1d(u, v, assume_unique=True)) if u is not v else 0 for v in y] for u in x])
            else:
                both = _overlaps(x, y)
            nx, ny = np.array([n[r] for r in left]), np.array([n[r] for r in right])
            linked = both >= threshold * (nx[:, None] + ny[None, :] - both) - 1e-9
            if left is right:
                np.fill_diagonal(linked, False)
                degree, square = linked.sum(1), linked
            else:
                degree = np.concatenate([linked.sum(1), linked.sum(0)])
                square = np.zeros((len(rows), len(rows)), dtype=bool)
                square[: len(left), len(left) :] = linked
                square[len(left) :, : len(left)] = linked.T
                rows = np.concatenate([left, right])
            root = np.arange(len(rows))
            r, m = spanning(square)
            root[m] = r
            out += [(int(s1[i]), int(s2[i]), int(s1[rows[j]]), int(s2[rows[j]]), int(d)) for i, j, d in zip(rows, root, degree, strict=True) if d]
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 5], names=["s1", "s2", "r1", "r2", "links"])]

    return _held_groups(["g1", "g2", "lo", "hi", "own", "s1", "s2", "shingles"], 4, emit)


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows plus lo, hi, own: a key's rows are dealt into blocks of about `block`, and every pair of blocks gets its rows.

    sizes: (key, _n), keys of one row left out.
    """
    dealt = rows.join(sizes.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), key)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit(5), "s1", "s2"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_blocks", "_other")


def compared_links(members: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(s1, s2, r1, r2, links) of sets (s1, s2, g1, g2, shingles): how many of the others in a pair of blocks of the
    group (g1, g2) reach the threshold, and a set of the pair of blocks that is linked with it, directly or not.

    Every pair of a group's sets meets once; no task holds a group and no pair is written.
    """
    named = members.withColumn("_g", F.struct("g1", "g2"))
    sizes = named.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = in_blocks(named, "_g", sizes, block).select("g1", "g2", "lo", "hi", "own", "s1", "s2", "shingles")
    sorted_ = rows.repartition("g1", "g2", "lo", "hi").sortWithinPartitions("g1", "g2", "lo", "hi")
    return sorted_.mapInArrow(_compare(threshold), "s1 bigint, s2 bigint, r1 bigint, r2 bigint, links bigint")


def link_counts(members: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(id, links) of sets (id, component, shingles; structs of s1, s2): the others of the component that reach the threshold."""
    flat = members.select(*[F.col(f"id.{c}").alias(c) for c in ("s1", "s2")], F.col("component.s1").alias("g1"), F.col("component.s2").alias("g2"), "shingles")
    return compared_links(flat, threshold, block).groupBy(F.struct("s1", "s2").alias("id")).agg(F.sum("links").alias("links"))


def forest_groups(distinct: DataFrame, threshold: float, trees: int, depth: int, floor: int, recall: float, small: int = 8, block: int = 2048) -> DataFrame:
    """(id, component) of the sets (s1, s2, b1, b2, keys) that meet in the forest and whose bits agree."""
    share = (1 - threshold) / 2
    most = int(BITS * share + 4 * (BITS * share * (1 - share)) ** 0.5)
    levels = depth - floor + 1
    links: list[DataFrame] = []
    for k in range(depth, floor - 1, -1):
        paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.element_at("keys", t * levels + F.lit(k - floor + 1)))  # noqa: B023
        rows = distinct.select(F.explode(paths).alias("bucket"), "s1", "s2", "b1", "b2")
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1")
        dealt = in_blocks(rows, "bucket", sizes, block).select("bucket", "lo", "hi", "own", "s1", "s2", "b1", "b2")
        dealt = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        found = materialize(dealt.mapInArrow(_walk(most, small), "a1 bigint, a2 bigint, b1 bigint, b2 bigint, differ bigint, pairs bigint"), "forest")
        links.append(found)
        # a pair is counted in each trie in which it meets, trees * j ** k of them on average
        similar = {d: max(0.0, 1 - 2 * d / BITS) for d in range(BITS + 1)}
        chance = {d: 1 - (1 - j**k) ** trees for d, j in similar.items()}
        meets = {d: trees * j**k for d, j in similar.items()}
        at = {r["differ"]: r["n"] for r in found.where("differ is not null").groupBy("differ").agg(F.sum("pairs").alias("n")).collect()}
        near = {d: n / meets[d] for d, n in at.items() if d <= BITS * share and meets[d] > 0}
        if sum(n * chance[d] for d, n in near.items()) >= recall * sum(near.values()):
            break
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    edges = every.where("a1 is not null").select(F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")).alias("u"), F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2")).alias("v"))
    groups = connected_components(edges)
    discard(*links)
    return groups


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, trees: int = 16, depth: int = 8, recall: float = 0.998, small: int = 8, block: int = 256) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its component), class_size, n_links, kept, text_hash.

    kept is true for the rows of the class's first doc_id; text_hash (xxhash64 of the text) tells
    the rows of one doc_id apart.
    """
    floor = prefix_depth(threshold, trees, depth, recall)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = "doc_id bigint, text_hash bigint, s1 bigint, s2 bigint, n bigint, b1 bigint, b2 bigint, keys array<bigint>"
    sets = materialize(hashed.mapInArrow(_sets(shingle, trees, depth, floor), schema), "sets")
    per_set = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("b1", "b2", "keys")])
    distinct = materialize(per_set, "distinct_sets")
    groups = forest_groups(distinct, threshold, trees, depth, floor, recall, small)
    grouped = distinct.select(F.struct("s1", "s2").alias("id"), "first").join(groups, "id").select("id", "first", "component")
    # whole texts are read and moved once more, those of grouped sets only
    wanted = grouped.select(F.col("first").alias("doc_id")).distinct()
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id), "left_semi")
    found = texts.mapInArrow(_shingles(shingle), "s1 bigint, s2 bigint, shingles binary").withColumn("id", F.struct("s1", "s2"))
    members = found.join(grouped, "id").dropDuplicates(["id"]).select("s1", "s2", F.col("component.s1").alias("g1"), F.col("component.s2").alias("g2"), "shingles")
    members = materialize(members, "members")
    compared = materialize(compared_links(members, threshold, block), "links")
    edges = compared.select(F.struct("s1", "s2").alias("u"), F.struct(F.col("r1").alias("s1"), F.col("r2").alias("s2")).alias("v"))
    components = connected_components(edges)
    degree = compared.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    own = components.select(F.col("id.s1").alias("s1"), F.col("id.s2").alias("s2"), "component")
    slim = distinct.select("s1", "s2", "first", "copies")
    classed = slim.join(own, ["s1", "s2"], "left").join(degree, ["s1", "s2"], "left").withColumn("component", F.coalesce("component", F.struct("s1", "s2")))
    classes = classed.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    by_set = classed.join(classes, "component").select("s1", "s2", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_set = materialize(by_set, "classes")
    discard(distinct, members, compared)
    # rows without words have a null set: they take no part in the join
    worded = sets.where("n > 0").select("doc_id", "text_hash", "s1", "s2").join(by_set, ["s1", "s2"])
    worded = worded.select("doc_id", "class_id", "class_size", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "text_hash")
    one, none = F.lit(1).cast("bigint").alias("class_size"), F.lit(0).cast("bigint").alias("n_links")
    return worded.unionByName(sets.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), one, none, F.lit(True).alias("kept"), "text_hash"))
