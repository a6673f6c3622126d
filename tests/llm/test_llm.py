"""Brute-force comparisons and edge cases of the training-data operators."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from veridica.llm import common, decontamination, exact_dedup, graph, jaccard_join, language_id, line_dedup, packing, repeated_substrings, tool_calls, url_filter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(None, "a b c"), (1, None), (2, ""), (3, "word " * 30_000), (4, "x y z"), (4, "x y z"), (5, "...\n\n..."), (6, "é ü 漢字 " * 50)]


def docs(spark, rows, extra=True):
    """Documents with columns whose names clash with those of results."""
    full = [(i, t, "en", "s", 0) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("n", "h", "keep_id", "bucket", "id", "component", "removed", "score", "items"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


@pytest.fixture(scope="module")
def fixture_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def corpus(n=120, seed=3):
    """Random documents with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 200))) for _ in range(n)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    for i in range(n // 3):
        base = out[rng.randrange(n)].split()
        kind = i % 4
        if kind == 0:
            out.append(" ".join(base))
        elif kind == 1:
            for _ in range(max(1, len(base) // 40)):
                base[rng.randrange(len(base))] = "edited"
            out.append(" ".join(base))
        elif kind == 2:
            at = rng.randrange(len(base) + 1)
            out.append(" ".join([*base[:at], passage, *base[at:]]))
        else:
            out.append(passage + "\n" + "ab" * rng.randint(0, 400))
    return list(enumerate(out))


def py_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# language ID


def test_language_held_out_accuracy(spark, fixture_docs):
    rows = fixture_docs.withColumn("held_out", language_id.held_out())
    model = language_id.learn(rows.where("not held_out"))
    got = language_id.predict(rows.where("held_out"), model).collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixture_and_edges(spark, fixture_docs):
    model = language_id.learn(fixture_docs)
    by = {r.lang: r.text for r in fixture_docs.where("length(text) > 1500").collect()}
    half = by["en"][:1200] + " " + by["de"][:1200]
    got = language_id.predict(docs(spark, [*EDGE, (9, half)]), model).collect()
    assert len(got) == len(EDGE) + 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[5].lang_pred == "und" and by_id[1].score == 0
    shares = {m.lang: m.share for m in by_id[9].mixture}
    assert set(shares) == {"en", "de"} and abs(shares["en"] - 0.5) < 0.15
    assert {r.lang_pred for r in language_id.predict(docs(spark, EDGE), language_id.learn(docs(spark, []))).collect()} == {"und"}


# exact dedup


def test_exact_dedup_collisions_and_edges(spark):
    from pyspark.sql import functions as F

    rows = [*EDGE, (10, "a  b\tc"), (11, "A b c"), (12, None), (13, "x y z")]
    for content_hash in (exact_dedup.md5_hash, lambda c: F.lit(b"same")):
        got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(docs(spark, rows), content_hash).collect()}
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = defaultdict(list)
        for i, t in rows:
            groups[norm(t)].append(i)
        for i, t in rows:
            r = got[i, hashlib.sha256(norm(t).encode()).hexdigest()]
            keep = min((x for x in groups[norm(t)] if x is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[norm(t)]), i == keep)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


# tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, 0, "a", "f", '{"y": 2, "x": "s"}', []),
            (1, 3, 0, "b", "f", '{"x": 1}', ["a"]),
            (1, 5, 0, "c", "g", "[1]", ["b", "a", "zz"]),
            (1, 6, 0, "d", "f", "nonsense", ["e"]),
            (1, 7, 0, "e", "f", None, ["d"]),
            (1, 8, 0, None, "h", "{}", None),
            (2, 1, 0, "a", "f", '{"x": "é\\"", "z": null}', None),
            (2, 2, 0, "dup", "f", '{"x":"1"}', ["dup"]),
            (2, 2, 1, "dup", "f", '{"x":"1"}', []),
            (None, 1, 0, "a", "f", '{"x":"1","y":1.5}', []),
        ],
        "conv_id long, turn long, position int, call_id string, name string, arguments string, uses array<string>",
    )
    results = spark.createDataFrame([(1, 2, "a", "r"), (1, 4, "a", "again"), (1, 4, "b", None), (2, 1, "nobody", "q"), (None, 2, "a", "n"), (2, 3, "dup", "d")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "integer", False), ("g", None, None, None)], "tool string, parameter string, type string, required boolean")
    messages = spark.createDataFrame([(1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    rows = tool_calls.format_messages(messages, calls, results, schemas).collect()
    assert len(rows) == 18
    call = {(r.conv_id, r.call_id, r.position): r for r in rows if r.kind == "call"}
    assert [call[1, k, 0].level for k in "abcde"] == [0, 1, 2, None, None]
    assert [call[1, k, 0].status for k in "abc"] == ["linked", "linked", "unanswered"]
    assert call[2, "dup", 0].status == "ambiguous" and call[1, None, 0].status == "ambiguous"
    assert call[1, "a", 0].json == '{"arguments":{"x":"s","y":2},"id":"a","name":"f"}' and call[1, "a", 0].problems == []
    assert call[1, "b", 0].problems == ["wrong type of x"]
    assert call[1, "c", 0].problems == ["arguments are no object"] == call[1, "d", 0].problems == call[1, "e", 0].problems
    assert call[1, None, 0].problems == ["unknown tool"]
    assert call[2, "a", 0].problems == ["unexpected z"]
    assert call[None, "a", 0].problems == ["wrong type of y"]
    result = {(r.conv_id, r.call_id, r.turn): r for r in rows if r.kind == "result"}
    assert result[1, "a", 2].status == "linked" and result[1, "a", 4].status == "repeated" and result[1, "b", 4].level == 1
    assert result[2, "nobody", 1].status == "orphan" and result[2, "dup", 3].status == "orphan" and result[None, "a", 2].status == "linked"
    assert all(json.loads(r.json) is not None for r in rows)
    assert json.loads(next(r for r in rows if r.kind == "message" and r.turn == 0).json) == {"content": 'say "hi"\n', "role": "user"}
    empty = [df.limit(0) for df in (messages, calls, results)]
    assert tool_calls.format_messages(*empty, schemas).count() == 0


def test_levels_match_peeling(spark):
    rng = random.Random(8)
    rows = [(0, str(i), [str(i - 1)] if i else []) for i in range(150)]
    rows += [(1, str(i), [str(rng.randrange(i)) for _ in range(rng.randint(0, 3))] if i else None) for i in range(60)]
    rows += [(None, str(i), [str(rng.randrange(i + 2 if i % 17 == 3 else i)) for _ in range(rng.randint(0, 2))] if i else []) for i in range(60)]
    rows += [(2, str(i), [str((i + 1) % 5)] if i < 5 else [str(i - 1)]) for i in range(9)]
    uses = {(c, i): {(c, u) for u in us or [] if u != i} for c, i, us in rows}
    uses = {k: {u for u in v if u in uses} for k, v in uses.items()}
    level: dict = {}
    while free := [k for k, v in uses.items() if k not in level and v <= level.keys()]:
        level |= {k: max([level[u] + 1 for u in uses[k]], default=0) for k in free}
    found = tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, uses array<string>")).collect()
    assert len(found) == len(rows) and any(r.level is None for r in found)
    assert {(r.conv_id, r.call_id): r.level for r in found} == {k: level.get(k) for k in uses}


# decontamination


def brute_leaks(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = py_words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = py_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    found |= windows[tuple(w[at : at + n])]
                    hit |= set(range(at, at + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark):
    rows = corpus()
    texts = [t for _, t in rows]
    items = [(1, " ".join(texts[5].split()[:40]).upper()), (2, "ab"), (3, None), (None, "x"), (4, ""), (5, "Edited, -- words!"), (10, texts[7]), (10, "one two"), (6, "é ü 漢字 é")]
    rows += [*EDGE, (900, "ab cd"), (901, "one"), (902, "two one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs(spark, rows), bench).collect()
    want = brute_leaks(rows, [(i, t) for i, t in items if i is not None])
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_hit for r in got)
    assert {r.n_hit for r in decontamination.decontaminate(docs(spark, rows), bench.limit(0)).collect()} == {0}
    assert decontamination.decontaminate(docs(spark, []), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = decontamination.decontaminate(docs(spark, [(1, "x a b c d e and f g h i j"), (2, "a b c d e and also or f g h i j")]), bench).collect()
    assert [(r.n_hit, r.n_near > 0) for r in sorted(got)] == [(0, True), (0, False)]


# repeated substrings


def brute_repeats(rows, size):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[p : p + size] for _, raw in raws for p in range(len(raw) - size + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - size + 1):
            if seen[raw[p : p + size]] > 1:
                gone[p : p + size] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [20_000, 1])
def test_repeated_substrings(spark, wide):
    rows = corpus(60, seed=5) + [(i + 500, t[:3000] if t else t) for i, t in enumerate([x[1] for x in EDGE])]
    rows += [(800, "z" * 900), (801, "q" + "z" * 450 + "r"), (802, "abc" * 150)]
    got = repeated_substrings.remove_repeats(docs(spark, rows), wide=wide).collect()
    want = brute_repeats(rows, 200)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert repeated_substrings.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_across_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    whole = repeated_substrings.triggers(data, 200)
    monkeypatch.setattr(repeated_substrings, "_CHUNK", 700)
    starts = [(p, s) for place, _, first, last in repeated_substrings._chunked(data, 200) for p, a, b in zip(place, first, last, strict=True) for s in range(a, b + 1)]
    assert starts == [(p, s) for p, _, a, b in zip(*whole, strict=True) for s in range(a, b + 1)]


# url filter and components


def test_url_filter(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://a.example.org/es/1", ""),
        (2, "https://b.test/x#frag", link % "http://A.example.org/es/1"),
        (3, "https://c.test/y?q", '<meta http-equiv="refresh" content="0; url=https://b.test/x">'),
        (4, "http://EXAMPLE.org/en/15", None),
        (5, "http://notexample.org/es/", ""),
        (6, "https://x.com/de/", link % "https://x.com/fr/"),
        (7, "https://x.com/fr/", ""),
        (8, "https://alias.test", link % "https://x.com/fr/"),
        (9, None, None),
        (10, "no scheme", ""),
        (11, "http://x.org", ""),
        (1, "http://a.example.org/es/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as rule", "'z' as component")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("b.test", "/x", None, "block") and got[3] == ("c.test", "/y", None, "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow") and got[8] == ("alias.test", "", None, "allow")
    assert got[9] == ("", "", None, "allow") == got[10] and got[11] == ("x.org", "", None, "allow")
    assert url_filter.filter_urls(pages).count() == len(rows) and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


# line dedup


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog and then some more words follow here in a rather long line of text number %s"
    rows = [
        (1, "Alpha beta gamma.\n" + line % "one" + "\n\nonly here"),
        (2, "ALPHA, beta -- gamma\nsomething else entirely"),
        (3, "alpha beta gamma"),
        (4, None), (5, ""), (6, "!!!\n!!!"), (7, "twice\ntwice\nonce"), (7, "twice\nother"), (8, "again and again"), (8, "again and again"), (None, "alpha beta gamma\nnull id"),
    ]
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got if r.doc_id not in (4, 5))
    assert ("None", "alpha beta gamma\nnull id", 2, 0) in texts
    assert ("1", (line % "one") + "\n\nonly here", 4, 1) in texts and ("2", "something else entirely", 2, 1) in texts and ("3", None, 1, 1) in texts
    assert ("6", "!!!\n!!!", 2, 0) in texts and ("8", "again and again", 1, 0) in texts
    assert sum(t[0] == "7" and "twice" in (t[1] or "") for t in texts) == 1
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def py_simhash_pairs(lines, hashes, most, similarity=0.8):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    return {(a, b) for a, b in combinations(sorted(lines), 2) if (hashes[a] ^ hashes[b]).bit_count() <= most and distance(lines[a], lines[b]) <= int((1 - similarity) * max(len(lines[a]), len(lines[b])) + 1e-9)}


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_fuzzy_lines_match_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    lines = {}
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(150)]
        lines[3 * i] = " ".join(base)
        for j in (1, 2):
            base[rng.randrange(150)] = rng.choice(vocab)
            lines[3 * i + j] = " ".join(base)
    rows = list(lines.items())
    hashed = line_dedup.simhashes(line_dedup._lines(docs(spark, rows)), ["doc_id", "h1"]).collect()
    hashes = {r.doc_id: r.simhash & (2**64 - 1) for r in hashed}
    links = py_simhash_pairs(lines, hashes, 3)
    assert len(links) > 10
    parent = {i: i for i in lines}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in sorted(links):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, rows)).where("text is null").collect()}
    assert got == {i for i in lines if find(i) != i}


def test_fuzzy_lines_reach_edit_similarity(spark):
    """Pairs of edit similarity alone, at the corpus's line lengths and at short ones."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, pairs = [], 0
    for n in (5, 8, 14, 27, 60, 120):
        for _ in range(25):
            base = [rng.choice(vocab) for _ in range(n)]
            near = list(base)
            for at in rng.sample(range(n), max(1, n // 20)):
                near[at] = rng.choice([v for v in vocab if len(v) <= 4])
            x, y = " ".join(base), " ".join(near)
            if x != y and levenshtein(x, y) <= 0.2 * max(len(x), len(y)):
                rows += [(2 * pairs, x), (2 * pairs + 1, y)]
                pairs += 1
    long_pairs = pairs
    for _ in range(60):  # short lines: characters replaced, inserted and left out, as many as allowed
        x = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(6, 24)))
        y = list(x)
        for _ in range(len(x) // 5):
            at = rng.randrange(len(y))
            y[at : at + 1] = rng.choice([[], ["z"], [y[at], "z"]])
        y = "".join(y)
        if levenshtein(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) and max(len(x), len(y)) <= line_dedup.SHORT and x != y:
            rows += [(2 * pairs, x), (2 * pairs + 1, y)]
            pairs += 1
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, rows), bands=line_dedup.BANDS).where("text is null").collect()}
    assert long_pairs > 100 and pairs - long_pairs > 20
    assert {2 * i + 1 for i in range(long_pairs, pairs)} <= gone
    assert len({2 * i + 1 for i in range(long_pairs)} & gone) >= 0.98 * long_pairs
    assert not any(i % 2 == 0 for i in gone)


# Jaccard join


def brute_classes(rows, n=5, threshold=0.8):
    sets = []
    for i, t in rows:
        w = py_words(t)
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) >= threshold * len(x | y):
            parent[find(b)] = find(a)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(sets))


@pytest.mark.parametrize("small", [8, 2])
def test_jaccard_join(spark, small):
    rng = random.Random(4)
    rows = corpus(80, seed=9) + [(700 + i, t) for i, (_, t) in enumerate(EDGE)]
    base = ["w%d" % rng.randrange(5000) for _ in range(300)]
    for i in range(60):  # one large group of near copies
        near = list(base)
        for _ in range(5):
            near[rng.randrange(300)] = "v%d" % rng.randrange(5000)
        rows.append((2000 + i, " ".join(near)))
    got = jaccard_join.near_duplicates(docs(spark, rows), small=small).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)
    size = Counter(r.class_id for r in got)
    assert all(r.class_size == size[r.class_id] or r.doc_id in (701, 702, 706) for r in got)
    assert all((r.n_links > 0) == (r.class_size > 1) for r in got)
    assert jaccard_join.near_duplicates(docs(spark, [(None, "a b"), (None, None)])).count() == 2
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_link_counts(spark):
    rng = random.Random(14)
    base = ["w%d" % rng.randrange(5000) for _ in range(200)]
    rows = corpus(40, seed=2)
    for i in range(40):  # near copies, some of them alike through others only
        near = list(base)
        for _ in range(rng.randrange(8)):
            near[rng.randrange(200)] = "v%d" % rng.randrange(5000)
        rows.append((2000 + i, " ".join(near)))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (py_words(t) for _, t in rows)]
    copies = Counter(sets)
    want = [copies[x] - 1 + sum(1 for y in copies if y != x and len(x & y) >= 0.8 * len(x | y) - 1e-9) for x in sets]
    assert max(want) > 20 and len(set(want)) > 5
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: n for (i, _), n in zip(rows, want, strict=True)}
    members = spark.createDataFrame([((i, 0), (0, 0), np.arange(i, i + 40, dtype=np.uint64).tobytes()) for i in range(30)], "id struct<s1 long, s2 long>, component struct<s1 long, s2 long>, shingles binary")
    counts = {r.id.s1: r.links for r in jaccard_join.link_counts(members, 0.8, block=4).collect()}
    assert counts == {i: sum(0 < abs(i - j) <= 4 for j in range(30)) for i in range(30)}


def test_prefix_depth():
    assert jaccard_join.prefix_depth(0.8, 16, 6, 0.9995) == 4 and jaccard_join.prefix_depth(0.99, 16, 6, 0.99) == 6


# packing


def test_packing(spark, fixture_docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text) for r in fixture_docs.limit(60).collect()]
    rows += [(5000, None), (5001, ""), (5002, " don't  \r\n\t 12345 漢字🙂    x"), (5003, "ab " * 9000), (5002, "same id"), (None, "null id")]
    for encoder in ((public.path("byte_bpe_50k.tiktoken"), public.PATTERN), (public.path("byte_bpe_50k.json"),)):
        got = packing.pack(docs(spark, rows), encoder).collect()
        pieces, bins = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r.doc_id, r.doc_tokens].append(r)
            bins[r.sequence_id].append(r)
        for i, t in rows:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
            own = sorted(pieces[i, len(ids)], key=lambda r: r.start)
            assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and sum(r.length for r in own) == len(ids)
            assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        padding = 0
        for rows_of in bins.values():
            rows_of.sort(key=lambda r: r.offset)
            total = sum(r.length for r in rows_of)
            assert [r.offset for r in rows_of] == list(np.cumsum([0, *[r.length for r in rows_of]])[:-1]) and total <= 1024
            padding += 0 if total & (total - 1) == 0 else 1024 - total
        assert padding <= 1024 * 8
    assert packing.pack(docs(spark, []), encoder).count() == 0


def test_packing_added_tokens():
    public = pytest.importorskip("public_tokenizers")
    ranks = packing.rank_encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    whole = packing.json_encoder(public.path("byte_bpe_50k.json"))
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n y", "<|endoftext|", "a  b"):
        assert list(ranks(text)) == list(whole(text))


# WARC


def test_warc_round_trip(spark):
    big = "".join(chr(33 + i % 90) for i in range(50_000))
    rows = [(1, "http://a/", "x"), (2, "http://b/\n: é", "x"), (3, None, None), (4, "u", ""), (5, "v", big), (6, "w", big), (7, "z", "\x1f\x8b\x08 é\r\n\r\nWARC/1.1\r\n"), (2, "http://b/", "x"), (None, "n", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as size", "'q' as sha").repartition(2)
    manifest = warc.write_archives(pages)
    for size in (50, 1000, 4 << 20):
        got = warc.read_archives(manifest, size).collect()
        assert len(got) == len(rows)
        html = {(i, u): (t or "").encode() for i, u, t in rows}
        largest = {}
        for i, _, t in rows:
            if i is not None:
                largest[t or ""] = max(largest.get(t or "", -1), i)
        for r in got:
            payload = html[r.page_id, r.url]
            assert r.payload_bytes == len(payload)
            want = largest.get(payload.decode())
            if r.page_id in (None, want):
                assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)
            else:
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", want, None)
    assert {r.record_type for r in warc.round_trip(spark, pages.where("html = 'x'"), min_payload=2).collect()} == {"response"}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_words_match_definition():
    texts = ["Hello, wORLD 12é_x", "", "a", "---", "漢字 x\x7fy", "ß" * 5 + " " + "ß" * 5]
    import pyarrow as pa

    h, first = common.words(*common.utf8_bytes(pa.array(texts)))
    want = [py_words(t) for t in texts]
    assert list(np.diff(first)) == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# the pipeline


def test_pipeline_stages(spark, fixture_docs):
    import corpus_pipeline

    docs_, kept = fixture_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs_.collect()}
        docs_ = common.materialize(stage(spark, docs_, SF), name)
        assert docs_.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs_.collect()}
        assert set(kept[name]) <= set(before)
        if name == "jaccard_join":
            classes = dict(brute_classes(list(before.items())))
            assert set(kept[name]) == set(classes.values())
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(kept[name]) == {i for i, _, hit, _ in brute_leaks(list(before.items()), bench) if not hit}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["decontamination"])
    empty = fixture_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.count() == 0


def test_packing_blank_runs(spark):
    public = pytest.importorskip("public_tokenizers")
    whole = packing.json_encoder(public.path("byte_bpe_50k.json"))
    ranks = packing.rank_encoder(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    text = "a" + " " * 1_000_000 + "b"
    assert list(ranks(text)) == list(whole(text))


def test_warc_damage(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "text %d " % i * 50) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages)
    path = manifest.first().archive
    raw = open(path, "rb").read()
    starts = [p for p, _ in warc.read_range(path, 0, len(raw))]
    assert len(starts) == 6 and [p for a in range(0, len(raw), 97) for p, _ in warc.read_range(path, a, a + 97)] == starts

    def read(data, size=None):
        with open(path + ".damaged", "wb") as out:
            out.write(data)
        return [p for a in range(0, len(data), 97) for p, _ in warc.read_range(path + ".damaged", a, a + 97, size)]

    for damaged in (raw[:-50], raw[: starts[2]] + b"x" + raw[starts[2] + 1 :], raw[: starts[3] + 200] + b"\0\0\0\0" + raw[starts[3] + 204 :], b"x" + raw[1:], raw + b"rest"):
        with pytest.raises(ValueError):
            read(damaged)
    with pytest.raises(ValueError):
        read(raw[: starts[5]], len(raw))
    assert read(raw, len(raw)) == starts


def test_relative_links(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "http://b.com/de/1", ""),
        (2, "http://b.com/x/y?q", link % "/de/1"),
        (3, "http://b.com/x/y/z", link % "../.././de/1"),
        (4, "https://b.com/de", link % "//b.com/de/1"),
        (5, "http://b.com/de/", link % "#top"),
        (6, "http://c.net/a", link % "http://b.com/de/1"),
        (7, "http://c.net/b", '<meta http-equiv="refresh" content="0; url=a">'),
        (8, "http://c.net/c", link % "mailto:x"),
        (9, None, link % "/de/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow"}


def test_chat_order_and_ties(spark):
    calls = spark.createDataFrame([(1, 5, 0, "c", "f", '{"n":12345678901234567890}', ["a"]), (1, 1, 0, "a", "f", '{"n":1.00}', []), (1, 3, 0, "b", "f", '{"n":1e0}', []), (1, 2, 0, "d", "f", '{"n":1}', ["c"])], "conv_id long, turn long, position int, call_id string, name string, arguments string, uses array<string>")
    results = spark.createDataFrame([(1, 2, "a", "x"), (1, 2, "a", "x"), (1, 2, "a", "a"), (1, 6, None, "q"), (1, 6, None, "q")], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "n", "integer", True)], "tool string, parameter string, type string, required boolean")
    messages = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(7)], "conv_id long, turn long, role string, text string")
    rows = tool_calls.format_messages(messages, calls, results, schemas).orderBy("conv_id", "after", "level", "turn", "position").collect()
    named = [r.call_id or r.kind for r in rows if r.kind == "call" or r.kind == "message"]
    assert named.index("a") < named.index("b") < named.index("c") < named.index("d")
    assert named[:2] == ["message", "message"] and named.index("c") == len(named) - 3  # d waits for c; m6 is last
    assert sorted((r.status, json.loads(r.json)["content"]) for r in rows if r.kind == "result" and r.call_id) == [("linked", "a"), ("repeated", "x"), ("repeated", "x")]
    problems = {r.call_id: r.problems for r in rows if r.kind == "call"}
    assert problems == {"a": [], "b": ["wrong type of n"], "c": [], "d": []}


def test_benchmark_in_parts(spark):
    rows = corpus(50, seed=21)
    items = [(i, " ".join(t.split()[3:40])) for i, t in rows[:20]] + [(30, "ab"), (31, None), (32, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9")]
    rows.append((999, "p0 p1 p2 p3 p4 put in p5 p6 p7 p8 p9"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = ({(r.doc_id, r.text_hash): r for r in decontamination.decontaminate(docs(spark, rows), bench, max_test_bytes=m).collect()} for m in (1 << 20, 300))
    assert whole == parts and sum(r.n_hit > 0 for r in whole.values()) > 20 and any(r.n_near for r in whole.values())


@pytest.mark.parametrize("n", [6, 10, 15, 25, 40])
def test_line_recall(spark, n):
    """Lines with one word replaced, judged by edit similarity alone."""
    rng = random.Random(n)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows = []
    while len(rows) < 200:
        base = [rng.choice(vocab) for _ in range(n)]
        near = list(base)
        near[rng.randrange(n)] = rng.choice(vocab)
        x, y = " ".join(base), " ".join(near)
        if x != y and levenshtein(x, y) <= 0.2 * max(len(x), len(y)):
            rows += [(len(rows), x), (len(rows) + 1, y)]
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, rows), bands=line_dedup.BANDS).where("text is null").collect()}
    assert all(i % 2 for i in gone) and len(gone) >= 95
