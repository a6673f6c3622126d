"""Language ID by multilingual mixture inference.

Per language a smoothed character-trigram model is learned from labelled documents. A
document's words get a likelihood under each language; expectation-maximisation over the
words estimates the document's language proportions. The language set is chosen by
penalised likelihood: nested sets, in the order of the full mixture's proportions, compete
under log-likelihood - penalty * (languages - 1) * ln(words).

Defined results: null text, or text without a letter -> `und`, score 0. With no labelled
document every row is `und`. Very long texts are scored whole, in chunks. Repeated rows get
equal results. Extra input columns pass through only where their names do not clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridica.llm.common import row_slices

BUCKETS = 1 << 16
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_ALPHA: list[np.ndarray] = []
_CHUNK = 2_000_000


def _alpha() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _ALPHA[0]


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each letter, first letter of each word, row of each word)."""
    lowered = [(t or "").lower() for t in texts]
    cps = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), dtype=np.uint32)
    alpha = _alpha()[cps]
    shown = np.where(alpha, cps, np.uint32(32))
    at = np.flatnonzero(alpha)
    h = (shown[at - 1] * _A) ^ (shown[at] * _B) ^ (shown[at + 1] * _C)
    h = (h ^ (h >> np.uint32(15))) * _B
    begins = ~alpha[at - 1] if len(at) else np.zeros(0, dtype=bool)
    firsts = np.flatnonzero(begins)
    row_starts = np.cumsum([1] + [len(t) + 1 for t in lowered])
    return (h >> np.uint32(16)).astype(np.int64), firsts, np.searchsorted(row_starts, at[firsts], side="right") - 1


def _pieces(text: str | None) -> list[str]:
    """A text in chunks cut at spaces, so that memory stays bounded for any length."""
    if text is None or len(text) <= _CHUNK:
        return [text or ""]
    out, at = [], 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            end = max(text.rfind(" ", at, end), 0) + 1 or end
            end = end if end > at else at + _CHUNK
        out.append(text[at:end])
        at = end
    return out


def _count(langs: list[str]):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in row_slices(batch, "text", 4 << 20):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for piece in _pieces(text):
                        total[index[lang]] += np.bincount(_trigrams([piece])[0], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang_no": lang.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[lang, bucket]})

    return run


def learn(docs: DataFrame, max_docs_per_lang: int = 3000) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood table of shape (BUCKETS, languages)) from columns text, lang, doc_id.

    Bound: about max_docs_per_lang labelled documents of each language, chosen by a hash of
    doc_id; they are read whole. What reaches the driver is one count per language and bucket.
    """
    labelled = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    share = F.lit(None)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs_per_lang / sizes[lang]))).otherwise(share)
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1_000_000)) < share * 1_000_000)
    counts = sample.select("lang", "text").mapInArrow(_count(langs), "lang_no int, bucket int, n long")
    rows = counts.groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(langs)), 0.5)
    np.add.at(table, (rows["bucket"].to_numpy(), rows["lang_no"].to_numpy()), rows["n"].to_numpy())
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Mixture shares (docs x languages) and log-likelihoods; like: words x languages, scaled to a maximum of 1."""
    docs, k = len(first) - 1, like.shape[1]
    sizes = np.diff(first)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    active = np.arange(docs)
    loglik = np.zeros(docs)
    x, size = like, sizes
    for step in range(rounds):
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        r = x * np.repeat(share[active].astype(np.float32), size, axis=0)
        s = np.maximum(r @ np.ones(k, dtype=np.float32), np.float32(1e-37))
        loglik[active] = np.add.reduceat(np.log(s).astype(np.float64), starts)
        r /= s[:, None]
        new = np.add.reduceat(r, starts, axis=0).astype(np.float64) / size[:, None]
        moved = np.abs(new - share[active]).max(axis=1) > 1e-3
        share[active] = new
        if not moved.any():
            break
        if step % 3 == 2 and moved.mean() < 0.7:
            x, active, size = x[np.repeat(moved, size)], active[moved], size[moved]
    return share, loglik


def _infer(like: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares under the chosen language set of each document; every document has a word. like: log-likelihoods."""
    k = like.shape[1]
    sizes = np.diff(first)
    single = np.add.reduceat(like.astype(np.float64), first[:-1], axis=0)
    top = like.max(axis=1)
    scaled = np.exp(np.maximum(like - top[:, None], np.float32(-80)))
    base = np.add.reduceat(top.astype(np.float64), first[:-1])
    full, loglik = _em(scaled, first, np.ones((len(sizes), k)))
    cost = penalty * np.log(sizes + 1.0)
    best, share = single.max(axis=1), np.eye(k)[single.argmax(axis=1)]
    order = np.argsort(-full, axis=1, kind="stable")
    for n in range(2, k + 1):
        open_ = np.flatnonzero(base + loglik - (n - 1) * cost > best)  # else no set of n languages can win
        if not len(open_):
            break
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :n], 1, axis=1)
        pick = np.zeros(len(sizes), dtype=bool)
        pick[open_] = True
        got, ll = _em(scaled[np.repeat(pick, sizes)], np.concatenate([[0], np.cumsum(sizes[open_])]), allowed)
        score = base[open_] + ll - (n - 1) * cost[open_]
        won = score > best[open_]
        best[open_[won]], share[open_[won]] = score[won], got[won]
    return share, best


def _predict(langs: list[str], table, penalty: float, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table.value
        for batch in batches:
            for part in row_slices(batch, "text", 4 << 20):
                rows, pieces = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for piece in _pieces(text):
                        rows.append(i)
                        pieces.append(piece)
                like, owner = [], []
                at = 0
                while at < len(pieces):  # a few million letters at a time
                    end, size = at, 0
                    while end < len(pieces) and (end == at or size + len(pieces[end]) <= _CHUNK * 2):
                        size += len(pieces[end])
                        end += 1
                    grams, firsts, row = _trigrams(pieces[at:end])
                    if len(firsts) and len(langs):
                        like.append(np.add.reduceat(logp[grams], firsts, axis=0))
                        owner.append(np.asarray(rows[at:end])[row])
                    at = end
                pred = np.full(len(part), "und", dtype=object)
                score = np.zeros(len(part))
                mixture: list = [[] for _ in range(len(part))]
                if like:
                    owner_all = np.concatenate(owner)
                    docs, first = np.unique(owner_all, return_index=True)
                    share, _ = _infer(np.concatenate(like), np.append(first, len(owner_all)), penalty)
                    for d, s in zip(docs, share, strict=True):
                        pred[d], score[d] = langs[int(s.argmax())], min(1.0, float(s.max()))
                        mixture[d] = [{"lang": langs[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] >= 0.005]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                cols = [part.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score), pa.array(mixture, kind)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "mixture"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 4.0) -> DataFrame:
    """docs plus lang_pred, score and mixture (array of lang, share). Only `text` is an input.

    Input columns of those names are replaced. No shuffle; the model (2^16 rows per language) is broadcast.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "mixture")]
    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("mixture", "array<struct<lang:string,share:double>>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    table = docs.sparkSession.sparkContext.broadcast(model[1])
    return docs.select(*keep).mapInArrow(_predict(model[0], table, penalty, keep), schema)


def held_out() -> Column:
    """True where crc32 of doc_id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
