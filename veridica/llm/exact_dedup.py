"""Exact dedup: 128-bit content hash, smallest stable id, byte comparison inside groups.

Defined results: null text counts as empty; rows that repeat one doc_id with equal text are one
document's copies, all carry kept = true when that id stays; a null doc_id stays only in a group
of nulls. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of white space that count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def md5_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Grouping by (hash, text) compares the bytes of what shares a hash; map-side partial
    aggregation shrinks large groups of copies before the only shuffle of texts. Rows find
    their group by (hash, sha256), so that texts move once.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    rows = docs.select("doc_id", norm.alias("norm"))
    hashed = rows.select("doc_id", "norm", content_hash(F.col("norm")).alias("h"))
    groups = (
        hashed.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    slim = hashed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    return slim.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
