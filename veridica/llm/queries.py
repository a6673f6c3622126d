"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from veridica.llm import (
    best_two_fit,
    decontamination,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    packing,
    periodic_runs,
    repeated_substrings,
    tool_calls,
    url_filter,
    vector_codes,
    warc,
)
from veridica.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.learn(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: Fixed values of the derived tool schemas.
TOOLS = [("lookup", "query", "string", True), ("lookup", "limit", "integer", False), ("count_words", "text", "string", True), ("count_words", "expected", "integer", True), ("notify", "message", "string", True), ("notify", "urgent", "boolean", True)]


def conversation_calls(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from turns: an assistant turn makes a call that uses the one before it;
    the user turn after it is the result. Some derived arguments break their schema."""
    key = lambda turn: F.concat_ws("_", F.lit("call"), F.col("conv_id"), turn)
    n = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    tool = F.element_at(F.array(F.lit("lookup"), F.lit("count_words"), F.lit("notify")), (n % 3 + 1).cast("int"))
    calls = chat.where("role = 'assistant'").select(
        "conv_id", "turn", F.lit(0).alias("position"), key(F.col("turn")).alias("call_id"), tool.alias("name"),
        F.when(n % 3 == 0, F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit"))))
        .when(n % 3 == 1, F.to_json(F.struct(F.col("text").alias("text"), F.when(n % 2 == 0, n).alias("expected"))))
        .otherwise(F.to_json(F.struct((n > 50).alias("urgent"), F.col("text").alias("message"), F.when(n % 5 == 0, n).alias("retries")))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(key(F.col("turn") - 2))).otherwise(F.array()).alias("uses"),
    )
    results = chat.where("role = 'user' and turn >= 2").select("conv_id", "turn", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations")
    schemas = spark.createDataFrame(TOOLS, "tool string, parameter string, type string, required boolean")
    return tool_calls.format_messages(chat, *conversation_calls(chat), schemas)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), bands=line_dedup.BANDS)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("left_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def rank_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), rank_tokenizer())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h the crc32 of the id, every document of h % 10 = 0 repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeat_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    start, length, period = -best["before"], best["length"], -best["shorter"]
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    codebooks = vector_codes.train(vectors)
    coded = materialize(vector_codes.encode(vectors, codebooks), "codes")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return vector_codes.with_group_error(coded, "label", "label_error").select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.pack(table(spark, sf_dir, "documents"), rank_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_decontamination": op4_decontamination,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_best_two_fit": op13_best_two_fit,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
