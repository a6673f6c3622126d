"""Chat formatting: tool-call linking.

Calls and their results are joined by identifier within a conversation, ordered topologically
(a call after the calls whose results it uses, a result after its call), the calls' arguments are
validated against their tool's schema, and each message is serialised as canonical JSON (keys in
code-unit order, no spaces).

The order is given as (after, level, turn, position), ascending with nulls last: rows sorted by it
within a conversation are in topological order and, where calls use earlier turns only, in the
order of turns. `after` is the latest turn of a row and of all calls it depends on, a level the
longest chain of calls before a call; both are found by doubling the chains, a join and two
group-bys per round. No conversation is gathered in one task, however
long.

Defined results: a call without identifier, or whose identifier another call of the conversation
has too, is `ambiguous`; one without a result is `unanswered`; a result whose call is missing or
ambiguous is `orphan`; of several results of a call one, the first by (turn, content), is `linked`,
the others are `repeated`. Calls on a cycle, or after one, get level and after null. Arguments that
are not a JSON object are invalid, so is an object that repeats a key. Canonical numbers: integers
of any length and decimals lose trailing zeros (1.00 is 1, and an integer); numbers with an
exponent are doubles and stay so (1e0 is 1.0, and no integer). A tool without schema is `unknown tool`. A null conversation or turn is
kept as a group of its own. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridica.llm.common import discard, materialize

#: Which types of a JSON value fit a schema's type.
FITS = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with call_status, results with result_status and their call's turn).

    calls: conv_id, turn, position, call_id, ...; results: conv_id, turn, call_id, ...
    """
    names = calls.where("call_id is not null").groupBy(F.col("conv_id").alias("n_conv"), F.col("call_id").alias("n_id")).agg(F.count("*").alias("n_calls"), F.min("turn").alias("call_turn"))
    answers = results.where("call_id is not null").select(F.col("conv_id").alias("a_conv"), F.col("call_id").alias("a_id"), F.lit(1).alias("n_results")).distinct()
    first = Window.partitionBy("conv_id", "call_id").orderBy(F.col("turn").asc_nulls_last(), "content")

    def with_calls(df: DataFrame) -> DataFrame:
        return df.join(names, F.col("conv_id").eqNullSafe(F.col("n_conv")) & (F.col("call_id") == F.col("n_id")), "left")

    used = ["n_conv", "n_id", "n_calls", "a_conv", "a_id", "n_results", "_place"]
    call_status = F.when(F.coalesce("n_calls", F.lit(0)) != 1, "ambiguous").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    result_status = F.when(F.coalesce("n_calls", F.lit(0)) != 1, "orphan").when(F.col("_place") == 1, "linked").otherwise("repeated")
    answered = with_calls(calls).join(answers, F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("call_id") == F.col("a_id")), "left")
    # only results of known calls are put in order, so that results without identifier meet in no task
    owned = with_calls(results)
    placed = owned.where("n_calls = 1").withColumn("_place", F.row_number().over(first)).unionByName(owned.where("n_calls is null or n_calls <> 1"), allowMissingColumns=True)
    return answered.withColumn("call_status", call_status).drop(*used, "call_turn"), placed.withColumn("result_status", result_status).drop(*used)


def levels(calls: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(conv_id, call_id, level, after): the longest chain of used calls before a call, and the latest turn of the call
    and all calls it depends on (null without turns); both null on or after a cycle.

    calls: conv_id, call_id, uses (array of call_ids) and, if there is one, turn. Uses that name no
    call of the conversation, or the call itself, do not count. An edge (call, used, w, t) stands
    for a chain of w uses, the latest of whose turns is t; used is null where it has reached a call
    of known level, w then being the level it asks for. Each round replaces an edge to a call that
    waits for at most one other by that call's own edges, so that chains double in length: a chain
    takes as many rounds as the logarithm of its calls. A round that settles no call leaves only
    cycles and what follows them; more than max_rounds are an error.
    """
    named = calls.where("call_id is not null")
    turn = F.col("turn").cast("bigint") if "turn" in calls.columns else F.lit(None).cast("bigint")
    nodes = named.groupBy("conv_id", "call_id").agg(F.max(turn).alias("t"))
    known = nodes.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"), F.col("t").alias("k_t"))
    uses = named.select("conv_id", "call_id", turn.alias("t"), F.explode("uses").alias("used")).where("used <> call_id").distinct()
    uses = uses.join(known, F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("used") == F.col("k_id"))).select("conv_id", "call_id", "used", F.lit(1).cast("bigint").alias("w"), F.greatest("t", "k_t").alias("t"))
    edges = materialize(uses.unionByName(nodes.select("conv_id", "call_id", F.lit(None).cast("string").alias("used"), F.lit(0).cast("bigint").alias("w"), "t")), "edges")
    before = None
    for step in range(max_rounds + 1):
        by_call = edges.groupBy("conv_id", "call_id").agg(F.count("used").alias("n_open"), F.max("used").alias("only"), F.max(F.when(F.col("used").isNotNull(), F.col("w"))).alias("w_only"), F.max(F.when(F.col("used").isNull(), F.col("w"))).alias("level"), F.max("t").alias("o_t"))
        waiting = by_call.where("n_open > 0").count()
        if not waiting or waiting == before:
            break
        if step == max_rounds:
            raise RuntimeError("levels did not settle")
        before = waiting
        ahead = by_call.where("n_open <= 1").select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_id"), "n_open", "only", "w_only", "level", "o_t")
        reached = edges.where("used is not null").join(ahead, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("used") == F.col("o_id")), "left")
        # all calls start with the edge (null, 0), so that level is null for a missing match alone; on a cycle, w grows up to 2 ** 40
        parts = F.when(F.col("level").isNull(), F.array(F.struct(F.col("used").alias("used"), F.col("w").alias("w")))).otherwise(
            F.array_compact(F.array(F.struct(F.lit(None).cast("string").alias("used"), (F.col("w") + F.col("level")).alias("w")), F.when(F.col("n_open") == 1, F.struct(F.col("only").alias("used"), F.least(F.col("w") + F.col("w_only"), F.lit(1 << 40)).alias("w")))))
        )
        stepped = reached.select("conv_id", "call_id", F.explode(parts).alias("e"), F.greatest("t", "o_t").alias("t")).select("conv_id", "call_id", "e.used", "e.w", "t")
        merged = edges.where("used is null").unionByName(stepped).groupBy("conv_id", "call_id", "used").agg(F.max("w").alias("w"), F.max("t").alias("t"))
        new = materialize(merged, "edges")
        discard(edges)
        edges = new
    settled = edges.groupBy("conv_id", "call_id").agg(F.count("used").alias("n_open"), F.max("w").alias("w"), F.max("t").alias("t"))
    done = F.col("n_open") == 0
    return settled.select("conv_id", "call_id", F.when(done, F.col("w").cast("int")).alias("level"), F.when(done, F.col("t")).alias("after"))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls plus problems (sorted array of strings; empty: the arguments fit).

    calls: conv_id, turn, position, name, arguments (JSON text). schemas: tool, parameter, type (a
    key of FITS), required; a tool without parameters has one row with null parameter. Schemas are
    reference data, gathered to one row per tool and joined by name.
    """
    fits = F.create_map(*[F.lit(x) for kv in FITS.items() for x in kv])
    shape = schemas.groupBy(F.col("tool").alias("name")).agg(F.array_compact(F.collect_list(F.when(F.col("parameter").isNotNull(), F.struct("parameter", fits[F.col("type")].alias("pattern"), "required")))).alias("shape"))
    parsed = calls.withColumn("_v", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("_ok", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    canonical = F.when(F.col("_ok"), F.to_json("_v"))
    parsed = parsed.withColumn("_keys", F.json_object_keys(canonical))
    parsed = parsed.withColumn("_kinds", F.transform_values(F.from_json(F.when(F.col("_ok"), F.col("arguments")), "map<string,variant>"), lambda k, v: F.schema_of_variant(v)))
    joined = parsed.join(shape, "name", "left")
    missing = F.transform(F.filter("shape", lambda s: s["required"] & ~F.array_contains("_keys", s["parameter"])), lambda s: F.concat(F.lit("missing "), s["parameter"]))
    unknown = F.transform(F.array_except("_keys", F.transform("shape", lambda s: s["parameter"])), lambda k: F.concat(F.lit("unexpected "), k))
    wrong = F.transform(
        F.filter("shape", lambda s: F.array_contains("_keys", s["parameter"]) & ~F.coalesce(F.regexp_like(F.col("_kinds")[s["parameter"]], F.concat(F.lit("^("), s["pattern"], F.lit(")$"))), F.lit(False))),
        lambda s: F.concat(F.lit("wrong type of "), s["parameter"]),
    )
    problems = F.when(F.col("shape").isNull(), F.array(F.lit("unknown tool"))).when(~F.col("_ok"), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))
    return joined.withColumn("problems", problems).drop("_v", "_ok", "_keys", "_kinds", "shape")


def format_messages(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message, call and result: conv_id, after, level, turn, position, kind, call_id, status, problems, json.

    messages: conv_id, turn, role, text. calls: conv_id, turn, position, call_id, name, arguments,
    uses. results: conv_id, turn, call_id, content.
    """
    linked, owned = link(calls, results)
    depth = levels(calls).select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_id"), "level", F.col("after").alias("d_after"))
    at = lambda df: df.drop("level").join(depth, F.col("conv_id").eqNullSafe(F.col("d_conv")) & (F.col("call_id") == F.col("d_id")), "left")
    checked = at(validate(linked, schemas))
    none = F.array().cast("array<string>")
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    plain = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
    said = messages.select("conv_id", F.col("turn").cast("bigint").alias("after"), F.lit(0).alias("level"), "turn", F.lit(-1).alias("position"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), none.alias("problems"), F.concat(F.lit('{"content":'), plain("text"), F.lit(',"role":'), plain("role"), F.lit("}")).alias("json"))
    alone = F.col("call_status") == "ambiguous"  # depends on no call that can be told
    made = checked.select("conv_id", F.when(alone, F.col("turn").cast("bigint")).otherwise(F.col("d_after")).alias("after"), "level", "turn", "position", F.lit("call").alias("kind"), "call_id", F.col("call_status").alias("status"), "problems", F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), plain("call_id"), F.lit(',"name":'), plain("name"), F.lit("}")).alias("json"))
    got = at(owned).select("conv_id", F.greatest("d_after", F.col("turn").cast("bigint")).alias("after"), "level", F.greatest("turn", "call_turn").alias("turn"), F.lit(1 << 30).alias("position"), F.lit("result").alias("kind"), "call_id", F.col("result_status").alias("status"), none.alias("problems"), F.concat(F.lit('{"content":'), plain("content"), F.lit(',"role":"tool","tool_call_id":'), plain("call_id"), F.lit("}")).alias("json"))
    return said.unionByName(made).unionByName(got)
