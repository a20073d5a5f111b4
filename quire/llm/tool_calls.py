"""Chat formatting: link tool calls to results, order, validate, serialise.

Calls and results are hash-joined by identifier; a call names at most one call
that must come before it, so the calls of a conversation are a forest, and their
depths are found by pointer doubling (log2 of the longest chain rounds, each a
join on conversation and call).  Arguments are checked against schemas and
serialised as canonical JSON: the variant type keeps the keys of an object in
order, and every number outside of strings is then written by one rule.  DataFrame functions only; no conversation is gathered in one
task, so one that holds a third of all rows is no different from others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import materialize

#: JSON type -> name that schema_of_variant gives for it.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "number": ("BIGINT", "DOUBLE", "DECIMAL")}


#: Strings, numbers, and what lies between them.  The quantifiers are possessive:
#: no step back into a string, however long it is.
TOKENS = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'


def number(token):
    """The one spelling of a JSON number: that of RFC 8785 (ECMAScript), but a whole number
    that is written without point or exponent keeps all of its digits, however large.

    So 1, 1.0, 10e-1 are ``1``; 1e21 is ``1e+21``; 0.0000001 is ``1e-7``; -0 is ``0``."""
    d = token.cast("double")
    text, size = d.cast("string"), F.abs(d)
    # the digits of the shortest spelling without an exponent
    large, small = d.cast("decimal(38,10)").cast("string"), d.cast("decimal(38,30)").cast("string")
    plain = F.when(size >= 1e7, large).when(size < 1e-3, small).otherwise(text)
    plain = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    short = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E(-?)", "e$1")
    scientific = F.when(size >= 1, F.regexp_replace(short, "e", "e+")).otherwise(short)
    whole = F.when(token == "-0", "0").otherwise(token)
    spelt = F.when(d == 0, "0").when((size >= 1e-6) & (size < 1e21), plain).otherwise(scientific)
    return F.when(token.rlike("^-?[0-9]+$"), whole).otherwise(spelt)


def respelt(json):
    """JSON text with every number in its one spelling; keys must be in order already."""
    tokens = F.regexp_extract_all(json, F.lit(TOKENS), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[-0-9]"), number(t)).otherwise(t)), "")


def canonical(json):
    """JSON text with the keys of every object in code-point order, no spaces and one spelling
    per number; null if it isn't JSON."""
    return respelt(F.to_json(F.try_parse_json(json)))


def argument_error(schemas: dict):
    """The first fault of (name, arguments) against ``schemas``, else null.

    schemas: function -> {parameter: (type, required)}.  Faults: ``unknown
    function``, ``not JSON``, ``not an object``, ``missing: p``, ``type: p``,
    ``unknown: p`` (first in code-point order)."""
    parsed = F.try_parse_json(F.col("arguments"))
    keys = F.json_object_keys(F.col("arguments"))
    out = F.lit("unknown function")
    for name, params in schemas.items():
        checks = F.lit(None).cast("string")
        unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(p) for p in params]) if params else F.array().cast("array<string>")))
        checks = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.get(unknown, F.lit(0))))
        for p, (kind, required) in sorted(params.items(), reverse=True):
            value = F.try_variant_get(parsed, "$['" + p.replace("'", "\\'") + "']", "variant")
            got = F.schema_of_variant(value)
            wrong = value.isNotNull() & ~F.expr("true") if kind == "any" else value.isNotNull() & ~F.regexp_extract(got, r"^[A-Z]+", 0).isin(*TYPES[kind])
            if required:
                checks = F.when(value.isNull(), F.lit(f"missing: {p}")).when(wrong, F.lit(f"type: {p}")).otherwise(checks)
            else:
                checks = F.when(wrong, F.lit(f"type: {p}")).otherwise(checks)
        checks = F.when(parsed.isNull(), F.lit("not JSON")).when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("not an object")).otherwise(checks)
        out = F.when(F.col("name") == name, checks).otherwise(out)
    return F.when(F.col("name").isNull(), F.lit("unknown function")).otherwise(out)


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` from ``calls(conv_id, call_id, after)``; null on a cycle.

    A call whose ``after`` names no call of its conversation starts a chain.
    Pointer doubling: each round every open call jumps over its pointer's
    pointer.  Whoever has not reached a start after log2(n) rounds is on a cycle
    or behind one.
    """
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    state = materialize(
        calls.select("conv_id", "call_id", "after")
        .join(known, (F.col("conv_id") == F.col("c")) & (F.col("after") == F.col("k")), "left")
        .select("conv_id", "call_id", F.col("k").alias("at"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    )
    rounds, n = 0, None
    while True:
        open_ = state.where("at is not null")
        n = state.count() if n is None else n
        if not open_.limit(1).count() or (1 << rounds) > 2 * n:
            break
        to = state.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("at").alias("next"), F.col("depth").alias("more"))
        state = materialize(
            state.join(to, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("k")), "left")
            .select("conv_id", "call_id", F.col("next").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )
        rounds += 1
    return state.select("conv_id", "call_id", F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call: ``conv_id, call_id, turn, depth, error, status, message``.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (call id or
    null); results: conv_id, call_id, content.  (depth, turn, call_id) is a
    topological order within a conversation: a call's ``after`` is one level
    up.  status: ``linked``, ``unanswered`` (no result), ``invalid`` (arguments
    fail), ``cycle``.  message is canonical JSON of call and result.

    * An identifier claimed by several rows (repeated rows too) is one call: the
      lowest (turn, name, arguments, after) counts, nulls first; several results:
      the lowest content that isn't null.
    * Rows without conv_id or call_id, and results of no call, are left out.
    * Null arguments: ``not JSON``.  Empty tables: empty result.  Very long
      arguments and contents are kept whole.  Other columns are ignored.
    """
    one = (
        calls.where("conv_id is not null and call_id is not null")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
        .select("conv_id", "call_id", "c.turn", "c.name", "c.arguments", "c.after")
    )
    one = materialize(one)
    answer = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    out = one.join(depths(one), ["conv_id", "call_id"]).join(answer, ["conv_id", "call_id"], "left").withColumn("error", argument_error(schemas))
    status = (
        F.when(F.col("depth").isNull(), "cycle").when(F.col("error").isNotNull(), "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    )
    message = F.to_json(
        F.struct(
            F.col("after"),
            F.try_parse_json("arguments").alias("arguments"),
            F.col("content"),
            F.col("call_id").alias("id"),
            F.col("name"),
        ),
        {"ignoreNullFields": "false"},
    )
    # strings in the message hold no numbers of its own, and its keys are in order
    message = respelt(message)
    return out.select("conv_id", "call_id", "turn", "depth", "error", status.alias("status"), message.alias("message"))


#: The schema that the query checks turns against.
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def conversation_calls(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read ``conversations(conv_id, turn, role, text)`` as calls and results.

    An assistant turn calls ``reply`` with its text; its identifier is its turn,
    it comes after the assistant turn two before it, and the user's turn that
    follows is its result."""
    rows = conv.select("conv_id", "turn", "role", "text")
    said = rows.where("role = 'assistant'")
    calls = said.select(
        "conv_id",
        F.col("turn").cast("string").alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        (F.col("turn") - 2).cast("string").alias("after"),
    )
    results = rows.where("role = 'user'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op9_tool_calls(spark, sf_dir):
    from quire.llm.store import read_table

    calls, results = conversation_calls(read_table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, REPLY)


OP9_SQL = r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), u AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
), d AS (
  SELECT conv_id, turn, 0::BIGINT AS depth FROM a
  WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.conv_id, a.turn, d.depth + 1 FROM d JOIN a ON a.conv_id = d.conv_id AND a.turn = d.turn + 2
)
SELECT a.conv_id, a.turn::VARCHAR AS call_id, a.turn, d.depth, NULL::VARCHAR AS error,
       CASE WHEN u.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       '{"after":"' || (a.turn - 2) || '","arguments":{"text":' || to_json(a.text) || ',"turn":' || a.turn
         || '},"content":' || coalesce(to_json(u.content)::VARCHAR, 'null') || ',"id":"' || a.turn || '","name":"reply"}' AS message
FROM a JOIN d USING (conv_id, turn) LEFT JOIN u USING (conv_id, turn)
"""
