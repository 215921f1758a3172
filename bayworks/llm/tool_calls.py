"""Tool-call linking for chat data: calls meet their results by identifier, stand in an order
that respects their dependencies, have their arguments checked, and become canonical JSON.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayworks.session import settle_table

#: Types of JSON schema -> what schema_of_variant says, as a pattern.
KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY.*", "object": "^OBJECT.*",
}
#: What a chat turn is as a call: its role is the tool, its text the argument.
TURN = {
    "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 0}},
    "required": ["text", "words"],
    "additionalProperties": False,
}
TURN_SCHEMAS = {"user": TURN, "system": TURN}


def _field_errors(name: str, rule: dict, required: bool) -> list[Column]:
    """Messages, or nulls, for one argument; ``v`` is the parsed arguments column."""
    path = "$['" + name.replace("'", "\\'") + "']"
    value = F.try_variant_get("v", path, "variant")
    kind = F.schema_of_variant(value)
    absent = value.isNull() | (kind == "VOID")
    out = [F.when(absent, f"missing {name}")] if required else []
    if "type" in rule:
        out.append(F.when(~absent & ~kind.rlike(KINDS[rule["type"]]), f"{name} is not {rule['type']}"))
    text, number = F.try_variant_get("v", path, "string"), F.try_variant_get("v", path, "double")
    checks = {
        "minLength": lambda k: F.char_length(text) < k, "maxLength": lambda k: F.char_length(text) > k,
        "minimum": lambda k: number < k, "maximum": lambda k: number > k, "enum": lambda k: ~text.isin(*map(str, k)),
    }
    out += [F.when(~absent & test(rule[k]), f"{name} breaks {k}") for k, test in checks.items() if k in rule]
    return out


def argument_errors(tool: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Sorted messages about ``arguments``; the column ``v`` holds them parsed."""
    out = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        fields = schema.get("properties", {})
        found = [e for f, rule in fields.items() for e in _field_errors(f, rule, f in schema.get("required", []))]
        if schema.get("additionalProperties", True) is False:
            strange = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)).cast("array<string>"))
            found.append(F.when(F.size(strange) > 0, F.concat(F.lit("unexpected "), F.array_join(F.array_sort(strange), " "))))
        listed = F.array_sort(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")
        out = F.when(tool == name, listed).otherwise(out)
    not_object = F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True))
    return F.when(not_object, F.array(F.lit("arguments are no object"))).otherwise(out)


#: More than any chain of calls is long; keeps the lengths around a cycle in range.
_FAR = 1 << 40


def ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, step, looped) of identified calls (conv_id, call_id, turn, after, one row each).

    The step is the turn, or more if a dependency's step demands it: one more than each of
    its dependencies at least. Sorting by step, then turn, is a topological order, and where
    every dependency has an earlier turn it is the order of turns: such conversations are
    done after one join. Dependencies on unknown calls do not count.

    In the others, a call without open dependencies is done and is taken off what depends on
    it, which takes over its step (Kahn). A dependency on a call that itself has just one is
    passed on to that one, with the length of both, so a chain of any length takes rounds
    that grow with its logarithm; calls with several open dependencies each take a round for
    each level. When a round takes nothing off, what is left depends on a cycle: those
    calls are marked and get no step. Turns play no part in the number of rounds.
    """
    key = ["conv_id", "call_id"]
    now = calls.select(*key, F.col("turn").cast("long").alias("step"))
    edges = calls.select(*key, F.explode("after").alias("needs")).distinct()
    asked = now.withColumnsRenamed({"call_id": "needs", "step": "its"})
    edges = settle_table(edges.join(asked, ["conv_id", "needs"]).join(now, key).withColumn("late", F.col("its") >= F.col("step")))
    odd = edges.where("late").select("conv_id").distinct()
    edges = settle_table(edges.join(odd, "conv_id", "left_semi").select(*key, "needs", F.lit(1).cast("long").alias("far")))
    left = edges.count()
    if not left:
        return now.withColumn("looped", F.lit(False))
    value = settle_table(now.join(odd, "conv_id", "left_semi"))
    while left:
        open_ = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("next"), F.max("far").alias("more"))
        open_ = open_.select("conv_id", F.col("call_id").alias("needs"), "n", "next", "more")
        its = value.withColumnsRenamed({"call_id": "needs", "step": "its"})
        both = settle_table(edges.join(its, ["conv_id", "needs"]).join(open_, ["conv_id", "needs"], "left"))
        due = both.groupBy(*key).agg(F.max(F.col("its") + F.col("far")).alias("least"))
        value = settle_table(value.join(due, key, "left").select(*key, F.greatest("step", F.coalesce("least", "step")).alias("step")))
        passed = (F.col("n") == 1) & (F.col("needs") != F.col("call_id"))
        kept = both.where("n is not null").select(
            *key, F.when(passed, F.col("next")).otherwise(F.col("needs")).alias("needs"),
            F.when(passed, F.least(F.col("far") + F.col("more"), F.lit(_FAR))).otherwise(F.col("far")).alias("far"),
        )
        edges = settle_table(kept.groupBy(*key, "needs").agg(F.max("far").alias("far")))
        before, left = left, edges.count()
        if left == before:
            break
    stuck = edges.select(*key).distinct().withColumn("looped", F.lit(True))
    moved = value.select(*key, F.col("step").alias("moved"))
    out = now.join(moved, key, "left").join(stuck, key, "left").withColumn("looped", F.coalesce("looped", F.lit(False)))
    return out.select(*key, F.when(~F.col("looped"), F.coalesce("moved", "step")).alias("step"), "looped")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and each result that no call claims.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON text), after (identifiers).
    ``results``: conv_id, call_id, turn, content. Returns conv_id, call_id, turn, step, tool,
    status, valid, errors, line.

    status: linked; unanswered (no result); cycle; duplicate (a later call with the same
    identifier); unidentified (null conversation, identifier or turn); for results orphan
    (no such call) and extra (a later result of an answered call). Of calls with one
    identifier the one with the smallest turn, then arguments, counts; repeated rows are
    told apart by position. Null ``after`` means none. ``valid`` is null for results. ``line``
    is JSON with sorted keys, no blanks, and no null members; arguments that are not JSON
    stand in it as text.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()
    calls = settle_table(calls.select("conv_id", "call_id", "turn", "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"), F.monotonically_increasing_id().alias("row")))
    results = settle_table(results.select("conv_id", "call_id", "turn", "content", F.monotonically_increasing_id().alias("row")))
    key = ["conv_id", "call_id"]
    first = calls.where(named).groupBy(key).agg(F.min(F.struct("turn", "arguments", "row")).alias("first"))
    first = first.select(*key, F.col("first.turn").alias("turn"), F.col("first.row").alias("row"))
    counted = settle_table(calls.join(first.select("row"), "row"))
    answer = results.where(named).groupBy(key).agg(F.min(F.struct("turn", "row", "content")).alias("answer"))
    answers = settle_table(answer.join(first.select(*key), key).select(*key, F.col("answer.row").alias("answer_row"), F.col("answer.content").alias("content")))
    steps = ordered(counted.select(*key, "turn", "after"))
    good = counted.join(steps, key).join(answers, key, "left")
    status = F.when(F.col("looped"), "cycle").when(F.col("answer_row").isNull(), "unanswered").otherwise("linked")
    good = good.select("conv_id", "call_id", "turn", "step", "tool", "arguments", "content", status.alias("status"))
    other = calls.join(first.select("row"), "row", "left_anti")
    none = F.lit(None)
    other = other.select("conv_id", "call_id", "turn", none.cast("long").alias("step"), "tool", "arguments", none.cast("string").alias("content"),
                         F.when(named, "duplicate").otherwise("unidentified").alias("status"))
    rows = good.unionByName(other).withColumn("v", F.try_parse_json("arguments"))
    rows = rows.withColumn("errors", argument_errors(F.col("tool"), F.col("arguments"), schemas))
    plain = F.when(F.col("v").isNull(), F.col("arguments"))
    line = F.to_json(F.struct(F.col("v").alias("arguments"), plain.alias("arguments_text"), "call_id", F.col("content").alias("result"), "step", "tool"))
    rows = rows.select("conv_id", "call_id", "turn", "step", "tool", "status", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), line.alias("line"))
    claimed = answers.select(F.col("answer_row").alias("row"))
    free = results.join(claimed, "row", "left_anti").join(first.select(*key, F.lit(True).alias("called")), key, "left")
    kind = F.when(~named, "unidentified").when(F.col("called"), "extra").otherwise("orphan")
    free = free.select(
        "conv_id", "call_id", "turn", none.cast("long").alias("step"), none.cast("string").alias("tool"), kind.alias("status"),
        none.cast("boolean").alias("valid"), none.cast("string").alias("errors"), F.to_json(F.struct("call_id", F.col("content").alias("result"))).alias("line"),
    )
    return rows.unionByName(free)


def format_conversations(turns: DataFrame, schemas: dict[str, dict] = TURN_SCHEMAS) -> DataFrame:
    """Chat turns (conv_id, turn, role, text) as calls and results, linked.

    A turn that is not the assistant's calls for the assistant's next turn: the role is the
    tool, text and number of words are the arguments, conversation and turn the identifier.
    It depends on the call two turns before, whose result stands between them. Turns without
    a conversation or number are unidentified; a null text gives arguments without text. Of
    repeated turns the first is the call or its answer, the others are duplicates or extra, as
    ``link`` says.
    """
    ident = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    asked = F.to_json(F.struct("text", F.when(F.col("text").isNotNull(), words).otherwise(0).alias("words")))
    at = lambda k: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + k).cast("string"))
    said = F.col("role").eqNullSafe("assistant")
    calls = turns.where(~said).select(
        "conv_id", F.when(known, ident).alias("call_id"), "turn", F.col("role").alias("tool"), asked.alias("arguments"),
        F.when(known, F.array(at(-2))).alias("after"),
    )
    results = turns.where(said).select("conv_id", F.when(known, at(-1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return link(calls, results, schemas)
