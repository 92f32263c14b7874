"""Tool calls and their results: linking, order, validation and canonical JSON.

Only DataFrame functions. Calls and results meet by hash join on their identifier, and order is a sort
key of each call. Only conversations with a dependency against their turns are gathered for it, up to
``FOLDED`` calls each; larger ones are ordered by joins, so a conversation may have any size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow.llm.common import written

#: A call in a message: JSON with ``id``, ``name``, ``arguments`` and ``after``, between these marks.
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
#: A result in a message: JSON with ``id`` and ``content``.
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"
#: How Spark names the types of JSON values, by the names that schemas use.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*",
    "object": "^OBJECT<.*",
}

#: Calls up to which the order of a conversation is found in one row.
FOLDED = 2000

Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def marked_calls(messages: DataFrame) -> DataFrame:
    """``(conv_id, call_id, turn, seq, name, arguments, after)`` of the calls marked in messages."""
    found = messages.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("seq", "json"))
    call = F.from_json("json", "id string, name string, arguments string, after array<string>")
    return found.select("conv_id", "turn", "seq", call.alias("c")).select(
        "conv_id", F.col("c.id").alias("call_id"), "turn", "seq", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after")
    )


def marked_results(messages: DataFrame) -> DataFrame:
    """``(conv_id, call_id, turn, seq, content)`` of the results marked in messages."""
    found = messages.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(RESULT), F.lit(1))).alias("seq", "json"))
    result = F.from_json("json", "id string, content string")
    return found.select("conv_id", F.col("turn"), "seq", result.alias("r")).select(
        "conv_id", F.col("r.id").alias("call_id"), "turn", "seq", F.col("r.content").alias("content")
    )


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as an array of strings in fixed order.

    ``schemas``: function name to parameter to ``(type, required)``; a null argument counts as none.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    cases = F.array(F.lit("unknown function"))
    for function, parameters in schemas.items():
        found = []
        for p, (kind, required) in sorted(parameters.items()):
            has = F.schema_of_variant(F.try_variant_get(value, f'$["{p}"]', "variant"))
            none = has.isNull() | (has == "VOID")
            wrong = F.when(~none & ~has.rlike(TYPES[kind]), F.lit(f"{p}: not {kind}"))
            found.append(F.when(none, F.lit(f"{p}: missing")).otherwise(wrong) if required else wrong)
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, parameters)) if parameters else F.array().cast("array<string>")))
        listed = F.concat(F.array_compact(F.array(*found).cast("array<string>")), F.transform(extra, lambda k: F.concat(k, F.lit(": unknown"))))
        cases = F.when(name == function, listed).otherwise(cases)
    return F.when(~is_object, F.array(F.lit("arguments: not an object"))).otherwise(cases)


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and without white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(arguments))


def _late(calls: DataFrame) -> DataFrame:
    """Dependencies as ``(conv_id, call_id, on_id, late)``: 1 if the other call stands behind."""
    edges = calls.select("conv_id", "call_id", "place", F.explode("after").alias("on_id")).where("on_id IS NOT NULL").distinct()
    on = calls.select("conv_id", F.col("call_id").alias("on_id"), F.col("place").alias("on_place"))
    return edges.join(on, ["conv_id", "on_id"]).select(
        "conv_id", "call_id", "on_id", (F.col("on_place") >= F.col("place")).cast("int").alias("late")
    )


def _shortened(edges: DataFrame) -> DataFrame:
    """Dependencies with the same levels, past calls that wait for one other only.

    Each round doubles the chains that a dependency spans. ``late`` adds up, to ``most`` + 1 at most,
    which a chain into a cycle reaches.
    """
    going = True
    while going:
        one = edges.groupBy("conv_id", F.col("call_id").alias("on_id")).agg(
            F.first("on_id").alias("next_id"), F.first("late").alias("more"), F.count("*").alias("n")
        ).where("n = 1").drop("n")
        longer = edges.join(one, ["conv_id", "on_id"], "left").withColumn("goes", F.col("next_id").isNotNull() & (F.col("late") <= F.col("most")))
        edges = longer.groupBy("conv_id", "call_id", F.when(F.col("goes"), F.col("next_id")).otherwise(F.col("on_id")).alias("on_id")).agg(
            F.max("most").alias("most"),
            F.max(F.when(F.col("goes"), F.least(F.col("late") + F.col("more"), F.col("most") + 1)).otherwise(F.col("late"))).alias("late"),
            F.max("goes").alias("goes"),
        )
        edges = written(edges, "late-edges")
        going = not edges.where("goes").isEmpty()
        edges = edges.drop("goes")
    return edges


def _folded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of conversations of up to ``FOLDED`` calls, each in one row.

    Calls that wait for none are done first; each that is done counts down those that wait for it,
    and raises their level. What is never counted down to none waits for a cycle. The work of a row is the
    product of its calls and its dependencies, whatever their shape.
    """
    place = W.partitionBy("conv_id").orderBy("place", "call_id")
    numbered = written(nodes.select("conv_id", "call_id", (F.row_number().over(place) - 1).alias("i")), "numbered-calls")
    on = numbered.select("conv_id", F.col("call_id").alias("on_id"), F.col("i").alias("on"))
    found = written(edges.join(numbered, ["conv_id", "call_id"]).join(on, ["conv_id", "on_id"]).select("conv_id", "i", "on", "late"), "numbered-edges")
    waits = found.groupBy("conv_id", "i").agg(F.count("*").cast("int").alias("waits"))
    followed = found.groupBy("conv_id", "on").agg(F.sort_array(F.collect_list(F.struct("i", "late"))).alias("by"))
    of = followed.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("on", F.transform("by", lambda x: x["i"]).alias("i")))).alias("who"),
                                         F.map_from_entries(F.collect_list(F.struct("on", F.transform("by", lambda x: x["late"]).alias("late")))).alias("late"))
    row = numbered.join(waits, ["conv_id", "i"], "left").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "call_id", F.coalesce("waits", F.lit(0)).alias("waits")))).alias("calls")
    )
    row = row.join(of, "conv_id").withColumn("waits", F.transform("calls", lambda c: c["waits"]))

    def state(queue: Column, waits: Column, level: Column) -> Column:
        return F.struct(queue.alias("queue"), waits.alias("waits"), level.alias("level"))

    def step(st: Column, k: Column) -> Column:
        done = F.get(st["queue"], k)
        who, late = F.try_element_at("who", done), F.try_element_at("late", done)
        here = F.get(st["level"], done)
        level = F.transform(st["level"], lambda x, j: F.greatest(x, here + F.try_element_at(late, F.nullif(F.array_position(who, j).cast("int"), F.lit(0)))))
        left = F.transform(st["waits"], lambda x, j: F.when(F.array_contains(who, j), x - 1).otherwise(x))
        queue = F.concat(st["queue"], F.filter(who, lambda j: F.get(st["waits"], j) == 1))
        return F.when(who.isNull(), st).otherwise(state(queue, left, level))

    first = F.filter(F.transform("waits", lambda x, j: F.when(x == 0, j)), lambda j: j.isNotNull())
    begin = state(first, F.col("waits"), F.transform("waits", lambda x: F.lit(0)))
    end = row.select("conv_id", "calls", F.aggregate(F.sequence(F.lit(0), F.size("calls") - 1), begin, step).alias("end"))
    each = end.select("conv_id", F.explode(F.arrays_zip("calls", F.col("end.waits").alias("waits"), F.col("end.level").alias("level"))).alias("c"))
    return each.select("conv_id", "c.calls.call_id", F.when(F.col("c.waits") == 0, F.col("c.level")).cast("long").alias("level"))


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of calls that may not stand where they do; null in a cycle.

    ``calls`` has unique ``(conv_id, call_id)``, ``place`` and ``after``. Sorted by level and
    place, each call comes behind those that it waits for: its level is at least theirs, and
    higher if they stand behind it. A transcript in order has no late dependency and so no row
    here. Conversations of up to ``FOLDED`` calls take a fixed number of joins, see ``_folded``; larger
    ones as many rounds as ``_risen`` needs.
    """
    edges = written(_late(calls), "call-edges")
    late = edges.groupBy("conv_id").agg(F.sum("late").alias("most")).where("most > 0")
    size = calls.join(late, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"), F.first("most").alias("most"))
    size = written(size, "late-conversations")
    few, many = size.where(F.col("n") <= FOLDED), size.where(F.col("n") > FOLDED)
    folded = _folded(calls.join(few, "conv_id", "left_semi"), edges.join(few, "conv_id", "left_semi"))
    if many.isEmpty():
        return folded
    many = many.select("conv_id", "most")
    return folded.unionByName(_risen(calls.select("conv_id", "call_id").join(many, "conv_id"), edges.join(many, "conv_id")))


def _risen(at: DataFrame, edges: DataFrame) -> DataFrame:
    """The levels of ``_folded`` by joins, for conversations of any size.

    Chains of calls that wait for one other each are shortened by doubling, then levels rise
    until none moves. A level counts late dependencies, so one above those of the conversation
    belongs to a cycle, or waits for one; it rises no further.
    """
    at = at.withColumn("level", F.lit(0).cast("long"))
    edges = _shortened(written(edges, "late-edges")).drop("most")
    at, moved = written(at, "levels"), True
    while moved:
        on = at.select("conv_id", F.col("call_id").alias("on_id"), F.col("level").alias("on_level"))
        raised = edges.join(on, ["conv_id", "on_id"]).groupBy("conv_id", "call_id").agg(F.max(F.col("on_level") + F.col("late")).alias("raised"))
        new = at.join(raised, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", "most",
            F.least(F.greatest("level", F.coalesce("raised", "level")), F.col("most") + 1).alias("level"),
            (F.col("raised").isNotNull() & (F.least("raised", F.col("most") + 1) > F.col("level"))).alias("moved"),
        )
        new = written(new, "levels")
        moved = not new.where("moved").isEmpty()
        at = new
    return at.select("conv_id", "call_id", F.when(F.col("level") <= F.col("most"), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per result without a call.

    ``calls``: ``(conv_id, call_id, turn, seq, name, arguments, after)``; ``results``: ``(conv_id,
    call_id, turn, seq, content)``; other columns are left out. Of calls, or results, that share an
    identifier the first by turn and seq counts (null: last), the others are ``repeated``; rows
    with the same place are ordered by their content. Returns ``conv_id, call_id, turn, seq, name``;
    ``status``: linked, unanswered, early (a result before its call), repeated, orphan or
    nameless (a null id, which links to nothing); ``problems``, see there; ``level``, the sort
    key before turn and seq, null in a cycle; ``json``, canonical JSON of call and result.
    Equal rows are one call or result and its repetitions. Texts may be of any length. Empty tables
    give no rows.
    """
    place = F.struct(F.col("turn").isNull(), "turn", F.col("seq").isNull(), "seq")
    calls = calls.select(
        "conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("int").alias("seq"), "name", "arguments",
        F.coalesce("after", F.array().cast("array<string>")).alias("after"),
    )
    calls = calls.withColumn("place", place).withColumn("order", F.struct("place", "name", "arguments", "after"))
    results = results.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("int").alias("seq"), "content")
    results = results.withColumn("order", F.struct(place, "content"))
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    key = ["conv_id", "call_id"]
    # One row per identifier on either side: the first of those that share it.
    call = calls.where(known).groupBy(key).agg(F.min(F.struct("order", "turn", "seq", "name", "arguments", "after", "place")).alias("c"), F.count("*").alias("n_calls"))
    answer = results.where(known).groupBy(key).agg(F.min(F.struct("order", "turn", "seq", "content")).alias("r"), F.count("*").alias("n_results"))
    call = written(call.select(*key, "c.turn", "c.seq", "c.name", "c.arguments", "c.after", "c.place", "n_calls"), "calls")
    level = levels(call)
    both = call.join(answer, key, "full").join(level.withColumn("ordered", F.lit(True)), key, "left")
    early = F.col("r.turn") < F.col("turn")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").when(early, "early").otherwise("linked")
    )
    nothing = F.array().cast("array<string>")
    linked = both.select(
        *key, F.coalesce("turn", "r.turn").alias("turn"), F.coalesce("seq", "r.seq").alias("seq"), "name", status.alias("status"),
        F.when(F.col("n_calls").isNull(), nothing).otherwise(problems(F.col("name"), F.col("arguments"), schemas)).alias("problems"),
        F.when(F.col("ordered"), F.col("level")).otherwise(F.lit(0).cast("long")).alias("level"),
        F.to_json(
            F.struct(
                F.try_parse_json("arguments").alias("arguments"), "call_id", F.col("r.content").alias("content"), "name"
            )
        ).alias("json"),
    )
    again = F.when(F.expr(known), "repeated").otherwise("nameless")

    def rest(rows: DataFrame, first: DataFrame, of: Column, json: Column) -> DataFrame:
        """The rows that were not the first of their identifier."""
        same = rows.select("*", F.lit(1).alias("one")).join(first, key, "left")
        # Equal rows are the first once; how many more there are is known from their count.
        more = same.groupBy(*key, "turn", "seq", of.alias("name"), json.alias("json"), again.alias("status")).agg(
            F.count("*").alias("n"), F.max((F.col("order") == F.col("least")).cast("int")).alias("is_first")
        )
        copies = F.col("n") - F.coalesce("is_first", F.lit(0))
        return more.where(copies > 0).select(
            *key, "turn", "seq", "name", "status", nothing.alias("problems"), F.lit(0).cast("long").alias("level"), "json",
            F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"),
        ).drop("copy")

    def least(rows: DataFrame) -> DataFrame:
        return rows.where(known).groupBy(key).agg(F.min("order").alias("least"), F.count("*").alias("of")).where("of > 1").drop("of")

    def others(rows: DataFrame, of: Column, json: Column) -> DataFrame:
        """Rows whose identifier is shared or null; only these need the comparison."""
        shared = least(rows)
        some = rows.join(shared.select(*key), key, "left_semi").unionByName(rows.where(f"NOT coalesce({known}, false)"))
        return rest(some, shared, of, json)

    call_json = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "name"))
    result_json = F.to_json(F.struct("call_id", "content"))
    return linked.unionByName(others(calls, F.col("name"), call_json)).unionByName(others(results, F.lit(None).cast("string"), result_json))
