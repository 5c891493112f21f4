"""Chat formatting: linked, checked and ordered tool calls as canonical JSON lines.

A turn whose text is a JSON object with "tool_calls" carries calls ({"id", "name", "arguments", "after": [ids]}, and "content" for its
words); a turn of role "tool" carries a result ({"tool_call_id", "content"}). Any other turn is a message. Calls and results are joined by
(conversation, id). The output has one row for each message, call and result, never one for a whole conversation, so a conversation of any
length is spread over tasks; its order is given by the columns (ord_turn, part, level, place).

Every turn has the identifier "t" + turn, and answers the turn before it (reply_to) where the conversation has one. A message's level is
the length of the chain of turns it ends; it is found by pointer doubling, in as many joins as the longest chain's length has binary
digits, so a very long conversation isn't brought together either. Its status is "valid" or "unknown_role".

Order of calls: a call follows the calls named in its "after" (level = longest chain of such calls; calls on a cycle, or that follow one on a cycle,
have level null and status "cyclic"), and a result follows its call. Chains of calls that each follow one other are run through by pointer
doubling too; only calls that follow several are settled level by level. Arguments are checked against the schema of the tool: status "valid", or "unknown_tool",
"bad_arguments". An id that several calls of a conversation share belongs to the first (turn, place), the others are "repeated_id"; of
several results the first after the call counts, then the first of all, the others are "repeated_id"; a result without a call is
"orphan"; a call without a result is valid all the same, with linked false.

Canonical JSON: keys in order, no spaces, numbers and strings as Spark writes variants. Null text is an empty message; a null role is "";
a null conv_id or turn keeps its row and links with nothing; malformed JSON is a message; repeated rows are rows of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assimspark.llm.common import Scratch, materialise

#: Tools and their parameters: name -> (JSON kind, required).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "get_weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
    "run_code": {"language": ("string", True), "source": ("string", True)},
}
ROLES = ("system", "user", "assistant", "tool")
#: Fixed map: what schema_of_variant says of each JSON kind.
KINDS = {"string": r"STRING", "integer": r"BIGINT", "number": r"(BIGINT|DOUBLE|DECIMAL.*)", "boolean": r"BOOLEAN", "array": r"ARRAY.*", "object": r"OBJECT.*"}


def _canonical(variant: Column) -> Column:
    return F.to_json(variant)


def arguments_status(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """"valid", "unknown_tool" or "bad_arguments" for a call's arguments (a variant)."""
    out = F.lit("unknown_tool")
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    for tool, parameters in schemas.items():
        good = is_object
        for p, (kind, required) in parameters.items():
            value = F.try_variant_get(arguments, f"$.{p}", "variant")
            fits = F.schema_of_variant(value).rlike(f"^{KINDS[kind]}$")
            good = good & F.coalesce(fits, F.lit(not required))
        listed = F.map_keys(F.from_json(F.to_json(arguments), "map<string,string>"))
        strangers = F.array_except(listed, F.array(*map(F.lit, parameters)).cast("array<string>"))
        good = good & F.coalesce(F.size(strangers) == 0, F.lit(False))
        out = F.when(name == tool, F.when(good, "valid").otherwise("bad_arguments")).otherwise(out)
    return out


def reply_chains(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, chain): the turn that each turn answers (null: none), and how many turns its chain has before it."""
    scratch = Scratch(turns.sparkSession)
    keys = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = keys.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("reply_to"))
    now = scratch.write(keys.join(before, ["conv_id", "turn"], "left").select("*", F.col("reply_to").alias("up"), F.col("reply_to").isNotNull().cast("long").alias("chain")), "chat-chains")
    while now.where("up is not null").limit(1).count():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("above"), F.col("chain").alias("more"))
        further = now.where("up is not null").join(above, ["conv_id", "up"]).select("conv_id", "turn", "reply_to", F.col("above").alias("up"), (F.col("chain") + F.col("more")).alias("chain"))
        after = scratch.write(now.where("up is null").select(*further.columns).unionByName(further), "chat-chains")
        scratch.drop(now)
        now = after
    return now.drop("up")


def _doubled(single: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, id, up, dist, late): for calls that need one other (conv_id, id, turn, needs) the first call up the chain that doesn't, how far it is and the latest turn
    before it. Each round doubles how far all have come; those that never arrive are on cycles, or hang on them, and have no row."""
    chained = single.select("conv_id", F.col("id").alias("up"), F.lit(True).alias("open"))
    start = single.select("conv_id", "id", F.col("needs").alias("up"), F.lit(1).cast("long").alias("dist"), F.col("turn").alias("late")).join(chained, ["conv_id", "up"], "left")
    now = scratch.write(start.withColumn("open", F.coalesce("open", F.lit(False))), "chat-chains")
    most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        if not now.where("open").limit(1).count():
            break
        above = now.select("conv_id", F.col("id").alias("up"), F.col("up").alias("above"), F.col("dist").alias("more"), F.col("late").alias("later"), F.col("open").alias("on"))
        moved = now.where("open").join(above, ["conv_id", "up"]).select("conv_id", "id", F.col("above").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.greatest("late", "later").alias("late"), F.col("on").alias("open"))
        after = scratch.write(now.where("not open").select(*moved.columns).unionByName(moved), "chat-chains")
        scratch.drop(now)
        now = after
    return now.where("not open").drop("open")


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level, floor_turn) of the calls that hang on others; those without are on cycles or hang on them.

    Chains of calls that need one other each are run through by pointer doubling. What is left are calls that need several: these are settled in
    rounds, each of which writes and appends the calls that it settles.
    """
    scratch = Scratch(calls.sparkSession)
    waits = calls.select("conv_id", "id", "turn", F.explode("after").alias("needs")).join(calls.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_semi").distinct()
    waits = scratch.write(waits, "chat-waits")
    roots = calls.join(waits, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.lit(0).cast("long").alias("level"), F.col("turn").alias("floor_turn"))
    if not waits.limit(1).count():
        return roots.withColumn("level", F.col("level").cast("int"))
    single = scratch.write(waits.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.max("turn").alias("turn"), F.min("needs").alias("needs")), "chat-single")
    several = waits.join(single.where("n > 1").select("conv_id", "id"), ["conv_id", "id"], "left_semi")
    chains = _doubled(single.where("n = 1").select("conv_id", "id", "turn", "needs"), scratch)
    ends = single.where("n = 1").select("conv_id", F.col("id").alias("needs"))
    far = chains.select("conv_id", F.col("id").alias("needs"), "up", "dist", "late")
    # A need in the middle of a chain is one of the chain's end, from further away; one on a cycle is never settled (up is null).
    edges = several.join(far, ["conv_id", "needs"], "left").join(ends.withColumn("chained", F.lit(True)), ["conv_id", "needs"], "left")
    edges = edges.select("conv_id", "id", F.when(F.col("chained"), F.col("up")).otherwise(F.col("needs")).alias("up"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), F.greatest("turn", "late").alias("late"))
    edges, settled = scratch.write(edges, "chat-edges"), scratch.write(roots, "chat-settled")
    while True:
        met = edges.join(settled.select("conv_id", F.col("id").alias("up"), "level", "floor_turn"), ["conv_id", "up"], "left")
        ready = met.groupBy("conv_id", "id").agg(F.max(F.col("level") + F.col("dist")).alias("level"), F.max(F.greatest("floor_turn", "late")).alias("floor_turn"), F.count("*").alias("n"), F.count("level").alias("k")).where("n = k")
        new = scratch.write(ready.select("conv_id", "id", "level", "floor_turn"), "chat-settled")
        if not new.limit(1).count():
            break
        rest = scratch.write(edges.join(new, ["conv_id", "id"], "left_anti"), "chat-edges")
        scratch.drop(edges)
        edges, settled = rest, settled.unionByName(new)
    on = settled.select("conv_id", F.col("id").alias("up"), "level", "floor_turn")
    chained = chains.join(on, ["conv_id", "up"]).select("conv_id", "id", (F.col("level") + F.col("dist")).alias("level"), F.greatest("floor_turn", "late").alias("floor_turn"))
    return scratch.write(settled.unionByName(chained).withColumn("level", F.col("level").cast("int")), "chat-levels")


def chat_lines(conversations: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, turn, ord_turn, part, level, place, kind, status, linked, json."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    parsed = turns.withColumn("v", F.when(text.startswith("{"), F.try_parse_json("text")))
    call_type = "array<struct<id:string,name:string,arguments:variant,after:array<string>>>"
    parsed = parsed.withColumn("calls", F.try_variant_get("v", "$.tool_calls", call_type)).withColumn("result_id", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))
    parsed = materialise(parsed.withColumn("n_calls", F.coalesce(F.size("calls"), F.lit(0))).withColumn("v_text", F.to_json("v")).withColumn("calls_text", F.to_json("calls")).drop("v", "calls"), "chat-turns")
    has_calls = F.col("n_calls") > 0

    content = F.when(has_calls, F.coalesce(F.try_variant_get(F.try_parse_json("v_text"), "$.content", "string"), F.lit(""))).otherwise(F.col("text"))
    message = parsed.where(F.col("result_id").isNull()).join(reply_chains(parsed), ["conv_id", "turn"], "left")
    named = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    plain = message.select(
        "conv_id", "turn", F.col("turn").alias("ord_turn"), F.lit(0).alias("part"), F.coalesce("chain", F.lit(0)).cast("int").alias("level"), F.lit(0).alias("place"), F.lit("message").alias("kind"),
        F.when(F.col("role").isin(*ROLES), "valid").otherwise("unknown_role").alias("status"), F.col("reply_to").isNotNull().alias("linked"),
        F.to_json(F.struct(content.alias("content"), named("turn").alias("id"), named("reply_to").alias("reply_to"), F.col("role").alias("role"))).alias("json"),
    )
    each = parsed.where(has_calls & F.col("result_id").isNull()).select("conv_id", "turn", F.posexplode(F.try_variant_get(F.try_parse_json("calls_text"), "$", call_type)).alias("place", "c"))
    each = each.select("conv_id", "turn", "place", "c.id", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    each = each.withColumn("status", arguments_status(F.coalesce("name", F.lit("")), F.col("arguments"), schemas or SCHEMAS)).withColumn("arguments", F.coalesce(_canonical(F.col("arguments")), F.lit("null")))
    each = materialise(each, "chat-calls")
    # The few rows that share one id within a conversation are ranked, not the conversation.
    first = each.where("id is not null and conv_id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias("top"))
    owners = materialise(each.join(first, ["conv_id", "id"], "left").withColumn("owner", F.coalesce((F.col("turn") == F.col("top.turn")) & (F.col("place") == F.col("top.place")), F.lit(False))).drop("top"), "chat-owners")
    owning = owners.where("owner").dropDuplicates(["conv_id", "id"])
    levels = _levels(owning)
    results = materialise(parsed.where("result_id is not null").select("conv_id", "turn", F.col("result_id").alias("id"), F.try_variant_get(F.try_parse_json("v_text"), "$.content", "string").alias("content"), F.try_variant_get(F.try_parse_json("v_text"), "$.content", "variant").alias("raw")).withColumn("raw", F.to_json("raw")), "chat-results")
    met = results.join(owning.select("conv_id", "id", F.col("turn").alias("call_turn")), ["conv_id", "id"], "left").join(levels, ["conv_id", "id"], "left")
    pick = met.where("call_turn is not null").groupBy("conv_id", "id").agg(F.min(F.struct((F.col("turn") <= F.col("call_turn")).alias("early"), F.col("turn").alias("turn"))).alias("top"))
    answered = met.join(pick, ["conv_id", "id"], "left")
    is_first = F.coalesce(F.col("turn") == F.col("top.turn"), F.lit(False))
    # Of equal rows (same conversation, id and turn) each counts as the first: they are copies.
    result_rows = answered.select(
        "conv_id", "turn", F.greatest("turn", F.coalesce("floor_turn", "call_turn", "turn")).alias("ord_turn"), F.lit(2).alias("part"), F.coalesce("level", F.lit(0)).alias("level"), F.lit(0).alias("place"), F.lit("result").alias("kind"),
        F.when(F.col("call_turn").isNull(), "orphan").when(is_first, "valid").otherwise("repeated_id").alias("status"), (F.col("call_turn").isNotNull() & is_first).alias("linked"),
        F.concat(F.lit('{"content":'), F.coalesce("raw", F.lit("null")), F.lit(',"id":'), F.regexp_extract(F.to_json(F.struct("id")), r'^\{"id":(.*)\}$', 1), F.lit(',"type":"result"}')).alias("json"),
    )
    linked = pick.select("conv_id", "id", F.lit(True).alias("has_result"))
    called = owners.join(levels, ["conv_id", "id"], "left").join(linked, ["conv_id", "id"], "left")
    status = F.when(F.col("id").isNotNull() & F.col("conv_id").isNotNull() & ~F.col("owner"), "repeated_id").when(F.col("owner") & F.col("level").isNull(), "cyclic").otherwise(F.col("status"))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1), F.lit(""))
    or_null = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    call_rows = called.select(
        "conv_id", "turn", F.when(F.col("owner"), F.coalesce("floor_turn", "turn")).otherwise(F.col("turn")).alias("ord_turn"), F.lit(1).alias("part"), F.when(F.col("owner"), F.col("level")).otherwise(F.lit(0)).alias("level"), "place", F.lit("call").alias("kind"),
        status.alias("status"), (F.col("owner") & F.coalesce("has_result", F.lit(False))).alias("linked"),
        F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), or_null("id"), F.lit(',"name":'), or_null("name"), F.lit(',"type":"call"}')).alias("json"),
    )
    return plain.unionByName(call_rows).unionByName(result_rows)
