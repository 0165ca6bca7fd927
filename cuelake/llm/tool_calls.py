"""Chat formatting: link tool calls with their results, in built-in functions only.

Calls and results meet in a hash join on (conversation, call id). Dependencies
between calls give a topological level (rounds of joins; chains of calls with one
dependency are contracted first). Arguments are checked against the tool's schema, and every linked exchange is
written as canonical JSON: object keys in order, no blanks, nulls kept, one
text per number value (``1e3``, ``1000.0`` and ``1000`` are ``1000``).

Rows stay one per call, so a conversation that holds a third of all rows is
spread like any other; ``(topo_level, turn, call_id)`` orders a conversation.

Edge cases: several rows with one id in one conversation are one call (the
first by turn, name, arguments), ``n_calls`` and ``n_results`` say how many; a
row without conversation or id is kept as status ``no_id``; a result without
call is ``orphan_result``, a call without result ``pending``; arguments that
are null or no JSON object, or repeat a key, are ``invalid_json``, as are those beyond
Spark's size of a VARIANT; a call on a cycle, or behind
one, has a null level; a dependency on an unknown call counts in
``missing_deps``. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Field types of a schema: the name that ``schema_of_variant`` gives the encoded value, and what a string begins with.
#: A number without fraction is an integer, however it is written and whatever its size.
TYPES = {"string": ("STRING", "^s"), "integer": ("STRING", r"^n(-?[0-9]+$|[^e]*e[+])"), "number": ("STRING", "^n"),
         "boolean": ("BOOLEAN", None), "array": ("ARRAY<.*", None), "object": ("OBJECT<.*", None)}
KEY = ["conv_id", "call_id"]


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"


def canonical_number(token: Column) -> Column:
    """One text per value of a JSON number, exact at any size: no exponent,
    no trailing zeros and no point in integers of up to 21 digits;
    ``d.ddde+N`` for larger ones, ``d.ddde-N`` below 0.000001; zero is ``0``."""
    frac = F.regexp_extract(token, r"\.([0-9]+)", 1)
    power = F.regexp_extract(token, r"[eE][+]?(-?[0-9]+)$", 1)
    power = F.when(power == "", F.lit(0)).otherwise(power.try_cast("int"))
    lead = F.ltrim(F.concat(F.regexp_extract(token, "^-?([0-9]+)", 1), frac), F.lit("0"))
    digits = F.rtrim(lead, F.lit("0"))
    n = F.length(digits)
    e = power.cast("bigint") - F.length(frac) + F.length(lead) - n
    pos = e + n
    zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))
    size = pos - 1
    body = (F.when((e >= 0) & (pos <= 21), F.concat(digits, zeros(e)))
            .when((e < 0) & (pos > 0), F.concat(F.left(digits, pos.cast("int")), F.lit("."), F.substr(digits, (pos + 1).cast("int"))))
            .when((e < 0) & (pos > -6), F.concat(F.lit("0."), zeros(-pos), digits))
            .otherwise(F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
                                F.when(size < 0, "e").otherwise("e+"), size.cast("string"))))
    signed = F.concat(F.when(token.startswith("-"), "-").otherwise(""), body)
    # An exponent past 32 bits stays as it is written.
    return F.coalesce(F.when(digits == "", F.lit("0")).otherwise(signed), token)


def exact(arguments: Column) -> Column:
    """JSON text whose strings begin with ``s`` and whose numbers are strings
    that begin with ``n``: a VARIANT of it keeps every number as it is."""
    tokens = F.regexp_extract_all(arguments, F.lit(f'(?s){_STRING}|{_NUMBER}|[^"0-9-]++|.'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r'(?s)^".*"$'), F.concat(F.lit('"s'), F.substr(t, F.lit(2))))
                                    .when(t.rlike("^-?[0-9]"), F.concat(F.lit('"n'), canonical_number(t), F.lit('"')))
                                    .otherwise(t)), "")


def plain(encoded: Column) -> Column:
    """The JSON text that ``exact`` encoded."""
    tokens = F.regexp_extract_all(encoded, F.lit(f'(?s){_STRING}|[^"]++|.'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"s'), F.concat(F.lit('"'), F.substr(t, F.lit(3))))
                                    .when(t.startswith('"n'), F.substr(t, F.lit(3), F.length(t) - 3)).otherwise(t)), "")


def parsed(arguments: Column) -> Column:
    """VARIANT of the encoded arguments; null where they are no JSON."""
    return F.when(F.try_parse_json(arguments).isNotNull(), F.try_parse_json(exact(arguments)))


def violations(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]],
               doc: Column | None = None) -> Column:
    """Sorted array of what is wrong with a call's JSON arguments: ``schemas``
    is ``{tool: {field: (type, required)}}``, a parameter of bounded size.
    ``doc`` is ``parsed(arguments)`` where a column holds it already."""
    doc = parsed(arguments) if doc is None else doc
    ok = F.schema_of_variant(doc).startswith("OBJECT")

    def has_type(field: str, kind: str) -> Column:
        path = f"$['s{field}']"
        of = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
        return of.rlike(f"^{TYPES[kind][0]}$") & (
            F.try_variant_get(doc, path, "string").rlike(TYPES[kind][1]) if TYPES[kind][1] else F.lit(True))

    per_tool = F.lit(None).cast("array<string>")
    for tool, fields in sorted(schemas.items()):
        checks = [F.when(~F.array_contains(F.json_object_keys(arguments), f),
                         F.lit(f"missing:{f}") if required else F.lit(None))
                  .when(~has_type(f, kind), F.lit(f"type:{f}"))
                  for f, (kind, required) in sorted(fields.items())]
        extra = F.transform(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in sorted(fields)])),
                            lambda k: F.concat(F.lit("unknown:"), k))
        per_tool = F.when(name == tool, F.sort_array(F.concat(F.array_compact(F.array(*checks)), extra))).otherwise(per_tool)
    return F.when(F.coalesce(ok, F.lit(False)), F.coalesce(per_tool, F.array(F.lit("unknown_tool")))).otherwise(
        F.array(F.lit("invalid_json")))


def _chains(edges: DataFrame, single: DataFrame, folder: str) -> DataFrame:
    """``conv_id, call_id, to, w``: each call with one dependency, and the call
    ``w`` links on that has none or several. Jumps double in length; a call
    that still jumps after as many links as there are calls is on or behind a cycle
    of such calls, and its ``to`` has one dependency itself."""
    jumps = stage(edges.join(single, KEY).select(*KEY, F.col("dep").alias("to"), F.lit(1).cast("bigint").alias("w")), folder, "jump-0")
    reach, most, n = 1, jumps.count(), 0
    while reach <= most:
        n += 1
        on = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"))
        jumps = stage(jumps.join(on, ["conv_id", "to"], "left").select(
            *KEY, F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
            F.col("next").isNotNull().alias("open")), folder, f"jump-{n}")
        if jumps.filter("open").isEmpty():
            break
        reach *= 2
    return jumps.select(*KEY, "to", "w")


def levels(calls: DataFrame, folder: str) -> DataFrame:
    """``conv_id, call_id, topo_level, missing_deps`` of calls with an array
    ``depends`` of call ids: the level is the longest path to a call without
    known dependencies.

    Calls with one dependency are contracted by jumps that double, so a plain
    chain takes rounds by the logarithm of its length. The others settle by
    rounds in which only the newest settled calls meet the waiting edges:
    as many rounds as calls with several dependencies follow each other.
    Each round is written to shared storage."""
    ids = calls.select(*KEY)
    edges = (calls.select(*KEY, F.explode(F.array_distinct("depends")).alias("dep")).filter("dep IS NOT NULL")
             .join(ids.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known")), ["conv_id", "dep"], "left"))
    edges = stage(edges, folder, "edges")
    need = edges.groupBy(*KEY).agg(F.count_if("known").alias("n_deps"), F.count_if(F.col("known").isNull()).alias("missing_deps"))
    nodes = stage(ids.join(need, KEY, "left").fillna(0, ["n_deps", "missing_deps"]), folder, "nodes")
    edges = edges.filter("known").drop("known")
    chains = _chains(edges, nodes.filter("n_deps = 1").select(*KEY), folder)
    done = newest = nodes.filter("n_deps = 0").select(*KEY, F.lit(0).cast("bigint").alias("topo_level"))
    waiting = nodes.filter("n_deps > 1").select(*KEY, F.col("n_deps").alias("left"), F.lit(0).cast("bigint").alias("topo_level"))
    behind = chains.select("conv_id", F.col("call_id").alias("dep"), "to", "w")
    links = stage(edges.join(waiting.select(*KEY), KEY).join(behind, ["conv_id", "dep"], "left").select(
        *KEY, F.coalesce("to", "dep").alias("to"), (F.coalesce("w", F.lit(0)) + 1).alias("w")), folder, "links")
    n = 0
    while not newest.isEmpty() and not waiting.isEmpty():
        n += 1
        base = newest.select("conv_id", F.col("call_id").alias("to"), F.col("topo_level").alias("base"))
        hit = links.join(base, ["conv_id", "to"]).groupBy(*KEY).agg(
            F.count("*").alias("hits"), F.max(F.col("base") + F.col("w")).alias("high"))
        state = stage(waiting.join(hit, KEY, "left").select(
            *KEY, (F.col("left") - F.coalesce("hits", F.lit(0))).alias("left"), F.greatest("topo_level", "high").alias("topo_level")),
            folder, f"state-{n}")
        newest, waiting = state.filter("left = 0").select(*KEY, "topo_level"), state.filter("left > 0")
        done = done.unionByName(newest)
    ends = done.select("conv_id", F.col("call_id").alias("to"), F.col("topo_level").alias("base"))
    chained = chains.join(ends, ["conv_id", "to"]).select(*KEY, (F.col("base") + F.col("w")).alias("topo_level"))
    return nodes.join(done.unionByName(chained), KEY, "left").select(*KEY, "topo_level", "missing_deps")


def link(calls: DataFrame, results: DataFrame, schemas: dict, folder: str) -> DataFrame:
    """One row per call, and per result without a call.

    ``calls``: conv_id BIGINT, call_id STRING, turn BIGINT, name, arguments
    (JSON text), depends ARRAY<STRING>. ``results``: conv_id, call_id, turn, content.
    """
    calls = calls.select(*KEY, "turn", "name", "arguments", "depends")
    results = results.select(*KEY, "turn", "content")
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("o"), "turn", "name", "arguments", "depends")).alias("c")
    one = calls.filter(has_id).groupBy(*KEY).agg(first, F.count("*").alias("n_calls")).select(
        *KEY, "c.turn", "c.name", "c.arguments", "c.depends", "n_calls")
    one = stage(one, folder, "calls")
    got = results.filter(has_id).groupBy(*KEY).agg(
        F.min(F.struct(F.coalesce("turn", F.lit(2**62)).alias("o"), F.col("turn").alias("result_turn"),
                       F.col("content").alias("result"))).alias("r"), F.count("*").alias("n_results"))
    order = levels(one, folder)
    linked = (one.join(order, KEY).hint("shuffle_hash").join(got.select(*KEY, "r.result_turn", "r.result", "n_results"), KEY, "full"))
    lonely = calls.filter(~has_id).select(*KEY, "turn", "name", "arguments", F.lit(1).cast("bigint").alias("n_calls")).unionByName(
        results.filter(~has_id).select(*KEY, F.col("turn").alias("result_turn"), F.col("content").alias("result"),
                                       F.lit(1).cast("bigint").alias("n_results")), allowMissingColumns=True)
    rows = linked.drop("depends").unionByName(lonely, allowMissingColumns=True)
    is_call = F.col("n_calls").isNotNull()
    status = (F.when(~has_id, "no_id").when(~is_call, "orphan_result").when(F.col("n_results").isNull(), "pending")
              .otherwise("linked"))
    rows = rows.select(
        *KEY, "turn", "result_turn", "name", status.alias("status"), "topo_level",
        F.when(is_call, F.coalesce("missing_deps", F.lit(0))).cast("bigint").alias("missing_deps"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        is_call.alias("is_call"), "arguments", parsed(F.col("arguments")).alias("doc"), "result")
    wrong = F.when(F.col("is_call"), violations(F.col("name"), F.col("arguments"), schemas, F.col("doc")))
    rows = rows.withColumn("v", wrong)
    # Fields in order of their names; VARIANT writes the keys of each object in order.
    rest = F.to_json(F.struct("call_id", "conv_id", "name", "result"), {"ignoreNullFields": "false"})
    canonical = F.concat(F.lit('{"arguments":'), F.coalesce(plain(F.to_json("doc")), F.lit("null")), F.lit(","), F.substr(rest, F.lit(2)))
    return rows.select(*KEY, "turn", "result_turn", "name", "status", "topo_level", "missing_deps", "n_calls", "n_results",
                       F.size(F.coalesce("v", F.array())).cast("bigint").alias("n_errors"),
                       F.array_join("v", ",").alias("errors"), canonical.alias("canonical"))
