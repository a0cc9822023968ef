"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are hash-joined by conversation and call id. A call's level in the topological
order is one more than the highest level it depends on. Chains of calls with one dependency each are
passed by pointer doubling, so a chain of n calls takes log n rounds; calls with several dependencies are
settled in rounds, when all they depend on are; what never settles is cyclic. Arguments are parsed once, checked
against the tool's schema (types, required members, values to choose from, bounds, items and nested objects) and written as canonical JSON: keys sorted, no blanks.

Defined results: a call without a result is ``unanswered``, a result without a call is
``orphan``; of calls or results that repeat an id the first (by turn, text, then the other columns) is linked and
the rest are ``repeated``, each in a row of its own, exact copies too (``link_all``; ``link`` leaves out the results among them), so every call comes out
once, and every result once, linked results in their call's row; a null conversation or call id is linked with nothing; unknown
dependencies are ignored; arguments that are null or no JSON object are an error, as is an unknown
tool. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A parameter's rule: (JSON type, required), or JSON-Schema words: type, required (true or false), enum, minimum, maximum, minItems, maxItems, items (a rule), properties (rules by name).
Rule = tuple[str, bool] | dict
#: Rules of each tool's parameters.
Schemas = dict[str, dict[str, Rule]]
#: The names of parsed values' types that each JSON type may have.
_KINDS = {"string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
CALL_KEY = ["conv_id", "call_id"]
REPLY: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
LIMIT = {"type": "integer", "minimum": 1, "maximum": 100}
#: ``REPLY`` and a tool with nested parameters, item types, values to choose from and bounds.
TOOLS: Schemas = REPLY | {
    "search": {
        "filter": {"type": "object", "required": True, "properties": {"lang": {"type": "string", "required": True, "enum": ["de", "en", "fr"]}, "limit": LIMIT}},
        "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 3},
    }
}
#: Arguments of the calls of ``search`` that ``tool_messages`` makes, their canonical form and their errors.
SEARCHES = (
    ('{"tags": [], "filter": {"limit": 10, "lang": "en"}}', '{"filter":{"lang":"en","limit":10},"tags":[]}', ""),
    ('{"filter": {"limit": 0, "lang": "de"}}', '{"filter":{"lang":"de","limit":0}}', "filter.limit is below 1"),
    ('{"filter": {"limit": 500, "lang": "fr"}}', '{"filter":{"lang":"fr","limit":500}}', "filter.limit is above 100"),
    ('{"filter": {"lang": "xx"}, "tags": "a"}', '{"filter":{"lang":"xx"},"tags":"a"}', "filter.lang is none of its values; tags is no array"),
    ('{"tags": ["a", 1, null], "filter": {"lang": "en"}}', '{"filter":{"lang":"en"},"tags":["a",1,null]}', "tags[1] is no string; tags[2] is no string"),
    ('{"tags": ["a", "b", "c", "d"]}', '{"tags":["a","b","c","d"]}', "filter is missing; tags has more than 3 items"),
    ('{"filter": {"deep": true, "limit": "10"}, "more": 1}', '{"filter":{"deep":true,"limit":"10"},"more":1}', "filter.lang is missing; filter.limit is no integer; unknown parameter filter.deep; unknown parameter more"),
    ("search now", '"search now"', "arguments are no JSON object"),
)


def embedded(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from messages whose text is JSON: an assistant's ``tool_calls`` and the ``tool`` role's ``tool_call_id`` and ``content``."""
    many = "tool_calls array<struct<id: string, name: string, arguments: string, after: array<string>>>"
    calls = messages.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", many)["tool_calls"]).alias("c"))
    results = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return (
        calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after")),
        results.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")),
    )


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chats as calls of the tool ``reply``: a user's turn calls it, after the user's turn before; the assistant's next turn is the result."""
    turn = F.col("turn")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    calls = messages.where("role = 'user'").select("conv_id", "turn", name(turn).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"))).alias("arguments"), F.array(name(turn - 2)).alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


_NONE = "CAST(array() AS array<string>)"


def _members(value: Column, keys: Column, rules: dict[str, Rule], prefix: str | Column) -> Column:
    """The errors of an object's members, by name, and then its unknown members."""
    within = F.lit(prefix) if isinstance(prefix, str) else prefix
    checks = []
    for name, rule in sorted(rules.items()):
        label = F.concat(within, F.lit(name))
        required = rule[1] if isinstance(rule, tuple) else rule.get("required", False)
        absent = F.array(F.concat(label, F.lit(" is missing"))) if required else F.expr(_NONE)
        checks.append(F.when(F.array_contains(keys, name), _faults(F.try_variant_get(value, f"$['{name}']", "variant"), rule, label)).otherwise(absent))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, rules)) if rules else F.expr(_NONE)))
    return F.concat(*checks, F.transform(unknown, lambda k: F.concat(F.lit("unknown parameter "), within, k)))


def _faults(value: Column, rule: Rule, label: Column) -> Column:
    """The errors of a value against its rule; what has the wrong type has no others."""
    if isinstance(rule, tuple):
        rule = {"type": rule[0]}
    typed = F.coalesce(F.schema_of_variant(value).rlike(f"^(?:{_KINDS[rule['type']]})$"), F.lit(False))
    says = lambda when, text: F.when(when, F.array(F.concat(label, F.lit(text)))).otherwise(F.expr(_NONE))
    found = [F.expr(_NONE)]
    if "enum" in rule:
        values = [json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in rule["enum"]]
        found.append(says(~F.to_json(value).isin(values), " is none of its values"))
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in rule:
        found.append(says(number < rule["minimum"], f" is below {rule['minimum']}"))
    if "maximum" in rule:
        found.append(says(number > rule["maximum"], f" is above {rule['maximum']}"))
    if rule["type"] == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        if "minItems" in rule:
            found.append(says(F.size(items) < rule["minItems"], f" has less than {rule['minItems']} items"))
        if "maxItems" in rule:
            found.append(says(F.size(items) > rule["maxItems"], f" has more than {rule['maxItems']} items"))
        if "items" in rule:
            found.append(F.flatten(F.transform(items, lambda v, k: _faults(v, rule["items"], F.concat(label, F.lit("["), k.cast("string"), F.lit("]"))))))
    if "properties" in rule:
        found.append(_members(value, F.json_object_keys(F.to_json(value)), rule["properties"], F.concat(label, F.lit("."))))
    return F.when(typed, F.concat(*found)).otherwise(F.array(F.concat(label, F.lit(f" is no {rule['type']}"))))


def tool_messages(chats: DataFrame) -> DataFrame:
    """Plain chats as messages with tool calls, for ``embedded``, by rule: a user's turn t calls ``call_t`` and ``look_t``, the assistant's next turn answers.

    ``call_t`` comes after ``call_(t-2)``; ``look_t`` in every third conversation after both ``call_t`` and ``call_(t-2)``; in every fifteenth ``call_t``
    comes after ``look_t`` as well, a cycle. Some ids repeat, some are null, some tools are unknown, and ``SEARCHES`` has errors of every kind.
    """
    c, t = F.col("conv_id"), F.col("turn")
    every = lambda n, k, of=c: F.coalesce(F.pmod(of, F.lit(n)) == k, F.lit(False))
    call, look = (lambda t: F.concat(F.lit("call_"), t.cast("string"))), (lambda t: F.concat(F.lit("look_"), t.cast("string")))
    reply = F.struct(call(t).alias("id"), F.when(every(11, 0, c + t), "shout").otherwise("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), t.alias("turn"))).alias("arguments"), F.array_compact(F.array(call(t - 2), F.when(every(15, 6), look(t)))).alias("after"))
    asked = F.element_at(F.array(*(F.lit(a) for a, _, _ in SEARCHES)), F.coalesce(F.pmod(c + t, F.lit(len(SEARCHES))), F.lit(0)).cast("int") + 1)
    search = F.struct(F.when(~every(17, 5), look(t)).alias("id"), F.lit("search").alias("name"), asked.alias("arguments"), F.when(every(3, 0), F.array(call(t), call(t - 2))).otherwise(F.expr(_NONE)).alias("after"))
    calls = chats.where("role = 'user'").select(c, t, F.lit("assistant").alias("role"), F.to_json(F.struct(F.when(every(4, 2), F.array(reply, reply, search)).otherwise(F.array(reply, search)).alias("tool_calls"))).alias("text"))
    said = F.struct(call(t - 1).alias("tool_call_id"), F.col("text").alias("content"))
    seen = F.struct(F.when(~every(13, 0, c + t), look(t - 1)).alias("tool_call_id"), F.lit("found").alias("content"))
    answers = F.explode(F.array_compact(F.array(said, F.when(every(6, 1), said), F.when(every(2, 0, c + t), seen))))
    results = chats.where("role = 'assistant'").select(c, t, F.lit("tool").alias("role"), answers.alias("r")).select("conv_id", "turn", "role", F.to_json("r").alias("text"))
    return calls.unionByName(results)


def errors_of(parsed: Column, keys: Column, name: Column, schemas: Schemas) -> Column:
    """The arguments' errors (nested names as ``a.b`` and ``a[0]``) against the schema of the tool ``name``, as an array of strings."""
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, parameters in schemas.items():
        out = F.when(name == tool, _members(parsed, keys, parameters, "")).otherwise(out)
    return F.when(keys.isNull(), F.array(F.lit("arguments are no JSON object"))).otherwise(out)


def firsts(rows: DataFrame, text: str) -> DataFrame:
    """The first row of each call id by (turn, text, other columns), and ``rows``' number of that id; ``_row`` is the last column, so it decides between exact copies only."""
    known = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    return known.groupBy(*CALL_KEY).agg(F.min(F.struct(F.col("turn"), F.col(text), *(c for c in rows.columns if c not in (*CALL_KEY, "turn", text)))).alias("first"), F.count("*").alias("n"))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of distinct calls (with ``after``); the level is null on and behind a cycle."""
    keys = calls.select(*CALL_KEY)
    edges = calls.select(*CALL_KEY, F.explode(F.array_distinct("after")).alias("before"))
    edges = cut(edges.join(keys.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi").select("conv_id", "call_id", "before"))
    needs = edges.groupBy(*CALL_KEY).agg(F.count("*").alias("needs"))
    state = cut(keys.join(needs, CALL_KEY, "left").select(*CALL_KEY, F.coalesce("needs", F.lit(0)).alias("needs")))
    steps = _chains(state, edges)
    # what stands at the ends of chains: calls without a dependency, and those with several
    heads = state.where("needs != 1").select(*CALL_KEY, "needs", F.when(F.col("needs") == 0, 0).alias("level"))
    if not heads.where("needs > 1").isEmpty():
        heads = _settled(cut(heads), edges.join(state.where("needs > 1"), CALL_KEY, "left_semi"), steps)
    ends = heads.select("conv_id", F.col("call_id").alias("to"), "level")
    behind = steps.join(ends, ["conv_id", "to"]).select(*CALL_KEY, (F.col("level") + F.col("far")).cast("int").alias("level"))
    known = heads.select(*CALL_KEY, F.col("level").cast("int").alias("level")).unionByName(behind)
    return state.select(*CALL_KEY).join(known, CALL_KEY, "left")


def _chains(state: DataFrame, edges: DataFrame) -> DataFrame:
    """For each call with one dependency the first call back along the chain that has none or several (``to``), and how far it is.

    Pointers double in every round; what never arrives is on or behind a cycle and is left out.
    """
    single = edges.join(state.where("needs = 1"), CALL_KEY, "left_semi")
    ends = state.select("conv_id", F.col("call_id").alias("before"), (F.col("needs") != 1).alias("done"))
    steps = cut(single.join(ends, ["conv_id", "before"]).select(*CALL_KEY, F.col("before").alias("to"), F.lit(1).cast("long").alias("far"), "done"))
    while True:
        on = steps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("there"))
        moved = cut(steps.where("NOT done").join(on, ["conv_id", "to"]).select(*CALL_KEY, F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("there").alias("done")))
        # distances along a chain have no gaps: a round in which none arrives is the last
        if moved.where("done").isEmpty():
            return steps.where("done").drop("done")
        steps = cut(steps.where("done").unionByName(moved))


def _settled(heads: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Levels of the calls with several dependencies, in rounds: a call is settled when all it depends on are."""
    direct = heads.select("conv_id", F.col("call_id").alias("before"), F.col("call_id").alias("to"), F.lit(0).cast("long").alias("far"))
    through = steps.select("conv_id", F.col("call_id").alias("before"), "to", "far")
    need = cut(edges.join(direct.unionByName(through), ["conv_id", "before"]).select("conv_id", "call_id", "to", "far"))
    while True:
        done = heads.where("level IS NOT NULL").select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("at"))
        ready = need.join(done, ["conv_id", "to"]).groupBy(*CALL_KEY).agg(F.count("*").alias("met"), (F.max(F.col("at") + F.col("far")) + 1).alias("next"))
        step = cut(heads.join(ready, CALL_KEY, "left").select(*CALL_KEY, "needs", F.coalesce("level", F.when(F.col("met") == F.col("needs"), F.col("next"))).alias("level"), (F.col("level").isNull() & (F.col("met") == F.col("needs"))).alias("moved")))
        heads = step.drop("moved")
        if step.where("moved").isEmpty():
            return heads


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """``link_all`` without the results that repeat an id."""
    return _linked(calls, results, schemas, False)


def link_all(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, status, level, errors and the canonical JSON record of every call and every result that is not linked."""
    return _linked(calls, results, schemas, True)


def _linked(calls: DataFrame, results: DataFrame, schemas: Schemas, every: bool) -> DataFrame:
    # the numbers tell exact copies apart, so they are settled before they are used
    calls = cut(calls.select(*CALL_KEY, "turn", "arguments", "name", "after", F.monotonically_increasing_id().alias("_row")))
    results = cut(results.select(*CALL_KEY, "turn", "content", F.monotonically_increasing_id().alias("_row")))
    one_call = cut(firsts(calls, "arguments").select(*CALL_KEY, "first.arguments", "first.name", "first.after", "first._row", F.col("n").alias("n_calls")))
    one_result = firsts(results, "content").select(*CALL_KEY, F.col("first.content").alias("content"), F.lit(True).alias("answered"), "first._row")
    kept_results = one_result.select("_row")
    one_result = one_result.drop("_row")
    ordered = one_call.join(levels(one_call), CALL_KEY, "left")
    joined = ordered.hint("shuffle_hash").join(one_result, CALL_KEY, "full")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    linked = joined.select(*CALL_KEY, status.alias("status"), "level", "name", "arguments", "content")
    # what repeats an id, and what has none, is kept as it came; rows meet by their numbers, so no id's rows meet in one task
    none = lambda kind: F.lit(None).cast(kind)
    keyless = F.col("conv_id").isNull() | F.col("call_id").isNull()
    rest_calls = calls.join(one_call.select("_row"), "_row", "left_anti").select(*CALL_KEY, F.when(keyless, "unanswered").otherwise("repeated").alias("status"), none("int").alias("level"), "name", "arguments", none("string").alias("content"))
    rest_results = results.where(F.lit(every) | keyless).join(kept_results, "_row", "left_anti").select(*CALL_KEY, F.when(keyless, "orphan").otherwise("repeated").alias("status"), none("int").alias("level"), none("string").alias("name"), none("string").alias("arguments"), "content")
    everything = linked.withColumn("_result", F.col("status") == "orphan").unionByName(rest_calls.withColumn("_result", F.lit(False))).unionByName(rest_results.withColumn("_result", F.lit(True)))
    parsed = everything.withColumn("parsed", F.try_parse_json("arguments")).withColumn("keys", F.when(F.schema_of_variant("parsed").startswith("OBJECT"), F.json_object_keys("arguments")))
    checked = parsed.withColumn("errors", F.when(F.col("_result"), F.array().cast("array<string>")).otherwise(errors_of(F.col("parsed"), F.col("keys"), F.col("name"), schemas)))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    value = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    arguments = F.when(F.col("keys").isNotNull(), F.to_json("parsed")).otherwise(value(F.col("arguments")))
    record = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), value(F.col("call_id")), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")), F.lit(',"name":'), value(F.col("name")), F.lit(',"result":'), value(F.col("content")), F.lit("}"))
    return checked.select(*CALL_KEY, "status", F.col("level").cast("int").alias("level"), F.array_join("errors", "; ").alias("errors"), record.alias("record"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, conv_id + turn AS s FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text, conv_id + turn AS s FROM conversations WHERE role = 'assistant'),
k AS (
  SELECT conv_id, 'call_' || turn AS id, CASE WHEN s % 11 = 0 THEN 'shout' ELSE 'reply' END AS name,
         CASE WHEN text IS NULL THEN '{{"turn":' || turn || '}}' ELSE CAST(json_object('prompt', text, 'turn', turn) AS VARCHAR) END AS arguments,
         CASE WHEN s % 11 = 0 THEN 'unknown tool shout' WHEN text IS NULL THEN 'prompt is missing' ELSE '' END AS errors, rep
  FROM u, (VALUES (1), (2)) r(rep) WHERE rep = 1 OR conv_id % 4 = 2
  UNION ALL SELECT conv_id, CASE WHEN conv_id % 17 <> 5 THEN 'look_' || turn END, 'search', ({_listed(c for _, c, _ in SEARCHES)})[s % 8 + 1], ({_listed(e for _, _, e in SEARCHES)})[s % 8 + 1], 1 FROM u
),
r AS (
  SELECT conv_id, 'call_' || (turn - 1) AS id, text AS content, rep FROM a, (VALUES (1), (2)) r(rep) WHERE rep = 1 OR conv_id % 6 = 1
  UNION ALL SELECT conv_id, CASE WHEN s % 13 <> 0 THEN 'look_' || (turn - 1) END, 'found', 1 FROM a WHERE s % 2 = 0
),
n AS (SELECT conv_id, id FROM k WHERE rep = 1 AND id IS NOT NULL),
e AS (
  SELECT x.* FROM (
    SELECT conv_id, 'call_' || turn AS id, 'call_' || (turn - 2) AS b FROM u
    UNION ALL SELECT conv_id, 'call_' || turn, 'look_' || turn FROM u WHERE conv_id % 15 = 6
    UNION ALL SELECT conv_id, 'look_' || turn, 'call_' || turn FROM u WHERE conv_id % 3 = 0
    UNION ALL SELECT conv_id, 'look_' || turn, 'call_' || (turn - 2) FROM u WHERE conv_id % 3 = 0
  ) x JOIN n USING (conv_id, id) JOIN n m ON m.conv_id = x.conv_id AND m.id = x.b
),
size AS (SELECT conv_id, count(*) AS n FROM n GROUP BY 1),
p AS (SELECT conv_id, id, 0 AS len FROM n UNION SELECT e.conv_id, e.id, p.len + 1 FROM e JOIN p ON e.conv_id = p.conv_id AND e.b = p.id JOIN size ON size.conv_id = e.conv_id WHERE p.len < size.n),
lv AS (SELECT p.conv_id, p.id, CASE WHEN max(len) < max(n) THEN max(len) END AS level FROM p JOIN size USING (conv_id) GROUP BY 1, 2),
o AS (
  SELECT k.conv_id, k.id, CASE WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, level, errors, arguments, name, content
  FROM k JOIN lv ON k.conv_id = lv.conv_id AND k.id = lv.id LEFT JOIN r ON k.conv_id = r.conv_id AND k.id = r.id AND r.rep = 1 WHERE k.rep = 1
  UNION ALL SELECT conv_id, id, CASE WHEN id IS NULL THEN 'unanswered' ELSE 'repeated' END, NULL, errors, arguments, name, NULL FROM k WHERE rep = 2 OR id IS NULL
  UNION ALL SELECT conv_id, id, CASE WHEN rep = 2 THEN 'repeated' ELSE 'orphan' END, NULL, '', NULL, NULL, content FROM r WHERE rep = 2 OR id IS NULL OR (conv_id, id) NOT IN (SELECT (conv_id, id) FROM n)
)
SELECT conv_id, id AS call_id, status, CAST(level AS INTEGER) AS level, errors,
       '{{"arguments":' || coalesce(arguments, 'null') || ',"id":' || CASE WHEN id IS NULL THEN 'null' ELSE '"' || id || '"' END || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
       || ',"name":' || CASE WHEN name IS NULL THEN 'null' ELSE '"' || name || '"' END || ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}}' AS record
FROM o
"""
