"""Tool schemas, tool calls, expected calls and tool prompts.

Open JSON is held as VARIANT: alias keys and mixed shapes are read with path expressions, and
a row's tools and calls stay inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.text import col, extract, let, present, strict_json, strip

# Keys under which sources keep tools, queries, calls and their parts.
TOOL_KEYS = (
    "tools", "tool", "functions", "function", "apis", "api", "tool_schema", "tool_schemas",
    "tool_spec", "tool_specs", "tool_specification", "tool_definitions", "tool_definition",
    "tool_list", "api_list", "api_specs", "api_spec", "schema", "schemas",
)
QUERY_KEYS = (
    "query", "question", "instruction", "input", "prompt", "user_query", "text", "task", "goal", "utterance",
)
CALL_KEYS = (
    "answers", "answer", "tool_calls", "tool_call", "function_calls", "function_call", "api_calls",
    "api_call", "calls", "call", "response", "output", "target", "completion",
)
NO_TOOL_KEYS = ("needs_tool", "tool_required", "tool_needed", "requires_tool", "use_tool")
WRAPPER_KEYS = ("tools", "functions", "function", "apis", "api", "tool_list")
NAME_KEYS = ("name", "tool_name", "function_name", "api_name")
DESCRIPTION_KEYS = ("description", "desc", "api_description")
PARAMETER_KEYS = ("parameters", "args_schema", "input_schema", "schema")
ARGUMENT_KEYS = ("arguments", "args", "parameters", "params")
LATE_ARGUMENT_KEYS = ("input", "tool_input", "api_arguments")
FLAT_NAME_KEYS = ("tool_name", "api_name", "function_name", "name")
FLAT_PARAMETER_KEYS = ("parameters", "params", "args", "arguments", "input_schema", "schema")
FLAT_ARGUMENT_KEYS = ("arguments", "args", "parameters", "params", "input", "tool_input")

# The instruction of a tool prompt.
TOOLS_HEAD = "You have access to the following tools (JSON schema):\n"
TOOLS_TAIL = (
    "Respond with a JSON array of tool calls only, e.g. "
    '[{"name": "...", "arguments": {...}}]. If no tool is needed, respond with [].'
)

# Distractor tools, as name, description and JSON schema of the parameters.
DEFAULT_TOOLS = (
    ("search_web", "Search the web for information.",
     '{"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}'),
    ("get_weather", "Get the weather for a location.",
     '{"type": "object", "properties": {"location": {"type": "string"}, "date": {"type": "string"}}, "required": ["location"]}'),
    ("get_time", "Get the current time for a location.",
     '{"type": "object", "properties": {"location": {"type": "string"}}, "required": ["location"]}'),
    ("calculator", "Evaluate a math expression.",
     '{"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]}'),
    ("lookup_stock", "Look up a stock price for a ticker.",
     '{"type": "object", "properties": {"ticker": {"type": "string"}}, "required": ["ticker"]}'),
)

TOOL = "struct<name:string,description:string,parameters:variant>"
CALL = "struct<name:string,arguments:variant>"
_EMPTY_OBJECT = '{"type":"object","properties":{}}'
_VALUE_OBJECT = '{"type":"object","properties":{"value":{"type":"string"}}}'


def default_tools(limit: int | None = None) -> Column:
    """The distractor tools as an array of tools."""
    rows = [
        F.struct(F.lit(name).alias("name"), F.lit(description).alias("description"), F.parse_json(F.lit(schema)).alias("parameters"))
        for name, description, schema in DEFAULT_TOOLS[:limit]
    ]
    return F.array(*rows).cast(f"array<{TOOL}>")


def as_variant(df: DataFrame, name: str) -> Column:
    """A column as VARIANT; text stays a text until ``_parsed`` reads it."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.VariantType):
        return c
    if isinstance(kind, T.StringType):
        return F.variant_get(F.parse_json(F.to_json(F.array(c))), "$[0]", "variant")
    return F.parse_json(F.to_json(c)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.parse_json(c.cast("string"))


def kind_of(v: Column) -> Column:
    """object, array, string, null or other."""
    return let(F.schema_of_variant(v), lambda s: (
        F.when(s.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").otherwise("other")
    ))


def _get(v: Column, key: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", as_type)


def _first_text(v: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[present(_get(v, k, "string")) for k in keys])


def _filled(v: Column) -> Column:
    """The variant, or null when it is null, an empty text, an empty object or an empty array."""
    text = F.to_json(v)
    return F.when(~text.isin("null", '""', "{}", "[]"), v)


def _parsed(v: Column) -> Column:
    """A text that holds an object or array is read as such; other text gives null."""
    inner = let(strip(v.cast("string")), lambda t: F.when(t.rlike(r"^[\[{]"), strict_json(t)))
    return F.when(kind_of(v) == "string", inner).otherwise(v)


def _items(v: Column) -> Column:
    """Elements of an array; an object counts as its own only element."""
    return let(kind_of(v), lambda k: F.when(k == "array", v.try_cast("array<variant>")).when(
        k == "object", F.array(v)))


def normalize_tool(v: Column) -> Column:
    """One tool as name, description and parameters; null without a name."""
    empty, value = F.parse_json(F.lit(_EMPTY_OBJECT)), F.parse_json(F.lit(_VALUE_OBJECT))

    def tool(name, description, params):
        return F.when(name.isNotNull(), F.struct(
            name.alias("name"), description.alias("description"), params.alias("parameters")).cast(TOOL))

    def described(body):
        params = let(F.coalesce(*[_filled(_get(body, k)) for k in PARAMETER_KEYS]), lambda p: F.when(
            p.isNull(), empty).otherwise(let(_parsed(p), lambda r: F.when(kind_of(r) == "object", r).otherwise(value))))
        return tool(_first_text(body, NAME_KEYS), F.coalesce(_first_text(body, DESCRIPTION_KEYS), F.lit("")), params)

    def one(x):
        inner = _get(x, "function")
        wrapped = (_get(x, "type", "string") == "function") & (kind_of(inner) == "object")
        return F.when(
            kind_of(x) == "string", let(present(strip(x.cast("string"))), lambda n: tool(n, F.lit(""), empty))
        ).otherwise(let(F.when(wrapped, inner).otherwise(x), described))

    return let(v, one)


def tool_list(v: Column) -> Column:
    """Tools of a text, a list, one tool or an object that wraps a list; null when none."""

    def inner(read):
        unwrapped = F.coalesce(*[F.when(kind_of(read) == "object", _get(read, k)) for k in WRAPPER_KEYS], read)
        # A tool in call format is wrapped in `function` itself; its `type` says so.
        return F.when(_get(read, "type", "string") == "function", read).otherwise(unwrapped)

    def tools(source):
        found = F.filter(F.transform(_items(source), normalize_tool), lambda t: t.isNotNull())
        return let(found, lambda f: F.when(F.size(f) > 0, f))

    return let(let(_parsed(v), inner), tools)


def normalize_tools(df: DataFrame) -> Column:
    """Tools of a row from the first key that holds some, else from flat name columns."""
    have = [tool_list(as_variant(df, k)) for k in TOOL_KEYS if k in df.columns]
    flat = [k for k in FLAT_NAME_KEYS if k in df.columns]
    if flat:
        name = F.coalesce(*[present(F.col(k)) for k in flat])
        texts = [k for k in ("tool_description", "api_description", "description", "desc") if k in df.columns]
        params = [k for k in FLAT_PARAMETER_KEYS if k in df.columns]
        given = F.coalesce(*[as_variant(df, k) for k in params], F.lit(None).cast("variant"))
        read = _parsed(given)
        have.append(F.when(name.isNotNull(), F.array(F.struct(
            name.alias("name"),
            F.coalesce(*[present(F.col(k)) for k in texts], F.lit("")).alias("description"),
            F.when(kind_of(read) == "object", read).when(kind_of(given) == "null", F.parse_json(F.lit(_EMPTY_OBJECT)))
            .otherwise(F.parse_json(F.lit(_VALUE_OBJECT))).alias("parameters"),
        ).cast(TOOL))))
    return F.coalesce(*have) if have else F.lit(None).cast(f"array<{TOOL}>")


def normalize_arguments(v: Column) -> Column:
    """Arguments as an object: lists go under ``args`` and other values under ``value``."""

    def shaped(read):
        k, text = kind_of(read), F.to_json(read)
        return (
            F.when(k == "null", F.parse_json(F.lit("{}"))).when(k == "object", read)
            .when(k == "array", F.parse_json(F.concat(F.lit('{"args":'), text, F.lit("}"))))
            .otherwise(F.parse_json(F.concat(F.lit('{"value":'), text, F.lit("}"))))
        )

    return let(v, lambda x: let(F.coalesce(_parsed(x), x), shaped))


def normalize_call(v: Column) -> Column:
    def call(read):
        name = F.when(kind_of(read) == "object", _first_text(read, NAME_KEYS))
        args = F.coalesce(*[_filled(_get(read, k)) for k in (*ARGUMENT_KEYS, *LATE_ARGUMENT_KEYS)])
        return let(name, lambda n: F.when(n.isNotNull(), F.struct(
            n.alias("name"), normalize_arguments(args).alias("arguments")).cast(CALL)))

    return let(_parsed(v), call)


def call_list(v: Column) -> Column:
    """Calls of a text, a list or one call; ``none``, ``no``, ``null`` and '' mean no call."""
    nothing = (kind_of(v) == "string") & strip(v.cast("string")).isin("", "none", "no", "null")

    def calls(source):
        found = F.filter(F.transform(_items(source), normalize_call), lambda c: c.isNotNull())
        # An object that is no call is unusable, while a list may be empty.
        return let(found, lambda f: F.when(~((kind_of(source) == "object") & (F.size(f) == 0)), f))

    inner = let(_parsed(v), lambda r: F.when(
        kind_of(r) == "object", F.coalesce(_get(r, "tool_calls"), r)).otherwise(r))
    return F.when(nothing, F.array().cast(f"array<{CALL}>")).otherwise(let(inner, calls))


def normalize_calls(df: DataFrame) -> Column:
    """Calls of a row from the first usable key; a row that needs no tool has no call."""
    have = []
    for k in NO_TOOL_KEYS:
        if k in df.columns and isinstance(df.schema[k].dataType, T.BooleanType):
            have.append(F.when(~F.col(k), F.array().cast(f"array<{CALL}>")))
    have += [call_list(as_variant(df, k)) for k in CALL_KEYS if k in df.columns]
    names = [k for k in FLAT_NAME_KEYS if k in df.columns]
    if names:
        name = F.coalesce(*[present(F.col(f"`{k}`").cast("string")) for k in names])
        args = F.coalesce(*[as_variant(df, k) for k in FLAT_ARGUMENT_KEYS if k in df.columns], F.lit(None).cast("variant"))
        have.append(F.when(name.isNotNull(), F.array(F.struct(name.alias("name"), normalize_arguments(args).alias("arguments")).cast(CALL))))
    return F.coalesce(*have) if have else F.lit(None).cast(f"array<{CALL}>")


def augment_tools(tools: Column, distractors: Column, n: int) -> Column:
    """Up to ``n`` distractors whose name is not among the tools, added at the end."""
    base = F.coalesce(tools, F.array().cast(f"array<{TOOL}>"))
    if n <= 0:
        return base
    names = F.transform(base, lambda t: t["name"])
    extra = F.filter(distractors, lambda d: ~F.array_contains(names, d["name"]))
    return F.concat(base, F.slice(extra, 1, n))


def tools_json(tools: Column) -> Column:
    return F.to_json(tools)


def render_tool_prompt(tools: Column, query: Column, use_system: bool = True) -> Column:
    """System and user message, or one user message, that present the tools."""
    shown = F.concat(F.lit(TOOLS_HEAD), tools_json(tools), F.lit("\n\n"))
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if use_system:
        return F.array(m("system", F.concat(shown, F.lit(TOOLS_TAIL))), m("user", query))
    return F.array(m("user", F.concat(shown, F.lit("User query: "), query, F.lit("\n\n" + TOOLS_TAIL))))


def tool_conversation(tools: Column, query: Column, calls: Column, use_system: bool = True) -> Column:
    answer = F.struct(F.lit("assistant").alias("role"), F.to_json(calls).alias("content"))
    return F.concat(render_tool_prompt(tools, query, use_system), F.array(answer))


def no_tool(turns: DataFrame, tools: Column | None = None, use_system: bool = True) -> DataFrame:
    """Examples answered with ``[]``: the first user text of each conversation, with tools."""
    first = turns.filter((F.col("role") == "user") & (strip(F.col("text")) != "")).groupBy("conv_id").agg(
        F.min_by(strip(F.col("text")), "turn").alias("query")
    )
    none = F.array().cast(f"array<{CALL}>")
    return first.select(
        "conv_id", tool_conversation(default_tools() if tools is None else tools, F.col("query"), none, use_system)
        .alias("messages"),
    )


def query_of(df: DataFrame) -> Column:
    """Text of the request from the first filled key, else the first user message."""
    have = [present(F.col(k)) for k in QUERY_KEYS if k in df.columns and isinstance(df.schema[k].dataType, T.StringType)]
    for k in ("messages", "conversation", "conversations", "dialogue"):
        kind = df.schema[k].dataType if k in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            names = kind.elementType.fieldNames()
            role, text = ("role", "content") if "role" in names else ("from", "value")
            users = F.filter(k, lambda m: F.lower(strip(m[role])).isin(
                "user", "human", "instruction", "prompt", "tool", "function", "function_response", "tool_response"
            ) & (strip(m[text]) != ""))
            have.append(strip(F.get(users, F.lit(0))[text]))
    return F.coalesce(*have) if have else F.lit(None).cast("string")


# ---- expected calls --------------------------------------------------------------------

EXPECTED = "array<struct<name:string,arguments:map<string,array<string>>>>"


def canonical(v: Column) -> Column:
    """A value as comparable text: numbers, and texts that hold a number, compare by value.

    Whole numbers compare exactly, to 38 digits; other numbers as doubles.
    """
    whole, real = r"^[+-]?\d{1,38}$", r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"

    def number(d):
        exact = (d == F.floor(d)) & (F.abs(d) < F.lit(1e37))
        return F.concat(F.lit("n:"), F.when(exact, d.try_cast("decimal(38,0)").cast("string")).otherwise(d.cast("string")))

    def scalar(text):
        plain = F.concat(F.lit("s:"), text)
        read = lambda t: F.when(t.rlike(whole), F.concat(F.lit("n:"), t.try_cast("decimal(38,0)").cast("string"))).otherwise(
            let(F.when(t.rlike(real), t.try_cast("double")), lambda d: F.when(d.isNotNull(), number(d)).otherwise(plain)))
        # most texts hold no digit and are told by one look
        return F.when(text.rlike("[0-9]"), let(strip(text), read)).otherwise(plain)

    def shown(x):
        return let(F.schema_of_variant(x), lambda s: (
            F.when(s.isNull() | (s == "VOID"), F.lit("null"))
            .when(s == "BOOLEAN", F.when(x.cast("string") == "true", "n:1").otherwise("n:0"))
            .when(s.startswith("OBJECT") | s.startswith("ARRAY"), F.concat(F.lit("j:"), F.to_json(x)))
            .when(s.isin("DOUBLE", "FLOAT"), number(x.try_cast("double")))
            .otherwise(let(x.cast("string"), scalar))
        ))

    return let(v, shown)


def _is_empty(v: Column) -> Column:
    return canonical(v).isin("null", "s:")


# name(value, key=value, ...) and the marks its arguments consist of.
_CALL = r"(?s)^\s*([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\((.*)\)\s*$"
_MARK = (
    r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|[A-Za-z_]\w*\s*=(?!=)|[A-Za-z_]\w*"
    r"|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|\S"
)
_KEY = "\u0001"


def _mark_json(mark: Column) -> Column:
    """JSON of one mark; a key becomes a text that starts with ``_KEY``, unknown words stay and break the JSON."""
    inner = F.substring(mark, F.lit(2), F.length(mark) - 2)
    plain = F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('\\"')), F.lit('"'))
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(mark, r"^\+", ""), r"^(-?)\.", "$10."), r"\.(?=$|[eE])", "")
    return (
        F.when(mark.isin(",", ":", "[", "]", "{", "}"), mark).when(mark == "(", "[").when(mark == ")", "]")
        .when(mark.rlike("^['\"]."), quoted)
        .when(mark.endswith("="), F.concat(F.lit('"\\u0001'), F.regexp_replace(mark, r"\s*=$", ""), F.lit('",')))
        .when(mark == "True", "true").when(mark == "False", "false").when(mark == "None", "null")
        .when(mark.rlike(r"^[-+]?\.?\d"), number).otherwise(mark)
    )


def parse_call_text(text: Column) -> Column:
    """``name(value, key=value, ...)`` as ``{name: {key: [value], _args: [[values]]}}`` JSON.

    Values are what has a JSON form: texts, numbers, True, False, None, lists, tuples of several
    values and dictionaries. Null when the text has another form.
    """
    marks = F.transform(F.regexp_extract_all(extract(text, _CALL, 2), F.lit(_MARK), F.lit(0)), _mark_json)
    body = F.regexp_replace(F.array_join(marks, ""), r",$", "")
    items = let(body, lambda b: F.when(~b.rlike(r'",$'), strict_json(F.concat(F.lit("["), b, F.lit("]")))))

    def walk(values):
        # values of other kinds than texts never begin so
        is_key = lambda v: F.coalesce(v.cast("string").startswith(_KEY), F.lit(False))
        start = F.struct(
            F.lit(None).cast("string").alias("key"), F.array().cast("array<struct<key:string,value:string>>").alias("named"),
            F.array().cast("array<string>").alias("rest"), F.lit(True).alias("ok"),
        )

        def step(at, v):
            shown, opened = F.to_json(v), at["key"].isNotNull()
            named = F.concat(at["named"], F.array(F.struct(at["key"].alias("key"), shown.alias("value"))))
            return let(is_key(v), lambda key: F.struct(
                F.when(key, F.substring(v.cast("string"), 2, 1 << 30)).alias("key"),
                F.when(~key & opened, named).otherwise(at["named"]).alias("named"),
                F.when(~key & ~opened, F.concat(at["rest"], F.array(shown))).otherwise(at["rest"]).alias("rest"),
                # a key behind a key, or a value without key behind named ones, is no call
                (at["ok"] & ~(key & opened) & ~(~key & ~opened & (F.size(at["named"]) > 0))).alias("ok"),
            ))

        def shown(end):
            pairs = F.transform(end["named"], lambda e: F.concat(F.lit('"'), e["key"], F.lit('":['), e["value"], F.lit("]")))
            first = F.concat(F.lit('"_args":[['), F.array_join(end["rest"], ","), F.lit("]]"))
            every = F.concat(F.when(F.size(end["rest"]) > 0, F.array(first)).otherwise(F.array().cast("array<string>")), pairs)
            return F.when(end["ok"] & end["key"].isNull(), F.array_join(every, ","))

        return F.aggregate(values, start, step, shown)

    name = F.regexp_replace(extract(text, _CALL, 1), r"\s", "")
    return F.concat(F.lit('{"'), name, F.lit('":{'), let(items.try_cast("array<variant>"), walk), F.lit("}}"))


def _expected_call(item: Column) -> Column:
    """One expected call from ``{name: {arg: value or allowed values}}`` or a call text."""
    obj = F.when(kind_of(item) == "string", F.try_parse_json(parse_call_text(item.cast("string")))).otherwise(item)

    def call(first):
        params = first["value"].try_cast("map<string,variant>")
        allowed = F.transform_values(params, lambda _, v: F.when(
            kind_of(v) == "array", v.try_cast("array<variant>")).otherwise(F.array(v)))
        return F.when(first["key"].isNotNull() & params.isNotNull(), F.struct(
            first["key"].alias("name"), allowed.alias("arguments")))

    return let(F.get(F.map_entries(obj.try_cast("map<string,variant>")), F.lit(0)), call)


CALLS = "array<struct<name:string,arguments:map<string,array<variant>>>>"


def _unread_call() -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("name"), F.create_map().cast("map<string,array<variant>>").alias("arguments")))


def unread(expected: Column) -> Column:
    """True where the ground truth is a call text that could not be read, apart from an unknown one."""
    return F.coalesce(F.exists(expected, lambda c: c["name"].isNull()), F.lit(False))


def expected_turns(ground_truth: Column, n_turns: Column) -> Column:
    """Expected calls per turn, null where the ground truth is unknown.

    A turn with a call text that cannot be read has one call without a name (see ``unread``). A flat list belongs to the last turn; a list of lists is aligned to the turns, padded or
    cropped at the end.
    """
    unknown = F.lit(None).cast(CALLS)
    blanks = lambda n: F.array_repeat(unknown, F.greatest(n, F.lit(0)))

    def turn(values):
        calls = F.transform(values, _expected_call).cast(CALLS)
        texts = F.forall(values, lambda v: kind_of(v) == "string")
        return let(calls, lambda cs: F.when(~F.exists(cs, lambda c: c.isNull()), cs).when(texts, _unread_call()))

    def aligned(items):
        nested = F.coalesce(kind_of(F.get(items, F.lit(0))) == "array", F.lit(False))
        per_turn = F.transform(items, lambda v: turn(v.try_cast("array<variant>")))
        return F.when(items.isNull(), blanks(n_turns)).when(
            nested, F.slice(F.concat(per_turn, blanks(n_turns - F.size(items))), F.lit(1), n_turns)
        ).otherwise(F.concat(blanks(n_turns - 1), F.array(turn(items))))

    def listed(gt):
        k = kind_of(gt)
        return F.when(k == "array", gt.try_cast("array<variant>")).when(k.isin("object", "string"), F.array(gt))

    return let(let(ground_truth, listed), aligned)


def canonical_calls(expected: Column) -> Column:
    """JSON answer from expected calls: the first non-empty allowed value of each argument."""

    def one(c):
        pick = F.transform_values(c["arguments"], lambda _, a: F.get(F.filter(a, lambda v: ~_is_empty(v)), F.lit(0)))
        kept = F.map_filter(pick, lambda _, v: v.isNotNull())
        return F.struct(c["name"].alias("name"), kept.alias("arguments"))

    return F.coalesce(F.to_json(F.transform(F.filter(expected, lambda c: c["name"].isNotNull()), one)), F.lit("[]"))


def question_turns(question: Column) -> Column:
    """Texts of the user turns of a question: a text, messages, or messages per turn."""
    content = lambda m: F.coalesce(_get(m, "content", "string"), F.lit(""))

    def joined(values):
        return strip(F.array_join(F.filter(F.transform(values, content), lambda x: x != ""), "\n\n"))

    def turn(t):
        return let(kind_of(t), lambda k: F.when(k == "array", joined(t.try_cast("array<variant>")))
                   .when(k == "object", content(t)).otherwise(t.cast("string")))

    def turns(items):
        messages = kind_of(F.get(items, F.lit(0))) == "object"
        return F.when(messages, F.array(joined(items))).otherwise(F.transform(items, turn))

    items = F.when(kind_of(question) == "array", question.try_cast("array<variant>")).otherwise(F.array(question))
    return let(items, turns)


def attach_answers(items: DataFrame, answers: DataFrame, subset: str = "subset") -> DataFrame:
    """Ground truth per item: its own, else the answer table's, else none for irrelevance sets."""
    joined = items.join(
        answers.filter("id is not null").select("id", F.col("ground_truth").alias("__gt")), "id", "left"
    )
    nothing = F.when(F.contains(F.col(subset), F.lit("irrelevance")), F.parse_json(F.lit("[]")))
    return joined.withColumn("ground_truth", F.coalesce("ground_truth", "__gt", nothing)).drop("__gt")


def build_expected_calls(items: DataFrame) -> DataFrame:
    """Function-call items as conversations with the expected calls of the last turn.

    ``items(id, question, function, ground_truth)``, VARIANT but for the id.
    """
    turns = items.withColumn("turns", question_turns(F.col("question")))
    ready = turns.withColumn("expected_turns", expected_turns(F.col("ground_truth"), F.size("turns")))
    system = F.concat(F.lit(TOOLS_HEAD), F.to_json("function"), F.lit("\n\n" + TOOLS_TAIL))
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    dialog = F.flatten(F.zip_with("turns", "expected_turns", lambda t, e: F.array(
        m("user", t), m("assistant", canonical_calls(e)))))
    last = F.try_element_at("expected_turns", F.lit(-1))
    return ready.select(
        "id", F.concat(F.array(m("system", system)), dialog).alias("messages"),
        F.transform(last, lambda c: F.struct(
            c["name"].alias("name"),
            F.transform_values(c["arguments"], lambda _, a: F.transform(a, canonical)).alias("arguments"),
        )).cast(EXPECTED).alias("expected"),
    )


def predicted_calls(response) -> Column:
    """Calls of a response text; null when it is no JSON list (or object) of named calls."""

    def one(c):
        def with_args(args):
            name = F.coalesce(present(_get(c, "name", "string")), present(_get(c, "function", "string")))
            ok = (kind_of(c) == "object") & name.isNotNull() & (kind_of(args) == "object")
            return F.when(ok, F.struct(name.alias("name"), F.transform_values(
                args.try_cast("map<string,variant>"), lambda _, a: canonical(a)).alias("arguments")))

        raw = _get(c, "arguments")
        read = let(kind_of(raw), lambda k: F.when(k == "string", strict_json(raw.cast("string")))
                   .when(k == "null", F.parse_json(F.lit("{}"))).otherwise(raw))
        return let(read, with_args)

    calls = let(strict_json(response), lambda v: F.transform(_items(v), one))
    return let(calls, lambda cs: F.when(~F.exists(cs, lambda c: c.isNull()), cs))


def calls_match(predicted: Column, expected: Column) -> Column:
    """Same number of calls, matched one to one: each expected call takes the first predicted
    call left that has its name and an allowed value for each argument.

    An argument may be missing when its allowed values hold an empty text or null; further
    arguments of the prediction do not matter. An unknown ground truth accepts any calls; one
    that could not be read gives null.
    """

    def fits(p, e):
        return (p["name"] == e["name"]) & F.forall(F.map_entries(e["arguments"]), lambda a: F.when(
            F.map_contains_key(p["arguments"], a["key"]),
            F.array_contains(a["value"], F.try_element_at(p["arguments"], a["key"])),
        ).otherwise(F.exists(a["value"], lambda v: v.isin("null", "s:"))))

    def take(state, e):
        left = state["left"]
        place = F.array_position(F.transform(left, lambda p: F.coalesce(fits(p, e), F.lit(False))), True).cast("int")

        def without(at):
            rest = F.concat(
                F.slice(left, F.lit(1), F.greatest(at - 1, F.lit(0))),
                F.slice(left, F.greatest(at + 1, F.lit(1)), F.size(left)),
            )
            return F.struct(F.when(at > 0, rest).otherwise(left).alias("left"), (state["ok"] & (at > 0)).alias("ok"))

        return let(place, without)

    def verdict(p):
        run = F.aggregate(expected, F.struct(p.alias("left"), F.lit(True).alias("ok")), take, lambda s: s["ok"])
        return F.when(unread(expected), F.lit(None)).when(p.isNull(), F.lit(False)).when(expected.isNull(), F.lit(True)).when(
            F.size(p) != F.size(expected), F.lit(False)).otherwise(run)

    return let(predicted, verdict)
