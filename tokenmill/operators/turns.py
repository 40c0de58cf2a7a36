"""Conversation jobs on the long form ``turns(conv_id, turn, role, text)``.

The long form is the working form: windows stay inside a conversation, stream through their
rows and spill. ``to_nested`` and ``to_long`` convert to and from one row per conversation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import blank, col, present, strip
from tokenmill.plans.joins import skew_join

# Role names and the role they stand for.
USER_ROLES = ("user", "human", "instruction", "prompt")
ASSISTANT_ROLES = ("assistant", "gpt", "model", "bot", "response")
TOOL_ROLES = ("function_response", "function", "tool", "tool_response")

# Columns that may hold a language.
LANGUAGE_COLUMNS = ("lang", "language", "languages", "langs", "locale", "language_code")

# Request limits.
LIMITS = {
    "max_messages": 500,
    "max_message_chars": 8000,
    "max_total_chars": 32000,
    "temperature": (0.0, 2.0),
    "top_k": (1, 200),
    "max_tokens": (1, 4096),
}

THINK_BLOCK = r"(?s)<think>.*?</think>\s*"

# Default re-prompt templates.
REPROMPT = "{prompt}{solution}{feedback}\n\nCorrectly solve the original question."
SOLUTION = "\n\nCorrect solution:\n\n{successful_previous_attempt}"
FEEDBACK = (
    "\n\nThe following is feedback from your unsuccessful earlier attempt:\n\n{feedback_raw}"
)


def _turns(*extra: str):
    return Window.partitionBy("conv_id").orderBy("turn")


def first_of(df: DataFrame, *aliases: str) -> Column:
    """First of the aliases that exists in the table and is neither null nor empty."""
    have = [present(F.col(f"`{a}`")) for a in aliases if a in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def filter_english(df: DataFrame, columns: Sequence[str] = LANGUAGE_COLUMNS) -> DataFrame:
    """Keep rows whose language columns name English; rows without any language stay."""
    types = dict(df.dtypes)
    have = [c for c in columns if c in types]
    if not have:
        return df

    def english(c):
        tokens = F.col(c) if types[c].startswith("array") else F.array(F.col(c).cast("string"))
        parts = F.flatten(F.transform(tokens, lambda t: F.split(F.lower(t), r"[\s,;/|]+")))
        return F.coalesce(F.exists(parts, lambda p: p.startswith("en") | p.contains("english")),
                          F.lit(False))

    named = reduce(lambda a, b: a | b, [english(c) for c in have])
    silent = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in have])
    return df.filter(named | silent)


def role_of(raw: Column, is_first: Column, strict: bool) -> Column:
    name = F.lower(strip(raw.cast("string")))
    other = (
        F.raise_error(F.concat(F.lit("Unknown role: "), name)).cast("string")
        if strict else F.lit("user")
    )
    return (
        F.when(name == "system", F.when(is_first, "system").otherwise("user"))
        .when(name.isin(*USER_ROLES, *TOOL_ROLES), "user")
        .when(name.isin(*ASSISTANT_ROLES), "assistant")
        .otherwise(other)
    )


def map_roles(turns: DataFrame, strict: bool = False) -> DataFrame:
    """Map source role names to system, user and assistant; system only as the first turn."""
    is_first = F.row_number().over(_turns()) == 1
    return turns.withColumn("__first", is_first).withColumn(
        "role", role_of(F.col("role"), F.col("__first"), strict)
    ).drop("__first")


def merge_same_role(turns: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Join neighbouring turns of one role; the merged turn keeps the first turn number."""
    w = _turns()
    starts = F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)
    runs = turns.withColumn("__new", starts).withColumn("__run", F.sum("__new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return runs.groupBy("conv_id", "__run").agg(
        F.min("turn").alias("turn"),
        F.first("role").alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"),
    ).drop("__run")


def validate_turns(
    turns: DataFrame, end_assistant: bool = True, min_messages: int = 1, min_dialog: int = 0
) -> DataFrame:
    """One row per conversation: is it an optional system turn followed by user, assistant, ...

    ``min_messages`` counts all turns, ``min_dialog`` those after the system turn.
    """
    numbered = turns.withColumn("__n", F.row_number().over(_turns()) - 1)
    lead = numbered.withColumn(
        "__sys", F.max(F.when((F.col("__n") == 0) & (F.col("role") == "system"), 1).otherwise(0))
        .over(Window.partitionBy("conv_id"))
    )
    at = F.col("__n") - F.col("__sys")
    fits = (at < 0) | (F.col("role") == F.when(at % 2 == 0, "user").otherwise("assistant"))
    facts = lead.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.max("__sys").alias("__sys"),
        F.bool_and(F.coalesce(fits, F.lit(False))).alias("__alternates"),
        F.bool_and(F.col("text").isNotNull()).alias("__texts"),
        F.max_by("role", "turn").alias("__last"),
    )
    reason = (
        F.when(F.col("n_messages") < min_messages, "too_few_messages")
        .when(F.col("n_messages") - F.col("__sys") < min_dialog, "too_few_messages")
        .when(~F.col("__alternates"), "roles_do_not_alternate")
        .when(~F.col("__texts"), "content_not_text")
    )
    if end_assistant:
        reason = F.coalesce(reason, F.when(F.col("__last") != "assistant", "last_not_assistant"))
    return facts.select(
        "conv_id", "n_messages", reason.isNull().alias("is_valid"), reason.alias("reason")
    )


def trim_trailing(turns: DataFrame) -> DataFrame:
    """Drop the last turn of a conversation when it is not the assistant's."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("__r", last).filter(
        ~((F.col("__r") == 1) & (F.col("role") != "assistant"))
    ).drop("__r")


def fold_system(turns: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Put a leading system turn in front of the user turn that follows it."""
    w = _turns()
    marked = (
        turns.withColumn("__n", F.row_number().over(w))
        .withColumn("__prev_role", F.lag("role").over(w))
        .withColumn("__prev_text", F.lag("text").over(w))
    )
    follows = (F.col("__n") == 2) & (F.col("__prev_role") == "system")
    text = F.when(follows, F.concat("__prev_text", F.lit(separator), "text")).otherwise(F.col("text"))
    return (
        marked.filter(~((F.col("__n") == 1) & (F.col("role") == "system")))
        .withColumn("text", text)
        .drop("__n", "__prev_role", "__prev_text")
    )


def parse_transcripts(df: DataFrame, text_col: str, id_col: str = "conv_id") -> DataFrame:
    """Split ``Human:`` / ``Assistant:`` transcripts into turns; other chunks are dropped."""
    chunks = F.split(strip(text_col), r"\n\n(?=Human:|Assistant:)")
    parts = df.select(F.col(id_col).alias("conv_id"), F.posexplode(chunks).alias("turn", "__c"))
    label = F.regexp_extract("__c", r"^(Human|Assistant):", 1)
    return parts.filter(label != "").select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.when(label == "Human", "user").otherwise("assistant").alias("role"),
        strip(F.regexp_replace("__c", r"^(Human|Assistant):", "")).alias("text"),
    )


def pair_messages(df: DataFrame) -> DataFrame:
    """Pairs of a user message and an assistant reply to it, English where the language is known.

    ``df(message_id, parent_id, role, lang, text)``. An equi-join in which a
    parent with very many replies is spread out.
    """
    english = F.col("lang").isNull() | F.col("lang").isin("", "en")
    usable = english & (F.coalesce(F.col("text"), F.lit("")) != "")
    role = F.lower("role")
    child = df.filter(usable & (role == "assistant") & (F.coalesce("parent_id", F.lit("")) != ""))
    parent = df.filter(usable & role.isin("prompter", "user", "human"))
    replies = child.select("parent_id", "message_id", F.col("text").alias("assistant_text"))
    asked = parent.select(F.col("message_id").alias("parent_id"), F.col("text").alias("user_text"))
    return skew_join(replies, asked, ["parent_id"])


def check_limits(turns: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Reasons why a conversation breaks the request limits; no reason means accepted.

    Optional columns temperature, top_k and max_tokens are checked against their ranges.
    """
    size = F.length("text")
    facts = [
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.coalesce(size, F.lit(0))).alias("total_chars"),
        F.max(F.coalesce(size, F.lit(0))).alias("longest"),
        F.bool_or(F.coalesce(size, F.lit(0)) == 0).alias("__empty"),
        F.bool_or(~F.col("role").isin("user", "assistant")).alias("__role"),
    ]
    ranged = [c for c in ("temperature", "top_k", "max_tokens") if c in turns.columns]
    facts += [
        F.bool_or(~F.col(c).between(*limits[c])).alias(f"__{c}") for c in ranged
    ]
    per = turns.groupBy("conv_id").agg(*facts)
    checks = [
        ("too_many_messages", F.col("n_messages") > limits["max_messages"]),
        ("empty_content", F.col("__empty")),
        ("message_too_long", F.col("longest") > limits["max_message_chars"]),
        ("conversation_too_long", F.col("total_chars") > limits["max_total_chars"]),
        ("invalid_role", F.col("__role")),
    ] + [(f"{c}_out_of_range", F.col(f"__{c}")) for c in ranged]
    reasons = F.array_compact(F.array(*[F.when(cond, name) for name, cond in checks]))
    return per.select(
        "conv_id", "n_messages", "total_chars", reasons.alias("reasons"),
        (F.size(reasons) == 0).alias("accepted"),
    )


def to_nested(turns: DataFrame) -> DataFrame:
    """One row per conversation with ``messages ARRAY<STRUCT<role, content>>``."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(
        F.transform(
            parts, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("content"))
        ).alias("messages")
    )


def to_long(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", F.posexplode("messages").alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.col("m.role").alias("role"), F.col("m.content").alias("text"),
    )


def content_text(parts) -> Column:
    """Text of a message that is a list of parts."""
    return F.array_join(F.transform(col(parts), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def prompt_and_reference(turns: DataFrame) -> DataFrame:
    """Prompt text (``Role: text`` of all but the last turn) and the reference answer.

    The reference is null when the last turn is not the assistant's.
    """
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    lines = F.struct(
        "turn", F.concat(F.initcap(F.lower("role")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")
    )
    return turns.withColumn("__r", last).groupBy("conv_id").agg(
        strip(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("__r") > 1, lines))),
                        lambda p: p["line"]),
            "\n\n",
        )).alias("prompt_text"),
        F.max(F.when((F.col("__r") == 1) & (F.col("role") == "assistant"), F.col("text")))
        .alias("reference_text"),
    )


def _fill(template: str, **values: Column) -> Column:
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), values[name]]
    return F.concat(*out, F.lit(rest))


def build_reprompts(
    df: DataFrame,
    reprompt: str = REPROMPT,
    solution: str = SOLUTION,
    feedback: str = FEEDBACK,
    drop_thinking: bool = False,
    feedback_only_without_solution: bool = False,
) -> DataFrame:
    """Prompt for a second attempt from ``prompt_text``, ``solution_text``, ``feedback_text``.

    Rows with neither a solution nor feedback are dropped.
    """
    sol = F.col("solution_text")
    fb = F.col("feedback_text")
    if feedback_only_without_solution:
        fb = F.when(present(sol).isNull(), fb)
    shown = F.regexp_replace(sol, THINK_BLOCK, "") if drop_thinking else sol
    sol_part = F.when(present(sol).isNotNull(), _fill(solution, successful_previous_attempt=shown))
    fb_part = F.when(present(fb).isNotNull(), _fill(feedback, feedback_raw=fb))
    text = _fill(
        reprompt,
        prompt=strip(F.coalesce("prompt_text", F.lit(""))),
        solution=F.coalesce(sol_part, F.lit("")),
        feedback=F.coalesce(fb_part, F.lit("")),
    )
    return df.filter(sol.isNotNull() | ~blank(fb)).withColumn("reprompt", strip(text))


def truncate_on_stop(df: DataFrame, text_col: str, stops: Sequence[str]) -> DataFrame:
    """Cut the text at the earliest stop string."""
    stops = [s for s in stops if s]
    if not stops:
        return df
    hits = F.array(*[F.locate(s, F.col(text_col)) for s in stops])
    first = F.array_min(F.filter(hits, lambda p: p > 0))
    return df.withColumn(
        text_col,
        F.when(first.isNull(), F.col(text_col)).otherwise(F.left(text_col, first - 1)),
    )


# Python source in the first fenced block, if any.
CODE_BLOCK = r"(?s)```(?:python)?\s*\n(.*?)\n```"


def code_of(text) -> Column:
    blocks = F.regexp_extract_all(col(text), F.lit(CODE_BLOCK), F.lit(1))
    return strip(F.coalesce(F.get(blocks, F.lit(0)), col(text)))


def leading_imports(prompt) -> Column:
    """Import lines before the first line that is neither an import, a comment nor blank."""
    lines = F.transform(F.split(col(prompt), "\n"), strip)
    is_import = lambda s: s.startswith("import ") | s.startswith("from ")
    stops = F.transform(lines, lambda s: ~is_import(s) & (s != "") & ~s.startswith("#"))
    first_stop = F.array_position(stops, True)
    head = F.when(first_stop > 0, F.slice(lines, 1, (first_stop - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(head, is_import), "\n")


def assemble_programs(responses: DataFrame, tasks: DataFrame, kind: str) -> DataFrame:
    """Test programs for an external runner.

    ``kind='check'``: tasks(item_id, prompt, test, entry_point), imports of the prompt, the
    code, the test and a call of ``check``. ``kind='asserts'``: tasks(item_id,
    test_setup_code, test_list, challenge_test_list), the code, the setup and the assertions;
    program is null without any assertion.
    """
    both = skew_join(responses, tasks, ["item_id"])
    code = code_of("text")
    if kind == "check":
        program = F.concat(
            leading_imports("prompt"), F.lit("\n\n"), code, F.lit("\n\n"), F.col("test"),
            F.lit("\ncheck("), F.col("entry_point"), F.lit(")"),
        )
    else:
        listed = F.concat(
            F.coalesce("test_list", F.array().cast("array<string>")),
            F.coalesce("challenge_test_list", F.array().cast("array<string>")),
        )
        asserts = F.filter(F.transform(listed, strip), lambda t: t != "")
        program = F.when(F.size(asserts) > 0, F.concat(
            code, F.lit("\n\n"), F.coalesce("test_setup_code", F.lit("")), F.lit("\n\n"),
            F.array_join(asserts, "\n"), F.lit("\n"),
        ))
    return both.select(*responses.columns, program.alias("program"))
