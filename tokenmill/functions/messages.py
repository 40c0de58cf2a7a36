"""Expressions on the nested form ``ARRAY<STRUCT<role, content>>`` of one conversation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions.text import col, strip

# Role names and the role they stand for.
USER_NAMES = ("user", "human", "instruction", "prompt", "function_response", "function", "tool", "tool_response")
ASSISTANT_NAMES = ("assistant", "gpt", "model", "bot", "response")

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """User and assistant message, with a system message in front where there is one.

    Null when either text is missing, which marks a row that cannot be converted.
    """
    both = F.array(message("user", user), message("assistant", assistant)).cast(MESSAGES)
    if system is not None:
        lead = F.array(message("system", system)).cast(MESSAGES)
        both = F.when(F.coalesce(strip(system), F.lit("")) == "", both).otherwise(F.concat(lead, both))
    return F.when(user.isNotNull() & assistant.isNotNull(), both)


def mapped(messages, role: str, content: str, strict: bool) -> Column:
    """Messages with mapped roles; in strict mode an unknown role becomes null."""

    def one(m, i):
        name = F.lower(strip(m[role].cast("string")))
        return F.struct(
            F.when(name == "system", F.when(i == 0, "system").otherwise("user"))
            .when(name.isin(*USER_NAMES), "user")
            .when(name.isin(*ASSISTANT_NAMES), "assistant")
            .otherwise(None if strict else "user").alias("role"),
            m[content].cast("string").alias("content"),
        )

    return F.transform(col(messages), one).cast(MESSAGES)


def merged(messages: Column, separator: str = "\n\n") -> Column:
    """Neighbouring messages of one role joined."""

    def add(done, m):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            last["role"].alias("role"),
            F.concat(last["content"], F.lit(separator), m["content"]).alias("content"),
        )
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(last["role"] == m["role"], F.concat(head, F.array(joined))).otherwise(
            F.concat(done, F.array(m))
        ).cast(MESSAGES)

    return F.aggregate(messages, F.array().cast(MESSAGES), add)


def trimmed(messages: Column) -> Column:
    """Without a last message that is not the assistant's."""
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return F.when(last == "assistant", messages).otherwise(
        F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
    )


def alternates(messages: Column, end_assistant: bool = False, min_dialog: int = 0, system: bool = True) -> Column:
    """True for an optional system message followed by user, assistant, ... with texts."""
    n_sys = F.when((F.get(messages, F.lit(0))["role"] == "system") & F.lit(system), 1).otherwise(0)
    fits = F.forall(
        F.transform(messages, lambda m, i: F.coalesce(
            ((i < n_sys) | (m["role"] == F.when((i - n_sys) % 2 == 0, "user").otherwise("assistant")))
            & m["content"].isNotNull(), F.lit(False))),
        lambda ok: ok,
    )
    ok = fits & (F.size(messages) > 0) & (F.size(messages) - n_sys >= min_dialog)
    if end_assistant:
        ok &= F.try_element_at(messages, F.lit(-1))["role"] == "assistant"
    return F.coalesce(ok, F.lit(False))
