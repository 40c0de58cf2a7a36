"""Multiple-choice rows: option extraction, answer resolution, shuffling, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.text import WS, col, extract, lone_letter, plain_answer, present, strip

OPTION_COLUMNS = ("options", "choices", "answers", "answer_choices", "choices_text")

# The multiple-choice prompt.
MC_HEAD = "Multiple Choice question: "
MC_TAIL = "\nRespond only with the letter of the correct answer."


def letters_for(options: Column) -> Column:
    """A, B, C, ... for each option."""
    return F.transform(options, lambda _, i: F.char(i + 65))


def render_mc(question, letters, choices) -> Column:
    """Question, one ``- choice=letter`` line each, and the closing instruction."""
    lines = F.zip_with(
        col(choices), col(letters), lambda c, x: F.concat(F.lit("- "), c, F.lit("="), x, F.lit("\n"))
    )
    return F.concat(F.lit(MC_HEAD), col(question), F.lit("\n"), F.array_join(lines, ""), F.lit(MC_TAIL))


def lettered_options(text) -> Column:
    """Options of ``a ) one , b ) two``; without such marks the text is cut at commas."""
    marked = F.regexp_extract_all(col(text), F.lit(r"(?i)([a-e])\s*\)\s*([^,]+)"), F.lit(2))
    plain = F.filter(F.transform(F.split(col(text), ","), strip), lambda o: o != "")
    return F.when(F.size(marked) > 0, F.transform(marked, strip)).otherwise(plain)


def bracketed_options(text) -> Column:
    """Options of a list written as text, such as ``['one', "two"]``."""
    body = strip(col(text))
    quoted = F.regexp_extract_all(
        body, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0)
    )
    items = F.filter(
        F.transform(quoted, lambda q: strip(F.regexp_replace(
            F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))),
        lambda o: o != "",
    )
    numbers = r"^\[\s*-?[\d.]+(?:\s*,\s*-?[\d.]+)*\s*\]$"
    inner = F.regexp_replace(body, r"^[\[\]]+|[\[\]]+$", "")
    numeric = F.transform(F.split(inner, ","), strip)
    loose = F.filter(
        F.transform(F.split(inner, r"\s*\n\s*|\\n|\\t|\\r"),
                    lambda p: F.regexp_replace(strip(p), r"""^["']+|["']+$""", "")),
        lambda p: p != "",
    )
    return (
        F.when(body == "", F.array().cast("array<string>"))
        .when(F.size(items) >= 2, items)
        .when(body.rlike(numbers), numeric)
        .when(F.size(items) == 1, items)
        .otherwise(loose)
    )


def _names(struct: T.StructType, *wanted: str) -> list[str]:
    return [w for w in wanted if w in struct.fieldNames()]


def extract_options(df: DataFrame, columns=OPTION_COLUMNS) -> tuple[Column | None, Column | None]:
    """(options, labels) of each row, from the first option column that is not null in it.

    A column may be a struct of arrays, an array of structs, an array of texts or one text;
    labels are None when no column has any, and null for rows whose options come without.
    """
    found: list[tuple[Column, Column | None]] = []
    for name in columns:
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        c = F.col(f"`{name}`")
        if isinstance(kind, T.StructType):
            texts = _names(kind, "text", "options", "choices")
            labels = _names(kind, "label", "labels")
            if texts:
                found.append((
                    c[texts[0]].cast("array<string>"),
                    c[labels[0]].cast("array<string>") if labels else None,
                ))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            texts = _names(kind.elementType, "text", "content", "value")
            has_label = "label" in kind.elementType.fieldNames()
            found.append((
                F.transform(c, lambda o: F.coalesce(*[present(o[t]) for t in texts], F.lit(""))),
                F.transform(c, lambda o: o["label"].cast("string")) if has_label else None,
            ))
        elif isinstance(kind, T.ArrayType):
            found.append((c.cast("array<string>"), None))
        elif isinstance(kind, T.StringType):
            found.append((lettered_options(c), None))
    if not found:
        return None, None
    options = F.coalesce(*[o for o, _ in found])
    if all(labels is None for _, labels in found):
        return options, None
    pick = F.lit(None).cast("array<string>")
    for o, labels in reversed(found):
        pick = F.when(o.isNotNull(), F.lit(None).cast("array<string>") if labels is None else labels).otherwise(pick)
    return options, pick


def at(values: Column, index: Column) -> Column:
    """Element at a 0-based index, null outside the array."""
    return F.when((index >= 0) & (index < F.size(values)), F.get(values, index.cast("int")))


def position(values: Column, value: Column) -> Column:
    """0-based place of a value, null when it is not there."""
    p = F.array_position(values, value)
    return F.when(p > 0, (p - 1).cast("int"))


def resolve_answer(answer, labels: Column, options: Column) -> Column:
    """Label of the answer: by 0-based number, by letter, by text, by normalized text."""
    text = strip(col(answer).cast("string"))
    whole = F.regexp_replace(text, r"^(\d+)\.0+$", "$1") if not isinstance(answer, str) else text
    index = F.when(whole.rlike(r"^\d+$"), whole.try_cast("int"))
    letter = lone_letter(text)
    plain = F.lower(plain_answer(text))
    return F.when(text != "", F.coalesce(
        at(labels, index),
        F.when(F.array_contains(labels, letter), letter),
        at(labels, position(F.transform(options, strip), text)),
        at(labels, position(F.transform(options, lambda o: F.lower(plain_answer(o))),
                            F.nullif(plain, F.lit("")))),
    ))


def shuffle_choices(choices: Column, key: Column, gold: Column | int = 0) -> tuple[Column, Column]:
    """(choices in hash order, new place of the gold choice)."""
    tagged = F.array_sort(F.transform(choices, lambda c, i: F.struct(
        F.md5(F.concat(key.cast("string"), F.lit("|"), i.cast("string"))).alias("h"), i.alias("i"), c.alias("c")
    )))
    gold = gold if isinstance(gold, Column) else F.lit(gold)
    return (
        F.transform(tagged, lambda t: t["c"]),
        position(F.transform(tagged, lambda t: t["i"]), gold.cast("int")),
    )


def tagged_input(text) -> tuple[Column, Column, Column]:
    """(context, question, options) of a text with retrieval-context and input marks."""
    t = col(text)
    tags = r"(?is)<!--{0}-->(.*?)<!--/{0}-->"
    context = strip(extract(t, tags.format("retrieval_context")))
    block = strip(F.coalesce(extract(t, tags.format("input")), t))
    found = extract(block, r"(?s)^[^\[]*(\[.*\])")
    head = F.when(found.isNotNull(), strip(extract(block, r"(?s)^([^\[]*)"))).otherwise(block)
    question = F.nullif(strip(F.regexp_replace(head, rf"^[{WS}]*,+", "")), F.lit(""))
    options = F.when(found.isNotNull(), bracketed_options(found))
    return context, question, options
