"""Graders of responses. Each is a column expression; ``grade`` joins and routes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import (
    BOUNDARY, answer_number, boxed, boxed_integer, choice_letter, col, exact, extract, factoid, last_number,
    lone_letter, marked_number, plain_answer, strict_json, strip,
)
from tokenmill.operators.tools import calls_match, predicted_calls, unread
from tokenmill.plans.joins import skew_join


def number_match(reference, response, fallback: bool = True) -> Column:
    """Equal marked numbers; with ``fallback`` the last number stands in for a missing mark.

    Two texts without any number count as equal.
    """
    read = answer_number if fallback else marked_number
    return read(reference).eqNullSafe(read(response))


def number_match_strict(reference, response) -> Column:
    """Equal numbers, and both texts must have one."""
    a, b = answer_number(reference), answer_number(response)
    return F.coalesce(a == b, F.lit(False))


def numeric_equal(a: Column, b: Column) -> Column:
    """Equal as numbers where both parse, else as trimmed texts; null never matches."""
    x, y = a.try_cast("double"), b.try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(strip(a) == strip(b))
    return F.coalesce(same, F.lit(False))


def numeric_match(reference, response) -> Column:
    """Numbers of both texts compared by value."""
    read = lambda c: F.coalesce(F.nullif(answer_number(c), F.lit("")), last_number(c))
    return numeric_equal(read(reference), read(response))


def letter_exact(reference, response, letters=None) -> Column:
    """The response is the reference letter; one that is no allowed letter is an error."""
    same = col(response) == col(reference)
    if letters is None:
        return same
    return F.when(F.array_contains(col(letters), col(response)), same).otherwise(
        F.raise_error(F.concat(F.lit("Answer is not among the letters: "), F.coalesce(col(response), F.lit("null"))))
        .cast("boolean")
    )


def letter_match(reference, response) -> Column:
    """The first stand-alone letter of the response, or its first letter, is the reference."""
    want = lone_letter(reference)
    text = strip(response)
    first = F.upper(extract(text, rf"{BOUNDARY}([A-Za-z]){BOUNDARY}"))
    hit = F.coalesce(first == want, F.lit(False)) | F.upper(text).startswith(want)
    return F.coalesce(hit & (text != ""), F.lit(False))


def choice_match(reference_letter, response) -> Column:
    return F.coalesce(choice_letter(response) == col(reference_letter), F.lit(False))


def text_upper_match(reference, response) -> Column:
    return F.coalesce(F.upper(strip(response)) == F.upper(strip(reference)), F.lit(False))


def boxed_match(reference, response) -> Column:
    """Equal boxed answers, else equal trimmed texts."""
    a, b = boxed(reference), boxed(response)
    both = a.isNotNull() & b.isNotNull()
    return F.coalesce(F.when(both, a == b).otherwise(strip(reference) == strip(response)), F.lit(False))


def integer_match(reference, response) -> Column:
    return F.coalesce(boxed_integer(reference) == boxed_integer(response), F.lit(False))


def flexible_match(reference, response) -> Column:
    """Numbers where both texts have one, else normalized texts."""
    a, b = answer_number(reference), answer_number(response)
    return F.when(a.isNotNull() & b.isNotNull(), numeric_equal(a, b)).otherwise(
        F.lower(plain_answer(reference)) == F.lower(plain_answer(response))
    )


def mixed_match(reference, response, letters) -> Column:
    """Letter match for rows with letters, flexible match for the others."""
    return F.when(F.size(col(letters)) > 0, letter_match(reference, response)).otherwise(
        flexible_match(reference, response)
    )


def exact_match(reference, response) -> Column:
    return F.coalesce(exact(response) == exact(reference), F.lit(False))


def text_match(reference, response) -> Column:
    """Equal trimmed texts: the default grader."""
    return F.coalesce(strip(response) == strip(reference), F.lit(False))


def alias_match(aliases, response, reference=None) -> Column:
    """The normalized response is one of the normalized aliases."""
    names = F.transform(col(aliases), factoid)
    hit = F.array_contains(names, factoid(response))
    if reference is not None:
        hit = F.when(F.size(names) > 0, hit).otherwise(factoid(response) == factoid(reference))
    return F.coalesce(hit, F.lit(False)) & col(response).isNotNull()


def yes_no_match(reference, response) -> Column:
    want, got = F.lower(strip(reference)), F.lower(strip(response))
    hit = (
        (want.isin("yes", "no") & got.startswith(want))
        | ((want == "yes") & (F.contains(got, F.lit("true")) | F.contains(got, F.lit("yes"))))
        | ((want == "no") & (F.contains(got, F.lit("false")) | F.contains(got, F.lit("no"))))
    )
    return F.coalesce(hit & (got != ""), F.lit(False))


def json_valid(response) -> Column:
    return strict_json(response).isNotNull()


def call_match(expected, response) -> Column:
    """Function calls of the response against ``expected`` (see ``tools.EXPECTED``).

    Null where the ground truth could not be read, since no verdict is possible then.
    """
    match = F.coalesce(calls_match(predicted_calls(response), col(expected)), F.lit(False))
    return F.when(~unread(col(expected)), match)


def outcome_match(programs: DataFrame, outcomes: DataFrame, key: str = "program_id") -> DataFrame:
    """Results of programs that ran elsewhere; a program without a result failed."""
    return programs.join(outcomes.select(key, F.col("success").alias("__s")), key, "left").withColumn(
        "is_correct", F.coalesce("__s", F.lit(False))
    ).drop("__s")


GRADERS: dict[str, Callable[..., Column]] = {
    "gsm8k": number_match,
    "spelling": lambda ref, res: number_match(ref, res, fallback=False),
    "gsm8k_like": number_match_strict,
    "svamp": numeric_match,
    "letter": letter_match,
    "choice": choice_match,
    "math_qa": text_upper_match,
    "hendrycks_math": boxed_match,
    "aime": integer_match,
    "flexible": flexible_match,
    "exact": exact_match,
    "text": text_match,
    "boolq": yes_no_match,
}


def grade(responses: DataFrame, items: DataFrame, graders: dict[str, Callable[..., Column]] | Sequence[str]) -> DataFrame:
    """Responses joined to their items and graded by the grader of their task.

    ``graders`` names the graders in use, or maps names to functions (reference, response).

    ``responses(task, item_id, sample_no, text)``, ``items(task, item_id, reference, grader)``.
    Responses of a hot item are spread out; the item side has one row per key.
    """
    if not isinstance(graders, dict):
        graders = {name: GRADERS[name] for name in graders}
    both = skew_join(responses, items, ["task", "item_id"])
    verdict = F.lit(None).cast("boolean")
    for name, fn in graders.items():
        verdict = F.when(F.col("grader") == name, fn(F.col("reference"), F.col("text"))).otherwise(verdict)
    return both.withColumn("is_correct", verdict)


def reward(is_correct: Column) -> Column:
    return is_correct.cast("double")
