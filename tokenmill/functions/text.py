"""Text expressions: trimming, answer normalization, number and letter extraction.

Whitespace here means Unicode whitespace, which is wider than Spark's ``trim``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\t-\r\x1c-\x20\x85\p{Z}"
# The characters of ``WS``, which trims without a regular expression.
SPACES = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))
WORD = r"\p{L}\p{N}_"
# A word boundary by Unicode letters, digits and underscore.
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

GSM_ANSWER = r"#### (-?[0-9.,]+)"
ANY_NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
BOXED = r"\\+boxed\{([^}]*)\}"
BOXED_ONE = r"\\boxed\{([^}]*)\}"
FRAMED = r"\\framebox\{([^}]*)\}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(c) -> Column:
    """The text as VARIANT when all of it is one JSON value, else null.

    ``try_parse_json`` stops behind the first value; a closing mark behind the text shows that
    the parser came to its end.
    """

    def parsed(text):
        mark = F.md5(text)
        values = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
        return let(values.try_cast("array<variant>"), lambda a: F.when(
            (F.size(a) == 2) & (F.get(a, F.lit(1)).try_cast("string") == mark), F.get(a, F.lit(0))))

    return let(col(c), parsed)


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def rstrip(c) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def blank(c) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def present(c) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def extract(c, pattern: str, group: int = 1) -> Column:
    """First match of the pattern, or null when there is none (Spark gives '')."""
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))
    return F.get(found, F.lit(0))


def last_match(c, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))
    return F.try_element_at(found, F.lit(-1))


def marked_number(c) -> Column:
    """The number behind the ``####`` marker, commas removed."""
    return F.regexp_replace(extract(c, GSM_ANSWER), ",", "")


def last_number(c) -> Column:
    return F.regexp_replace(last_match(c, ANY_NUMBER), ",", "")


def answer_number(c) -> Column:
    """The marked number, or else the last number of the text."""
    return F.coalesce(marked_number(c), last_number(c))


def boxed(c) -> Column:
    return strip(extract(c, BOXED))


def boxed_integer(c) -> Column:
    """Last integer of the first box or frame that holds one, else of the whole text."""
    return F.coalesce(
        last_match(extract(c, BOXED_ONE), r"\d+"),
        last_match(extract(c, FRAMED), r"\d+"),
        last_match(c, r"\d+"),
    ).cast("decimal(38,0)")


def lone_letter(c) -> Column:
    """The letter of an answer such as ``(b)``; null when more than one letter is there."""
    return F.upper(extract(strip(c), r"^[^A-Za-z0-9]*([A-Za-z])[^A-Za-z0-9]*$"))


def choice_letter(c) -> Column:
    """First stand-alone capital after upper-casing, else a leading letter."""
    up = F.upper(strip(c))
    return F.coalesce(
        extract(up, rf"{BOUNDARY}([A-Z]){BOUNDARY}"),
        extract(up, r"^([A-Z])"),
    )


def plain_answer(c) -> Column:
    """Answer text without dollar signs, zero-width characters, boxes and whitespace."""
    out = F.coalesce(strip(c), F.lit(""))
    for pattern, by in (
        (r"\$", ""),
        (r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]", ""),
        (r"(?i)u200b|u200c|u200d|u2060|ufeff", ""),
        (BOXED_ONE, "$1"),
        (FRAMED, "$1"),
        (rf"[{WS}]+", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


def factoid(c) -> Column:
    """Lower-cased answer without punctuation and articles, single-spaced."""
    out = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), rf"[^0-9a-z{WS}]", " ")
    out = F.regexp_replace(out, r"\b(a|an|the)\b", " ")
    return strip(F.regexp_replace(out, rf"[{WS}]+", " "))


def exact(c) -> Column:
    """Trimmed, single-spaced, lower-cased text."""
    return F.lower(F.regexp_replace(strip(c), rf"[{WS}]+", " "))


def slug(c) -> Column:
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("-"))


def quote_regex(c) -> Column:
    """Regex that matches the text literally."""
    return F.regexp_replace(col(c), r"([\\\[\](){}.*+?^$|#&~\-\s])", r"\\$1")


def order_key(seed, *cols) -> Column:
    """Hash that orders rows the same way on any partitioning and in other engines."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def unit_interval(seed, *cols) -> Column:
    """Deterministic draw from [0, 1) built from the first eight hash digits."""
    digits = F.conv(F.left(order_key(seed, *cols), F.lit(8)), 16, 10).cast("double")
    return digits / F.lit(float(2**32))


def hash_pick(seed, n, *cols) -> Column:
    """Deterministic draw from 0 .. n-1; ``n`` is an int or a column."""
    digits = F.conv(F.left(order_key(seed, *cols), F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(digits, n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def sha1_seed(c) -> Column:
    """sha1 of the text modulo 2^32."""
    return F.conv(F.right(F.sha1(col(c)), F.lit(8)), 16, 10).cast("bigint")
