"""Text expressions: tags, scores, mentions, volatile ids. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of a generation, in the chat layout. Fixed values.
THINK, RESPONSE = ("<think>", "</think>"), ("<response>", "</response>")
#: Least length of a reasoning block, and markup that must not appear in it. Fixed values.
MIN_THINK_CHARS = 15
LEAKED_MARKUP = r"(?i)<\s*/?\s*(think|response|tool|\|im_)"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` only removes blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def between(c: Column, opening: str, closing: str) -> Column:
    """The text from the first ``opening`` to the next ``closing``; null where one is missing."""
    start = F.locate(opening, c)
    end = F.locate(closing, F.substr(c, start + F.lit(len(opening))))
    return F.when((start > 0) & (end > 0), F.substr(c, start + F.lit(len(opening)), end - 1))


def think(c: Column) -> Column:
    """The stripped reasoning block of a generation."""
    return strip(between(c, *THINK))


def response(c: Column) -> Column:
    """The stripped call list of a generation, as text."""
    return strip(between(c, *RESPONSE))


def until(c: Column, *stops: str) -> Column:
    """The text before the first of any of the ``stops``."""
    for s in stops:
        c = F.substring_index(c, s, 1)
    return c


def think_fault(c: Column) -> Column:
    """Null for usable reasoning, else what is wrong with it."""
    body = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(body) < MIN_THINK_CHARS, "empty_think").when(F.rlike(c, F.lit(LEAKED_MARKUP)), "think_leaked_markup")


#: What a judge is asked to write, by mode. Fixed values.
SCORE_PATTERNS = {"first_digit": r"(?i)SCORE\s*:\s*([0-5])", "clamped": r"(?i)SCORE:\s*(\d+)", "rejected": r"(?i)SCORE:\s*(\d+)", "last_digit": r"(?i)SCORE:\s*([0-5])\b"}
REASON_PATTERN = r"(?i)REASON\s*:\s*([^\r\n]+)"


def score(reply: Column, mode: str = "first_digit") -> Column:
    """The score in a judge's reply, after "SCORE:".

    ``first_digit``: the first digit 0 to 5, null if there is none. ``clamped``: the first number, at most 5, -1 if none.
    ``rejected``: the same, but more than 5 is -1. ``last_digit``: the last single digit 0 to 5 behind the reasoning block, or
    anywhere if none stands behind it, -1 if none.
    """
    if mode not in SCORE_PATTERNS:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(SCORE_PATTERNS)}")
    pattern = SCORE_PATTERNS[mode]
    if mode == "last_digit":
        last = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1)).cast("int")
        return F.coalesce(last(F.element_at(F.split(reply, "</think>"), -1)), last(reply), F.lit(-1))
    found = F.nullif(F.regexp_extract(reply, pattern, 1), F.lit(""))
    if mode == "first_digit":
        return found.cast("int")
    number = found.cast("double")  # however many digits
    if mode == "clamped":
        return F.when(number.isNull(), -1).otherwise(F.least(number, F.lit(5.0)).cast("int"))
    return F.when(number <= 5, number.cast("int")).otherwise(-1)


def score_reason(reply: Column) -> Column:
    """The line after "REASON:", at most 200 characters; null without one."""
    return F.left(strip(F.nullif(F.regexp_extract(reply, REASON_PATTERN, 1), F.lit(""))), F.lit(200))


def mentions(c: Column, name: Column) -> Column:
    """Whether ``name`` stands in the text as a word of its own."""
    return F.rlike(c, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))


#: Entity ids, which are drawn anew for every example. Fixed value.
VOLATILE_ID = r"\bb_\d+\b"


def without_ids(c: Column) -> Column:
    """Entity ids replaced by one mark."""
    return F.regexp_replace(c, VOLATILE_ID, "<id>")


def shortened(c: Column, n: int) -> Column:
    """At most ``n`` characters, with a mark where some were cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(" ...[truncated]"))).otherwise(c)


def eta(seconds: Column) -> Column:
    """Hours and minutes, or minutes and seconds, of a duration."""
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def version_key(c: Column, width: int = 4) -> Column:
    """A version as an array of numbers of one width, so that versions compare as arrays do."""
    parts = F.transform(F.split(F.regexp_extract(c, r"^\s*v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: x.try_cast("int"))
    return F.slice(F.concat(F.transform(parts, lambda x: F.coalesce(x, F.lit(0))), F.array_repeat(F.lit(0), width)), 1, width)


def satisfies(version: str, clauses: str) -> bool:
    """Whether a version meets all clauses, such as ">=1.2,<2,!=1.5.0"; missing places are 0. For the driver."""
    compare = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}

    def numbers(v: str) -> list[int]:
        found = re.match(r"\s*v?(\d+(?:\.\d+)*)", v)
        if not found:
            raise ValueError(f"no version: {v!r}")
        return [int(x) for x in found[1].split(".")]

    for clause in filter(None, (c.strip() for c in clauses.split(","))):
        op = next((o for o in compare if clause.startswith(o)), None)
        if op is None:
            raise ValueError(f"no comparison: {clause!r}")
        a, b = numbers(version), numbers(clause[len(op) :])
        width = max(len(a), len(b))
        if not compare[op](a + [0] * (width - len(a)), b + [0] * (width - len(b))):
            return False
    return True


def word_count(c: Column) -> Column:
    """Number of runs of characters other than white space: the default tokenizer's length."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))), F.lit(0))
