"""Plain forms of keys, labels and language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand where a key is missing. Fixed values.
MISSING_WORDS = ("", "-", "_", "n/a", "na", "nan", "nil", "none", "null", "missing", "unknown", "undefined")
#: Codes of a language besides its plain one. Fixed values.
LANG_ALIASES = {"py": "python", "python3": "python"}


def plain(c: Column) -> Column:
    """The plain form of a name: no blanks at the ends, lower case, each run of blanks, hyphens and underscores one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "_")


def key(c: Column) -> Column:
    """``plain``, and null where the name only says that there is none."""
    p = plain(c)
    return F.when(~p.isin(*MISSING_WORDS), p)


def lang(c: Column) -> Column:
    """The main part of a language code, without its region: 'en-EN' and 'EN' are 'en', 'py' is 'python'."""
    head = F.element_at(F.split(plain(c), "_"), 1)
    named = head
    for alias, name in LANG_ALIASES.items():
        named = F.when(head == alias, F.lit(name)).otherwise(named)
    return F.when(~plain(c).isin(*MISSING_WORDS), named)
