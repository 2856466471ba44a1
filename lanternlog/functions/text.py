"""Message text: levels, templates, categories, tokens."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from lanternlog.functions import fixed


def normalize_level(level: Column) -> Column:
    up = F.upper(F.coalesce(level, F.lit("")))
    return (
        F.when(up == "", "INFO")
        .when(up.isin(fixed.FATAL_ALIASES), "FATAL")
        .when(up.startswith("WARN"), "WARN")
        .otherwise(up)
    )


def is_error(level: Column) -> Column:
    """Error predicate; a missing level is no error."""
    return F.coalesce(F.upper(level).isin(fixed.ERROR_LEVELS), F.lit(False))


def error_template(message: Column) -> Column:
    """Message with its variable parts replaced, lower case, single spaces."""
    steps = [
        ("(?i)" + fixed.UUID_PART, "<UUID>"),
        (fixed.IP_PART, "<IP>"),
        (fixed.TIME_PART, "<TS>"),
        ("(?i)" + fixed.HEX_PART, "<HEX>"),
        (fixed.NUMBER_PART, "<ID>"),
        (fixed.QUOTED_PART, '"<STR>"'),
    ]
    out = F.coalesce(message, F.lit(""))
    for pattern, placeholder in steps:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(placeholder))
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))


def template_key(template: Column) -> Column:
    return F.substring(F.md5(template), 1, 16)


def first_keyword_class(text: Column, classes, default: Column) -> Column:
    """Name of the first class with a keyword in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, keywords in classes:
        hit = reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(default)


def error_category(text: Column, default: str | None = "unknown") -> Column:
    return first_keyword_class(text, fixed.ERROR_CATEGORIES, F.lit(default).cast("string"))


def tokens(*texts: Column) -> Column:
    """Distinct lower-cased word tokens of the given texts."""
    joined = F.concat_ws(" ", *texts)
    cleaned = F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}]+", " ")
    return F.array_distinct(F.filter(F.split(cleaned, " "), lambda t: t != ""))


def query_tokens(query: str) -> list[str]:
    """Tokens of a query given by the caller, by the rule of ``tokens``."""
    words = re.sub(r"[^\w]|_", " ", query.lower(), flags=re.UNICODE).split()
    return list(dict.fromkeys(words))


def matches_any(text_tokens: Column, query: str) -> Column:
    words = query_tokens(query)
    return F.arrays_overlap(text_tokens, F.array(*[F.lit(w) for w in words]))


def needed_tokens(n: Column | int, share: float) -> Column:
    """Tokens that must match: the share of the query tokens, rounded down."""
    count = n if isinstance(n, Column) else F.lit(n)
    return F.floor(count * F.lit(share))
