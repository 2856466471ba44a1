"""Signals of one log row and their combination to a score.

A row's signals are plain columns (``sig_pattern``, ``sig_pattern_w``, ...)
while rows are filtered and scored; the signal map is built for emitted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.numbers import round_exact
from lanternlog.functions.text import error_category, is_error


def optional(df: DataFrame, name: str, type_: str = "string") -> Column:
    """Column of that name, or null when the table does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def ladder(value: Column, steps, default=None) -> Column:
    """First label whose lower bound the value reaches (bounds descend)."""
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, F.lit(label)) if out is None else out.when(value >= bound, F.lit(label))
    return out.otherwise(F.lit(default))


def severity_weight(level: Column) -> Column:
    up = F.upper(level)
    out = None
    for name, weight in fixed.SEVERITY_WEIGHTS.items():
        hit = up == name
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return out


def pattern_regex(regex: str, word_bound: bool) -> str:
    return rf"(?i)\b(?:{regex})\b" if word_bound else f"(?i){regex}"


def top_pattern(text: Column, word_bound: bool = False) -> Column:
    """struct(name, weight) of the text's strongest pattern (the list is ordered by weight)."""
    out = None
    for name, regex, weight in fixed.PATTERNS:
        hit = text.rlike(pattern_regex(regex, word_bound))
        value = F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_immediate(text: Column, level: Column, word_bound: bool = False) -> Column:
    """A pattern of a dying process, or a fatal row with any stronger pattern."""
    dying = "|".join(r for n, r, _ in fixed.PATTERNS if n in fixed.IMMEDIATE_PATTERNS)
    strong = "|".join(r for _, r, w in fixed.PATTERNS if w >= 0.50)
    fatal = [n for n, w in fixed.SEVERITY_WEIGHTS.items() if w >= 0.95]
    return text.rlike(pattern_regex(dying, word_bound)) | (
        F.coalesce(F.upper(level).isin(fatal), F.lit(False)) & text.rlike(pattern_regex(strong, word_bound))
    )


def http_signal(status: Column) -> Column:
    """struct(name, weight) of an HTTP status, null when it signals nothing."""
    code = status.try_cast("int")

    def sig(name, weight):
        return F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))

    out = None
    for value, name, weight in fixed.HTTP_SIGNALS:
        hit = code == value
        out = F.when(hit, sig(name, weight)) if out is None else out.when(hit, sig(name, weight))
    out = out.when(code >= 500, sig(*fixed.HTTP_SERVER_ERROR))
    out = out.when(code == fixed.HTTP_RATE_LIMIT[0], sig(*fixed.HTTP_RATE_LIMIT[1:]))
    return out.when(code.isin(fixed.HTTP_AUTH[0]), sig(*fixed.HTTP_AUTH[1:]))


def frame_count(stack: Column) -> Column:
    """Stack frames of four language styles, counted by their markers."""
    text = F.coalesce(stack, F.lit(""))
    total = F.lit(0)
    for marker in fixed.FRAME_MARKERS:
        total = total + F.regexp_count(text, F.lit(marker))
    return total


def stack_weight(stack: Column) -> Column:
    return ladder(frame_count(stack), fixed.FRAME_WEIGHTS)


def combined_text(logs: DataFrame) -> Column:
    """Text the patterns are searched in: exception type and message, then the message."""
    parts = [optional(logs, "exception_type"), optional(logs, "exception_message"), F.col("message")]
    return F.concat_ws(" ", *[F.coalesce(part, F.lit("")) for part in parts])


def with_signals(logs: DataFrame, word_bound: bool = False) -> DataFrame:
    """Add the signal columns of every row."""
    rows = logs.withColumn("combined_text", combined_text(logs)).withColumns(
        {
            "is_error": is_error(F.col("level")),
            "sig_severity_w": severity_weight(F.col("level")),
            "sig_top": top_pattern(F.col("combined_text"), word_bound),
            "sig_http_top": http_signal(optional(logs, "http_status")),
            "sig_stack_w": stack_weight(optional(logs, "exception_stacktrace")),
            "sig_category": F.when(is_error(F.col("level")), error_category(F.col("combined_text"), None)),
            "immediate": is_immediate(F.col("combined_text"), F.col("level"), word_bound),
        }
    )
    return rows.withColumns(
        {
            "sig_pattern": F.col("sig_top.name"),
            "sig_pattern_w": F.col("sig_top.weight"),
            "sig_http": F.col("sig_http_top.name"),
            "sig_http_w": F.col("sig_http_top.weight"),
        }
    ).drop("sig_top", "sig_http_top")


def structural_weight() -> Column:
    return F.greatest(
        F.col("sig_stack_w"),
        F.when(F.col("sig_category").isNotNull(), F.lit(fixed.CATEGORY_SIGNAL)),
    )


def composite_score(statistical: Column | None = None, context: Column | None = None, floor: float = 0.65) -> Column:
    """Weighted sum of the strongest signal per category, at most 1.

    Rows with a pattern that is reported at once never score below ``floor``.
    """
    parts = {
        "pattern": F.col("sig_pattern_w"),
        "statistical": statistical,
        "context": context,
        "http": F.col("sig_http_w"),
        "severity": F.col("sig_severity_w"),
        "structural": structural_weight(),
    }
    total = F.lit(0.0)
    for name, weight in fixed.CATEGORY_WEIGHTS.items():
        if parts[name] is not None:
            total = total + F.coalesce(parts[name], F.lit(0.0)) * F.lit(weight)
    urgent = F.coalesce(F.col("sig_pattern").isin(fixed.IMMEDIATE_PATTERNS), F.lit(False))
    return F.greatest(F.least(round_exact(total, 3), F.lit(1.0)), F.when(urgent, F.lit(floor)).otherwise(0.0))


def composite_severity(score: Column) -> Column:
    return ladder(score, fixed.COMPOSITE_SEVERITY, "low")


def zscore_label(z: Column) -> Column:
    """struct(severity, confidence) of a z-score."""
    severity = ladder(z, [(b, s) for b, s, _ in fixed.ZSCORE_LABELS], "low")
    confidence = ladder(z, [(b, c) for b, _, c in fixed.ZSCORE_LABELS], 0.70)
    return F.struct(severity.alias("severity"), confidence.alias("confidence"))


def signal_list(extra: dict[str, Column] | None = None, word_bound: bool = False) -> Column:
    """All signals of a row as array<struct<name,weight>>, in a fixed order.

    ``extra`` adds windowed signals: name -> weight (null when absent).
    """

    def entry(name: Column, weight: Column) -> Column:
        return F.when(
            name.isNotNull() & weight.isNotNull(), F.struct(name.alias("name"), weight.cast("double").alias("weight"))
        )

    entries = [entry(F.lit("severity"), F.col("sig_severity_w"))]
    for name, regex, weight in fixed.PATTERNS:
        hit = F.col("combined_text").rlike(pattern_regex(regex, word_bound))
        entries.append(entry(F.lit(f"pattern:{name}"), F.when(hit, F.lit(weight))))
    entries.append(entry(F.col("sig_http"), F.col("sig_http_w")))
    entries.append(entry(F.lit("structural:stacktrace"), F.col("sig_stack_w")))
    entries.append(
        entry(F.concat(F.lit("structural:category:"), F.col("sig_category")), F.lit(fixed.CATEGORY_SIGNAL))
    )
    for name, weight in (extra or {}).items():
        entries.append(entry(F.lit(name), weight))
    return F.array_compact(F.array(*entries))


def signal_map(signals: Column, digits: int = 3) -> Column:
    return F.map_from_entries(
        F.transform(signals, lambda s: F.struct(s["name"], round_exact(s["weight"], digits)))
    )


def top_signals(signals: Column, n: int = 3) -> Column:
    """The n strongest signals as text; equal weights keep their order."""
    ranked = F.array_sort(
        F.transform(
            signals,
            lambda s, i: F.struct((-s["weight"]).alias("neg"), i.alias("pos"), s["name"].alias("name")),
        )
    )
    return F.array_join(
        F.transform(F.slice(ranked, 1, n), lambda s: F.format_string("%s=%.2f", s["name"], -s["neg"])), ", "
    )
