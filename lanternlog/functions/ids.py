"""Deterministic identifiers, so that a rerun writes the same keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lanternlog.functions import fixed


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5, DNS namespace) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(fixed.UUID_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (nibble % 4) + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with offset; microseconds only when there are any."""
    micros = F.unix_micros(ts) % 1000000
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def log_id(trace_id: Column, span_id: Column, ts: Column, content: Column) -> Column:
    """Log id: from trace, span and time; from the row's content when it has no trace."""
    traced = F.concat_ws("|", trace_id, F.coalesce(span_id, F.lit("")), iso_utc(ts))
    return uuid5(F.when(F.coalesce(trace_id, F.lit("")) != "", traced).otherwise(F.sha2(content, 256)))


def store_key(id_: Column, *parts: Column) -> Column:
    """Storage key: the row's id, else a hash of the given parts."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def key_hash(api_key: Column) -> Column:
    return F.sha2(api_key, 256)


def fingerprint(root: Column, category: Column, template: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", root, category, template)), 1, 12)


def dated_name(prefix: str, ts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyy.MM.dd"))


def traceparent(header: Column) -> Column:
    """struct(trace_id, span_id) of a W3C trace context header."""
    parts = F.split(header, "-")
    ok = header.rlike("^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$")
    return F.struct(F.when(ok, parts[1]).alias("trace_id"), F.when(ok, parts[2]).alias("span_id"))
