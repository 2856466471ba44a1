import uuid

import pytest
from pyspark.sql import functions as F

from lanternlog.functions import ids, numbers, signals, text


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    df = spark.createDataFrame([tuple(values.values())], names) if values else spark.range(1)
    return df.select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    "message,expected",
    [
        ("Order 550e8400-e29b-41d4-a716-446655440000 failed", "order <uuid> failed"),
        ("Connect 10.0.0.1:8080  at 2024-01-02T03:04:05.678Z", "connect <ip> at <ts>"),
        ("token DEADBEEFDEADBEEF01 bad", "token <hex> bad"),
        ("user=12345 and 99 items #777", "user=<id> and 99 items #777"),
        ('said "this is a rather long quote indeed" ok', 'said "<str>" ok'),
        ("  Mixed\tCase \n text ", "mixed case text"),
        ("code 4030/12345", "code <id>/<id>"),
    ],
)
def test_error_template(spark, message, expected):
    assert one(spark, text.error_template(F.col("m")), m=message) == expected


@pytest.mark.parametrize(
    "message,expected",
    [
        ("Read TIMEOUT on socket", "timeout"),
        ("code 4030", "authentication"),
        ("invalid token", "authentication"),
        ("invalid input", "validation"),
        ("SQL syntax", "database"),
        ("disk full", "resource_exhausted"),
        ("all fine", "unknown"),
    ],
)
def test_error_category(spark, message, expected):
    assert one(spark, text.error_category(F.col("m")), m=message) == expected


@pytest.mark.parametrize(
    "level,expected",
    [("critical", "FATAL"), ("Warning", "WARN"), ("", "INFO"), (None, "INFO"), ("alert", "FATAL"), ("debug", "DEBUG")],
)
def test_level(spark, level, expected):
    assert one(spark, text.normalize_level(F.col("m")), m=level) == expected


def test_uuid5_matches_the_standard(spark):
    for name in ("a|b|2024-01-01T00:00:00+00:00", "", "ü|x"):
        assert one(spark, ids.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_traceparent(spark):
    good = one(spark, ids.traceparent(F.col("h")), h="00-" + "a" * 32 + "-" + "b" * 16 + "-01")
    assert (good["trace_id"], good["span_id"]) == ("a" * 32, "b" * 16)
    assert one(spark, ids.traceparent(F.col("h")), h="nope")["trace_id"] is None


def test_iso_keeps_microseconds_only_when_there_are_any(spark):
    row = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:00.000123' b")
    got = row.select(ids.iso_utc(F.col("a")).alias("a"), ids.iso_utc(F.col("b")).alias("b")).head()
    assert got["a"] == "2024-01-01T00:00:00+00:00"
    assert got["b"] == "2024-01-01T00:00:00.000123+00:00"


def test_rounding_equals_python(spark):
    values = [i / 1000 for i in range(0, 2001)] + [-0.125, -2.675, 2.5, 3.5, 0.0005, 12345.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", numbers.round_exact(F.col("v"), 2).alias("r"), numbers.round_exact(F.col("v"), 0).alias("r0")).collect()
    assert all(r["r"] == round(r["v"], 2) for r in rows)
    assert all(r["r0"] == round(r["v"]) for r in rows)


def test_http_and_stack(spark):
    for code, weight in (("503", 0.9), ("502", 0.8), ("504", 0.85), ("599", 0.7), ("429", 0.5), ("401", 0.4)):
        assert one(spark, signals.http_signal(F.col("c")), c=code)["weight"] == weight
    assert one(spark, signals.http_signal(F.col("c")), c="abc") is None
    assert one(spark, signals.http_signal(F.col("c")), c="404") is None
    for frames, weight in ((16, 0.3), (6, 0.15), (2, 0.05), (1, None)):
        assert one(spark, signals.stack_weight(F.col("s")), s="x" + "\n\tat a.b" * frames) == weight


def test_out_of_memory_scores_the_floor(spark):
    df = spark.createDataFrame([("ERROR", "java.lang.OutOfMemoryError")], "level string, message string")
    row = signals.with_signals(df).select(signals.composite_score().alias("s"), "immediate", "sig_pattern").head()
    assert (row["s"], row["immediate"], row["sig_pattern"]) == (0.65, True, "oom")


def test_word_bound_patterns(spark):
    df = spark.createDataFrame([("ERROR", "room 1502ms")], "level string, message string")
    assert signals.with_signals(df).head()["sig_pattern"] == "oom"
    assert signals.with_signals(df, word_bound=True).head()["sig_pattern"] is None


def test_zscore_label(spark):
    df = spark.createDataFrame([(4.0,), (3.2,), (2.5,), (1.0,)], "z double")
    got = [r["l"]["severity"] for r in df.select(signals.zscore_label(F.col("z")).alias("l")).collect()]
    assert got == ["critical", "high", "medium", "low"]
