import random

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import composite as cp, windows as wn
from tests.simulation import simulate

T0 = 1704067200
MESSAGES = [
    ("all fine", [], None),
    ("request timeout", ["timeout"], "timeout"),
    ("out of memory now", ["oom"], "out_of_memory"),
    ("deadlock found", ["db"], "database"),
    ("no space left", ["resource"], "resource_exhausted"),
    ("odd failure", [], None),
]


def make_rows(n, seed, spread):
    random.seed(seed)
    rows, t = [], float(T0)
    for i in range(n):
        t += random.choice(spread)
        message, patterns, category = random.choice(MESSAGES)
        rows.append(
            dict(ts=t, seq=i, tenant=random.choice(["a", "b"]), service=random.choice(["s1", "s2", "s3"]),
                 level=random.choices(["INFO", "WARN", "ERROR", "FATAL"], [6, 1, 3, 0.4])[0], message=message,
                 template=message, patterns=patterns, category=category)
        )
    return rows


def frame(spark, rows):
    data = [(int(r["ts"] * 1e6), r["seq"], r["tenant"], r["service"], r["level"], r["message"]) for r in rows]
    df = spark.createDataFrame(data, "us bigint, log_seq bigint, tenant_id string, service string, level string, message string")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


@pytest.mark.parametrize("seed,spread", [(1, [0, 0.5, 1, 2]), (2, [0, 5, 10, 30, 5]), (3, [10, 10, 10, 20])])
def test_scores_equal_the_row_loop(spark, seed, spread):
    rows = make_rows(700, seed, spread)
    expected = simulate(rows)
    logs = frame(spark, rows)
    emitted = cp.immediate_rows(logs)
    got = {r.log_seq: ("windowed", r.score) for r in cp.windowed_scores(logs, emitted=emitted).select("log_seq", "score").collect()}
    direct = cp.with_signals(logs).join(emitted.select("log_seq"), "log_seq", "left_semi")
    got.update({r.log_seq: ("immediate", r.s) for r in direct.select("log_seq", cp.composite_score().alias("s")).collect()})
    assert {k: v[:2] for k, v in expected.items()} == got
    assert all(0 <= v[1] <= 1 for v in got.values())


def test_event_signals_equal_the_row_loop(spark):
    rows = make_rows(500, 7, [0, 1, 3])
    expected = simulate(rows)
    for r in cp.composite(frame(spark, rows)).select("log_seq", "detection_mode", "signal_weights").collect():
        mode, _, signals = expected[r.log_seq]
        assert r.detection_mode == mode
        assert r.signal_weights == {k: round(v, 3) for k, v in signals.items()}


def test_suppression_ends_after_300_seconds(spark):
    rows = [dict(ts=T0 + d, seq=i, tenant="a", service="s", level="ERROR", message="out of memory") for i, d in enumerate([0, 299, 300, 599, 601])]
    emitted = cp.immediate_rows(frame(spark, rows))
    assert sorted(r.log_seq for r in emitted.collect()) == [0, 2, 4]


def test_spike_of_the_worked_example(spark):
    """Five buckets at ten percent errors, then all errors: z is 2.236."""
    rows, seq = [], 0
    for b in range(5):
        for i in range(20):
            rows.append(dict(ts=T0 + b * 10 + i * 0.4, seq=seq, tenant="a", service="s", level="ERROR" if i < 2 else "INFO", message="m"))
            seq += 1
    for i in range(20):
        rows.append(dict(ts=T0 + 50 + i * 0.4, seq=seq, tenant="a", service="s", level="ERROR", message="m"))
        seq += 1
    stats = wn.with_window_statistics(frame(spark, rows)).where(f"log_seq = {seq - 1}").head()
    assert round(stats.mean_rate, 4) == 0.25
    assert round(stats.std_rate, 4) == 0.3354
    assert round(stats.z_score, 3) == 2.236


def test_constant_failure_without_context(spark):
    """All errors in three buckets: 1.0 x .25 + .7 x .10 from statistics and level."""
    rows = [dict(ts=T0 + b * 10, seq=b, tenant="a", service="s", level="ERROR", message="m") for b in range(3)]
    row = cp.windowed_scores(frame(spark, rows)).head()
    stat = row.score - 0.15 * 0.30  # first occurrence of its template adds a context signal
    assert round(stat, 3) == 0.32
