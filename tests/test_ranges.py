"""Counts around incidents by running sums, against plain counting."""

import datetime as dt
import random

import pytest

from lanternlog.operators import incidents as inc

BASE = dt.datetime(2024, 1, 1, 23, 50, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(6)
    logs = []
    for seq in range(900):
        service = rng.choice(("a", "a", "a", "b"))
        level = rng.choice(("INFO", "ERROR", "fatal", "WARN"))
        logs.append((seq, "t", service, rng.randrange(3000), level, f"m{seq}", rng.choice((None, "", *[f"x{i}" for i in range(12)]))))
    asked = [(f"i{k}", "t", rng.choice(("a", "b", "c")), rng.randrange(-500, 3600)) for k in range(60)]
    rows = spark.createDataFrame([(s, t, v, BASE + dt.timedelta(seconds=e), lv, m, x) for s, t, v, e, lv, m, x in logs], "log_seq int, tenant_id string, service string, ts timestamp, level string, message string, trace_id string")
    found = spark.createDataFrame([(i, t, v, BASE + dt.timedelta(seconds=e)) for i, t, v, e in asked], "id string, tenant_id string, service string, created_at timestamp")
    return logs, asked, rows, found


@pytest.mark.parametrize("minutes", [1, 10])
def test_context_and_traces(made, minutes):
    logs, asked, rows, found = made
    width = minutes * 60
    context, traces = {}, {}
    for id_, _, service, at in asked:
        near = [r for r in logs if r[2] == service and abs(r[3] - at) <= width]
        errors = sorted((r for r in near if r[4].upper() in ("ERROR", "FATAL", "CRITICAL")), key=lambda r: (r[3], r[0]))
        if near:
            context[id_] = (len(near), len(errors), errors[0][5] if errors else None)
        names = {r[6] for r in errors if r[6]}
        if names:
            traces[id_] = len(names)
    got = inc.incident_context(found, rows, minutes).collect()
    assert {r.id: (r.n_logs, r.n_errors, r.first_error_message) for r in got} == context
    assert {r.id: r.n_traces for r in inc.correlated_trace_counts(found, rows, minutes).collect()} == traces
    listed = {}
    for r in inc.correlated_traces(found, rows, minutes).collect():
        listed[r.id] = listed.get(r.id, 0) + 1
    assert listed == traces
