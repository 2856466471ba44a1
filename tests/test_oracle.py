"""Every registered query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from lanternlog.plans.oracle import ORACLE
from lanternlog.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = set()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_failure_incidents(spark, sf, con):
    """Tickets of failed requests, folded in a loop."""
    from lanternlog.plans.oracle import sql

    events = con.sql(sql("select tenant_id, dedup_key, epoch, event_id from fail_keys order by epoch, event_id")).fetchall()
    tickets, current = [], {}
    for tenant, key, epoch, event_id in events:
        t = current.get((tenant, key))
        if t is None or epoch >= t["opened"] + 900:
            current[(tenant, key)] = t = {"opened": epoch, "n": 0, "number": len(tickets) + 1}
            tickets.append(t)
        t["n"] += 1
    got = {r["id"]: r for r in QUERIES["failure_incidents"](spark, sf).collect()}
    assert len(got) == len(tickets)
    for t in tickets:
        row = got[f"TICK-{t['number']:04d}"]
        assert row["similar_count"] == row["n_traces"] == min(t["n"], 5)
