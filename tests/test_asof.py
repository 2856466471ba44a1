"""The as-of join against a plain look-up, and a replay that does not see the future."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import features as ft
from lanternlog.operators.asof import asof
from lanternlog.sources import readers
from lanternlog.streaming import pipelines as pl

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return None if seconds is None else BASE + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("block_seconds", [1, 10, 50_000])
def test_asof(spark, block_seconds):
    rng = random.Random(block_seconds)
    times = [*range(0, 400_000, 997), *range(100, 200)]
    keys = ["a", "b", "c", None]
    left = [(i, rng.choice(keys), rng.choice([None, *times])) for i in range(400)]
    right = [(rng.choice(["a", "b", None, "d"]), rng.choice([None, *times]), rng.randrange(50), rng.choice([None, "x", "y"])) for _ in range(90)]
    right += right[:10]
    lefts = spark.createDataFrame([(i, k, at(s), "own") for i, k, s in left], "id int, k string, t timestamp, v string")
    rights = spark.createDataFrame([(k, at(s), v, w) for k, s, v, w in right], "k string, ts timestamp, v int, w string")
    got = {r.id: r for r in asof(lefts, rights, ["k"], "t", "ts", ["v", "w"], "found", block_seconds).collect()}
    assert len(got) == len(left)
    for i, k, s in left:
        held = [(ts, v, w is not None, w or "") for kk, ts, v, w in right if kk == k and ts is not None and s is not None and ts <= s]
        best = max(held, default=None)
        want = None if best is None else (best[1], best[3] if best[2] else None)
        assert got[i].found == want and got[i].v == "own"


def test_empty_sides(spark):
    left = spark.createDataFrame([], "k string, t timestamp")
    right = spark.createDataFrame([], "k string, ts timestamp, v int")
    assert asof(left, right, ["k"], "t", "ts", ["v"], "found").count() == 0
    one = spark.createDataFrame([("a", at(5))], "k string, t timestamp")
    assert asof(one, right, ["k"], "t", "ts", ["v"], "found").head().found is None


def test_replay_does_not_see_the_future(spark, tmp_path):
    logs = spark.createDataFrame([(i, at(i * 100), "t", "s") for i in range(40)], "log_seq int, ts timestamp, tenant_id string, service string")
    logs.write.parquet(f"{tmp_path}/logs")
    history = [("t", "s", at(h * 1000), at((h + 1) * 1000), h / 10, 1.0, 2.0, h) for h in range(4)]
    schema = "tenant_id string, service string, hour timestamp, computed_at timestamp, error_rate_1h double, p99_latency_1h double, request_rate_1h double, anomaly_history_count int"
    spark.createDataFrame(history, schema).write.parquet(f"{tmp_path}/features")
    stream = readers.read_table_stream(spark, f"{tmp_path}/logs", logs.schema)

    def sink(df, batch_id):
        df.select("log_seq", "ml_features.*").write.parquet(f"{tmp_path}/out/batch={batch_id}")

    pl.enrich_each(stream, f"{tmp_path}/features", sink, f"{tmp_path}/cp", None, replay=True).awaitTermination()
    got = {r.log_seq: (r.anomaly_history_count, r._source) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: (max(0, i // 10 - 1), "default" if i < 10 else None) for i in range(40)}
    assert ft.enrich(logs, spark.read.parquet(f"{tmp_path}/features")).where(F.col("ml_features.anomaly_history_count") == 3).count() == 40
