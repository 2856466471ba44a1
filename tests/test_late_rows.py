"""The side table of late rows, its counts, and the repair of bucket scores."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlog.operators import windows as win
from lanternlog.params import Params
from lanternlog.sources import readers
from lanternlog.sources.logview import log_view
from lanternlog.streaming import late as lt

P = Params(window_seconds=60, bucket_seconds=10)
DELAY = 20


def rounded(df):
    shown = [F.round(c, 8).alias(c) for c in ("current_rate", "mean_rate", "std_rate")]
    return sorted(map(tuple, df.select("tenant_id", "service", "bucket", "total", "errors", "buckets", *shown).collect()))


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The log view in five files; every 17th row comes two files later than its time says."""
    path = str(tmp_path_factory.mktemp("late") / "logs")
    logs = log_view(spark, sf).select("ts", "log_seq", "tenant_id", "service", "level")
    last = logs.agg(F.max("log_seq")).head()[0]
    part = F.least(F.lit(4), F.floor(F.col("log_seq") * 5 / (last + 1)) + F.when(F.col("log_seq") % 17 == 0, 2).otherwise(0))
    dealt = logs.withColumn("part", part)
    for i in range(5):
        dealt.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source takes files in the order of their times
    return path, logs, dealt


def run(spark, parts, tmp_path):
    path, logs, _ = parts
    source = readers.read_table_stream(spark, path, logs.schema, files_per_batch=1)
    lt.start_with_late(source, lt.bucket_sink(f"{tmp_path}/counts", P), f"{tmp_path}/side", f"{tmp_path}/cp", f"{DELAY} seconds").awaitTermination()


def test_late_rows_are_set_aside(spark, parts, tmp_path):
    run(spark, parts, tmp_path)
    expected, newest = set(), None
    rows = parts[2].select("log_seq", "part", F.unix_millis("ts").alias("ms"), "tenant_id", "service").collect()
    for i in range(5):
        mark = None if newest is None else newest - DELAY * 1000
        expected |= {r.log_seq for r in rows if r.part == i and mark is not None and r.ms < mark}
        newest = max([r.ms for r in rows if r.part == i] + ([newest] if newest else []))
    side = spark.read.parquet(f"{tmp_path}/side")
    assert expected and {r.log_seq for r in side.collect()} == expected
    counts = {(r.tenant_id, r.service): r.late for r in lt.late_counts(side).collect()}
    plain = {}
    for r in rows:
        if r.log_seq in expected:
            plain[r.tenant_id, r.service] = plain.get((r.tenant_id, r.service), 0) + 1
    assert counts == plain
    kept = spark.read.parquet(f"{tmp_path}/counts").agg(F.sum("total")).head()[0]
    assert kept == len(rows) - len(expected)


def test_repaired_scores_equal_batch(spark, parts, tmp_path):
    run(spark, parts, tmp_path)
    scores = f"{tmp_path}/scores"
    lt.write_version(win.bucket_scores(lt.merged_buckets(spark.read.parquet(f"{tmp_path}/counts")), P), scores, 0)
    lt.repair(spark, f"{tmp_path}/counts", f"{tmp_path}/side", scores, 1, P)
    want = rounded(win.bucket_scores(win.bucket_rates(parts[1], P), P))
    stored = spark.read.parquet(scores)
    assert rounded(stored.where("version = 0").drop("version")) != want
    assert rounded(lt.newest(stored)) == want
    touched = lt.around(win.bucket_rates(spark.read.parquet(f"{tmp_path}/side"), P), 0, P.window_seconds, P).count()
    assert 0 < stored.where("version = 1").count() <= touched
    lt.repair(spark, f"{tmp_path}/counts", f"{tmp_path}/side", scores, 1, P)  # again, after a stop
    assert rounded(lt.newest(spark.read.parquet(scores))) == want


def test_blocks_and_near_equal_rates(spark):
    """Windows across blocks, and rates that differ by a billionth, against plain sums."""
    rng = random.Random(2)
    rows = []
    for service in ("a", "b"):
        for bucket in sorted(rng.sample(range(0, 12_000, 10), 700)):
            total = 10**9 if service == "b" else rng.randrange(1, 9)
            rows.append(("t", service, bucket, total, total // 2 + rng.randrange(2)))
    table = spark.createDataFrame(rows, "tenant_id string, service string, bucket bigint, total bigint, errors bigint")
    held = {(s, b): e / t for _, s, b, t, e in rows}
    for r in win.bucket_scores(table).collect():
        rates = [held[r.service, b] for b in range(r.bucket - 290, r.bucket + 10, 10) if (r.service, b) in held]
        std = float(np.std(rates))
        assert r.buckets == len(rates)
        assert r.std_rate == pytest.approx(std if std >= 1e-9 else 0, rel=1e-6, abs=1e-15)
        if std >= 1.0001e-9:
            assert r.z_score == pytest.approx((rates[-1] - np.mean(rates)) / std, rel=1e-4, abs=1e-5)
