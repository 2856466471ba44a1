"""Applied batches and packed files of daily tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import incidents as inc
from lanternlog.sources import store

AT = datetime(2024, 1, 1)


@pytest.fixture
def incidents(spark, tmp_path):
    rows = [(f"I{n}", "identified", AT + timedelta(days=n % 4)) for n in range(20)]
    df = spark.createDataFrame(rows, "id string, state string, created_at timestamp")
    df = df.withColumns({c: F.lit(None).cast("timestamp") for c in ("acknowledged_at", "mitigated_at", "resolved_at")})
    entry = inc.timeline_entry(F.col("created_at"), "state_change", F.lit("identified"), F.lit("m"), F.lit("system"))
    df = df.withColumns({"updated_at": F.col("created_at"), "timeline": F.array(entry), "applied": F.array().cast("array<string>"), "dt": F.to_date("created_at")})
    df.write.partitionBy("dt").parquet(f"{tmp_path}/incidents")
    return f"{tmp_path}/incidents", f"{tmp_path}/audit"


def requests(spark, *rows):
    return spark.createDataFrame([(*r[:-1], AT + timedelta(minutes=r[-1])) for r in rows], "batch_id string, pos int, id string, action string, at timestamp")


BATCH = [("b1", 0, "I1", "acknowledge", 1), ("b1", 1, "I1", "resolve", 2), ("b1", 2, "I5", "explode", 3), ("b1", 3, "X9", "resolve", 3), ("b1", 4, "I6", "investigate", 4)]


def state(spark, paths):
    stored = spark.read.parquet(paths[0]).select("id", "state", F.size("timeline"), "applied").where("size(applied) > 0")
    audit = spark.read.parquet(paths[1]).select("audit_id", "incident_id", "details", "actor")
    return sorted(map(str, stored.collect())), sorted(map(str, audit.collect())), spark.read.parquet(paths[0]).count()


def files(spark, path):
    return {r.file: r.dt for r in store.file_sizes(spark, path).collect()}


def test_apply_batch(spark, incidents):
    before = files(spark, incidents[0])
    results = store.apply_batch(spark, *incidents, requests(spark, *BATCH)).collect()
    assert {(r.pos, r.ok, r.result) for r in results} == {
        (0, True, "acknowledged"), (1, True, "resolved"), (2, False, "invalid state: explode"), (3, False, "not found"), (4, True, "investigating"),
    }
    rows = {r.id: r for r in spark.read.parquet(incidents[0]).collect()}
    assert len(rows) == 20 and (rows["I1"].state, len(rows["I1"].timeline), rows["I6"].state) == ("resolved", 3, "investigating")
    audit = {(r.incident_id, r.details["from"], r.details["to"]) for r in spark.read.parquet(incidents[1]).collect()}
    assert audit == {("I1", "identified", "acknowledged"), ("I1", "acknowledged", "resolved"), ("I6", "identified", "investigating")}
    after = files(spark, incidents[0])
    quiet = {f for f, dt in before.items() if str(dt) not in ("2024-01-02", "2024-01-03")}
    assert quiet and quiet <= set(after)


def test_batch_that_comes_again(spark, incidents):
    first = sorted(map(str, store.apply_batch(spark, *incidents, requests(spark, *BATCH)).collect()))
    once = state(spark, incidents)
    assert sorted(map(str, store.apply_batch(spark, *incidents, requests(spark, *BATCH)).collect())) == first
    assert state(spark, incidents) == once
    store.apply_batch(spark, *incidents, requests(spark, ("b2", 0, "I1", "mitigate", 9)))
    row = spark.read.parquet(incidents[0]).where("id = 'I1'").head()
    assert (row.state, row.applied, len(row.timeline)) == ("mitigated", ["b1", "b2"], 4)


def test_stop_between_the_writes(spark, incidents, monkeypatch):
    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(store, "replace_days", stop)
        with pytest.raises(RuntimeError):
            store.apply_batch(spark, *incidents, requests(spark, *BATCH))
    assert spark.read.parquet(incidents[1]).count() == 3
    store.apply_batch(spark, *incidents, requests(spark, *BATCH))
    stopped = state(spark, incidents)
    assert len(stopped[1]) == 3 and len(stopped[0]) == 2 and stopped[2] == 20


def test_compact_days(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("dt"))
    rows.where("id % 3 < 2").repartition(8).write.partitionBy("dt").parquet(path)
    rows.where("id % 3 = 2").coalesce(1).write.mode("append").partitionBy("dt").parquet(path)
    before = files(spark, path)
    target = 30_000
    packed = store.compact_days(spark, path, "id", target)
    assert [str(d) for d in packed] == ["2024-01-01", "2024-01-02"] or len(packed) == 3
    read = store.file_sizes(spark, path).collect()
    assert spark.read.parquet(path).agg(F.count("id"), F.sum("id")).head() == (3000, 3000 * 2999 // 2)
    assert max(r.bytes for r in read) <= 2 * target
    assert len(read) < len(before)
    assert len(store.compact_days(spark, path, "id", 10**9)) <= 3
    left = store.file_sizes(spark, path).collect()
    assert len(left) == 3 and store.compact_days(spark, path, "id", 10**9) == []


def test_untouched_days_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.range(200).select("id", F.when(F.col("id") < 100, "2024-01-01").otherwise("2024-01-02").cast("date").alias("dt"))
    rows.where("id < 100").coalesce(1).write.partitionBy("dt").parquet(path)
    rows.where("id >= 100").repartition(5).write.mode("append").partitionBy("dt").parquet(path)
    kept = {f for f, dt in files(spark, path).items() if str(dt) == "2024-01-01"}
    assert [str(d) for d in store.compact_days(spark, path, "id")] == ["2024-01-02"]
    assert kept <= set(files(spark, path)) and len(files(spark, path)) == 2
    assert spark.read.parquet(path).count() == 200
