import json
from datetime import datetime

from pyspark.sql import functions as F

from lanternlog.operators import features, parse as ps, quality, search, tenancy
from lanternlog.sources import readers, writers

T0 = 1704067200


def write(path, text):
    path.write_text(text)
    return str(path)


def maps(df):
    return [r.f for r in df.collect()]


def test_formats_are_found_by_name_and_content(spark, tmp_path):
    cases = {"a.csv": "x", "b.ndjson": "x", "c.jsonl": "x", "d.log": '\n  [{"a":1}]', "e.log": '{"a":1}', "f.log": "plain [x]"}
    found = {n: readers.file_format(spark, write(tmp_path / n, t)) for n, t in cases.items()}
    assert found == {"a.csv": "csv", "b.ndjson": "ndjson", "c.jsonl": "ndjson", "d.log": "json", "e.log": "json", "f.log": "text"}


def test_json_object_and_array(spark, tmp_path):
    one = write(tmp_path / "one.json", json.dumps({"message": "a", "n": 1}, indent=1))
    many = write(tmp_path / "many.json", json.dumps([{"message": "a"}, {"message": "b"}], indent=1))
    assert maps(readers.read_log_files(spark, one)) == [{"message": "a", "n": "1"}]
    assert sorted(m["message"] for m in maps(readers.read_log_files(spark, many))) == ["a", "b"]


def test_ndjson_and_text_skip_blank_lines(spark, tmp_path):
    lines = write(tmp_path / "x.ndjson", '{"message":"a"}\n\n{"message":"b"}\n')
    text = write(tmp_path / "x.txt", "first\n\n  \nsecond\n")
    assert [m["message"] for m in maps(readers.read_log_files(spark, lines))] == ["a", "b"]
    rows = ps.flat_rows(readers.read_log_files(spark, text)).collect()
    assert [(r.message, r.level) for r in rows] == [("first", "INFO"), ("second", "INFO")]


def test_csv_quotes_and_missing_cells(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'message,level,service\n"a, ""b""",warn , s\nshort\n')
    assert maps(readers.read_log_files(spark, path)) == [
        {"message": 'a, "b"', "level": "warn", "service": "s"},
        {"message": "short", "level": "", "service": ""},
    ]


def test_flat_rows_normalise(spark):
    df = spark.createDataFrame([({"message": "", "level": "Critical", "timestamp": "2024-01-01T00:00:01Z", "host": "h", "k": "v"},)], "f map<string,string>")
    r = ps.flat_rows(df).head()
    assert (r.message, r.level, r.service, r.host_name, r.attrs) == ("(no message)", "FATAL", "unknown", "h", {"k": "v"})


def logs(spark, days):
    rows = [(T0 + d * 86400, f"id{i}", "ten", "svc", "INFO", "m", "t", "s") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "sec bigint, log_id string, tenant_id string, service string, level string, message string, trace_id string, span_id string")
    return df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def test_upsert_is_idempotent_and_retention_drops_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    for _ in range(2):
        writers.upsert_daily(writers.with_log_key(logs(spark, [0, 0, 5, 20])), path)
    assert spark.read.parquet(path).count() == 4
    one_day = readers.read_dated(spark, path, F.lit(datetime(2024, 1, 6)), F.lit(datetime(2024, 1, 6)))
    assert one_day.count() == 1
    assert "PartitionFilters: [isnotnull(dt" in one_day._jdf.queryExecution().toString()
    gone = writers.apply_log_retention(spark, path, F.lit(datetime(2024, 1, 12)))
    assert gone == ["2024-01-01"]
    assert spark.read.parquet(path).count() == 2


def test_fallback_key(spark):
    rows = writers.with_log_key(logs(spark, [0]).withColumn("log_id", F.lit(""))).head()
    assert len(rows["_key"]) == 20


def test_archive_range(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(f"v{h}", datetime(2024, 1, 1, h)) for h in range(6)], "value string, timestamp timestamp")
    writers.write_archive(writers.archive_rows(rows, "raw-logs"), path)
    back = readers.read_archive(spark, path, "raw-logs", F.lit(datetime(2024, 1, 1, 2)), F.lit(datetime(2024, 1, 1, 4)))
    assert sorted(r.value for r in back.collect()) == ["v2", "v3", "v4"]


def test_csv_export_quotes(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", you', "high", "open", "s", datetime(2024, 1, 1), datetime(2024, 1, 1))], ", ".join(f"{c} {'timestamp' if c.endswith('_at') else 'string'}" for c in writers.SHORT_EXPORT))
    assert writers.export_lines(df).head().line == '1,"say ""hi"", you",high,open,s,2024-01-01T00:00:00Z,2024-01-01T00:00:00Z'
    assert writers.export_markdown(df).head().line.startswith("| 1 | say")
    writers.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).head()["title"] == 'say "hi", you'


def test_topic_messages_are_json(spark):
    row = writers.topic_messages(logs(spark, [0]), key="service").head()
    assert row.key == "svc" and json.loads(row.value)["log_id"] == "id0"


def test_kafka_options():
    o = readers.kafka_options("t", "b:9092", "earliest", 100)
    assert o["startingOffsets"] == "earliest" and o["maxOffsetsPerTrigger"] == "100"


def test_dimension_from_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d"))
    assert readers.read_dimension(spark, {"path": str(tmp_path / "d")}).count() == 3


def test_features_without_rows_are_stale(spark):
    empty = spark.createDataFrame([], "computed_at timestamp")
    assert features.feature_freshness(empty, F.current_timestamp()).head().stale is True


def test_upload_checks(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"level": "odd"},)], "f map<string,string>")
    row = quality.validate_logs(df).head()
    assert (row.valid, row.missing_required, row.missing_recommended, row.bad_levels) == (False, "message", "service,timestamp", 1)


def test_contract_finds_unknown_columns(spark):
    df = spark.createDataFrame([("e", 2.0)], "event_id string, anomaly_score double").withColumn("extra", F.lit(1))
    broken = {r.rule for r in quality.contract_report(df, quality.ANOMALY_CONTRACT).collect() if r.broken}
    assert {"missing:ts", "range:anomaly_score", "unknown:extra"} <= broken


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    path = str(tmp_path / "t")
    logs(spark, [0, 1]).withColumns({"dt": F.to_date("ts"), "log_seq": F.lit(1)}).write.partitionBy("dt").parquet(path)
    found = search.search_logs(spark.read.parquet(path), tenant="ten", service="svc", start=F.lit(datetime(2024, 1, 2)), fields=["ts", "message"])
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(service,svc)" in plan and "EqualTo(tenant_id,ten)" in plan and "dt" in plan.split("PartitionFilters:")[1][:80]
    assert "span_id" not in plan.split("ReadSchema:")[1]
    assert found.count() == 1


def test_tenant_filter(spark):
    assert tenancy.for_tenant(logs(spark, [0]), "other").count() == 0


def test_costly_rows_are_dealt_to_more_tasks_as_the_table_grows(spark):
    from lanternlog.sources.logview import spread

    for rows in (1000, 4000):
        dealt = spread(spark.range(0, rows, 1, 1), "id", 100)
        assert dealt.rdd.getNumPartitions() == rows // 100 and dealt.count() == rows
    assert spread(spark.range(0, 10, 1, 1), "id", 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
