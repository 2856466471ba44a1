import json
import random

from pyspark.sql import functions as F

from lanternlog.functions import otlp
from lanternlog.operators import parse as ps, tenancy


def raw(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def attr(key, **value):
    return {"key": key, "value": value}


def batch(records, resource):
    return {"resourceLogs": [{"resource": {"attributes": resource}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": records}]}]}


def test_routes(spark):
    rows = raw(
        spark, "{bad", {"a": 1}, batch([], []), {"body": {"stringValue": "x"}}, {"severityText": "WARN"},
        {"log_id": "1", "@timestamp": "2024-01-01T00:00:00Z", "level": "INFO"}, "", "[1]", '"text"',
    )
    got = [r.route for r in ps.with_route(rows).select("route").collect()]
    assert got == [
        "parse_error", "unknown_format", "batch", "record", "record", "canonical", "parse_error",
        "unknown_format", "unknown_format",
    ]


def test_dead_letters_keep_the_original(spark):
    long = "{bad " + "x" * 9000
    rows = {r.reason: r for r in ps.dead_letters(ps.parsed_rows(raw(spark, long, {"a": 1}))).collect()}
    assert rows["parse_error"].original == long
    assert json.loads(rows["unknown_format"].original) == {"a": 1}


def test_batch_fields(spark):
    record = {
        "timeUnixNano": "1704067200123456789", "severityText": "critical", "body": {"stringValue": "boom"},
        "attributes": [attr("http.status_code", intValue=503), attr("level", stringValue="x"), attr("n", doubleValue=1.5),
                       attr("ok", boolValue=True), attr("ids", arrayValue={"values": [{"intValue": "1"}, {"stringValue": 'q"'}]})],
        "traceId": "t1", "spanId": "s1",
    }
    later = {"observedTimeUnixNano": "1704067201000000000", "body": {"kvlistValue": {"values": []}}}
    resource = [attr("service.name", stringValue="svc"), attr("tenant_id", stringValue="ten"),
                attr("deployment.environment", stringValue="prod"), attr("host.name", stringValue="h1"), attr("k8s.pod", stringValue="p")]
    rows = ps.good_rows(ps.parsed_rows(raw(spark, batch([record, later], resource)))).orderBy("ts").collect()
    first, second = rows
    assert (first.level, first.message, first.service, first.tenant_id, first.scope_name) == ("FATAL", "boom", "svc", "ten", "lib")
    assert first.ts.microsecond == 123456
    assert first.level == "FATAL"
    assert first.attrs["http_status_code"] == "503" and first.attrs["n"] == "1.5" and first.attrs["ok"] == "true"
    assert json.loads(first.attrs["ids"]) == [1, 'q"']
    assert "level" not in first.attrs
    assert first.attrs["resource_k8s_pod"] == "p" and first.host_name == "h1"
    assert [r.environment for r in rows] == ["prod", "prod"]
    assert second.message.startswith("{") and second.level == "INFO"
    assert second.observed_ts == second.ts


def test_plain_body_and_defaults(spark):
    rows = ps.good_rows(ps.parsed_rows(raw(spark, {"body": "plain", "timestamp": "2024-01-01T00:00:05Z", "service": "f"}))).collect()
    assert (rows[0].message, rows[0].service, rows[0].tenant_id, rows[0].ts.second) == ("plain", "f", "dev-local", 5)


def test_same_input_same_ids(spark):
    rows = raw(spark, batch([{"body": {"stringValue": "a"}, "timeUnixNano": "1704067200000000000"}], []), {"body": "b", "timeUnixNano": "1704067200000000000"})
    ids = lambda: sorted(r.log_id for r in ps.good_rows(ps.parsed_rows(rows)).collect())
    assert ids() == ids() and len(set(ids())) == 2


def test_count_of_records_is_kept(spark):
    rows = raw(spark, batch([{"body": {"stringValue": str(i)}} for i in range(7)], []), "{bad", {"x": 1})
    parsed = ps.parsed_rows(rows)
    assert parsed.count() == 9 and ps.good_rows(parsed).count() == 7


def test_tenant_injection(spark):
    df = spark.createDataFrame([(json.dumps([attr("tenant_id", stringValue="spoof"), attr("a", stringValue="1")]), "me"), ("[]", "me")], "j string, t string")
    out = df.select(tenancy.inject_tenant(F.from_json("j", otlp.ATTRIBUTES), F.col("t")).alias("a")).collect()
    assert [[(x.key, x.value.stringValue) for x in r.a] for r in out] == [[("a", "1"), ("tenant_id", "me")], [("tenant_id", "me")]]


def test_last_of_equal_keys_counts(spark):
    df = spark.createDataFrame([(json.dumps([attr("k", stringValue="1"), attr("k", intValue=2)]),)], "j string")
    assert df.select(otlp.attribute_map(F.from_json("j", otlp.ATTRIBUTES)).alias("m")).head().m == {"k": "2"}


def wrapped(v):
    if isinstance(v, bool):
        return {"boolValue": v}
    if isinstance(v, int):
        return {"intValue": str(v)}
    if isinstance(v, float):
        return {"doubleValue": v}
    if isinstance(v, str):
        return {"stringValue": v}
    if isinstance(v, list):
        return {"arrayValue": {"values": [wrapped(x) for x in v]}}
    return {"kvlistValue": {"values": [{"key": k, "value": wrapped(x)} for k, x in v.items()]}} if v is not None else {}


def test_nested_values_at_any_depth(spark):
    """Nested attribute values of depth 1 to 12 and odd ones, against a plain recursion's input."""
    rng = random.Random(1)

    def made(depth):
        if depth == 0:
            return rng.choice([1, 2.5, True, False, None, 'a"b', '{"arrayValue":1}', "", "x,y]", "é\n"])
        inner = [made(rng.randrange(depth)) for _ in range(rng.randrange(4))] + [made(depth - 1)]
        return inner if rng.random() < 0.5 else {f'k{i}"': v for i, v in enumerate(inner)}

    values = [made(depth) for depth in range(1, 13) for _ in range(4)] + [[], {}, [[[[]]]], [None, {"": None}]]
    table = spark.createDataFrame([(i, json.dumps(wrapped(v))) for i, v in enumerate(values)], "i int, j string")
    got = table.select("i", otlp.any_value(F.from_json("j", otlp.ANY_VALUE)).alias("text")).collect()
    assert {r.i: json.loads(r.text) for r in got} == dict(enumerate(values))


def test_each_level_of_a_value_is_read_once(spark, capsys):
    """The JSON of a level is read in few places of the plan, not at every use of one of its fields; odd values stay as they were."""
    odd = ['{"arrayValue":"x"}', '{"arrayValue":{}}', '{"kvlistValue":{"values":["a"]}}', '{"stringValue":null}', "5", "null", '{"other":1}']
    table = spark.createDataFrame([('{"values":[%s]}' % ",".join(odd),)], "j string")
    none = F.lit(None).cast("string")
    value = F.struct(none.alias("stringValue"), none.alias("intValue"), none.alias("doubleValue"), none.alias("boolValue"), F.col("j").alias("arrayValue"), none.alias("kvlistValue"))
    shown = table.select(value.alias("v")).select(otlp.any_value(F.col("v")).alias("t"))
    shown.explain(True)
    analyzed = capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]
    assert 0 < analyzed.count("from_json(") <= 15
    assert shown.head().t == "[[],[],{},null,null,null,null]"


def test_good_rows_are_told_without_reading_messages_anew(spark, capsys):
    """No filter of the plan holds the reading of a message; each is read where its records come from."""
    messages = raw(spark, batch([{"body": {"stringValue": "a"}}], []), "{bad", {"x": 1}).withColumn("offset", F.length("value").cast("long"))
    rows = ps.good_rows(ps.parsed_rows(messages))
    rows.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    filters = [line for line in plan.split("\n") if "Filter " in line]
    assert filters and not any("from_json" in line for line in filters)
    assert [r.message for r in rows.collect()] == ["a"]


def test_detectors_run_on_parsed_rows(spark, sf, tmp_path):
    """The README's example: messages in text files, parsed, scored, correlated; also what stateful detectors need."""
    from lanternlog.operators import composite, features, incidents, rule_score, trace
    from lanternlog.sources.logview import log_view

    logs = log_view(spark, sf)
    ps.to_batches(logs, 100, {"http.status_code": F.col("http_status"), "latency_ms": F.col("latency_ms")}).write.text(f"{tmp_path}/raw")
    parsed = ps.parsed_rows(spark.read.text(f"{tmp_path}/raw"))
    ps.scoring_columns(ps.good_rows(parsed)).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.select("log_seq").distinct().count() == logs.count()

    def counted(df, *by):
        return {tuple(r)[:-1]: r[-1] for r in df.groupBy(*by).count().collect()}

    by = ("tenant_id", "service", "anomaly_type", "severity")
    assert counted(rule_score.rule_score(rows), *by) == counted(rule_score.rule_score(logs), *by)
    immediate = ("tenant_id", "service", "detection_mode")
    assert counted(composite.immediate(rows), *immediate) == counted(composite.immediate(logs), *immediate)
    failures = trace.request_failures(rows)
    # which service of a second comes first depends on arrival, which text files do not tell
    assert counted(failures, "tenant_id", "severity") == counted(trace.request_failures(logs), "tenant_id", "severity")
    assert incidents.open_tickets(failures).count() > 0
    feats = features.hourly_features(rows, rule_score.rule_score(rows))
    want = features.hourly_features(logs, rule_score.rule_score(logs))
    assert sorted(map(tuple, feats.collect())) == sorted(map(tuple, want.collect()))


def test_arrival_numbers(spark):
    """Numbers follow offset, partition and place, and are unique."""
    message = json.dumps(batch([{"body": {"stringValue": str(i)}} for i in range(3)], []))
    table = spark.createDataFrame([(message, p, o) for p in (0, 7) for o in (0, 5, 2**33)], "value string, partition int, offset bigint")
    rows = ps.good_rows(ps.parsed_rows(table)).select("log_seq", "message").collect()
    assert len({r.log_seq for r in rows}) == 18 and min(r.log_seq for r in rows) == 0
    assert [r.message for r in sorted(rows)] == ["0", "1", "2"] * 6
