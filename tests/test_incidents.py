import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lanternlog.functions.text import query_tokens
from lanternlog.operators import incidents as inc, lifecycle as lc, reports
from lanternlog.operators.rule_score import rule_score

T0 = 1704067200


def events(spark, minutes, score=0.9):
    rows = [(T0 + int(m * 60), f"{i:032x}", i, "ten", "svc", "error_rate_spike", "high", score, "text") for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "sec bigint, event_id string, log_seq bigint, tenant_id string, service string, anomaly_type string, severity string, anomaly_score double, description string")
    return df.withColumns({"ts": F.timestamp_seconds("sec"), "affected_services": F.array("service")}).drop("sec")


def test_ticket_opens_groups_drops_and_opens_again(spark):
    rows = inc.open_tickets(events(spark, [0, 1, 2, 3, 4, 5, 16])).orderBy("number").collect()
    assert [(r.id, r.grouped, r.dropped) for r in rows] == [("TICK-0001", 4, 1), ("TICK-0002", 0, 0)]


def test_events_below_the_score_open_nothing(spark):
    assert inc.open_tickets(events(spark, [0, 1], score=0.49)).count() == 0


def test_window_is_counted_from_the_opening(spark):
    rows = inc.open_tickets(events(spark, [0, 10, 14.9, 15, 29.9, 30]))
    assert sorted((r.open_sec - T0) // 60 for r in rows.collect()) == [0, 15, 30]


def store(spark, n, seed=1):
    random.seed(seed)
    words = ["timeout", "payment", "database", "disk", "memory", "gateway", "auth", "cache"]
    rows = [
        (f"I{i:04d}", random.choice("ab"), random.choice(["s1", "s2"]), random.choice(["identified", "investigating", "mitigated", "resolved"]),
         " ".join(random.sample(words, 3)), " ".join(random.sample(words, 4)), T0 + random.randrange(7200))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id string, tenant_id string, service string, state string, title string, description string, sec bigint")
    return rows, df.withColumns({"created_at": F.timestamp_seconds("sec"), "root_cause": F.lit(None).cast("string")})


def test_recent_duplicates_equal_brute_force(spark):
    held, df = store(spark, 150)
    asked, _ = store(spark, 150, seed=2)
    ev = spark.createDataFrame([(f"E{r[0]}", r[1], r[2], r[6], r[4] + " " + r[5]) for r in asked], "event_id string, tenant_id string, service string, sec bigint, text string").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.event_id: r.incident_id for r in inc.recent_duplicates(ev, df).collect()}
    expected = {}
    for r in asked:
        q = set(query_tokens(r[4] + " " + r[5]))
        need = max(int(len(q) * 0.6), 1)
        fits = [
            (h[6], h[0]) for h in held
            if h[1:3] == r[1:3] and h[3] in ("identified", "investigating") and r[6] - 900 <= h[6] <= r[6]
            and (len(q & set(h[4].split())) >= need or len(q & set(h[5].split())) >= need)
        ]
        if fits:
            expected[f"E{r[0]}"] = max(fits)[1]
    assert got == expected and expected


def test_an_incident_is_offered_once_to_event_texts_that_match_alike(spark, monkeypatch):
    """Twenty event texts that repeat the same incidents look them up as one, however many words of their own incidents have."""
    at = datetime(2024, 1, 1)
    held = [(f"I{i:02d}", "t", "s", "identified", "no words in common", f"connection refused to host order {1000 + i}", at + timedelta(seconds=i)) for i in range(30)]
    stored = spark.createDataFrame(held, "id string, tenant_id string, service string, state string, title string, description string, created_at timestamp")
    rows = [(f"E{i:02d}", "t", "s", at + timedelta(seconds=i + 5), f"connection refused to host u{i}") for i in range(20)]
    ev = spark.createDataFrame(rows, "event_id string, tenant_id string, service string, ts timestamp, text string")
    offered = []

    def counted(left, right, *rest):
        offered.append(right.count())
        return asof(left, right, *rest)

    asof = inc.asof
    monkeypatch.setattr(inc, "asof", counted)
    got = {r.event_id: r.incident_id for r in inc.recent_duplicates(ev, stored).collect()}
    assert got == {f"E{i:02d}": f"I{i + 5:02d}" for i in range(20)}
    assert offered == [30]


def texts_with_own_words(n, seed):
    random.seed(seed)
    words = ["refused", "host", "disk", "gate"]
    return [(" ".join(random.sample(words, 2) + [f"u{random.randrange(12)}" for _ in range(random.randrange(3))]), T0 + random.randrange(3600)) for _ in range(n)]


@pytest.mark.parametrize("room", [0, 1, 10**9])
def test_recent_duplicates_are_the_same_however_words_are_split(spark, monkeypatch, room):
    """All words in cores, some listed as rare, all of them rare; an event row that comes twice is answered twice."""
    monkeypatch.setattr(inc, "PAIRS_A_WORD", room)
    held = [(f"I{i:03d}", "t", "s", "identified", "no title" if i % 2 else text, text if i % 2 else "", sec) for i, (text, sec) in enumerate(texts_with_own_words(120, 1))]
    asked = [(f"E{i:03d}", "t", "s", sec, text) for i, (text, sec) in enumerate(texts_with_own_words(80, 2))]
    stored = spark.createDataFrame(held, "id string, tenant_id string, service string, state string, title string, description string, sec bigint").withColumn("created_at", F.timestamp_seconds("sec"))
    ev = spark.createDataFrame(asked + asked[:20], "event_id string, tenant_id string, service string, sec bigint, text string").withColumn("ts", F.timestamp_seconds("sec"))
    expected = []
    for r in asked + asked[:20]:
        q = set(r[4].split())
        fits = [(h[6], h[0]) for h in held if r[3] - 900 <= h[6] <= r[3] and max(len(q & set(h[4].split())), len(q & set(h[5].split()))) >= max(int(len(q) * 0.6), 1)]
        expected += [(r[0], max(fits)[1])] if fits else []
    assert sorted((r.event_id, r.incident_id) for r in inc.recent_duplicates(ev, stored).collect()) == sorted(expected)
    assert 40 < len(expected) < 100


def test_texts_with_a_word_of_their_own_are_not_paired_one_by_one(spark, monkeypatch):
    """Forty hosts in event texts and in incidents: what matches by the words around the host is one pair, not 1,600."""
    at = datetime(2024, 1, 1)
    held = [(f"I{i:02d}", "t", "s", "identified", "title", f"connection refused to host u{i} port of order", at + timedelta(seconds=i)) for i in range(40)]
    stored = spark.createDataFrame(held, "id string, tenant_id string, service string, state string, title string, description string, created_at timestamp")
    rows = [(f"E{i:02d}", "t", "s", at + timedelta(seconds=40 + i), f"connection refused to host u{i} port of order") for i in range(40)]
    ev = spark.createDataFrame(rows, "event_id string, tenant_id string, service string, ts timestamp, text string")
    pairs = []

    def counted(df, name="step"):
        df = cut_lineage(df, name)
        if name == "text-pairs":
            pairs.append(df.count())
        return df

    cut_lineage = inc.cut_lineage
    monkeypatch.setattr(inc, "cut_lineage", counted)
    got = {r.event_id: r.incident_id for r in inc.recent_duplicates(ev, stored).collect()}
    assert got == {f"E{i:02d}": "I39" for i in range(40)}
    assert pairs == [1]


def test_a_rule_tries_its_patterns_once_on_a_row(spark):
    logs = spark.createDataFrame([(datetime(2024, 1, 1), 1, "t", "s", "ERROR", "heap space")], "ts timestamp, log_seq bigint, tenant_id string, service string, level string, message string")
    plan = rule_score(logs).select("anomaly_type", "anomaly_score", "severity", "detection_mode")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|heap space|") == 1


def test_similar_resolved_equal_brute_force(spark):
    held, df = store(spark, 120)
    asked = df.select(F.col("id").alias("ask_id"), "tenant_id", "service", F.col("title").alias("text"))
    got = {}
    for r in inc.similar_resolved(asked, df).orderBy("rank").collect():
        got.setdefault(r.ask_id, []).append(r.similar_id)
    for a in held:
        fits = [
            (h[6], h[0]) for h in held
            if h[0] != a[0] and h[1:3] == a[1:3] and h[3] in ("mitigated", "resolved") and set(a[4].split()) & set((h[4] + " " + h[5]).split())
        ]
        assert got.get(a[0], []) == [i for _, i in sorted(fits, reverse=True)[:3]]


def test_similar_resolved_takes_a_common_word_in_parts(spark, monkeypatch):
    """Tasks follow the number of asked words, a word of all rows is joined in parts, and the answers stay the same."""
    at = datetime(2024, 1, 1)
    rows = [(f"I{i:03d}", "t", "s", "resolved" if i % 2 else "identified", "disk", f"disk full n{i}", at + timedelta(seconds=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, tenant_id string, service string, state string, title string, description string, created_at timestamp")
    df = df.withColumn("root_cause", F.lit(None).cast("string"))
    asked = df.select(F.col("id").alias("ask_id"), "tenant_id", "service", F.col("description").alias("text"))
    monkeypatch.setattr(inc, "WORD_ROWS", 7)
    monkeypatch.setattr(inc, "WORDS_A_TASK", 10)
    got = inc.similar_resolved(asked, df)
    assert got.rdd.getNumPartitions() == 18
    newest = ["I059", "I057", "I055", "I053"]
    answers = {}
    for r in got.orderBy("rank").collect():
        answers.setdefault(r.ask_id, []).append(r.similar_id)
    assert answers == {r[0]: [i for i in newest if i != r[0]][:3] for r in rows}


def test_priority_matrix(spark):
    df = spark.createDataFrame([("critical", "medium"), ("high", "low"), ("low", "low"), ("odd", "high")], "s string, u string")
    assert [r.p for r in df.select(inc.priority(F.col("s"), F.col("u")).alias("p")).collect()] == ["P1", "P3", "P5", "P3"]


def incident_table(spark, minutes):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("R%d" % i, "svc", "high", "resolved", at, at + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "id string, service string, severity string, state string, created_at timestamp, resolved_at timestamp")
    return df.withColumns({"acknowledged_at": F.lit(None).cast("timestamp"), "mitigated_at": F.lit(None).cast("timestamp")})


def test_time_to_resolve_statistics(spark):
    for n, median, p95 in ((4, 3.0, 4.0), (5, 3.0, 5.0), (1, 1.0, 1.0)):
        row = reports.time_to(incident_table(spark, range(1, n + 1))).head()
        assert (row.metric, row.median_minutes, row.p95_minutes, row.sample_size) == ("mttr", median, p95, n)
    assert reports.time_to(incident_table(spark, [-5])).head().max_minutes == 0.0


def test_transitions_keep_first_stamps(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", "identified", at, at)], "id string, state string, created_at timestamp, updated_at timestamp")
    df = df.withColumns({c: F.lit(None).cast("timestamp") for c in ("acknowledged_at", "mitigated_at", "resolved_at")})
    df = df.withColumn("timeline", F.array(inc.timeline_entry(F.col("created_at"), "state_change", F.lit("identified"), F.lit("m"), F.lit("system"))))
    req = spark.createDataFrame(
        [("A", a, at + timedelta(minutes=m)) for a, m in (("acknowledge", 1), ("acknowledge", 2), ("resolve", 3), ("bogus", 4), ("resolve", 5))] + [("B", "resolve", at)],
        "id string, action string, at timestamp",
    )
    row = lc.apply_transitions(df, req).head()
    assert (row.state, row.acknowledged_at, row.resolved_at, row.mttr_seconds) == ("resolved", at + timedelta(minutes=1), at + timedelta(minutes=5), 300)
    assert [e.message for e in row.timeline][1:3] == ["State changed: identified -> acknowledged", "State changed: acknowledged -> acknowledged"]


def test_repeats_of_stored_incidents_open_nothing(spark, tmp_path):
    """A failed request that repeats an unresolved incident is grouped into it; others open tickets with the next numbers."""
    from lanternlog.operators import trace as tr

    base = datetime(2024, 1, 1, 12)

    def failing(trace_id, minutes, service, message):
        at = base + timedelta(minutes=minutes)
        return [(at, k, "ten", trace_id, s, lv, m, "sp") for k, (s, lv, m) in enumerate((("web", "INFO", "begin"), (service, "ERROR", message)))]

    schema = "ts timestamp, log_seq bigint, tenant_id string, trace_id string, service string, level string, message string, span_id string"
    logs = spark.createDataFrame([r for rs in (failing("a", 0, "pay", "deadlock detected on orders"), failing("b", 1, "mail", "Request timeout after")) for r in rs], schema)
    stored = inc.build_incidents(inc.open_tickets(tr.request_failures(logs)))
    stored = stored.withColumn("description", F.concat("description", F.lit(": "), F.element_at("evidence_logs", -1)["message"]))
    stored.write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored").withColumn("state", F.when(F.col("service") == "mail", "resolved").otherwise(F.col("state")))
    later = [failing("c", 5, "pay", "deadlock detected on orders"), failing("d", 6, "pay", "deadlock detected on orders"), failing("e", 6, "mail", "Request timeout after"), failing("f", 7, "pay", "No space left on device")]
    events = tr.request_failures(spark.createDataFrame([r for rs in later for r in rs], schema))
    opened, repeats = inc.open_or_group(events, stored, start_number=2)
    assert sorted((r.service, r.id) for r in opened.collect()) == [("mail", "TICK-0003"), ("pay", "TICK-0004")]
    first = stored.where("service = 'pay'").head()
    assert [(r.incident_id, r.n_events) for r in repeats.collect()] == [(first.id, 2)]
    after = inc.group_into(stored, repeats).where(F.col("id") == first.id).head()
    assert (after.similar_count, len(after.request_traces), after.timeline[-1].type) == (first.similar_count + 2, 3, "grouped")
    assert inc.group_into(stored, repeats).where("service = 'mail'").head().similar_count == 1
