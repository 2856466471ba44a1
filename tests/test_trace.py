import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from lanternlog.operators import incidents as inc, trace as tr

T0 = 1704067200000
CASE_1 = [
    (100, "CheckoutController", "INFO", "Received checkout request", "a"),
    (150, "CheckoutController", "INFO", "Cart validated", "a"),
    (200, "PaymentService", "INFO", "Processing payment", "b"),
    (250, "PaymentService", "INFO", "Calling gateway", "b"),
    (300, "StripeGateway", "INFO", "Initiating charge", "c"),
    (800, "StripeGateway", "ERROR", "API returned 500: rate limit exceeded on /v1/charges", "c"),
    (810, "PaymentService", "ERROR", "Payment failed: upstream gateway error", "d"),
    (820, "CheckoutController", "ERROR", "Checkout failed: payment processing error", "e"),
]
CASE_3 = [
    (100, "CheckoutController", "INFO", "Received checkout request", "a"),
    (200, "PaymentService", "INFO", "Processing payment", "b"),
    (500, "StripeGateway", "ERROR", "API returned 500: rate limit exceeded on /v1/charges", "c"),
    (510, "CheckoutController", "ERROR", "Checkout failed: payment processing error", "a"),
]
QUIET = [(100, "Other", "INFO", "fine", "z")]


def logs(spark, traces):
    rows, seq = [], 0
    for trace_id, offset, steps in traces:
        for ms, service, level, message, span in steps:
            rows.append((T0 + offset + ms, seq, "ten", trace_id, service, level, message, span))
            seq += 1
    df = spark.createDataFrame(rows, "ms bigint, log_seq bigint, tenant_id string, trace_id string, service string, level string, message string, span_id string")
    return df.withColumn("ts", F.timestamp_millis("ms"))


def test_request_failure_scenarios(spark):
    events = {r.trace_id: r for r in tr.request_failures(logs(spark, [("t1", 0, CASE_1), ("t3", 5000, CASE_3), ("q", 0, QUIET)])).collect()}
    assert set(events) == {"t1", "t3"}
    one, three = events["t1"], events["t3"]
    assert one.request_flow == ["CheckoutController", "PaymentService", "StripeGateway"] == three.request_flow
    assert one.causal_chain == ["StripeGateway", "PaymentService", "CheckoutController"]
    assert three.causal_chain == ["StripeGateway", "CheckoutController"]
    for e in (one, three):
        assert (e.root_cause_service, e.error_category, e.severity, e.anomaly_score) == ("StripeGateway", "rate_limit", "high", 0.9)
        assert set(e.causal_chain) <= set(e.affected_services)
    assert one.span_ids == ["a", "b", "c", "d", "e"]
    assert one.root_cause_span_id == "c"
    assert one.blast_radius.affected_downstream == ["PaymentService"]
    assert one.blast_radius.impact_score == 0.33


def test_equal_failures_share_a_ticket(spark):
    events = tr.request_failures(logs(spark, [("t1", 0, CASE_1), ("t3", 5000, CASE_3)]))
    tickets = inc.open_tickets(events)
    built = inc.build_incidents(tickets).collect()
    assert len(built) == 1
    t = built[0]
    assert (t.id, t.similar_count, len(t.request_traces), t.priority) == ("TICK-0001", 2, 2, "P2")
    assert t.title == "Request failure in StripeGateway: rate_limit"
    assert t.tags == ["StripeGateway", "request_failure", "high", "rate_limit"]
    assert t.reproduce_steps[5] == "StripeGateway fails: API returned 500: rate limit exceeded on /v1/charges"
    assert t.reproduce_steps[0] == "CheckoutController: Received checkout request"
    assert [e.type for e in t.timeline] == ["state_change", "grouped"]
    assert len(t.evidence_logs) == 8


def test_reach_with_cycles_equals_breadth_first_search(spark):
    random.seed(2)
    names = [f"s{i}" for i in range(12)]
    pairs = {(t, a, b) for t in ("x", "y") for _ in range(18) for a, b in [random.sample(names, 2)]}
    edges = spark.createDataFrame([(t, a, b, 1) for t, a, b in pairs], "tenant_id string, caller string, callee string, n bigint")
    roots = spark.createDataFrame([(t, s) for t in ("x", "y") for s in names], "tenant_id string, root string")
    got = defaultdict(set)
    for r in tr.reach(edges, roots).collect():
        got[(r.tenant_id, r.root)].add(r.svc)
    graph = defaultdict(set)
    for t, a, b in pairs:
        graph[(t, a)].add(b)
    for t in ("x", "y"):
        for s in names:
            seen, queue = set(), deque([s])
            while queue:
                for nxt in graph[(t, queue.popleft())] - seen:
                    seen.add(nxt)
                    queue.append(nxt)
            assert got[(t, s)] == seen - {s}


def test_long_trace_is_read_whole(spark):
    """An error after more rows than are shown still gives the root; the shown list is marked as cut."""
    steps = [(i * 700, f"S{i % 3}", "INFO", f"m{i}", f"x{i}") for i in range(250)]
    steps += [(200_000, "deep", "ERROR", "deadlock detected", "d"), (200_001, "S0", "ERROR", "Request timeout", "e")]
    table = logs(spark, [("big", 0, steps), ("t1", 0, CASE_1)])
    events = {r.trace_id: r for r in tr.request_failures(table).collect()}
    big, small = events["big"], events["t1"]
    assert big.request_flow == ["S0", "S1", "S2", "deep"] and big.causal_chain == ["deep", "S0"]
    assert (big.root_cause_service, big.root_cause_span_id) == ("deep", "d")
    assert (len(big.request_trace), big.trace_rows, big.trace_cut) == (200, 252, True)
    assert big.request_trace[-1].message == "m199" and big.span_ids[0] == "x0"
    assert big.ts.timestamp() * 1000 == T0 + 200_001
    assert (len(small.request_trace), small.trace_rows, small.trace_cut) == (8, 8, False)


def test_steps_of_long_traces(spark):
    """Order, gaps and offsets over many minutes, against a plain walk."""
    rng = random.Random(8)
    traces = [(f"t{k}", 0, [(rng.randrange(0, 900_000), "S", rng.choice(("INFO", "ERROR")), "m", "x") for _ in range(300)]) for k in range(3)]
    table = logs(spark, traces)
    rows = defaultdict(list)
    for r in table.select("trace_id", "ms", "log_seq").collect():
        rows[r.trace_id].append((r.ms, r.log_seq))
    got = {r.log_seq: (r.seq, r.gap_ms, r.offset_ms) for r in tr.trace_steps(tr.trace_rows(table)).collect()}
    want = {}
    for own in rows.values():
        own.sort()
        for i, (ms, seq) in enumerate(own):
            want[seq] = (i + 1, float(ms - own[i - 1][0]) if i else None, float(ms - own[0][0]))
    assert got == want
