"""From events to incidents: deduplicate, group, number, describe, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.ids import fingerprint
from lanternlog.functions.signals import optional
from lanternlog.functions.text import needed_tokens, tokens
from lanternlog.operators.asof import asof
from lanternlog.operators.sequence import DAY, greedy_windows, piece_offsets, running_counts, running_number
from lanternlog.params import DEFAULTS, Params
from lanternlog.session import cut_lineage

KEYS = ["tenant_id", "dedup_key"]
LOOKUP_SECONDS = 60
# Rows of one word that a join takes together.
WORD_ROWS = 20_000
# Asked words that a task takes, about.
WORDS_A_TASK = 250_000
# Pairs of texts that share a rare word, for each word of a text.
PAIRS_A_WORD = 4


def urgency(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "high").when(severity == "medium", "medium").otherwise("low")


def priority(severity: Column, urgency_: Column) -> Column:
    entries = []
    for (sev, urg), value in fixed.PRIORITY_MATRIX.items():
        entries += [F.lit(f"{sev}|{urg}"), F.lit(value)]
    found = F.try_element_at(F.create_map(*entries), F.concat_ws("|", severity, urgency_))
    return F.coalesce(found, F.lit(fixed.DEFAULT_PRIORITY))


def dedup_key(events: DataFrame) -> Column:
    """Events with one key belong to one ticket while its window is open."""
    root = F.coalesce(optional(events, "root_cause_service"), F.col("service"))
    category = F.coalesce(optional(events, "error_category"), F.lit("unknown"))
    template = F.coalesce(optional(events, "error_message"), F.lit(""))
    return F.when(
        F.col("anomaly_type") == "request_failure",
        F.concat_ws(":", root, F.lit("request_failure"), fingerprint(root, category, template)),
    ).otherwise(F.concat_ws(":", "service", "anomaly_type"))


def keyed_events(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Events that may open or join a ticket."""
    return events.where(F.col("anomaly_score") >= p.ticket_min_score).withColumns(
        {"dedup_key": dedup_key(events), "sec": F.unix_seconds("ts")}
    )


def ticket_windows(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(keys, sec, open_sec, n_events) of keyed events, reduced to seconds first."""
    seconds = events.groupBy(*KEYS, "sec").agg(F.count(F.lit(1)).alias("n_events"))
    windows = greedy_windows(seconds.select(*KEYS, "sec"), KEYS, p.ticket_dedup_seconds)
    return seconds.join(windows, [*KEYS, "sec"])


def ticket_members(events: DataFrame, windows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The events a ticket keeps: its opener (rank 1) and the ones grouped into it.

    The top rows are taken per second and then per ticket, so that a busy
    key never reaches one task whole.
    """
    by_sec = W.partitionBy(*KEYS, "sec").orderBy("ts", "event_id")
    by_ticket = W.partitionBy(*KEYS, "open_sec").orderBy("ts", "event_id")
    first = events.withColumn("rk", F.row_number().over(by_sec)).where(F.col("rk") <= p.ticket_group_size).drop("rk")
    joined = first.join(windows.select(*KEYS, "sec", "open_sec"), [*KEYS, "sec"])
    return joined.withColumn("rank", F.row_number().over(by_ticket)).where(F.col("rank") <= p.ticket_group_size)


def ticket_rows(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per ticket: the opening event's fields and its group.

    The windows and the few events a ticket keeps are written out, so that
    the events are read twice and not once per later step.
    """
    keyed = keyed_events(events, p)
    windows = cut_lineage(ticket_windows(keyed, p), "ticket-windows")
    members = cut_lineage(ticket_members(keyed, windows, p), "ticket-members")
    totals = windows.groupBy(*KEYS, "open_sec").agg(F.sum("n_events").alias("n_events"))
    opener = members.where(F.col("rank") == 1).drop("rank", "sec")
    extra = F.least(F.col("n_events") - 1, F.lit(p.ticket_group_size - 1))
    tickets = (
        opener.join(totals, [*KEYS, "open_sec"])
        .withColumns({"grouped": extra, "similar_count": extra + 1, "dropped": F.col("n_events") - 1 - extra})
    )
    if "request_trace" in events.columns:
        kept = members.where(F.size(F.coalesce("request_trace", F.array())) > 0)
        traces = kept.groupBy(*KEYS, "open_sec").agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank", "trace_id", "span_ids", F.col("request_trace").alias("logs"), "error_message",
                        F.col("ts").alias("timestamp"),
                    )
                )
            ).alias("request_traces")
        )
        tickets = tickets.join(traces, [*KEYS, "open_sec"], "left")
    grouped = members.where(F.col("rank") > 1).groupBy(*KEYS, "open_sec").agg(
        F.array_sort(F.collect_list(F.struct("ts", "rank", "event_id"))).alias("grouped_events")
    )
    return tickets.join(grouped, [*KEYS, "open_sec"], "left")


def open_tickets(events: DataFrame, p: Params = DEFAULTS, start_number: int = 0) -> DataFrame:
    """Tickets with their number and id."""
    return numbered_tickets(ticket_rows(events, p), start_number)


def open_or_group(events: DataFrame, stored: DataFrame, p: Params = DEFAULTS, start_number: int = 0) -> tuple[DataFrame, DataFrame]:
    """New tickets, and tickets whose failed request repeats a stored unresolved incident (``incident_id``).

    A failed request is looked up among the stored incidents of its tenant and
    service before a ticket is opened for it, so a job that starts anew does
    not open what is open already; only new tickets are numbered.
    """
    rows = cut_lineage(ticket_rows(events, p), "tickets")
    text = F.substring(F.coalesce(optional(rows, "error_message"), F.lit("")), 1, fixed.DUPLICATE_TEXT)
    asked = rows.where(F.col("anomaly_type") == "request_failure").select("event_id", "tenant_id", "service", "ts", text.alias("text"))
    found = cut_lineage(recent_duplicates(asked, stored, p).select("event_id", "incident_id"), "duplicates")
    return numbered_tickets(rows.join(found, "event_id", "left_anti"), start_number), rows.join(found, "event_id")


def group_into(incidents: DataFrame, repeats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Incidents with the tickets that repeat them: their count, traces (the first few stay) and a timeline entry each."""
    entry = timeline_entry(
        F.col("ts"), "grouped", F.lit("identified"), F.concat(F.lit("Similar events grouped: "), F.col("n_events").cast("string")),
        F.lit("system"), F.col("event_id"),
    )
    has_traces = "request_traces" in repeats.columns and "request_traces" in incidents.columns
    traces = [F.flatten(F.collect_list(F.coalesce("request_traces", F.array()))).alias("_traces")] if has_traces else []
    added = repeats.groupBy(F.col("incident_id").alias("id")).agg(
        F.sum("n_events").alias("_n"), F.max("ts").alias("_at"), F.array_sort(F.collect_list(F.struct("ts", entry.alias("entry")))).alias("_entries"), *traces
    )
    rows = incidents.join(added, "id", "left")
    changed = {
        "similar_count": F.col("similar_count") + F.coalesce("_n", F.lit(0)),
        "updated_at": F.greatest("updated_at", "_at"),
        "timeline": F.concat("timeline", F.coalesce(F.col("_entries.entry"), F.slice("timeline", 1, 0))),
    }
    if has_traces:
        both = F.concat(F.coalesce("request_traces", F.slice("_traces", 1, 0)), F.coalesce("_traces", F.slice("request_traces", 1, 0)))
        changed["request_traces"] = F.coalesce(F.slice(both, 1, p.ticket_group_size), F.col("request_traces"))
    return rows.withColumns(changed).select(*incidents.columns)


def numbered_tickets(tickets: DataFrame, start_number: int = 0) -> DataFrame:
    numbered = running_number(tickets, ["ts", "event_id"], "number", start_number)
    return numbered.withColumn(
        "id", F.concat(F.lit("TICK-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))), F.lit("0")))
    )


def title(events: DataFrame) -> Column:
    root = F.coalesce(optional(events, "root_cause_service"), F.col("service"))
    category = F.coalesce(optional(events, "error_category"), F.lit("unknown"))
    failure = F.substring(F.concat(F.lit("Request failure in "), root, F.lit(": "), category), 1, 200)
    other = F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), "service", F.lit(" - "), F.substring("description", 1, 120)
    )
    return F.when(F.col("anomaly_type") == "request_failure", failure).otherwise(other)


def reproduce_steps(request_trace: Column) -> Column:
    """One step per row of the trace: what failed, or what was reached."""

    def step(r):
        failed = F.concat(r["service"], F.lit(" fails: "), F.substring(r["message"], 1, 80))
        reached = F.concat(r["service"], F.lit(": "), F.substring(r["message"], 1, 60))
        return F.when(r["level"].isin("ERROR", "FATAL"), failed).otherwise(reached)

    return F.transform(request_trace, step)


def tags(events: DataFrame) -> Column:
    base = F.array("service", "anomaly_type", "severity")
    category = optional(events, "error_category")
    extra = F.when(
        (F.col("anomaly_type") == "request_failure") & (F.coalesce(category, F.lit("")) != "") & (category != "unknown"),
        F.array(category),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(base, extra))


def timeline_entry(at: Column, kind: str, state: Column, message: Column, actor: Column, *key: Column) -> Column:
    return F.struct(
        F.substring(F.md5(F.concat_ws("|", *key, F.lit(kind), F.unix_micros(at).cast("string"), message)), 1, 8).alias("id"),
        at.alias("timestamp"),
        F.lit(kind).alias("type"),
        state.alias("state"),
        message.alias("message"),
        actor.alias("actor"),
    )


def build_incidents(tickets: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The stored form of each ticket.

    ``evidence`` holds (id, evidence_logs) of error-rate tickets; tickets of
    failed requests carry the rows of their own trace.
    """
    failure = F.col("anomaly_type") == "request_failure"
    no_text = F.lit(None).cast("string")
    no_time = F.lit(None).cast("timestamp")
    no_rows = F.array().cast("array<string>")
    system = F.lit("system")
    if "request_trace" not in tickets.columns:
        row = "array<struct<ts:timestamp,log_seq:bigint,service:string,level:string,message:string,span_id:string>>"
        tickets = tickets.withColumn("request_trace", F.lit(None).cast(row))
    if evidence is not None:
        tickets = tickets.join(evidence.select("id", F.col("evidence_logs").alias("log_evidence")), "id", "left")
    else:
        row = "array<struct<timestamp:timestamp,level:string,message:string,service:string>>"
        tickets = tickets.withColumn("log_evidence", F.lit(None).cast(row))
    trace_evidence = F.transform(
        "request_trace",
        lambda r: F.struct(r["ts"].alias("timestamp"), r["level"].alias("level"), r["message"].alias("message"), r["service"].alias("service")),
    )
    opened = timeline_entry(
        F.col("ts"), "state_change", F.lit("identified"),
        F.concat(F.lit("Anomaly detected: "), F.substring("description", 1, 100)), system, F.col("event_id"),
    )
    joined = F.transform(
        F.coalesce("grouped_events", F.array().cast("array<struct<ts:timestamp,rank:int,event_id:string>>")),
        lambda g: timeline_entry(
            g["ts"], "grouped", F.lit("identified"),
            F.concat(F.lit("Similar event grouped (total: "), g["rank"].cast("string"), F.lit(")")), system, g["event_id"],
        ),
    )
    urgent = urgency(F.col("severity"))
    columns = {
        "id": F.col("id"),
        "number": F.col("number"),
        "severity": F.col("severity"),
        "urgency": urgent,
        "priority": priority(F.col("severity"), urgent),
        "state": F.lit("identified"),
        "title": title(tickets),
        "description": F.col("description"),
        "service": F.col("service"),
        "environment": F.col("tenant_id"),
        "anomaly_type": F.col("anomaly_type"),
        "anomaly_score": F.col("anomaly_score"),
        "correlation_id": F.col("event_id"),
        "trace_id": optional(tickets, "trace_id"),
        "span_ids": F.coalesce(optional(tickets, "span_ids", "array<string>"), no_rows),
        "request_flow": F.coalesce(optional(tickets, "request_flow", "array<string>"), no_rows),
        "affected_services": F.coalesce(F.col("affected_services"), F.array("service")),
        "request_traces": F.col("request_traces") if "request_traces" in tickets.columns else F.lit(None).cast("string"),
        "root_cause": F.nullif(F.coalesce(optional(tickets, "root_cause"), F.lit("")), F.lit("")),
        "reproduce_steps": F.coalesce(reproduce_steps(F.col("request_trace")), no_rows),
        "similar_count": F.col("similar_count"),
        "affected_endpoint": F.coalesce(optional(tickets, "affected_endpoint"), F.lit("")),
        "error_type": optional(tickets, "error_category"),
        "status_code": F.lit(None).cast("int"),
        "impact": no_text,
        "commander": no_text,
        "assigned_to": no_text,
        "communication_channel": no_text,
        "runbook_url": no_text,
        "evidence_logs": F.when(failure, trace_evidence).otherwise(F.col("log_evidence")),
        "created_at": F.col("ts"),
        "updated_at": F.coalesce(F.try_element_at(F.transform("grouped_events", lambda g: g["ts"]), F.lit(-1)), F.col("ts")),
        "detected_at": F.col("ts"),
        "acknowledged_at": no_time,
        "mitigated_at": no_time,
        "resolved_at": no_time,
        "tenant_id": F.col("tenant_id"),
        "timeline": F.concat(F.array(opened), joined),
        "external_refs": F.array().cast("array<struct<system:string,ref_id:string,url:string,synced_at:timestamp>>"),
        "tags": tags(tickets),
        "custom_fields": F.when(
            failure,
            F.create_map(
                F.lit("causal_chain"), F.to_json(optional(tickets, "causal_chain", "array<string>")),
                F.lit("error_category"), F.coalesce(optional(tickets, "error_category"), F.lit("unknown")),
                F.lit("root_cause_service"), F.coalesce(optional(tickets, "root_cause_service"), F.col("service")),
                F.lit("llm_fallback"), F.lit("true"),
            ),
        ).otherwise(F.create_map().cast("map<string,string>")),
        "log_seq": F.col("log_seq"),
        "applied": F.array().cast("array<string>"),
    }
    if "blast_radius" in tickets.columns:
        columns["blast_radius"] = F.col("blast_radius")
    return tickets.select(*[c.alias(n) for n, c in columns.items()])


def evidence_logs(tickets: DataFrame, logs: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The newest error, fatal and warning rows of the ticket's service at its opening.

    Only such rows and the tickets' own are numbered per service, once; a
    ticket then needs one or two blocks of ``evidence_rows`` numbers, so the
    join never meets a whole service.
    """
    size = p.evidence_rows
    key = ["tenant_id", "service"]
    fits = F.col("level").isin("ERROR", "FATAL", "WARN")
    rows = logs.select(*key, "ts", "log_seq", "level", "message")
    others = rows.where(~F.coalesce(fits, F.lit(False))).join(tickets.select("log_seq"), "log_seq", "left_semi")
    rows = rows.where(fits).unionByName(others)
    numbered = cut_lineage(running_counts(rows, key, {"ev_no": F.coalesce(fits, F.lit(False))}), "numbered")
    at = numbered.select("log_seq", "ev_no").join(tickets.select("id", *key, "log_seq"), "log_seq")
    asked = at.select(
        "id", *key, F.col("ev_no").alias("upto"),
        F.explode(
            F.sequence(F.floor(F.greatest(F.col("ev_no") - size, F.lit(0)) / size), F.floor(F.greatest(F.col("ev_no") - 1, F.lit(0)) / size))
        ).alias("blk"),
    )
    blocks = numbered.where(fits).withColumn("blk", F.floor((F.col("ev_no") - 1) / size))
    return asked.join(blocks, [*key, "blk"]).where(
        (F.col("ev_no") <= F.col("upto")) & (F.col("ev_no") > F.col("upto") - size)
    ).select("id", *key, "ts", "log_seq", "level", "message", (F.col("upto") - F.col("ev_no") + 1).alias("rank"))


def evidence_arrays(evidence: DataFrame) -> DataFrame:
    """(id, evidence_logs) with the newest row first; at most the evidence size per ticket."""
    return evidence.groupBy("id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("rank", F.col("ts").alias("timestamp"), "level", "message", "service"))
            ),
            lambda r: F.struct(r["timestamp"].alias("timestamp"), r["level"].alias("level"), r["message"].alias("message"), r["service"].alias("service")),
        ).alias("evidence_logs")
    )


def similar_resolved(asked: DataFrame, incidents: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The newest mitigated or resolved incidents that share a word with the asked text.

    ``asked``: (ask_id, tenant_id, service, text).  A word of a service keeps
    only as many newest incidents as one answer can need (one more, for the
    asker itself), which leaves the newest of all words exact.  The asked
    rows of a common word are dealt to many parts, each with these few, and
    tasks grow in number and not in size with the asked words.
    """
    key = ["tenant_id", "service"]
    past = incidents.where(F.col("state").isin(fixed.RESOLVED_STATES)).select(
        *key, F.col("id").alias("similar_id"), "created_at",
        F.explode(tokens(F.col("title"), F.col("description"), F.coalesce(F.col("root_cause"), F.lit("")))).alias("word"),
    )
    newest = W.partitionBy(*key, "word").orderBy(F.desc("created_at"), F.desc("similar_id"))
    past = past.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= p.similar_rows + 1).drop("rn")
    past = past.groupBy(*key, "word").agg(F.sort_array(F.collect_list(F.struct("created_at", "similar_id")), False).alias("newest"))
    words = asked.select(*key, "ask_id", F.explode(tokens(F.col("text"))).alias("word"))
    counts = cut_lineage(words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).head()[0] or 0
    tasks = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // WORDS_A_TASK))
    common = counts.where(F.col("n") > WORD_ROWS).select(*key, "word", F.ceil(F.col("n") / WORD_ROWS).cast("int").alias("parts"))
    one = F.coalesce("parts", F.lit(1))
    words = words.join(common, [*key, "word"], "left").select(*key, "ask_id", "word", F.pmod(F.xxhash64("ask_id"), one).cast("int").alias("part"))
    past = past.join(common, [*key, "word"], "left").select(*key, "newest", "word", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    by = [*key, "word", "part"]
    found = words.repartition(tasks, *by).join(past.repartition(tasks, *by), by).select("ask_id", *key, "newest")
    found = found.repartition(tasks, "ask_id").groupBy("ask_id", *key).agg(F.array_distinct(F.flatten(F.collect_list("newest"))).alias("newest"))
    newest = F.sort_array(F.filter("newest", lambda x: x["similar_id"] != F.col("ask_id")), False)
    hits = found.select("ask_id", *key, F.inline(F.slice(newest, 1, p.similar_rows))).select("ask_id", *key, "similar_id", "created_at")
    best = W.partitionBy("ask_id").orderBy(F.desc("created_at"), F.desc("similar_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.similar_rows)


def recent_duplicates(events: DataFrame, incidents: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The newest unresolved incident an event repeats.

    ``events``: (event_id, tenant_id, service, ts, text).  Same tenant and
    service, created within the dedup window before the event, with the
    needed share of the event's words in its title or in its description.

    Events and incidents are read once and written out.  Equal texts are taken
    as one, and incidents are reduced to the words that some event of their
    service has: the others, such as numbers of their own, match nothing, so
    few different texts are left.  ``_text_pairs`` finds the texts that match.  Askers that match the same texts form one class;
    times meet in an as-of join by class, to which an incident is offered
    once and not once for every event text.
    """
    key = ["tenant_id", "service"]
    asked = events.select(*key, "event_id", "ts", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    asked = cut_lineage(asked.withColumn("ask_text", F.xxhash64("text")), "asked")
    held = incidents.where(F.col("state").isin(fixed.UNRESOLVED_STATES)).select(
        *key, "id", "created_at", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description")]
    )
    held = cut_lineage(held.withColumn("full_text", F.xxhash64("title", "description")), "held")
    ask_texts = asked.groupBy(*key, "ask_text").agg(F.first("text").alias("text"))
    ask_texts = ask_texts.select(*key, "ask_text", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    ask_texts = cut_lineage(ask_texts, "ask-texts")
    vocabulary = ask_texts.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n_asked"))
    vocabulary = cut_lineage(vocabulary, "ask-words")
    full_texts = held.groupBy(*key, "full_text").agg(F.first("title").alias("title"), F.first("description").alias("description"))
    full_texts = full_texts.select(*key, "full_text", tokens(F.col("title")).alias("title_words"), tokens(F.col("description")).alias("desc_words"))
    full_words = _exploded(full_texts, [*key, "full_text"]).join(vocabulary.select(*key, "word"), [*key, "word"])
    texts = _collected(full_words, [*key, "full_text"])
    texts = cut_lineage(texts.withColumn("held_text", F.xxhash64("title_words", "desc_words")), "held-texts")
    ask_cores, held_cores, pairs = _text_pairs(ask_texts, vocabulary, texts, key, p)
    matched = [*key, "kind", F.count(F.lit(1)), F.bit_xor("offer"), F.bit_xor(F.xxhash64("offer"))]
    classes = pairs.groupBy(*key, "kind", "asker").agg(F.xxhash64(*matched).alias("ask_class"))
    classes = cut_lineage(classes, "ask-classes")
    class_texts = pairs.join(classes, [*key, "kind", "asker"]).select(*key, "kind", "offer", "ask_class").distinct()
    # the newest incident of a matching text at or before the event, if it is new enough
    held_texts = texts.select(*key, "full_text", "held_text").join(held_cores.select(*key, "held_text", "held_core"), [*key, "held_text"])
    held_rows = held.select(*key, "full_text", "created_at", "id").join(held_texts, [*key, "full_text"])
    held_rows = held_rows.select(*key, "created_at", "id", F.inline(_kinds("held_core", "held_text", "offer")))
    held_rows = held_rows.join(class_texts, [*key, "kind", "offer"])
    offered = cut_lineage(held_rows.groupBy("ask_class", "created_at").agg(F.max("id").alias("id")), "offered")
    askers = ask_cores.select(*key, "ask_text", F.inline(_kinds("ask_core", "ask_text", "asker"))).join(classes, [*key, "kind", "asker"])
    askers = cut_lineage(askers.select(*key, "ask_text", "ask_class"), "askers")
    events_at = asked.join(askers, [*key, "ask_text"]).select(*key, "row", "event_id", "ts", "ask_class")
    hits = asof(events_at, offered, ["ask_class"], "ts", "created_at", ["created_at", "id"], "hit", LOOKUP_SECONDS)
    since = F.col("ts") - F.make_dt_interval(secs=F.lit(p.ticket_dedup_seconds))
    # an event is asked for its core and for its whole text; the rest of the struct is the event's own
    newest = F.max(F.struct("hit.created_at", F.col("hit.id").alias("incident_id"), *key, "event_id", "ts")).alias("newest")
    newest = hits.where(F.col("hit.created_at") >= since).groupBy("row").agg(newest).select("newest.*")
    return newest.select(*key, "event_id", "ts", "incident_id", "created_at")


def _exploded(texts: DataFrame, by: list[str]) -> DataFrame:
    """A row per word of a title or description, and where it stands; the union begins with all words of the description."""
    words = texts.select(*by, "title_words", "desc_words", F.posexplode(F.array_union("desc_words", "title_words")).alias("pos", "word"))
    return words.select(
        *by, "word", F.array_contains("title_words", F.col("word")).alias("in_title"), (F.col("pos") < F.size("desc_words")).alias("in_desc")
    )


def _collected(words: DataFrame, by: list[str], keep: Column | None = None) -> DataFrame:
    """Title and description from the rows of their words, of those to keep when a condition is given."""
    def of(place: str, name: str) -> Column:
        held = F.col(place) if keep is None else F.col(place) & keep
        return F.sort_array(F.collect_list(F.when(held, F.col("word")))).alias(name)

    return words.groupBy(*by).agg(of("in_title", "title_words"), of("in_desc", "desc_words"))


def _kinds(core: str, text: str, name: str) -> Column:
    """A core (kind 1) and a whole text (kind 2) as rows."""
    return F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias(name)) for kind, c in ((1, core), (2, text))])


def _text_pairs(
    ask_texts: DataFrame, vocabulary: DataFrame, texts: DataFrame, key: list[str], p: Params
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Event texts and incident texts with their cores, and who matches what: (kind, asker, offer).

    Texts with a word of their own (a user, a host) match one another by the
    words around it, so their pairs grow with the square of such words.
    Words are therefore split.  The rare ones are in so few texts that all
    pairs that share one are listed; they are chosen so that these pairs stay
    in proportion to the words.  What is left of a text is its core, and
    equal cores are one.  A text that matches by its core's words alone does
    so for all texts of that core (kind 1); any other match shares a rare
    word and is among the listed pairs (kind 2).
    """
    word = [*key, "word"]
    need = F.greatest(needed_tokens(F.size("words"), p.duplicate_token_share), F.lit(1))
    held_texts = texts.groupBy(*key, "held_text").agg(F.first("title_words").alias("title_words"), F.first("desc_words").alias("desc_words"))
    held_words = cut_lineage(_exploded(held_texts, [*key, "held_text"]), "held-words")
    known = vocabulary.join(held_words.groupBy(*word).agg(F.count(F.lit(1)).alias("n_held")), word)
    known = cut_lineage(known.withColumn("step", F.length(F.bin(F.greatest("n_asked", "n_held")))), "known-words")
    rare = F.col("step") <= _rare_step(known)
    known = known.select(*word, rare.alias("rare"))
    held_words = held_words.join(known, word)
    ask_words = ask_texts.select(*key, "ask_text", need.alias("need"), F.explode("words").alias("word")).join(known, word)

    core = F.sort_array(F.collect_list(F.when(~F.col("rare"), F.col("word")))).alias("words")
    ask_cores = ask_words.groupBy(*key, "ask_text", "need").agg(core)
    ask_cores = cut_lineage(ask_cores.withColumn("ask_core", F.xxhash64("need", "words")), "ask-cores")
    held_cores = _collected(held_words, [*key, "held_text"], ~F.col("rare"))
    held_cores = cut_lineage(held_cores.withColumn("held_core", F.xxhash64("title_words", "desc_words")), "held-cores")
    common = [F.size(F.array_intersect("words", c)) for c in ("title_words", "desc_words")]

    # cores that share the needed words share one of the asker's rarest
    asks = ask_cores.where(F.size("words") >= F.col("need")).groupBy(*key, "ask_core").agg(F.first("words").alias("words"), F.first("need").alias("need"))
    holds = held_cores.groupBy(*key, "held_core").agg(F.first("title_words").alias("title_words"), F.first("desc_words").alias("desc_words"))
    hold_words = holds.select(*key, "held_core", F.explode(F.array_union("title_words", "desc_words")).alias("word"))
    counts = hold_words.groupBy(*word).agg(F.count(F.lit(1)).alias("df"))
    rarest = W.partitionBy(*key, "ask_core").orderBy(F.coalesce("df", F.lit(0)), "word")
    first_words = (
        asks.select(*key, "ask_core", (F.size("words") - F.col("need") + 1).alias("n"), F.explode("words").alias("word"))
        .join(counts, word, "left")
        .withColumn("pos", F.row_number().over(rarest))
        .where((F.col("pos") <= F.col("n")) & F.col("df").isNotNull())
    )
    by_core = (
        first_words.select(*word, "ask_core")
        .join(hold_words, word)
        .select(*key, "ask_core", "held_core")
        .distinct()
        .join(asks, [*key, "ask_core"])
        .join(holds, [*key, "held_core"])
        .where(F.greatest(*common) >= F.col("need"))
    )
    by_rare = (
        ask_words.where("rare").select(*word, "ask_text")
        .join(held_words.where("rare").drop("rare"), word)
        .groupBy(*key, "ask_text", "held_text")
        .agg(F.count_if("in_title").alias("in_title"), F.count_if("in_desc").alias("in_desc"))
        .join(ask_cores, [*key, "ask_text"])
        .join(held_cores, [*key, "held_text"])
        .where((F.greatest(common[0] + F.col("in_title"), common[1] + F.col("in_desc")) >= F.col("need")) & (F.greatest(*common) < F.col("need")))
    )
    pairs = by_core.select(*key, F.lit(1).alias("kind"), F.col("ask_core").alias("asker"), F.col("held_core").alias("offer")).unionByName(
        by_rare.select(*key, F.lit(2).alias("kind"), F.col("ask_text").alias("asker"), F.col("held_text").alias("offer"))
    )
    return ask_cores, held_cores, cut_lineage(pairs, "text-pairs")


def _rare_step(known: DataFrame) -> int:
    """The binary digits up to which a word's texts count as few: as many as keep the pairs that share one in proportion to the words."""
    pairs = F.col("n_asked") * F.col("n_held")
    steps = known.groupBy("step").agg(F.sum(pairs).alias("pairs"), F.sum(F.col("n_asked") + F.col("n_held")).alias("n")).orderBy("step").collect()
    room, step = PAIRS_A_WORD * sum(s.n for s in steps), 0
    for s in steps:
        room -= s.pairs
        if room < 0:
            break
        step = s.step
    return step


def route(incidents: DataFrame, platforms: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(incident, platform) pairs: the severity's platforms that are enabled.

    ``platforms``: (platform, enabled).  A severity without a rule goes to
    every enabled platform.
    """
    rules = []
    for severity, names in p.routing.items():
        rules += [F.lit(severity), F.array(*[F.lit(n) for n in names or fixed.PLATFORMS])]
    every = F.array(*[F.lit(n) for n in fixed.PLATFORMS])
    targets = F.coalesce(F.try_element_at(F.create_map(*rules), F.col("severity")), every)
    return (
        incidents.select("id", "tenant_id", "severity", F.explode(targets).alias("platform"))
        .join(platforms.where("enabled").select("platform"), "platform", "left_semi")
        .select("id", "tenant_id", "severity", "platform")
    )


def _running(seconds: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Sums of per-second measures up to and with each second, over the days of a key and the seconds of a day."""
    pieces = seconds.select(
        *key, F.floor(F.col("sec") / DAY).alias("pc_day"), F.col("sec").alias("pc_sec"), F.lit(0).cast("long").alias("pc_block"), *names
    )
    before = piece_offsets(pieces, key, names)
    both = pieces.join(before, [*key, "pc_day", "pc_sec", "pc_block"])
    return both.select(
        *key, F.timestamp_seconds("pc_sec").alias("at"), *[(F.col(f"{n}_before") + F.col(n)).alias(n) for n in names]
    )


def _asked(incidents: DataFrame, key: list[str], **seconds: Column) -> DataFrame:
    """A row per incident and named second."""
    points = F.array(*[F.struct(F.lit(n).alias("point"), F.timestamp_seconds(s).alias("when")) for n, s in seconds.items()])
    return incidents.select("id", *key, F.unix_seconds("created_at").alias("created")).select("id", *key, "created", F.inline(points))


def incident_context(incidents: DataFrame, logs: DataFrame, minutes: int = 10) -> DataFrame:
    """Rows, errors and first error of the service around an incident.

    Counts in a range are the difference of two running sums, so an incident
    asks for its two ends and for the next error after its beginning, and
    never meets the rows or seconds in between.
    """
    key = ["tenant_id", "service"]
    width = minutes * 60
    err = F.upper("level").isin(fixed.ERROR_LEVELS)
    per_sec = cut_lineage(
        logs.groupBy(*key, F.unix_seconds("ts").alias("sec")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(err).alias("e"),
            F.min(F.when(err, F.struct("ts", "log_seq", "message"))).alias("first_err"),
        ),
        "seconds",
    )
    ends = _asked(incidents, key, low=F.col("created") - width - 1, high=F.col("created") + width)
    sums = asof(ends, _running(per_sec, key, ["n", "e"]), key, "when", "at", ["n", "e"], "sums", LOOKUP_SECONDS)

    def between(name: str) -> Column:
        value = F.coalesce(F.col(f"sums.{name}"), F.lit(0))
        return F.sum(F.when(F.col("point") == "high", value).otherwise(-value)).alias(f"n_{name}")

    counts = sums.groupBy("id", *key, "created").agg(between("n"), between("e")).where("n_n > 0")
    # the next error at or after a second is the newest one when time runs backwards
    begins = _asked(incidents, key, begin=width - F.col("created")).select("id", "when", *key)
    errors = per_sec.where("e > 0").select(*key, "sec", F.timestamp_seconds(-F.col("sec")).alias("at"))
    first = asof(begins, errors, key, "when", "at", ["sec"], "next", LOOKUP_SECONDS).select("id", F.col("next.sec").alias("sec"))
    found = counts.join(first, "id").withColumn("sec", F.when(F.col("sec") <= F.col("created") + width, F.col("sec")))
    return found.join(per_sec.select(*key, "sec", "first_err"), [*key, "sec"], "left").select(
        "id", *key, F.col("n_n").alias("n_logs"), F.col("n_e").alias("n_errors"), F.col("first_err.ts").alias("first_error_at"),
        F.col("first_err.message").alias("first_error_message"),
    )


def error_seconds(logs: DataFrame, key: list[str]) -> DataFrame:
    """The distinct seconds in which a trace has an error in a service."""
    errors = logs.where(F.upper("level").isin(fixed.ERROR_LEVELS) & (F.coalesce("trace_id", F.lit("")) != ""))
    return errors.select(*key, "trace_id", F.unix_seconds("ts").alias("sec")).distinct()


def correlated_traces(incidents: DataFrame, logs: DataFrame, minutes: int = 10) -> DataFrame:
    """(id, trace_id) of the service's failed traces around an incident: the list itself, so a row per pair."""
    key = ["tenant_id", "service"]
    width = minutes * 60
    traces = error_seconds(logs, key).withColumn("slot", F.floor(F.col("sec") / width))
    asked = incidents.select(
        "id", *key, F.unix_seconds("created_at").alias("at"),
        F.explode(F.array(*[F.floor(F.unix_seconds("created_at") / width) + d for d in (-1, 0, 1)])).alias("slot"),
    )
    near = asked.join(traces, [*key, "slot"]).where(F.abs(F.col("sec") - F.col("at")) <= width)
    return near.select("id", "trace_id").distinct()


def correlated_trace_counts(incidents: DataFrame, logs: DataFrame, minutes: int = 10) -> DataFrame:
    """(id, n_traces): how many of the service's failed traces lie around an incident, without pairing them.

    A window of fixed width counts a trace by the first of its seconds in it.
    A second is the first one for the windows that begin after the trace's
    second before it and not after itself, and that reach it; so each second
    adds one to a range of beginnings, and a window looks up a running sum.
    """
    key = ["tenant_id", "service"]
    width = minutes * 60
    own = W.partitionBy(*key, "trace_id").orderBy("sec")
    marks = error_seconds(logs, key).withColumn("earlier", F.lag("sec").over(own))
    begin = F.greatest(F.coalesce(F.col("earlier") + 1, F.col("sec") - 2 * width), F.col("sec") - 2 * width)
    steps = F.array(F.struct(begin.alias("sec"), F.lit(1).alias("d")), F.struct((F.col("sec") + 1).alias("sec"), F.lit(-1).alias("d")))
    changes = marks.select(*key, F.inline(steps)).groupBy(*key, "sec").agg(F.sum("d").alias("d"))
    asked = _asked(incidents, key, begin=F.col("created") - width)
    level = asof(asked, _running(changes, key, ["d"]), key, "when", "at", ["d"], "level", LOOKUP_SECONDS)
    return level.select("id", F.col("level.d").alias("n_traces")).where("n_traces > 0")


def burst_incidents(events: DataFrame, logs: DataFrame | None = None, width: str = "5 minutes", least: int = 3) -> DataFrame:
    """Services with at least ``least`` anomalies in one time window, and their severity."""
    rows = events.groupBy("tenant_id", "service", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_anomalies"),
        F.max("anomaly_score").alias("top_score"),
        F.max((F.col("anomaly_type") == "fatal_error").cast("int")).alias("has_fatal"),
        F.min("ts").alias("first_at"),
    )
    bursts = rows.where(F.col("n_anomalies") >= least)
    services = bursts.groupBy("tenant_id", "w").agg(F.count(F.lit(1)).alias("n_services"))
    severity = (
        F.when((F.col("n_services") >= 3) | (F.col("has_fatal") == 1), "critical")
        .when((F.col("n_services") >= 2) | (F.col("top_score") > 0.7), "high")
        .otherwise("medium")
    )
    return bursts.join(services, ["tenant_id", "w"]).select(
        "tenant_id", "service", F.col("w.start").alias("window_start"), "n_anomalies", "n_services", "top_score",
        severity.alias("severity"),
    )
