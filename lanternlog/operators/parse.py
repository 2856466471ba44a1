"""Raw log batches to canonical rows; unreadable ones to the dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.ids import log_id
from lanternlog.functions.otlp import ATTRIBUTES, attribute, attribute_map, bound, flat_names, without_keys
from lanternlog.functions.text import normalize_level
from lanternlog.params import DEFAULTS, Params

CORRUPT = "_corrupt"

RECORD = (
    "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
    f"body:string,attributes:{ATTRIBUTES},traceId:string,spanId:string>"
)
SCOPE_LOGS = f"struct<scope:struct<name:string>,logRecords:array<{RECORD}>>"
RESOURCE_LOGS = f"array<struct<resource:struct<attributes:{ATTRIBUTES}>,scopeLogs:array<{SCOPE_LOGS}>>>"
# Top-level fields of the four accepted forms; bodies stay raw text.
MESSAGE = (
    f"resourceLogs {RESOURCE_LOGS}, body string, severityText string, timeUnixNano string, "
    f"observedTimeUnixNano string, traceId string, spanId string, attributes {ATTRIBUTES}, "
    f"`@timestamp` string, timestamp string, service string, message string, log_id string, level string, "
    f"{CORRUPT} string"
)

# bits of an arrival number for the record's place in its message and for the topic's partition
PLACE_BITS, PARTITION_BITS = 18, 8
ATTRIBUTE_TEXTS = "array<struct<key:string,value:struct<stringValue:string>>>"

CORE = [
    "ts", "log_id", "observed_ts", "level", "message", "service", "tenant_id", "environment",
    "trace_id", "span_id", "scope_name", "host_name", "attrs",
]
# Names an attribute may not take in the flat row.
CORE_NAMES = [
    "@timestamp", "log_id", "observed_timestamp", "ingest_timestamp", "level", "message", "service",
    "tenant_id", "environment", "trace_id", "span_id", "scope_name", "host_name",
]


def nanos_to_ts(nanos: Column) -> Column:
    value = nanos.try_cast("bigint")
    return F.when(value > 0, F.timestamp_micros(F.call_function("div", value, F.lit(1000))))


def with_route(raw: DataFrame) -> DataFrame:
    """Add the parsed message and the form it has.

    Forms: batch, record, canonical, unknown_format, parse_error.
    """
    parsed = raw.withColumn("m", F.from_json("value", MESSAGE, {"columnNameOfCorruptRecord": CORRUPT}))
    # a well-formed message can still differ in one field's type; only such rows are read again
    broken = F.col(f"m.{CORRUPT}").isNotNull() & (
        F.expr("try_parse_json(value)").isNull() | (F.trim("value") == "")
    )
    route = (
        F.when(F.col("value").isNull() | broken | F.col("m").isNull(), "parse_error")
        .when(F.col("m.resourceLogs").isNotNull(), "batch")
        .when(F.col("m.body").isNotNull() | F.col("m.severityText").isNotNull(), "record")
        .when(
            F.col("m.log_id").isNotNull() & F.col("m.@timestamp").isNotNull() & F.col("m.level").isNotNull(),
            "canonical",
        )
        .otherwise("unknown_format")
    )
    return parsed.withColumn("route", route)


def _records(p_fields: Column) -> Column:
    """Log records of a message as one array; a message without any readable form gives one empty record.

    The route is a field of the records: a filter on it then stays behind the
    explode, where it would else make each message be written and read anew.
    """
    m = F.col("m")
    none = F.lit(None).cast("string")

    def record(res, scope, r, text_time=none, service=none, message=none, fields=F.lit(None).cast("map<string,string>")):
        return F.struct(
            res.alias("res"), scope.alias("scope_name"), r["timeUnixNano"].alias("time"),
            r["observedTimeUnixNano"].alias("observed"), r["severityText"].alias("severity"), r["body"].alias("body"),
            r["attributes"].alias("attributes"), r["traceId"].alias("trace_id"), r["spanId"].alias("span_id"),
            text_time.alias("text_time"), service.alias("field_service"), message.alias("field_message"),
            fields.alias("fields"), F.col("route").alias("route"),
        )

    empty = F.array().cast(f"array<{RECORD}>")
    batch = F.flatten(
        F.transform(
            m["resourceLogs"],
            lambda rl: F.flatten(
                F.transform(
                    F.coalesce(rl["scopeLogs"], F.array().cast(f"array<{SCOPE_LOGS}>")),
                    lambda sl: F.transform(
                        F.coalesce(sl["logRecords"], empty),
                        lambda r: record(rl["resource"]["attributes"], sl["scope"]["name"], r),
                    ),
                )
            ),
        )
    )
    no_attributes = F.lit(None).cast(ATTRIBUTES)
    single = F.array(
        record(no_attributes, none, m, F.coalesce(m["@timestamp"], m["timestamp"]), m["service"], m["message"])
    )
    canonical = F.array(record(no_attributes, none, m, fields=p_fields))
    return (
        F.when(F.col("route") == "batch", batch)
        .when(F.col("route") == "canonical", canonical)
        .otherwise(single)
    )


def arrival_number(columns: list[str]) -> Column:
    """A unique number of a record, in order of arrival.

    It is made of the message's offset and partition and the record's place,
    or, for messages without an offset, of the place at which Spark read it;
    that one is stable once the parsed rows have been written.
    """
    if "offset" not in columns:
        return F.monotonically_increasing_id()
    partition = F.col("partition").cast("bigint") if "partition" in columns else F.lit(0).cast("bigint")
    fits = (F.col("pos") < 1 << PLACE_BITS) & (partition < 1 << PARTITION_BITS)
    number = F.shiftleft(F.shiftleft(F.col("offset").cast("bigint"), PARTITION_BITS) + partition, PLACE_BITS) + F.col("pos")
    return F.when(fits, number).otherwise(F.raise_error(F.lit("a message or topic is too large to number its records")))


def parsed_rows(raw: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Canonical rows and dead letters of raw messages (column ``value``) in one table.

    Every message is read once.  Dead letters have ``_dlq`` true, their
    ``reason`` and ``original``, and no core columns.
    """
    fields = F.from_json("value", "map<string,string>")
    order = [c for c in ("partition", "offset") if c in raw.columns]
    rows = with_route(raw).select("value", *order, F.posexplode(_records(fields)).alias("pos", "r"))
    rows = rows.select(
        "value", "pos", arrival_number(order).alias("log_seq"), "r.*",
        attribute_map(F.col("r.res")).alias("ra"), attribute_map(F.col("r.attributes")).alias("la"),
    )

    def resource(name):
        return F.nullif(F.try_element_at("ra", F.lit(name)), F.lit(""))

    def field(name):
        return F.nullif(F.try_element_at("fields", F.lit(name)), F.lit(""))

    dead = F.col("route").isin("parse_error", "unknown_format")
    time = F.coalesce(
        nanos_to_ts(F.col("time")), nanos_to_ts(F.col("observed")), F.try_to_timestamp("text_time"),
        F.try_to_timestamp(field("@timestamp")), F.current_timestamp(),
    )
    rows = rows.withColumns(
        {
            "ts": time,
            "trace": F.coalesce("trace_id", field("trace_id"), F.lit("")),
            "span": F.coalesce("span_id", field("span_id"), F.lit("")),
            "tenant_id": F.coalesce(resource("tenant_id"), field("tenant_id"), F.lit(p.default_tenant)),
        }
    )
    none = F.create_map().cast("map<string,string>")
    log_attrs = F.map_filter(flat_names(F.coalesce("la", none)), lambda k, v: ~k.isin(CORE_NAMES))
    res_attrs = flat_names(
        without_keys(F.coalesce("ra", none), ["service.name", "tenant_id", "deployment.environment"]), "resource_"
    )
    canonical = F.col("fields").isNotNull()
    columns = {
        "ts": F.col("ts"),
        "log_id": F.coalesce(field("log_id"), log_id(F.col("trace"), F.col("span"), F.col("ts"), F.concat_ws("|", "value", "pos"))),
        "observed_ts": F.coalesce(nanos_to_ts(F.col("observed")), F.try_to_timestamp(field("observed_timestamp"))),
        "level": F.when(canonical, F.upper(field("level"))).otherwise(normalize_level(F.col("severity"))),
        "message": F.when(canonical, F.coalesce(field("message"), F.lit("(no message)"))).otherwise(
            body_text(F.col("body"), F.col("field_message"))
        ),
        "service": F.coalesce(
            resource("service.name"), F.nullif(F.try_element_at("la", F.lit("service.name")), F.lit("")),
            F.nullif("field_service", F.lit("")), field("service"), F.lit("unknown"),
        ),
        "tenant_id": F.col("tenant_id"),
        "environment": F.coalesce(resource("deployment.environment"), field("environment"), F.col("tenant_id")),
        "trace_id": F.col("trace"),
        "span_id": F.col("span"),
        "scope_name": F.coalesce(F.nullif("scope_name", F.lit("")), field("scope_name")),
        "host_name": F.coalesce(
            resource("host.name"), F.nullif(F.try_element_at("la", F.lit("host.name")), F.lit("")), field("host_name")
        ),
        "attrs": F.when(canonical, without_keys("fields", CORE_NAMES + ["timestamp"])).otherwise(
            merge_attributes(log_attrs, res_attrs)
        ),
    }
    broken = F.col("route") == "parse_error"
    return rows.select(
        *[F.when(~dead, c).alias(n) for n, c in columns.items() if n != "tenant_id"],
        F.when(~dead, F.col("log_seq")).alias("log_seq"),
        F.when(dead, F.lit(p.default_tenant)).otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.when(dead, F.lit(True)).alias("_dlq"),
        F.when(dead, F.col("route")).alias("reason"),
        F.when(broken, F.lit("malformed JSON")).alias("error"),
        F.when(dead, F.col("value")).alias("original"),
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_dlq").isNull()).select(*CORE, "log_seq")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_dlq").isNotNull()).select(
        "_dlq", "reason", "error", "tenant_id", F.current_timestamp().alias("timestamp"), "original"
    )


def body_text(body: Column, message: Column) -> Column:
    """Message of a record: text value, plain text, message field, else the body itself."""
    wrapped = F.get_json_object(body, "$.stringValue")
    plain = F.when(~body.startswith("{"), body)
    return F.coalesce(
        F.nullif(wrapped, F.lit("")), F.nullif(plain, F.lit("")), F.nullif(message, F.lit("")),
        F.when(body != "{}", body), F.lit("(no message)"),
    )


def merge_attributes(first: Column, second: Column) -> Column:
    """Both maps; of equal keys the first one's value stays."""
    return bound(
        F.struct(first.alias("first"), F.map_keys(first).alias("names"), second.alias("second")),
        lambda m: F.map_concat(m["first"], F.map_filter(m["second"], lambda k, v: ~F.array_contains(m["names"], k))),
    )


def flat_rows(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Flat log fields (column ``f``: map<string,string>) to canonical rows.

    Level names are normalised, defaults fill what is missing, and fields
    that are not core columns become attributes.  A row whose time cannot be
    read gets the current one and is marked (``bad_time``).
    """

    def field(name):
        return F.nullif(F.try_element_at("f", F.lit(name)), F.lit(""))

    given = F.coalesce(field("@timestamp"), field("timestamp"))
    rows = rows.withColumn("ts", F.coalesce(F.try_to_timestamp(given), F.current_timestamp()))
    trace = F.coalesce(field("trace_id"), F.lit(""))
    span = F.coalesce(field("span_id"), F.lit(""))
    tenant = F.coalesce(field("tenant_id"), F.lit(p.default_tenant))
    return rows.select(
        "ts",
        F.coalesce(field("log_id"), log_id(trace, span, F.col("ts"), F.to_json("f"))).alias("log_id"),
        F.try_to_timestamp(field("observed_timestamp")).alias("observed_ts"),
        normalize_level(F.coalesce(field("level"), F.lit("INFO"))).alias("level"),
        F.coalesce(field("message"), F.lit("(no message)")).alias("message"),
        F.coalesce(field("service"), F.lit("unknown")).alias("service"),
        tenant.alias("tenant_id"),
        F.coalesce(field("environment"), tenant).alias("environment"),
        trace.alias("trace_id"),
        span.alias("span_id"),
        field("scope_name").alias("scope_name"),
        F.coalesce(field("host_name"), field("host")).alias("host_name"),
        without_keys("f", CORE_NAMES + ["timestamp", "host"]).alias("attrs"),
        (given.isNotNull() & F.try_to_timestamp(given).isNull()).alias("bad_time"),
    )


def scoring_columns(rows: DataFrame) -> DataFrame:
    """Attributes the scorers read, lifted to columns of canonical rows."""
    names = {
        "http_status": "http_status_code",
        "exception_type": "exception_type",
        "exception_message": "exception_message",
        "exception_stacktrace": "exception_stacktrace",
        "endpoint": "endpoint",
    }
    lifted = {c: F.try_element_at("attrs", F.lit(a)) for c, a in names.items()}
    times = [F.try_element_at("attrs", F.lit(a)).try_cast("double") for a in fixed.LATENCY_ATTRIBUTES]
    return rows.withColumns(lifted | {"latency_ms": F.coalesce(*times)})


def fields_to_batches(rows: DataFrame, batch_rows: int = 1000) -> DataFrame:
    """Flat field maps (column ``f``) to OTLP batches, one message per service and block of rows.

    Fields without a place of their own become attributes, ``host`` under the
    name ``host.name``; empty ids are left out.
    """

    def field(name: str) -> Column:
        return F.nullif(F.try_element_at("f", F.lit(name)), F.lit(""))

    def attribute_of(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), F.struct(value.alias("stringValue")).alias("value"))

    others = F.transform(F.map_entries(without_keys("f", fixed.FLAT_FIELDS)), lambda e: attribute_of(e["key"], e["value"]))
    host = F.when(field("host").isNotNull(), F.array(attribute_of(F.lit("host.name"), field("host"))))
    time = F.coalesce(F.try_to_timestamp(field("timestamp")), F.current_timestamp())
    record = F.struct(
        (F.unix_micros(time) * 1000).cast("string").alias("timeUnixNano"),
        F.upper(F.coalesce(field("level"), F.lit("INFO"))).alias("severityText"),
        F.struct(F.coalesce(field("message"), F.lit("")).alias("stringValue")).alias("body"),
        F.concat(others, F.coalesce(host, F.array().cast(ATTRIBUTE_TEXTS))).alias("attributes"),
        field("trace_id").alias("traceId"),
        field("span_id").alias("spanId"),
    )
    placed = rows.select("f", F.coalesce(field("service"), F.lit("unknown")).alias("service"), F.monotonically_increasing_id().alias("place"))
    grouped = placed.groupBy("service", F.floor(F.col("place") / batch_rows).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", record.alias("record")))).alias("records")
    )
    scope = F.array(F.struct(F.struct(F.lit("lanternlog").alias("name")).alias("scope"), F.col("records.record").alias("logRecords")))
    resource = F.struct(F.array(attribute_of(F.lit("service.name"), F.col("service"))).alias("attributes"))
    return grouped.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scope.alias("scopeLogs"))).alias("resourceLogs"))).alias("value"))


def to_batches(
    logs: DataFrame, batch_rows: int = 1000, attributes: dict[str, Column] | None = None, offsets: bool = False
) -> DataFrame:
    """Flat rows to OTLP batches, one message per service and arrival block.

    ``attributes`` names the columns that become record attributes;
    ``offsets`` adds the partition and offset a topic would give.
    """
    extra = attributes or {}
    wrapped = [
        F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
        for k, v in extra.items()
    ]
    record = F.struct(
        F.col("log_seq"),
        (F.unix_micros("ts") * 1000).cast("string").alias("timeUnixNano"),
        F.upper(F.coalesce("level", F.lit("INFO"))).alias("severityText"),
        F.struct(F.coalesce("message", F.lit("")).alias("stringValue")).alias("body"),
        F.array(*wrapped).alias("attributes"),
        F.nullif("trace_id", F.lit("")).alias("traceId"),
        F.nullif("span_id", F.lit("")).alias("spanId"),
    )
    resource = F.array(
        F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value")),
        F.struct(F.lit("tenant_id").alias("key"), F.struct(F.col("tenant_id").alias("stringValue")).alias("value")),
    )
    grouped = logs.groupBy("tenant_id", "service", F.floor(F.col("log_seq") / batch_rows).alias("block")).agg(
        F.array_sort(F.collect_list(record)).alias("records")
    )
    scope = F.array(
        F.struct(
            F.struct(F.lit("lanternlog").alias("name")).alias("scope"),
            F.transform("records", lambda r: r.dropFields("log_seq")).alias("logRecords"),
        )
    )
    batch = F.array(F.struct(F.struct(resource.alias("attributes")).alias("resource"), scope.alias("scopeLogs")))
    place = [F.lit(0).alias("partition"), F.col("block").cast("bigint").alias("offset")] if offsets else []
    return grouped.select(F.to_json(F.struct(batch.alias("resourceLogs"))).alias("value"), *place)
