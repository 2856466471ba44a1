"""Changes of incidents: transitions, patches, notes, audit, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lanternlog.functions import fixed
from lanternlog.functions.signals import optional
from lanternlog.operators.incidents import priority, timeline_entry
from lanternlog.params import DEFAULTS, Params

MAX_AUDIT = 500


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b, never negative; null when one is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest((F.unix_micros(b) - F.unix_micros(a)) / 60e6, F.lit(0.0)))


def state_of(action: Column) -> Column:
    """State an action leads to; a state name stands for itself, else null."""
    entries = []
    for name, state in fixed.ACTIONS.items():
        entries += [F.lit(name), F.lit(state)]
    named = F.try_element_at(F.create_map(*entries), action)
    return F.coalesce(named, F.when(action.isin(fixed.STATES), action))


def _requests(requests: DataFrame) -> DataFrame:
    """The valid requests of each incident, in order, as one short array."""
    row = F.struct(
        F.col("at"), state_of(F.col("action")).alias("state"),
        F.coalesce(optional(requests, "actor"), F.lit("operator")).alias("actor"),
        optional(requests, "message").alias("message"),
    )
    return (
        requests.where(state_of(F.col("action")).isNotNull())
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(row)).alias("changes"))
    )


def apply_transitions(incidents: DataFrame, requests: DataFrame, text: str = "State changed: ") -> DataFrame:
    """Incidents after the requested transitions (id, action, at[, actor, message]).

    First acknowledgement and mitigation times are kept, the last resolution
    time counts, and every change is appended to the timeline.
    """
    # a lambda would read a column that the select redefines from its new value
    joined = incidents.join(_requests(requests), "id", "left").withColumnRenamed("state", "state_before")
    changed = F.col("changes").isNotNull()
    changes = F.coalesce("changes", F.array().cast("array<struct<at:timestamp,state:string,actor:string,message:string>>"))

    def times(state):
        return F.transform(F.filter(changes, lambda c: c["state"] == state), lambda c: c["at"])

    def entry(c, i):
        before = F.when(i == 0, F.col("state_before")).otherwise(F.try_element_at(changes, i)["state"])
        message = F.coalesce(c["message"], F.concat(F.lit(text), before, F.lit(" -> "), c["state"]))
        return timeline_entry(c["at"], "state_change", c["state"], message, c["actor"], F.col("id"))

    last = F.try_element_at(changes, F.lit(-1))
    resolved = F.try_element_at(times("resolved"), F.lit(-1))
    return joined.select(
        *[F.col(c) for c in incidents.columns if c not in (
            "state", "updated_at", "acknowledged_at", "mitigated_at", "resolved_at", "timeline", "mttr_seconds")],
        F.coalesce(last["state"], F.col("state_before")).alias("state"),
        F.coalesce(last["at"], F.col("updated_at")).alias("updated_at"),
        F.coalesce("acknowledged_at", F.try_element_at(times("acknowledged"), F.lit(1))).alias("acknowledged_at"),
        F.coalesce("mitigated_at", F.try_element_at(times("mitigated"), F.lit(1))).alias("mitigated_at"),
        F.coalesce(resolved, F.col("resolved_at")).alias("resolved_at"),
        F.concat("timeline", F.transform(changes, entry)).alias("timeline"),
        F.coalesce(
            F.unix_seconds(resolved) - F.unix_seconds("created_at"), optional(incidents, "mttr_seconds", "bigint")
        ).alias("mttr_seconds"),
        changed.alias("changed"),
    )


def batch_results(incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per requested id, of batches of any size: (batch_id, pos, id, ok, result)."""
    known = incidents.select("id", F.lit(True).alias("known"))
    joined = requests.join(known, "id", "left").withColumn("new_state", state_of(F.col("action")))
    result = (
        F.when(F.col("known").isNull(), "not found")
        .when(F.col("new_state").isNull(), F.concat(F.lit("invalid state: "), F.col("action")))
        .otherwise(F.col("new_state"))
    )
    ok = F.col("known").isNotNull() & F.col("new_state").isNotNull()
    return joined.select("batch_id", "pos", "id", ok.alias("ok"), result.alias("result"))


def batch_apply(incidents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, incidents afterwards (with ``changed``) and audit rows of batches of requests.

    ``requests``: batch_id, pos, id, action, at[, actor, message].  An
    incident remembers the batches it has taken in ``applied``; a batch that
    comes again gives the same results and changes nothing.
    """
    held = incidents.withColumn("applied", F.coalesce(optional(incidents, "applied", "array<string>"), F.array().cast("array<string>")))
    actor = F.coalesce(optional(requests, "actor"), F.lit("operator"))
    fit = requests.where(state_of(F.col("action")).isNotNull()).select(
        "id", "action", "at", actor.alias("actor"), optional(requests, "message").alias("message"),
        F.col("batch_id").cast("string").alias("batch_id"), "pos",
    )
    fit = fit.join(held.select("id", "applied", F.col("state").alias("before")), "id")
    fit = fit.where(~F.array_contains("applied", F.col("batch_id")))
    after = apply_transitions(held, fit.select("id", "action", "at", "actor", "message"))
    taken = fit.groupBy("id").agg(F.array_sort(F.collect_set("batch_id")).alias("taken"))
    after = after.join(taken, "id", "left").withColumn(
        "applied", F.array_union("applied", F.coalesce("taken", F.array().cast("array<string>")))
    ).drop("taken")
    row = F.struct("at", state_of(F.col("action")).alias("to"), "actor", "message", "batch_id", "pos")
    changes = fit.groupBy("id").agg(F.any_value("before").alias("before"), F.array_sort(F.collect_list(row)).alias("rows"))
    audit = changes.select("id", "before", "rows", F.posexplode("rows").alias("i", "r")).select(
        F.sha2(F.concat_ws("|", "id", "r.batch_id", F.col("r.pos").cast("string")), 256).alias("audit_id"),
        F.col("id").alias("incident_id"), F.col("r.at").alias("at"), F.lit("state_change").alias("action"), F.col("r.actor").alias("actor"),
        F.create_map(
            F.lit("from"), F.when(F.col("i") == 0, F.col("before")).otherwise(F.try_element_at("rows", F.greatest(F.col("i"), F.lit(1)))["to"]),
            F.lit("to"), F.col("r.to"),
        ).alias("details"),
    )
    return batch_results(incidents, requests), after, audit


def patch_incidents(incidents: DataFrame, patches: DataFrame) -> DataFrame:
    """Incidents after field patches; one patch per incident.

    ``patches``: id, at, actor, fields map<string,string>, tags, custom_fields.
    An urgency derives the priority anew; tags are united; custom fields merge.
    """
    p = patches.select(
        "id", F.col("at").alias("p_at"), F.coalesce(optional(patches, "actor"), F.lit("operator")).alias("p_actor"),
        F.col("fields").alias("p_fields"),
        optional(patches, "tags", "array<string>").alias("p_tags"),
        optional(patches, "custom_fields", "map<string,string>").alias("p_custom"),
    )
    joined = incidents.join(p, "id", "left")

    def given(name):
        return F.array_contains(F.map_keys("p_fields"), name)

    def value(name):
        return F.try_element_at("p_fields", F.lit(name))

    entries = [
        F.when(
            given(name),
            timeline_entry(
                F.col("p_at"), "field_change", F.col("state"),
                F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name), F.lit("None")), F.lit(" -> "), value(name)),
                F.col("p_actor"), F.col("id"),
            ),
        )
        for name in fixed.PATCH_FIELDS
    ]
    derived = F.when(value("urgency").isin(fixed.URGENCIES), priority(F.col("severity"), value("urgency")))
    changed = {n: F.when(given(n), value(n)).otherwise(F.col(n)) for n in fixed.PATCH_FIELDS}
    changed["priority"] = F.coalesce(derived, F.col("priority"))
    changed["tags"] = F.array_union("tags", F.coalesce("p_tags", F.array().cast("array<string>")))
    empty = F.create_map().cast("map<string,string>")
    added = F.coalesce("p_custom", empty)
    kept = F.map_filter("custom_fields", lambda k, v: ~F.array_contains(F.map_keys(added), k))
    changed["custom_fields"] = F.map_concat(kept, added)
    changed["timeline"] = F.concat("timeline", F.array_compact(F.array(*entries)))
    changed["updated_at"] = F.coalesce("p_at", "updated_at")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in incidents.columns])


def patch_audit(incidents: DataFrame, patches: DataFrame) -> DataFrame:
    """Audit rows of field patches: one per changed field."""
    fields = patches.select("id", "at", F.coalesce(optional(patches, "actor"), F.lit("operator")).alias("actor"),
                            F.explode("fields").alias("field", "to"))
    current = F.create_map(*[x for n in fixed.PATCH_FIELDS for x in (F.lit(n), F.col(n))])
    old = incidents.select("id", current.alias("old"))
    return fields.where(F.col("field").isin(fixed.PATCH_FIELDS)).join(old, "id").select(
        F.col("id").alias("incident_id"), "at", F.lit("field_change").alias("action"), "actor",
        F.create_map(
            F.lit("field"), "field",
            F.lit("from"), F.coalesce(F.try_element_at("old", F.col("field")), F.lit("None")),
            F.lit("to"), "to",
        ).alias("details"),
    )


def add_notes(incidents: DataFrame, notes: DataFrame) -> DataFrame:
    """Incidents with notes (id, at, actor, message) appended to their timeline."""
    row = F.struct("at", "message", F.coalesce(optional(notes, "actor"), F.lit("operator")).alias("actor"))
    grouped = notes.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("notes"))
    joined = incidents.join(grouped, "id", "left")
    entries = F.transform(
        F.coalesce("notes", F.array().cast("array<struct<at:timestamp,message:string,actor:string>>")),
        lambda n: timeline_entry(n["at"], "note", F.col("state"), n["message"], n["actor"], F.col("id")),
    )
    return joined.withColumns(
        {
            "timeline": F.concat("timeline", entries),
            "updated_at": F.coalesce(F.try_element_at(F.transform("notes", lambda n: n["at"]), F.lit(-1)), F.col("updated_at")),
        }
    ).drop("notes")


def timeline_rows(incidents: DataFrame) -> DataFrame:
    """One row per timeline entry."""
    return incidents.select(
        F.col("id").alias("incident_id"), F.posexplode("timeline").alias("pos", "e")
    ).select("incident_id", "pos", "e.*")


def latest_audit(audit: DataFrame, n: int = 100, cap: int = MAX_AUDIT) -> DataFrame:
    """The newest ``n`` entries per incident, newest first; no more than ``cap``."""
    order = W.partitionBy("incident_id").orderBy(F.desc("at"), F.desc("seq"))
    return audit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(n, cap))


def merge_tags(base: Column, *more: Column) -> Column:
    """Tags in order of first occurrence."""
    return F.array_distinct(F.concat(base, *more))


def expired_incidents(incidents: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    cutoff = F.timestamp_seconds(F.unix_seconds(now) - p.incident_retention_days * 86400)
    return incidents.where(F.col("created_at") < cutoff)


def purge_incidents(incidents: DataFrame, now: Column, p: Params = DEFAULTS) -> DataFrame:
    """Incidents within the retention time."""
    cutoff = F.timestamp_seconds(F.unix_seconds(now) - p.incident_retention_days * 86400)
    return incidents.where(F.col("created_at").isNull() | (F.col("created_at") >= cutoff))
