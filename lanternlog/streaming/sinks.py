"""A table sink that keeps a micro-batch when some of its rows cannot be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.sources.writers import upsert_daily
from lanternlog.streaming.pipelines import start
from lanternlog.streaming.state import write_batch

#: Column types of a stored log row.
LOG_TYPES = {
    "log_id": "string", "ts": "timestamp", "level": "string", "message": "string", "service": "string", "tenant_id": "string",
    "http_status": "int", "latency_ms": "double",
}
LOG_REQUIRED = ("log_id", "ts")


def faults(rows: DataFrame, types: dict[str, str], required: tuple[str, ...] = ()) -> Column:
    """What keeps a row from being stored: values that are not of their type, and missing ones."""

    def typed(name: str) -> Column:
        return F.col(name).try_cast(types[name])

    wrong = [F.when(F.col(n).isNotNull() & typed(n).isNull(), f"{n}: not a {t}") for n, t in types.items() if n in rows.columns]
    absent = [F.when(F.col(n).isNull() if n in rows.columns else F.lit(True), f"{n}: missing") for n in required]
    return F.array_compact(F.array(*wrong, *absent))


def split(rows: DataFrame, types: dict[str, str], required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows in their types, and rows that cannot be stored, whole and with their reasons.

    Columns without a type stay as they are; typed columns the rows lack are null.
    """
    checked = rows.withColumn("_reasons", faults(rows, types, required))
    typed = {n: (F.col(n).try_cast(t) if n in rows.columns else F.lit(None).cast(t)) for n, t in types.items()}
    good = checked.where(F.size("_reasons") == 0).drop("_reasons").withColumns(typed)
    names = sorted(rows.columns)
    whole = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    bad = checked.where(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), whole.alias("original"))
    return good, bad


class TypedSink:
    """Micro-batch function: rows that fit go to a daily table, once each, the others to the rejects."""

    def __init__(self, path: str, rejects: str, types: dict[str, str] = LOG_TYPES, required: tuple[str, ...] = LOG_REQUIRED, key: str = "log_id"):
        self.path, self.rejects, self.types, self.required, self.key = path, rejects, types, required, key

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            good, bad = split(rows, self.types, self.required)
            upsert_daily(good.withColumns({"_key": F.col(self.key), "dt": F.to_date("ts")}), self.path)
            write_batch(bad, self.rejects, batch_id)
        finally:
            rows.unpersist()


def store_typed(rows: DataFrame, path: str, rejects: str, checkpoint: str, interval: str | None = "5 seconds", **options):
    """Store a stream's rows every ``interval``; the source's options bound what one batch takes."""
    return start(rows, TypedSink(path, rejects, **options), checkpoint, interval, "typed")
