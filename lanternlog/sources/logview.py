"""Log table derived from the ``events`` table.

The test tables hold no logs; this view turns each event into one log row
with a tenant, a service, a level, a message, an HTTP status and a trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.functions.ids import iso_utc, uuid5

VIEW_COLUMNS = """
  event_id as log_seq,
  1704067200 + event_id div 4 as epoch,
  timestamp_seconds(1704067200 + event_id div 4) as ts,
  concat('t', cast((user_id div 4) % 2 as string)) as tenant_id,
  concat('svc-', cast(user_id % 4 as string)) as service,
  case when is_err then case when event_id % 10 = 0 then 'FATAL' else 'ERROR' end
       when event_type = 'signup' then 'WARN' when event_type = 'view' then 'DEBUG' else 'INFO' end as level,
  case when is_err then case event_id % 8
      when 0 then concat('Connection refused to 10.0.', cast(user_id as string), '.7:5432 order=', cast(event_id + 100000 as string))
      when 1 then concat('Request timeout after 30s for order #', cast(event_id + 100000 as string))
      when 2 then concat('java.lang.OutOfMemoryError: Java heap space, pod ', md5(cast(event_id as string)))
      when 3 then concat('deadlock detected on orders id=', cast(event_id + 100000 as string))
      when 4 then 'Service unavailable: upstream connect error'
      when 5 then concat('invalid token for user /', cast(user_id + 10000 as string))
      when 6 then 'No space left on device'
      else 'NullPointerException: null pointer in handler' end
    else concat('Request processed seq=', cast(event_id as string)) end as message,
  case when event_type = 'error' then case event_id % 8 when 0 then 503 when 1 then 504 when 5 then 401 else 500 end
       else 200 end as http_status,
  md5(concat('t', cast(event_id div 5 as string))) as trace_id,
  substr(md5(concat('s', cast(event_id as string))), 1, 16) as span_id,
  value as latency_ms,
  event_type, user_id
"""

IS_ERR = "event_type = 'error' or ((event_id div 400) % 7 = 6 and event_type in ('view', 'click'))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows_a_task: int | None = None) -> DataFrame:
    """Rows over all cores where the files give fewer splits than there are cores.

    A table of many files or row groups is left as it is.  ``rows_a_task``,
    for work that costs much per row, asks for so many tasks that each has
    about that many rows at most, however large the table is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task:
        tasks = max(tasks, -(-df.count() // rows_a_task))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


def log_view(spark: SparkSession, sf_dir: str, rows_a_task: int | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events = spread(events, "event_id", rows_a_task)
    rows = spark.sql(
        f"select {VIEW_COLUMNS} from (select *, ({IS_ERR}) as is_err from {{events}})", events=events
    )
    name = F.concat_ws("|", "trace_id", "span_id", iso_utc(F.col("ts")))
    return rows.withColumns({"log_id": uuid5(name), "environment": F.col("tenant_id")})
