"""Words, Arrow batches and work tables shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lanternlog.session import cut_lineage, work_path  # noqa: F401

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
#: Stands for a missing document id inside joins; sorts before every id.
NO_ID = -(2**63)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def md5_number(text: Column) -> Column:
    """A number below 2**32 from the first eight hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def arrow_map(df: DataFrame, rows: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """Apply ``rows`` to each Arrow batch as a dict of Python lists.

    The function returns a dict of equally long lists, one per output column.
    """
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    fields = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, struct)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete work tables of ``cut_lineage`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not re.search(r"/lanternlog/[\w-]+-[0-9a-f]{32}$", folder):
                raise ValueError(f"{folder} is not a work table")
            path = hadoop(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
