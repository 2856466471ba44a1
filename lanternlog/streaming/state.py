"""Small state tables of a stream, one version per micro-batch.

A micro-batch reads the newest version older than itself and writes its own,
so a batch that is run again after a failure gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEEP_VERSIONS = 3


class StateTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Versions that were written to the end."""
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(v for v in done if fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"v={v}/_done")))

    def read(self, batch_id: int) -> dict[str, DataFrame]:
        """Tables of the newest version before the batch; empty for the first batch."""
        older = [v for v in self._versions() if v < batch_id]
        if not older:
            return {}
        jvm, root, fs = self._fs()
        base = f"{self.path}/v={older[-1]}"
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(base)) if s.isDirectory()]
        return {n: self.spark.read.parquet(f"{base}/{n}") for n in names}

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        base = f"{self.path}/v={batch_id}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        jvm, root, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{base}/_done"), True).close()
        for old in [v for v in self._versions() if v < batch_id][: -KEEP_VERSIONS]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"v={old}"), True)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Output of one micro-batch; running the batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
