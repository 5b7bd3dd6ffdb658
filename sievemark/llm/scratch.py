"""Places for intermediate tables that every executor and the driver can reach."""

from __future__ import annotations

import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from sievemark.sources.shared import shared_dir


class Scratch:
    """Writes tables under the shared folder and drops them when asked.

    A written table cuts the lineage: a lost executor costs only the tasks that read it. Results are lazy, so tables that
    one reads stay until the caller has written it and calls release().
    """

    _live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []
        Scratch._live.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sievemark_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            self._delete(t._sievemark_path)
            self.paths.remove(t._sievemark_path)

    def only(self, table: DataFrame) -> DataFrame:
        """table, all others deleted."""
        for path in [p for p in self.paths if p != table._sievemark_path]:
            self._delete(path)
        self.paths = [table._sievemark_path]
        return table

    def close(self) -> None:
        self._delete(self.base)
        self.paths = []

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """To be given to release() later."""
    return len(Scratch._live)


def release(since: int = 0) -> None:
    """Deletes all tables begun since mark() was called; what reads them must have been written elsewhere."""
    while len(Scratch._live) > since:
        Scratch._live.pop().close()


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame, from file sizes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def task_count(spark: SparkSession, df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """As many ranges as shuffles have tasks here, or more where the input is large: a range is as large at any size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), scan_bytes(df) // bytes_each)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that clash with names renamed, and how to rename them back."""
    back = {f"aside_{i}_{c}": c for i, c in enumerate(df.columns) if c.lower() in names}
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back
