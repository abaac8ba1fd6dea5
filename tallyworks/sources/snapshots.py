"""Versioned table snapshots on plain Parquet: write a new version, then move the pointer.

One writer at a time. A version becomes visible when its marker file is created; readers take
the highest marker, so a failed write leaves the last version in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Tables of one ledger below ``root``: ``v<number>/<table>`` and markers ``v<number>.done``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        known = self.versions()
        if version is None and not known:
            raise FileNotFoundError(f"no version below {self.root}")
        return self.spark.read.parquet(f"{self.root}/v{known[-1] if version is None else version}/{table}")

    def commit(self, tables: dict[str, DataFrame], partition_by: dict[str, tuple[str, ...]] | None = None) -> int:
        """Write all tables as the next version and make it visible; a version that exists is refused."""
        version = (self.versions() or [0])[-1] + 1
        for name, df in tables.items():
            keys = (partition_by or {}).get(name, ())
            df.write.mode("overwrite").partitionBy(*keys).parquet(f"{self.root}/v{version}/{name}")
        if not self._fs.createNewFile(self._path(f"{self.root}/v{version}.done")):
            raise RuntimeError(f"version {version} was written by someone else")
        return version

    def prune(self, keep: int) -> list[int]:
        """Remove all but the last ``keep`` versions, markers first."""
        old = self.versions()[:-keep] if keep > 0 else []
        for version in old:
            self._fs.delete(self._path(f"{self.root}/v{version}.done"), False)
            self._fs.delete(self._path(f"{self.root}/v{version}"), True)
        return old
