"""The engine's tables in a folder of any store that Spark writes to: each change is a new version, read once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kontor.schemas import TABLES, table


class Store:
    """Tables by name. A version is whole (v) or what is added to the one before (a); one that was not completed is never read.

    Older versions go when a newer whole one is complete. After PARTS additions the next one makes a whole version.
    """

    PARTS = 50

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, text: str):
        path = self._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self._conf)

    def versions(self, name: str) -> list[str]:
        """Names of complete versions, oldest first."""
        path, fs = self._path(f"{self.folder}/{name}")
        if not fs.exists(path):
            return []
        found = [x.getPath() for x in fs.listStatus(path)]
        return sorted((p.getName() for p in found if p.getName()[0] in "va" and fs.exists(self._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), key=lambda n: n[1:])

    def _current(self, name: str) -> list[str]:
        """The last whole version and what was added to it."""
        found = self.versions(name)
        whole = [i for i, n in enumerate(found) if n.startswith("v")]
        return found[whole[-1] :] if whole else found

    def read(self, name: str) -> DataFrame:
        """The table as of its last complete version; empty before the first."""
        found = self._current(name)
        if not found:
            return self.spark.createDataFrame([], table(name))
        return self.spark.read.schema(table(name)).parquet(*(f"{self.folder}/{name}/{n}" for n in found))

    def _write(self, name: str, rows: DataFrame, kind: str) -> None:
        before = self.versions(name)
        new = (int(before[-1][1:]) if before else 0) + 1
        fields = table(name).fields
        rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in fields)).write.mode("overwrite").parquet(f"{self.folder}/{name}/{kind}{new:08d}")

    def save(self, name: str, rows: DataFrame) -> None:
        """A new whole version with the table's columns."""
        kept = self._current(name)
        self._write(name, rows, "v")
        for old in self.versions(name)[:-1]:
            if old not in kept:  # the one before may still be read by what was planned from it
                path, fs = self._path(f"{self.folder}/{name}/{old}")
                fs.delete(path, True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds `rows`, which are all that is written."""
        rows = rows.select(*(f.name for f in table(name).fields))
        if len(self._current(name)) > self.PARTS:
            self.save(name, self.read(name).unionByName(rows))
        else:
            self._write(name, rows, "a")

    def names(self) -> list[str]:
        return list(TABLES)
