"""Folders of batches, merged in levels, under a manifest that names the live ones.

Every batch of a stream writes a folder of its own. When a level has FAN folders they are merged into one of the next
level, so a read touches at most FAN - 1 folders a level, and each row is written again once a level. The manifest is
what counts: it changes in one commit after the merged folder is complete. A merge that stops before that leaves the
folders it read as they are; it is done again with the next batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
MANIFEST = "level int, first long, last long, live boolean"


class BatchFolders:
    """The batches below ``root``. ``merge`` makes the rows of a merged folder from those of its folders."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        merge: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        partition_by: tuple[str, ...] = (),
    ):
        self.spark, self.root, self.schema, self.merge, self.partition_by = spark, root, schema, merge, partition_by

    def path(self, first: int, last: int | None = None) -> str:
        return f"{self.root}/rows/batch={first}-{first if last is None else last}"

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def manifest(self) -> tuple[int, list[tuple[int, int, int, bool]]]:
        """Version and rows (level, first batch, last batch, live) of the last manifest: a few rows a level."""
        if not self._exists(f"{self.root}/manifest"):
            return -1, []
        rows = self.spark.read.schema(f"{MANIFEST}, version long, slot int").parquet(f"{self.root}/manifest").collect()
        version = max((r["version"] for r in rows), default=-1)
        return version, sorted((r["level"], r["first"], r["last"], r["live"]) for r in rows if r["version"] == version)

    def _commit(self, version: int, rows: list[tuple[int, int, int, bool]]) -> None:
        """One file in the slot of the last manifest but one; until it is there, the last one counts."""
        table = self.spark.createDataFrame(rows, MANIFEST).coalesce(1).withColumn("version", F.lit(version).cast("long"))
        table.write.mode("overwrite").parquet(f"{self.root}/manifest/slot={version % 2}")

    def _rows(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, batch STRING").option("basePath", f"{self.root}/rows")
        return reader.parquet(*folders).drop("batch")

    def read(self) -> DataFrame:
        """The rows of all batches."""
        _, rows = self.manifest()
        if not rows:
            raise FileNotFoundError(f"no batch below {self.root}")
        return self._rows([self.path(first, last) for _, first, last, live in rows if live])

    def write(self, rows: DataFrame, first: int, last: int | None = None) -> str:
        """Write, or overwrite, the folder of a batch; ``add`` makes it count."""
        path = self.path(first, last)
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(path)
        return path

    def add(self, batch: int) -> None:
        """Make the folder of ``batch`` live, and merge what has become due. A repeated batch changes nothing."""
        version, rows = self.manifest()
        # folders that were already out of use before the last commit: no reader of the last manifest needs them
        for _, first, last, live in rows:
            if not live:
                self._delete(self.path(first, last))
        rows = [r for r in rows if r[3]]
        covered = [r for r in rows if r[1] <= batch <= r[2]]
        if covered and covered[0][0] > 0:
            self._delete(self.path(batch))
            return
        if not covered:
            rows.append((0, batch, batch, True))
        level = 0
        while len(due := sorted(r for r in rows if r[0] == level and r[3])) >= FAN:
            first, last = due[0][1], due[-1][2]
            self.write(self.merge(self._rows([self.path(a, b) for _, a, b, _ in due])), first, last)
            rows = [r if r not in due else (*r[:3], False) for r in rows]
            rows.append((level + 1, first, last, True))
            level += 1
        self._commit(version + 1, rows)
