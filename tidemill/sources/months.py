"""A store of derived months that is kept up by fingerprints: only months whose source has changed are computed again.

A month's fingerprint is the number of its source rows, the sum and the exclusive or of their hashes, whatever their order. The
manifest (a small table, one row a month and version) names the fingerprint and the folder of each month. A refresh writes
new folders beside the old ones, then one new manifest: readers see the store before or after, never between, and a refresh that
dies leaves folders that no manifest names, which sweep removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.shared import settled

MANIFEST = "month string, n long, total decimal(38,0), mixed long, version string"


def fingerprints(rows: DataFrame, month: Column) -> DataFrame:
    """month, n, total and mixed. Rows without a month have none. Partial sums are made before the shuffle: a busy month is no hot task."""
    h = F.xxhash64(*sorted(rows.columns))
    marked = rows.select(month.alias("month"), h.alias("h")).where("month is not null")
    return marked.groupBy("month").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.expr("bit_xor(h)").alias("mixed"))


class MonthStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The number of the last manifest that was written whole; 0 where there is none."""
        target, files = self._files()
        if not files.exists(target):
            return 0
        jvm = self.spark.sparkContext._jvm
        names = [s.getPath().getName() for s in files.listStatus(target)]
        whole = [int(x.removeprefix("n=")) for x in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{x}/_SUCCESS"))]
        return max(whole, default=0)

    def manifest(self) -> DataFrame:
        n = self.latest()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/n={n}") if n else self.spark.createDataFrame([], MANIFEST)

    def read(self, schema: str) -> DataFrame:
        """The rows of all months, with ``month``."""
        if not self.latest():
            return self.spark.createDataFrame([], f"{schema}, month string")
        rows = self.spark.read.schema(f"{schema}, month string, version string").option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        return rows.join(self.manifest().select("month", "version"), ["month", "version"], "left_semi").drop("version")

    def refresh(self, source: DataFrame, month: Column, derive: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Brings the store up to date and returns the months that were computed, in order; nothing is written where none was.

        derive makes a month's rows, with the column ``month``, from the source rows of whole months. Months without source
        rows leave the store.
        """
        now, old = settled(fingerprints(source, month)), settled(self.manifest())
        same = now.join(old, ["month", "n", "total", "mixed"]).select("month", "n", "total", "mixed", "version")
        stale = settled(now.join(old, ["month", "n", "total", "mixed"], "left_anti"))
        changed = sorted(r["month"] for r in stale.select("month").collect())  # one row a month
        gone = old.join(now, "month", "left_anti").limit(1).count()
        if not changed and not gone:
            return []
        version = uuid.uuid4().hex
        if changed:
            rows = derive(source.join(stale.select(F.col("month").alias("__month")), month == F.col("__month"), "left_semi"))
            rows.withColumn("version", F.lit(version)).repartition("month").write.mode("append").partitionBy("month", "version").option("compression", "zstd").parquet(f"{self.path}/data")
        fresh = same.unionByName(stale.withColumn("version", F.lit(version)))
        fresh.coalesce(1).write.parquet(f"{self.path}/manifest/n={self.latest() + 1}")
        return changed

    def sweep(self) -> int:
        """Removes the folders of versions that the manifest does not name, and older manifests; returns how many versions went."""
        jvm = self.spark.sparkContext._jvm
        _, files = self._files()
        kept = {(r["month"], r["version"]) for r in self.manifest().select("month", "version").collect()}
        place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        removed = 0
        root = place(f"{self.path}/data")
        for m in files.listStatus(root) if files.exists(root) else []:
            for v in files.listStatus(m.getPath()) if m.isDirectory() else []:
                key = (m.getPath().getName().removeprefix("month="), v.getPath().getName().removeprefix("version="))
                if key not in kept and v.isDirectory():
                    files.delete(v.getPath(), True)
                    removed += 1
        last = self.latest()
        for n in range(1, last):
            files.delete(place(f"{self.path}/manifest/n={n}"), True)
        return removed
