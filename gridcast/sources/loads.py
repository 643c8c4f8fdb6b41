"""Loads that are there as a whole or not at all: tables of month files under a versioned manifest.

A load writes its months aside, under its own name, and then publishes a version of the manifest: which load each month's files are of. A reader takes
the newest version that is complete, so it sees the table before the load or after it. A load that breaks off leaves files that no version names; the next
load of that name writes them anew. A load id that a version holds already changes nothing. Files of replaced months stay for readers of older versions until `tidy`.

One writer at a time: two loads that start from the same version would both publish the next one. Rows without a time belong to the month `none`.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, month string, load string, path string"
NONE = "none"


def month_of(ts: str) -> Column:
    return F.coalesce(F.date_format(F.col(ts), "yyyy-MM"), F.lit(NONE))


class Table:
    """A table at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts", files: int = 8):
        self.spark, self.path, self.ts, self.files = spark, path.rstrip("/"), ts, files

    def manifest(self, version: int | None = None) -> list[tuple]:
        """(version, month, load, path) of the months of a version, the newest if none is given; a row for each month."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        return sorted(tuple(r) for r in rows.where(F.col("version") == version).collect())

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, from the files that it names and no others; none before the first load."""
        files = [r[3] for r in self.manifest(version)]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*files).drop("load", "month") if files else None

    def stage(self, df: DataFrame, load: str) -> list[tuple[str, str]]:
        """Writes a load's months aside; (month, path) of each. Nothing is visible yet. Times are dealt into about `files` files a month, so that a month isn't one task."""
        at = f"{self.path}/data/load={load}-{uuid.uuid4().hex[:8]}"
        out = df.withColumn("month", month_of(self.ts))
        out.repartition("month", F.pmod(F.xxhash64(self.ts), F.lit(self.files))).write.partitionBy("month").parquet(at)
        months = [r["month"] for r in out.select("month").distinct().collect()]  # a row for each month
        return [(m, f"{at}/month={m}") for m in sorted(months)]

    def publish(self, staged: list[tuple[str, str]], load: str) -> int:
        """The next version: the months of the newest one, those of the load replaced. One job commits it."""
        now = self.manifest()
        version = (now[0][0] if now else 0) + 1
        months = {m: (load_, path) for _, m, load_, path in now} | {m: (load, path) for m, path in staged}
        rows = [(version, m, *v) for m, v in sorted(months.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def loaded(self, load: str) -> bool:
        """Whether any version holds a load of that id."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").where(F.col("load") == load).limit(1).count() > 0
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return False

    def load(self, df: DataFrame, load: str) -> int:
        """Replaces the months that df holds, once for each load id. Returns the version that readers see then. An empty load publishes nothing."""
        if self.loaded(load):
            return self.manifest()[0][0]
        staged = self.stage(df, load)
        return self.publish(staged, load) if staged else (now[0][0] if (now := self.manifest()) else 0)

    def tidy(self) -> int:
        """Deletes the files that the newest version doesn't name, once no reader uses an older one; how many folders went."""
        keep = {r[3] for r in self.manifest()}
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs, gone = at.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for load in fs.listStatus(at) if fs.exists(at) else ():
            for month in fs.listStatus(load.getPath()):
                name = f"{self.path}/data/{load.getPath().getName()}/{month.getPath().getName()}"
                if name not in keep and month.isDirectory():
                    gone += fs.delete(month.getPath(), True)
        return gone
