"""Tables and intermediate results in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows with texts or digests that a Python worker gets at once.
BATCH = 500
_scopes: list[tuple[str, list[str]]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors must share; a local master (tests, one machine) may go without the setting."""
    if _scopes:
        return f"{_scopes[-1][0]}/{name}-{uuid.uuid4().hex[:12]}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridcast-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str):
    """What is kept inside lies in one folder, which goes at the end with the tables named inside: a result must be written elsewhere before. One scope at a time in a driver."""
    _scopes.append((folder(spark, name), []))
    try:
        yield
    finally:
        path, tables = _scopes.pop()
        for table in tables:
            spark.sql(f"drop table if exists {table}")
        remove(spark, path)


def named(table: str) -> None:
    """A catalog table that goes with the present scope."""
    if _scopes:
        _scopes[-1][1].append(table)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands at most `BATCH` rows at once to Python workers (fewer, if it is set so): rows may hold long texts.

    It isn't set back: plans that are still to run, also those of other queries of the session, only get smaller batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    if before <= 0 or before > BATCH:
        spark.conf.set(key, str(BATCH))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again, which cuts the lineage."""
    return store(df, folder(df.sparkSession, name))


def store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
