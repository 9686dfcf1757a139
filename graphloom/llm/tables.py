"""Tables written between stages, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Rows that go to Python workers at a time while a table is written: texts are long.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4000
_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set, as in tests."""
    found = spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def written(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no rework.

    The application's folder goes when the Python driver ends; drop() removes one table earlier.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"
    if top not in _registered:
        _registered.add(top)
        atexit.register(_drop, spark, top)
    path = f"{top}/{uuid.uuid4().hex}"
    had = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(had), batch_rows) if int(had) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, had)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by written() of which every reader has finished."""
    _drop(df.sparkSession, df._graphloom_path)


def spread(df: DataFrame, small: int = 48 << 20) -> DataFrame:
    """df dealt to all cores where its files are so small that one may hold all rows: a plan's choice, not a result's.

    Larger tables come in many row groups and stay where they are read."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(size) <= small else df


def settle(spark: SparkSession) -> None:
    """Let the cluster drop the shuffle files of finished steps whose results are written and whose plans nothing names."""
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
