"""Session helpers: bounded Arrow batches and tables written to the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_mine: list = []


def bounded(spark: SparkSession) -> SparkSession:
    """Limit what one Arrow batch to Python may hold, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where driver and executors are one machine
    (local mode), a temporary folder does if it is unset; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scriptorium-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: cuts the lineage, survives lost executors,
    and keeps a costly plan from running twice. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _mine.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    _mine[:] = [x for x in _mine if x[1] != path]
    _remove(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of plans that are done; without memory pressure the
    driver would keep them for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean_up() -> None:
    while _mine:
        _remove(*_mine.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")
