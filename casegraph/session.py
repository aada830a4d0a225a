"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The event tables hold zone-less UTC timestamps.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # The Java runtime compiles no method beyond this size; Spark then makes smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "casegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune_runtime(spark: SparkSession) -> None:
    """Apply the runtime settings results depend on, and that of method sizes, to a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", DEFAULTS["spark.sql.codegen.hugeMethodLimit"])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a session within one process (tests) may do without.

    Executors of a cluster do not share a local folder, so there the setting is needed.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="casegraph-checkpoint-")
    context.setCheckpointDir(folder)


def release(spark: SparkSession) -> None:
    """Give back the shuffle files of finished stages now.

    Spark removes them once the driver's garbage collector finds that nobody refers to them, which may
    be long after a large job went on to its next stage.  The bridge to the JVM passes on about once a
    second which frames Python has given up, and what they held goes with the collection after that.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(1.5)
        spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that run in here are removed as soon as each has ended.

    It is for jobs that store their rows: a frame collected again later would have to repeat its stages.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs survive executor loss and keep a short plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: a plan without a past, like that of a table.

    Ids are hashes in hexadecimal, of which only this compression takes off half.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    with shuffles_given_back(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` gave, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
