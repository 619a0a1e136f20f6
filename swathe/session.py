"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Compressed bytes beyond which a table read from files is never broadcast on the strength of its file size.
BROADCAST_FILES = 1 << 20


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("swathe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master,
    where driver and executors are one machine, may fall back to its own
    temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-swathe-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def sized(df: DataFrame) -> DataFrame:
    """``df``, read from files, with joins that do not gather it on the driver unless its files are small.

    The planner takes the size of the files for that of the rows, which are
    some tens of times larger in a broadcast table.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.hint("merge") if int(str(size)) > BROADCAST_FILES else df


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives lost executors, and carries real file
    sizes, so later joins are planned from what was actually written.
    """
    spark = df.sparkSession
    target = os.path.join(scratch_folder(spark), f"{tag}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.mode("error").parquet(target)
    out = sized(spark.read.schema(schema).parquet(target))
    out._written_to = target
    return out


def dealt(df: DataFrame, ids: list[str], copies: int, most: int = 1_000_000) -> DataFrame:
    """``df``, whose rows are about to be made into ``copies`` each, dealt so that no task makes more than about ``most``.

    A small file is one task, however many copies its rows become.
    """
    tasks = -(-df.count() * copies // most)
    return df.repartition(max(1, tasks), *ids)


def discard(*written: DataFrame) -> None:
    """Deletes what ``cut`` wrote.

    Only for tables whose every result is itself written: a lost executor may
    otherwise need them again.
    """
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def df_sql(text: str, **frames: DataFrame) -> DataFrame:
    """SQL over data frames named in braces."""
    return next(iter(frames.values())).sparkSession.sql(text, **frames)
