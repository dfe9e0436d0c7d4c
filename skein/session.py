"""Session, shared folder and lineage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go below the shared folder.
STAGE_DIR = "skein-stage"
_cleaned_at_end: set[str] = set()


def get_spark(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else (in tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The files survive the loss of any executor. `clean` removes what a session wrote, and so does the end of the
    program where the session is still there.
    """
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _cleaned_at_end:
        _cleaned_at_end.add(spark.sparkContext.applicationId)
        atexit.register(_clean_quietly, spark)
    path = os.path.join(shared_dir(spark), STAGE_DIR, spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean_quietly(spark: SparkSession) -> None:
    try:
        clean(spark)
    except Exception:  # noqa: BLE001, S110
        pass  # the session has ended before


def clean(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), STAGE_DIR, sc.applicationId))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of a data folder, pruned to the named columns."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, for Python stages over a few small files.

    Large inputs have more partitions than cores already and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
