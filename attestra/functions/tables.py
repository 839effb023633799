"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files of a small table, at least.
FILES = 24


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder, within the shared one, of all tables that this session keeps."""
    name = spark.conf.get("spark.attestra.run", None)
    if not name:
        name = f"attestra-{uuid.uuid4().hex}"
        spark.conf.set("spark.attestra.run", name)
    return f"{shared_dir(spark)}/{name}"


def forget(spark: SparkSession) -> None:
    """Removes the tables kept so far; call it when all results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark.conf.unset("spark.attestra.run")


def keep_small(df: DataFrame, name: str) -> DataFrame:
    """``keep`` for narrow tables, in at most a few files for each core, however many partitions the shuffle has.

    On a local file system every file that a task opens has its JVM start ``chmod``.
    """
    return keep(df.coalesce(max(FILES, 4 * df.sparkSession.sparkContext.defaultParallelism)), name)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
