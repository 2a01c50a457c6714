"""Session, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only on a local master, where that may be unset (tests),
    a temporary folder is used; a cluster without the setting is an error."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(lambda d=_OWN_DIR[7:]: __import__("shutil").rmtree(d, ignore_errors=True))
    return _OWN_DIR


def materialize(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage, computes each row once (an RDD checkpoint
    computes twice) and survives the loss of any executor. release() removes the files early, the end of the application
    those that are left."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    path = getattr(df, "_loom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the Python path of the workers that start from now on."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer than half as many tasks as there are cores; else df as it is. For work
    in Python that costs more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
