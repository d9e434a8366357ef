"""Session helpers shared by every operator: tables, shared folders, sessions for tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomdex")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver's folder is visible."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and driver and executors are one process, a
    folder of our own; on a cluster that would be a folder of one machine, so it is an error."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        atexit.register(shutil.rmtree, got[len("file://") :], True)
        spark.conf.set("spark.checkpoint.dir", got)
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


_MADE: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared root; `release` removes it."""
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Removes the folders that this application's operators have made, but for the first `since`; their results can't be read any more.
    A long-lived session calls it once it has written a query's result. Returns how many are left."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in made[since:]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del made[since:]
    return len(made)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
