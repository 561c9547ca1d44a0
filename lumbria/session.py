"""Session helpers: sensible defaults for tests and the shared scratch folder of a cluster."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def local_session(cores: int | str = 8, name: str = "lumbria", **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it
    has one of its own; on a cluster that would be another folder on each machine, so there it is an error."""
    conf = spark.sparkContext.getConf()
    if (path := conf.get("spark.checkpoint.dir")) or (path := spark.conf.get("spark.checkpoint.dir", None)):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lumbria-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; never reused, so that a retried job can't meet an older one's files."""
    return f"{shared_dir(spark)}/lumbria-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage is cut, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no DataFrame needs any more: Spark frees them once their owners are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did, whatever folder the session was started in."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    return spark
