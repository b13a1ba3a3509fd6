"""Session defaults and table access shared by every module."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | None = None, name: str = "corvane") -> SparkSession:
    """A local session with the settings the engine expects; on a cluster use the session given."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started. A cluster is given it as py-files."""
    top, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), top]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, removed when the application ends.

    The setting is the session's. Only where it is unset, as in tests on one machine, a
    temporary folder stands in, and no other master than a local one may use that.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _made.get("local") or _made.setdefault("local", tempfile.mkdtemp(prefix="corvane-"))
    path = f"{top.rstrip('/')}/corvane-{sc.applicationId}"
    if path not in _made:
        _made[path] = path
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder, if it is there."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def keep(df: DataFrame, name: str = "part", compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: computed once, and the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Removes what keep wrote, once nothing reads it any more; what isn't discarded goes when the application ends."""
    remove(kept.sparkSession, kept._kept_at)
