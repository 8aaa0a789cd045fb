"""Session, lineage and shared-folder helpers that every operator uses."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_DIRS: list[str] = []
_SHARED: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", app: str = "triloom", shuffle: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own.

    Its Python workers find this package from wherever the session is started.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in path:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, path)])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRILOOM_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is a single JVM is a temporary folder of
    this machine used instead; on a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not known:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            known = tempfile.mkdtemp(prefix="triloom-")
            _LOCAL_DIRS.append(known)
        sc.setCheckpointDir(known)
    return known or current.get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, without its lineage.

    A reliable checkpoint: a lost executor loses none of it.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager)


def settle(df: DataFrame, **seen: Column) -> tuple[DataFrame, dict]:
    """``df`` as a table in the shared folder, without its lineage, and the aggregates ``seen`` observed while it was written.

    Unlike a checkpoint it has the size of its files, so joins with it are planned by what
    it really is, and carries no constraints of earlier plans along, which would grow with
    every round of an iteration.
    """
    spark = df.sparkSession
    path = new_table_dir(spark, "settled")
    observed = Observation()
    kept = df.observe(observed, *[c.alias(k) for k, c in seen.items()]) if seen else df
    kept.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    if not seen:
        return table, {}
    got = observed_values(observed)
    return table, table.agg(*[c.alias(k) for k, c in seen.items()]).first().asDict() if got is None else got


def forget(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again; others are left alone."""
    for t in tables:
        if path := getattr(t, "_settled_at", None):
            delete_path(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Has shuffle files and broadcasts that nothing refers to any more deleted now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def observed_values(observed: Observation) -> dict | None:
    """What was observed, or None where the plan was found to be empty and never ran."""
    try:
        return observed.get
    except Py4JJavaError:
        return None


def new_table_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory for a table in the shared folder, removed when Python ends."""
    path = f"{shared_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _SHARED.append((spark, path))
    return path


def plan_bytes(df: DataFrame) -> int:
    """The size the optimizer expects of ``df``; of a settled table it follows from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_bytes(spark: SparkSession) -> int:
    """The size up to which the session broadcasts a table; -1 if never."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SHARED:
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    for d in _LOCAL_DIRS:
        shutil.rmtree(d, ignore_errors=True)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
