"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session in this library relies on.  AQE re-plans joins at
# runtime (a shuffle side that turns out small becomes a broadcast; a skewed
# partition is split), and UTC keeps timestamps comparable with DuckDB.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "corpuskit", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session and call
    :func:`configure` on it instead."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("CORPUSKIT_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators assume and ship this
    package to the executors' Python workers (idempotent)."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql.") and k != "spark.sql.execution.arrow.maxRecordsPerBatch":
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip the ``corpuskit`` sources and ``addPyFile`` them, so Python UDFs,
    ``mapInPandas`` and streaming state functions import the package on
    every executor, whatever the workers' own path is."""
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="corpuskit-py-"), "corpuskit.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(id(sc))


_LOCAL_CHECKPOINT: dict[int, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset (local tests) do we create
    and register a folder of our own, which is removed at exit.  On a cluster
    an unset folder is an error: executors do not share a local one.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(sc)
    if key not in _LOCAL_CHECKPOINT:
        local = tempfile.mkdtemp(prefix="corpuskit-ckpt-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        sc.setCheckpointDir(local)
        _LOCAL_CHECKPOINT[key] = local
    return _LOCAL_CHECKPOINT[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/corpuskit-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts lineage, so several consumers (and retries after a lost
    executor) reuse one result instead of recomputing it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
