"""Session settings and the shared scratch folder.

Everything written by the library (landed fixture files, stream
checkpoints, point tables) goes below ``spark.checkpoint.dir``: on a
cluster that names a shared file system, so files survive the loss of
any executor.  A folder of our own is created only when the session has
no such setting and the master is local.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# Settings every tickwarden session wants.  AQE re-plans shuffles at run
# time (coalesces small partitions, splits skewed join partitions).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files of datasets that are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "tickwarden",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or fetch) a session with the tickwarden defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            # With only the bind address set, local block fetches can hang.
            builder = builder.config("spark.driver.host", "127.0.0.1")
            builder = builder.config("spark.driver.bindAddress", "127.0.0.1")
    settings = dict(SESSION_DEFAULTS)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def package_zip() -> str:
    """The package as a zip file, whether it is a folder or inside a zip already."""
    package_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(package_dir)
    if os.path.isfile(parent):  # imported from a zip
        return parent
    base = os.path.join(tempfile.mkdtemp(prefix="tickwarden-ship-"), "tickwarden")
    with zipfile.ZipFile(f"{base}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package_dir)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, parent))
    return f"{base}.zip"


def ship_package(spark: SparkSession) -> None:
    """Make ``tickwarden`` importable in the executors' Python workers.

    Functions that run in Python workers are pickled by reference, so the
    workers import this package.  It is shipped as a zip file with
    ``addPyFile`` (once per application; a folder cannot be added on a
    cluster), from a folder of the driver that Spark serves to executors.
    The stateful processor is first unpickled in a Python runner on the
    driver, which finds the package through its ``PYTHONPATH``.  With a
    ``--py-files`` deployment the zip that is already there is used.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context to add files to
        return
    if sc.applicationId in _SHIPPED:
        return
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    current = sc.environment.get("PYTHONPATH", "")
    if parent not in current.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (parent, current) if p)
    archive = package_zip()
    if os.path.basename(archive) not in {os.path.basename(f) for f in sc._python_includes}:
        sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def use_rocksdb_state(spark: SparkSession) -> None:
    """Stateful streaming operators here need the RocksDB state store."""
    current = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if current != ROCKSDB_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset and the master is local
    (tests, local runs) a folder of our own is made and registered.  On a
    cluster every host would write to its own disk, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        sc = None
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if sc is None or not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tickwarden-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    elif sc is not None and not sc.getCheckpointDir():
        # Dataset.checkpoint() needs the context's directory
        sc.setCheckpointDir(root)
    return qualified(spark, root).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path without scheme as the URI that Spark resolves it to, so that
    readers outside Spark open the same place; one on a local file system
    stays as it is."""
    if "://" in path or path.startswith("file:"):
        return path
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # Spark Connect: the path goes to Spark only
        return path
    there = jvm.org.apache.hadoop.fs.Path(path)
    whole = there.getFileSystem(conf).makeQualified(there).toString()
    return path if whole.startswith("file:") else whole


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """Written below the shared root and read back: the lineage is cut, and
    every reader sees the same rows."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique folder path below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/tickwarden/{purpose}-{uuid.uuid4().hex[:12]}"
