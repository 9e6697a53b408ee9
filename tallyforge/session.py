"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Folders of local applications without a setting of their own.
_LOCAL_ROOTS: dict[str, str] = {}
# Applications whose workers have the package.
_SHIPPED: set[str] = set()


def build_session(master: str | None = None, app: str = "tallyforge", **conf) -> SparkSession:
    """A session with adaptive execution and UTC time; `conf` entries use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The state of the latest-state stream outgrows memory; this store keeps it on disk.
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the workers, once per application, so that they find it whatever their working directory is."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tallyforge-package-"), "tallyforge")
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(application)


def release(spark: SparkSession) -> None:
    """Deletes the application's intermediates in the shared folder; frames that read them are gone with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    A local master without that setting gets a temporary folder of its own; a
    cluster without it is an error, since a machine-local folder would be lost
    with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="tallyforge-")
    return _LOCAL_ROOTS[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, compression: str | None = None, tidy: bool = False) -> DataFrame:
    """Writes an intermediate once to the shared folder and reads it back.

    Later uses read only the columns they need, their size is known to the planner, and
    a lost executor costs a re-read instead of a recomputation. Files stay until the
    folder of the application is removed. Long texts are worth `compression="zstd"`.
    With `tidy` the shuffle files of the write go when it ends, not when the driver collects garbage.
    """
    path, conf = scratch_path(df.sparkSession, "settled"), df.sparkSession.conf
    before = conf.get(TIDY, "false")
    if tidy:
        conf.set(TIDY, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if tidy:
            conf.set(TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(settled: DataFrame) -> None:
    """Deletes the files behind a settled frame that nothing reads any more."""
    files = settled.inputFiles()
    if files:
        spark = settled.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# A hinted side is held by every executor and by the driver: its size is checked in bytes.
BROADCAST_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a settled frame, as the planner sees them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Settles `df` and hints a broadcast only if its files hold at most `max_bytes` bytes.

    Beyond that the plain frame is returned and Spark shuffles the join, splitting
    skewed keys at run time.
    """
    settled = settle(df)
    return F.broadcast(settled) if stored_bytes(settled) <= max_bytes else settled
