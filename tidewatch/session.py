"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans rely on; every one can be overridden by the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def _path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_size(spark: SparkSession, path: str) -> int:
    target, fs = _path(spark, path)
    return fs.getFileStatus(target).getLen()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, one in the home folder of the default file system.

    A table written here must be seen by every executor, so on a cluster whose default file system is a machine's own disk
    the folder has to be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getScheme() == "file" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"{fs.getHomeDirectory().toString().rstrip('/')}/.tidewatch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this run wrote; a missing one is no error."""
    target, fs = _path(spark, path)
    fs.delete(target, True)


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one for tables a job writes between stages; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target, fs = _path(spark, path)
    fs.deleteOnExit(target)
    atexit.register(_forget, fs, target)
    return path


def _forget(fs, target) -> None:
    with contextlib.suppress(Exception):  # the gateway may have gone before; the JVM's own hook deletes it then
        fs.delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """Materialise a frame in reliable storage and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """A frame written to the shared folder as Parquet, several times smaller than :func:`settle` leaves long tables, and read back."""
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
