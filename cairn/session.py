"""Session construction and the shared working folder.

The library never builds its own session inside an operator; these helpers
are for tests, the bench and the driver entry point.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every cairn job relies on: UTC timestamps (the oracle is UTC-naive),
# AQE for runtime re-planning, skew-join splitting, Arrow for pandas UDFs.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "cairn") -> SparkSession:
    """Local/test session.  On a cluster, pass the cluster's own session."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("CAIRN_DRIVER_MEMORY", "16g"))
               .config("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``.  Where it is unset, a session whose master is
    ``local`` gets a scratch folder, one for each application (the setting itself can't
    be changed in a running session); any other session gets an error, since its executors
    couldn't see a folder of the driver's machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _SCRATCH.get(spark.sparkContext.applicationId)
        if base is None:
            base = _SCRATCH[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="cairn-ckpt-")
            spark.sparkContext.setCheckpointDir(base)
    return base


_SCRATCH: dict = {}
_RUN: ContextVar = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession):
    """Intermediate tables written inside the block go to one folder, dropped at its end.

    Consume or write the results inside the block: they are read from those tables.
    Indexes and caches, which later runs use again, aren't intermediate and stay.
    """
    path = f"{shared_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems; nothing happens if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unique sub-path of the shared folder, or of the run's own folder (never reused)."""
    base = _RUN.get() or shared_dir(spark).rstrip("/")
    return f"{base}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, gives all later readers the same rows, and makes the result
    a scan, so that AQE can split a skewed join against it (it can't split one
    whose other side is an aggregate without a shuffle of its own).
    """
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PART_BYTES = 8 << 20  # text that a task of co-located units has, about


def co_located(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` hash-partitioned by ``key`` into parts of about ``PART_BYTES`` of ``text``.

    Tokens take many times the memory of their text, and Spark sizes partitions by the bytes before
    they are split; with a number of partitions that follows the texts, a task's share stays the same
    however large the table.
    """
    total = df.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES)), key)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cairn`` importable by the Python workers of this SparkContext.

    UDFs defined in the package are pickled by reference, so executors must
    be able to import it.  The package is zipped in memory, written once into
    the shared folder and added with ``addPyFile`` (Spark distributes it).
    """
    import io
    import posixpath
    import zipfile

    import pyarrow.fs as pafs

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg_dir):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(dirpath, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = f"{shared_dir(spark).rstrip('/')}/pkg/{uuid.uuid4().hex}/cairn.zip"
    uri = target if "://" in target else "file://" + posixpath.abspath(target)
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(key)
