"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library assumes: UTC, adaptive plans, skew handling.

    ``conf`` keys use double underscores for dots. Nothing here overrides what
    a cluster has set already through spark-submit.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()

#: The setting by which a query drops its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that executors need no copy of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "panelwright.zip")  # read by the driver alone, which serves it to executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("panelwright", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder of this machine; on a cluster a missing setting is an
    error, since a machine's own folder would be lost with the machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    d = os.path.join(tempfile.gettempdir(), f"panelwright-{spark.sparkContext.applicationId}")
    os.makedirs(d, exist_ok=True)
    return d


def steps_dir(spark: SparkSession) -> str:
    """Where this application's written steps lie."""
    return f"{shared_dir(spark)}/panelwright-steps-{spark.sparkContext.applicationId}"


def drop_steps(spark: SparkSession) -> None:
    """Delete the written steps; results that still read them must have been saved before."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(steps_dir(spark))
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table cuts the lineage: a lost executor costs the tasks that
    read it, not the steps before it. Columnar files are far smaller than a
    serialized RDD checkpoint. As nothing reads the shuffles of the write again,
    their files go when it ends, and with them what the driver keeps of the
    step; both would else stay until its heap is full.
    """
    spark = df.sparkSession
    path = f"{steps_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, n_rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast ``df`` if its counted rows stay within ``limit``, else leave the join to the planner."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if n_rows <= limit else df
