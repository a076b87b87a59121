"""Session and shared-storage helpers.

Jobs never pick a machine-local scratch folder on a cluster: anything that
must outlive a task (checkpoints, published tables, materialized files) goes
under ``spark.checkpoint.dir``, which the cluster points at shared storage.
Only when that setting is absent (local tests) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Behaviour the engine's plans rely on (adaptive execution, skew splitting,
# checkpoint cleanup). Cluster sizing (executors, memory, partitions) comes
# from the job submission, not from here.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's join partition even when that costs one more shuffle
    # (the aggregate after the join then runs on the split pieces).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "textbarge",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session first; a local one is set only when it is unset and the
    master is local (tests), where one machine is all there is. On a cluster an
    unset folder is an error. Also registers it as the checkpoint directory so
    ``DataFrame.checkpoint()`` lands there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="textbarge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends in storage
    that every executor sees, and what reads it prunes columns."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme so Python file APIs can use the path."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri


def ensure_local_dir(uri: str) -> None:
    p = local_path(uri)
    if "://" not in p:
        os.makedirs(p, exist_ok=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by executor Python workers (the code behind
    ``mapInPandas`` is pickled by module reference). Zips the package once per
    application into the shared folder and registers it with ``addPyFile`` —
    the programmatic form of ``spark-submit --py-files``."""
    import io
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = f"{shared_dir(spark)}/pyfiles/textbarge-{app}.zip"
    if "://" in target and not target.startswith("file:"):
        from pyarrow import fs as pafs
        fs, inner = pafs.FileSystem.from_uri(target)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner) as fh:
            fh.write(buf.getvalue())
    else:
        lp = local_path(target)
        os.makedirs(os.path.dirname(lp), exist_ok=True)
        with open(lp, "wb") as fh:
            fh.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(app)
