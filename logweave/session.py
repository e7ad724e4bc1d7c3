"""Session helpers: building a session for tests/bench and finding the
shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "logweave", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """A session tuned for these jobs.  On a cluster, pass no ``master`` and
    let the launcher decide; settings already present win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # AQE coalesces small shuffle partitions towards this size and splits
        # skewed join partitions; start from many partitions on a cluster.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.session.timeZone": "UTC",
        # Checkpoint files go when nothing in the application reads them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder.

    Uses the context's folder, else ``spark.checkpoint.dir`` from the
    session.  Only a local-mode session (tests) may fall back to a fresh
    temporary folder; a cluster must name a shared folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", None)
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running iterative jobs"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logweave`` importable in Python workers (the code behind the
    pandas UDF and ``applyInPandas``), the way ``--py-files`` does: the
    package is zipped once per driver process and added with
    ``addPyFile``, which Spark distributes to every executor."""
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: ship as a Python artifact
        sc = None
    key = sc.applicationId if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="logweave-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)
