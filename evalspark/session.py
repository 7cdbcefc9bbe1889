"""Session helpers.

Library functions never create or configure a session themselves; they take
DataFrames. These helpers exist for tests, the bench and the entry file.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job relies on for correct results (UTC epoch arithmetic), for
# runtime re-planning at scale (AQE coalescing, skew-join splitting), and for
# bounded Python-worker memory (Arrow batches capped by bytes as well as rows,
# so whole long documents cannot make a batch arbitrarily large).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # A union of bucketed scans claims their partitioning but reads them one after the other
    # (seen with Spark 4.1.2): aggregates over it would miss rows of a key in another layer.
    "spark.sql.unionOutputPartitioning": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "evalspark") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("EVALSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only for local runs.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and is
    used as is. When it is unset, a scratch folder is created only for a
    local master (tests, benchmarks); a cluster job without the setting fails
    with a clear message instead of checkpointing to a machine-local folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's distributed "
                           "file system): model outputs and row indexes are checkpointed there")
    path = tempfile.mkdtemp(prefix="evalspark-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``evalspark`` importable in Python workers (``addPyFile`` of a zip).

    Pandas functions defined in the package (model stand-ins, retrieval cells)
    are pickled by reference, so executors must be able to import it; Spark
    distributes the zip to every executor. Done once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="evalspark-pkg-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "evalspark"), "zip", os.path.dirname(pkg), "evalspark")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def apply_session_conf(spark: SparkSession) -> None:
    """Set the settings results depend on (time zone, AQE) on an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
