"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job here assumes: UTC wall clock for DATE(ts), AQE for runtime
# re-planning (partition coalescing, skew-join splitting, size-checked broadcast).
CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Starting points for a large cluster (inputs around 100 TB), applied on top of
# CONFS by the cluster's own session builder:
# * many initial shuffle partitions; AQE coalesces them to the advisory size,
#   so small shuffles do not pay for the count;
# * file splits of 512 MB keep scan tasks in the tens of thousands;
# * a skewed partition is split when it is 4x the median and above 512 MB;
# * broadcast only below 64 MB, by plan statistics or AQE runtime statistics.
CLUSTER_CONFS = {
    "spark.sql.shuffle.partitions": "100000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def apply_confs(spark: SparkSession, confs: dict) -> None:
    """Set runtime SQL settings on an existing session."""
    for k, v in confs.items():
        spark.conf.set(k, v)


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shopflow", extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs; on a cluster use the cluster's own builder
    and apply :data:`CONFS`."""
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in CONFS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", "8g")
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is only read; it is an error
    if it is unset there, because executors can't read each other's local folders.
    When it is unset on a ``local`` master (tests) a scratch folder is made and set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master or 'a cluster'}")
        d = tempfile.mkdtemp(prefix="shopflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> str | None:
    """Make ``shopflow`` importable in Python workers (needed where a Python
    function runs on executors, e.g. the streaming state function): zip the
    package's sources on the driver and ``addPyFile`` it, once per context.
    Where the package is installed on the cluster nodes this is unnecessary."""
    import zipfile

    key = "spark.shopflow.pyfile"
    done = spark.conf.get(key, None)
    if done:
        return done
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="shopflow-pyfiles-"), "shopflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(key, path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
