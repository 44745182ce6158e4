"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings that decide results: calendar days are UTC days, and of two equal keys
# in a JSON object the last one counts.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Runtime settings that decide speed only. Partition counts stay with the cluster: AQE
# coalesces small shuffle partitions and splits skewed ones.
SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Leaves of VARIANT columns are written as Parquet columns of their own and read by themselves.
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.inferShreddingSchema": "true",
    "spark.sql.variant.allowReadingShredded": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
    # Batches drop rows beyond a limit before they are shuffled, however large the limit.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
}


_own: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session the caller owns."""
    for key, value in {**RESULT_CONF, **SPEED_CONF}.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master, where driver and executors are one process, may do without the
    setting; it gets a temporary folder that goes when Python ends. Elsewhere the setting is
    required, and what it holds is the cluster's to keep or clear.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get("root")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _own["root"] = tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
