"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE splits skewed join partitions, merges small ones and swaps in broadcast
# joins when the measured size is below autoBroadcastJoinThreshold.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Code texts are large; smaller Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # Streaming state on local disk instead of the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "hunkwise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the default settings; ``master`` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder stands in for it only when the setting is absent and the
    session is local; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "hunkwise")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared folder."""
    return f"{shared_dir(spark)}/hunkwise/{name}-{uuid.uuid4().hex}"
