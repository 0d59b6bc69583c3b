"""A session with the settings that the operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch that goes to Python, where the session leaves Spark's default: texts are long.
BATCH_ROWS = 1000
#: How Python workers hold memory: large pieces go back to the system when they are freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}

#: Where streams keep their state: on disk and in native memory, and the only store that has timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("siftline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepared(builder.getOrCreate())


def prepared(spark: SparkSession) -> SparkSession:
    """What an application sets once for its session; operators themselves change no settings.

    Python workers find this package wherever the driver was started (on a cluster it must be installed or shipped)
    and give memory back, and texts go to them in small batches unless the session says otherwise. Of equal keys in a
    JSON object the last one counts. Streams keep their state in RocksDB.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark
