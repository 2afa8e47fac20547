"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps are read, shown and truncated in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key in a JSON body keeps its last value, as JavaScript does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Bookmark and profile state outgrows executor heaps; it is kept on disk.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Keys of aes_encrypt/aes_decrypt never reach explain output or event logs.
    "spark.sql.redaction.string.regex": r"(?i)aes_(en|de)crypt\(.*",
}


def build_session(app_name: str = "joblattice", **extra: str) -> SparkSession:
    """Return a session with the settings above; ``extra`` wins over them.

    The number of shuffle partitions is left to the cluster: AQE merges small
    partitions, so a generous ``spark.sql.shuffle.partitions`` is safe.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the (runtime) settings on a session somebody else has built."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A local session, whose executors are threads of one machine, may do without: it
    gets a folder of its own. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] == "local":
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")
