"""Session settings every stage relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Master, memory and spark.checkpoint.dir come from spark-submit or the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a heavy meter even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def settle(spark: SparkSession) -> SparkSession:
    """Give a session someone else started the settings that the plans count on."""
    for name, value in SETTINGS.items():
        if spark.conf.isModifiable(name):
            spark.conf.set(name, value)
    return spark


def session(app_name: str = "gridloom") -> SparkSession:
    """The active session or a new one, either with the settings above."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return settle(active)
    return SparkSession.builder.appName(app_name).config(map=SETTINGS).getOrCreate()
