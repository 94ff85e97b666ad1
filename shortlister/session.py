"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC; sizes are left to the cluster unless given."""
    b = SparkSession.builder.appName("shortlister").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
