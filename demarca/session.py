"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change plans or results; cluster sizing stays with the operator of the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Needed by the Windows-1252 reader; harmless otherwise.
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(
    app: str = "demarca", master: str | None = None, shuffle_partitions: int | None = None, **extra: str
) -> SparkSession:
    """A session with the settings above; ``extra`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SETTINGS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
