"""Session settings the plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode: let larger
    # fused stages fall back to generated code in smaller pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Totals and seen pages of a stream live on executors' disks; keyed state of
    # the processor kind is kept by this store only.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A filter makes the planner derive constraints from every column of every
    # projection under it; over the scorer's chain that takes minutes.
    "spark.sql.constraintPropagation.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes of shuffles are left to the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def require_configured(spark: SparkSession) -> None:
    """The scorer changes no settings itself: it asks for the one that its plans cannot do without."""
    key = "spark.sql.constraintPropagation.enabled"
    if spark.conf.get(key) != SETTINGS[key]:
        raise ValueError(f"call sparkcomments.configure(spark), or set {key} to {SETTINGS[key]}, before scoring")
