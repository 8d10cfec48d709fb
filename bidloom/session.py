"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results depend on these: UTC instants, strict casts, later entries winning in merged maps.
SEMANTIC = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configured(spark: SparkSession) -> SparkSession:
    """spark with the settings that results rely on; sizes and memory stay the cluster's own."""
    for key, value in SEMANTIC.items():
        spark.conf.set(key, value)
    return spark


def local(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configured(spark)
