"""A local session with the settings that the queries are tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "4m"}
    spark = SparkSession.builder.master(master).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
