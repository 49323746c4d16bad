"""Streams of workbooks: a folder is followed, event time is a column like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.workbooks import FORMAT
from ..sources.datasource import register


def follow(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """A stream of the records of every workbook that is put into the folder."""
    register(spark)
    reader = spark.readStream.format(FORMAT).schema(schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(folder)


def tumbling_counts(events: DataFrame, time: str, late: str, width: str, key: str) -> DataFrame:
    """(start, key, events, total) by windows of event time; later than ``late`` is too late."""
    stream = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    counted = stream.groupBy(F.window("at", width), key).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "events", "total")
