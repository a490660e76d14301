"""Response logs as streams: an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import entity_accuracy
from ..sources import schemas


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log folder as a stream, with the time at which a file came as event time."""
    rows = spark.readStream.schema(schemas.RESPONSES).json(path)
    return rows.withColumn("arrived", F.col("_metadata.file_modification_time"))


def first_answers(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each item, condition and model once while the watermark remembers it."""
    return stream.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["item_id", "condition", "model_label"])


def running_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy so far of each condition, for update or complete mode."""
    return scored.groupBy("condition").agg(*entity_accuracy().columns())


def accuracy_by_window(scored: DataFrame, time: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Accuracy in windows of event time; rows later than ``lateness`` are dropped by the watermark."""
    return scored.withWatermark(time, lateness).groupBy(F.window(time, width), "condition").agg(*entity_accuracy().columns())
