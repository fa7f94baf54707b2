"""Running scores over streams of verdicts, first-wins deduplication, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.metrics import binary_metrics, confusion


def running_scores(preds: DataFrame, *keys: str) -> DataFrame:
    """Confusion cells and metrics of a stream so far; for output mode complete."""
    cells = preds.groupBy(*keys).agg(*confusion(F.col("pred"), F.col("truth")))
    return cells.select("*", *[v.alias(k) for k, v in binary_metrics().items()])


def first_wins(rows: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An exactly-once file sink over everything that is there now."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
