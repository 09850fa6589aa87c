"""Messages scored as they arrive, against the tables of a finished run, and clusters counted over event time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..plans.score import Scored
from ..plans.single import explain_messages


def score_stream(raw: DataFrame, run: Scored, config: dict[str, Any], path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's explained scores as Parquet; the batch number partitions them, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        explain_messages(batch, run, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def window_clusters(raw: DataFrame, config: dict[str, Any], delay: str = "10 minutes") -> DataFrame:
    """Equal texts counted in time windows of a stream, late rows admitted for ``delay``."""
    text = X.normalized(F.col("original_text"), config["runtime"]["nfkc"])
    seconds = config["thresholds"]["hard_bot_time_window_sec"]
    rows = raw.select(X.text_hash(text).alias("text_hash"), F.col("date")).where("date is not null").withWatermark("date", delay)
    counted = rows.groupBy("text_hash", F.window("date", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("window_count"))
    return counted.select("text_hash", X.time_bucket(F.col("w.start"), seconds).alias("time_window_bucket"), "window_count")
