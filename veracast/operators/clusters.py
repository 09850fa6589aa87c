"""Clusters of equal texts, over all time and in time windows, and the flags they give."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_cluster_counts(clean: DataFrame) -> DataFrame:
    """Rows and distinct known authors of each text, by its hash. Missing texts form one cluster.

    Counting goes by (text, author) first, so a text with very many rows is summed up before it meets in one place.
    """
    by_author = clean.groupBy("text_hash", "author_hash").agg(F.count("*").alias("n"))
    return by_author.groupBy("text_hash").agg(F.sum("n").alias("repeat_count"), F.count("author_hash").alias("unique_author_count"))


def with_texts(counts: DataFrame, clean: DataFrame) -> DataFrame:
    """Cluster counts with each cluster's text, which no aggregate carries: one row a hash goes through the exchange."""
    first = F.row_number().over(Window.partitionBy("text_hash").orderBy("message_id"))
    texts = clean.select("text_hash", "message_id", "normalized_text").withColumn("_n", first).where("_n = 1").select("text_hash", "normalized_text")
    return counts.join(texts, "text_hash").select("text_hash", "normalized_text", "repeat_count", "unique_author_count")


def text_clusters(clean: DataFrame) -> DataFrame:
    return with_texts(text_cluster_counts(clean), clean)


def text_window_clusters(clean: DataFrame) -> DataFrame:
    return clean.where("time_window_bucket is not null").groupBy("text_hash", "time_window_bucket").agg(F.count("*").alias("window_count"))


def attach_clusters(clean: DataFrame, clusters: DataFrame, windows: DataFrame, null_text_mode: str = "cluster") -> DataFrame:
    """Clean rows with same_text_repeat_count, same_text_unique_author_count and same_text_time_window_count, 0 where there is none."""
    names = {"repeat_count": "same_text_repeat_count", "unique_author_count": "same_text_unique_author_count", "window_count": "same_text_time_window_count"}
    df = clean.join(clusters.select("text_hash", "repeat_count", "unique_author_count"), "text_hash", "left").join(windows, ["text_hash", "time_window_bucket"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    if null_text_mode == "ignore":
        missing = F.col("is_empty_text") == 1 if "is_empty_text" in clean.columns else F.col("normalized_text").isNull()
        count = lambda c: F.when(missing, 0).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("long")
    return df.withColumns({new: count(old) for old, new in names.items()}).drop(*names)


def spam_pattern_flag(config: dict[str, Any]) -> Column:
    t = config["thresholds"]
    return (
        (F.col("same_text_repeat_count") >= t["spam_repeat_threshold"])
        | (F.col("same_text_unique_author_count") >= t["spam_multi_author_threshold"])
        | (F.col("same_text_time_window_count") >= t["spam_time_cluster_threshold"])
    ).cast("byte")


def hard_bot_cluster_flag(config: dict[str, Any]) -> Column:
    t = config["thresholds"]
    return (
        (F.col("same_text_repeat_count") >= t["hard_bot_repeat_threshold"])
        & (F.col("same_text_unique_author_count") >= t["hard_bot_multi_author_threshold"])
        & (F.col("same_text_time_window_count") >= t["hard_bot_time_cluster_threshold"])
    ).cast("byte")


def with_cluster_flags(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    return df.withColumns({"spam_pattern_flag": spam_pattern_flag(config), "hard_bot_cluster_flag": hard_bot_cluster_flag(config)})
