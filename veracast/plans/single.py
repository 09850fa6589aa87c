"""New messages scored against a history: any number of rows, each explained."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clean_messages
from ..operators.clusters import text_cluster_counts, text_window_clusters
from ..operators.semantic import Scorer
from ..schema import EXPLANATION_COLUMNS
from .materialize import materialize
from .score import Scored, clean_store, cluster_messages, score_messages, score_store, without_texts


def score_against_store(raw: DataFrame, text_clusters: DataFrame, windows: DataFrame, author_scores: DataFrame, message_refs: DataFrame, config: dict[str, Any], scorer: Scorer | None = None) -> DataFrame:
    """New messages by the history's clusters alone; they do not count themselves, and an unknown author scores 0."""
    new = clean_messages(raw, config, scorer)
    df = score_messages(cluster_messages(new, text_clusters, windows, config), author_scores, message_refs, config, unknown_author=0.0)
    return df.select("message_id", *EXPLANATION_COLUMNS)


def score_with_history(raw: DataFrame, history: DataFrame, config: dict[str, Any], scorer: Scorer | None = None) -> DataFrame:
    """New messages together with the raw history, themselves counted; an author unknown before has no score."""
    return score_with_store(raw, clean_store(history, config, scorer), config, scorer)


def score_with_store(raw: DataFrame, store: DataFrame, config: dict[str, Any], scorer: Scorer | None = None) -> DataFrame:
    """As ``score_with_history``, with a history that is clean and has no duplicates."""
    old = score_store(without_texts(store), config, keep=materialize)
    new = clean_messages(raw, config, scorer).withColumn("message_id", -1 - F.col("message_id"))
    counted = ("text_hash", "author_hash", "time_window_bucket")
    both = old.clean.select(*counted).union(new.select(*counted))
    ours = cluster_messages(new, text_cluster_counts(both), text_window_clusters(both), config)
    df = score_messages(ours, old.author_scores, old.message_refs, config)
    return df.withColumn("message_id", -1 - F.col("message_id")).select("message_id", *EXPLANATION_COLUMNS)


def explain_messages(raw: DataFrame, run: Scored, config: dict[str, Any], scorer: Scorer | None = None) -> DataFrame:
    return score_against_store(raw, run.cluster_counts, run.text_window_clusters, run.author_scores, run.message_refs, config, scorer)
