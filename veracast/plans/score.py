"""The whole computation as one lazy plan: raw messages in, scored messages out."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import authors, clean, clusters, fuse, messages
from ..operators.semantic import Scorer
from .materialize import lazily


class Scored:
    """The tables of a run. Each is worked out when it is first asked for, so that no query pays for one it does not read;
    ``keep`` is given each table that several others read."""

    def __init__(self, store: DataFrame, config: dict[str, Any], text: DataFrame | None, windows: DataFrame | None, keep: Callable[[DataFrame, str], DataFrame]) -> None:
        self._store, self._text, self._windows, self._config, self._keep = store, text, windows, config, keep
        self._by_quantile = config["runtime"]["refs_mode"] == "quantile"

    @cached_property
    def clean(self) -> DataFrame:
        return self._keep(self._store, "messages")

    @cached_property
    def cluster_counts(self) -> DataFrame:
        return self._keep(clusters.text_cluster_counts(self.clean), "text-clusters") if self._text is None else self._text

    @cached_property
    def text_clusters(self) -> DataFrame:
        """With their texts where the store has them."""
        return clusters.with_texts(self.cluster_counts, self.clean) if self._text is None and "normalized_text" in self.clean.columns else self.cluster_counts

    @cached_property
    def text_window_clusters(self) -> DataFrame:
        return self._keep(clusters.text_window_clusters(self.clean), "window-clusters") if self._windows is None else self._windows

    @cached_property
    def author_features(self) -> DataFrame:
        return self._keep(authors.author_features(self.clean, self.cluster_counts), "author-features")

    @cached_property
    def author_refs(self) -> DataFrame:
        return self._keep(authors.author_refs(self.author_features), "author-refs")

    @cached_property
    def author_scores(self) -> DataFrame:
        return self._keep(authors.author_scores(self.author_features, self.author_refs, self._config), "author-scores")

    @cached_property
    def clustered(self) -> DataFrame:
        df = cluster_messages(self.clean, self.cluster_counts, self.text_window_clusters, self._config)
        return self._keep(df, "clustered") if self._by_quantile else df  # else read once

    @cached_property
    def message_refs(self) -> DataFrame:
        refs = messages.message_refs_quantile(self.clustered, self._config) if self._by_quantile else messages.message_refs(self.clean, self.cluster_counts, self.text_window_clusters, self._config)
        return self._keep(refs, "message-refs")

    @cached_property
    def scored(self) -> DataFrame:
        return self._keep(score_messages(self.clustered, self.author_scores, self.message_refs, self._config), "scored")


#: What scoring does not read: texts, and what only cleaning and deduplication need.
_UNREAD = ("original_text", "normalized_text", "english_keywords_clean", "main_emotion", "url", "raw_url_domain", "subdomain", "row_fingerprint", "original_hash")


def without_texts(store: DataFrame) -> DataFrame:
    """Clean messages with all that scoring reads, but none of the long columns, which would go through its every exchange."""
    return store.drop(*_UNREAD)


def languages_kept(rows: DataFrame, config: dict[str, Any]) -> DataFrame | None:
    """The languages of the rows that are not rare, where a run marks rare ones."""
    return clean.common_languages(rows, config) if config["runtime"]["refs_mode"] == "quantile" else None


def clean_rows(raw: DataFrame, config: dict[str, Any], scorer: Scorer | None = None) -> DataFrame:
    """Every raw message cleaned."""
    rows = clean.with_message_id(raw)
    return clean.clean_messages(rows, config, scorer, languages_kept(rows, config))


def deduplicated(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    return rows if config["runtime"]["dedup_scope"] == "none" else clean.drop_duplicates(rows)


def clean_store(raw: DataFrame, config: dict[str, Any], scorer: Scorer | None = None) -> DataFrame:
    """Clean, deduplicated messages."""
    return deduplicated(clean_rows(raw, config, scorer), config)


def cluster_messages(store: DataFrame, text: DataFrame, windows: DataFrame, config: dict[str, Any]) -> DataFrame:
    df = clusters.attach_clusters(store, text, windows, config["runtime"]["null_text_mode"])
    if "exclamation_count" not in df.columns:  # the lean store leaves it out
        df = df.withColumn("exclamation_count", X.exclamations(F.col("normalized_text")))
    return clusters.with_cluster_flags(df, config)


def score_store(store: DataFrame, config: dict[str, Any], text: DataFrame | None = None, windows: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lazily) -> Scored:
    """Scores of clean messages. ``keep`` is given each table that several others read (``materialize`` stores them). With ``refs_mode`` "quantile" ranges come from quantiles over all messages."""
    return Scored(store, config, text, windows, keep)


def score_messages(clustered: DataFrame, scores: DataFrame, refs: DataFrame, config: dict[str, Any], unknown_author: float | None = None) -> DataFrame:
    """Clustered messages with message, behavioral and final scores."""
    df = messages.message_scores(clustered, refs, config)
    df = fuse.attach_authors(df, scores, unknown_author)
    return fuse.final_score(fuse.behavioral_score(df, config), config)
