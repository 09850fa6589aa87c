"""Column contracts, versions and fixed vocabularies."""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T

PIPELINE_VERSION, STORE_SCHEMA_VERSION, SCORE_SCHEMA_VERSION = "1.0.0", "1", "1"

#: Texts that mean a missing value, after trimming and lower-casing.
MISSING = ("", "nan", "null", "none", "n/a")

#: Public suffixes of two parts.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "com.tr", "com.mx", "co.in", "com.cn")

RAW_MESSAGE = T.StructType(
    [
        T.StructField("original_text", T.StringType()),
        T.StructField("english_keywords", T.StringType()),
        T.StructField("sentiment", T.DoubleType()),
        T.StructField("main_emotion", T.StringType()),
        T.StructField("primary_theme", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("author_hash", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)

#: Columns of the stored clean messages, in order, after the message id.
LEAN_COLUMNS = (
    "row_fingerprint",
    "original_text",
    "normalized_text",
    "text_hash",
    "keyword_count",
    "primary_theme",
    "sentiment",
    "language",
    "registered_domain",
    "date",
    "time_window_bucket",
    "author_hash",
    "author_type",
    "author_hash_missing_flag",
    "text_length_chars",
    "token_count",
    "unique_token_count",
    "max_token_frequency",
    "max_token_ratio",
    "repeated_token_count_over_2",
    "hashtag_count",
    "hashtag_density_chars",
    "hashtag_density_tokens",
    "roberta_score",
    "semantic_model_applied_flag",
    "is_short_text",
    "is_long_text_flag",
    "is_empty_text",
)
#: Further columns of a debug store.
DEBUG_COLUMNS = ("english_keywords_clean", "main_emotion", "url", "raw_url_domain", "subdomain")

#: Columns that a store must have.
REQUIRED_STORE = (
    "message_id",
    "original_text",
    "normalized_text",
    "text_hash",
    "keyword_count",
    "time_window_bucket",
    "author_hash",
    "author_type",
    "text_length_chars",
    "token_count",
    "unique_token_count",
    "max_token_frequency",
    "max_token_ratio",
    "repeated_token_count_over_2",
    "hashtag_count",
    "hashtag_density_chars",
    "hashtag_density_tokens",
    "roberta_score",
    "semantic_model_applied_flag",
    "is_long_text_flag",
)
STORE_TABLES = ("cleaned_messages", "text_clusters", "text_window_clusters")
#: Columns that author scores must have.
REQUIRED_AUTHOR_SCORES = ("author_hash", "author_score", "author_hard_hourly_flag", "max_posts_one_hour", "language_nunique", "theme_nunique", "sentiment_std", "median_interpost_sec")
#: Columns of scored messages, in order.
SCORED_COLUMNS = (
    "message_id",
    "author_hash",
    "author_type",
    "normalized_text",
    "same_text_repeat_count",
    "same_text_unique_author_count",
    "same_text_time_window_count",
    "hashtag_count",
    "exclamation_count",
    "max_token_frequency",
    "max_token_ratio",
    "spam_pattern_flag",
    "hard_bot_cluster_flag",
    "hard_same_text_repeat_flag",
    "author_hard_hourly_flag",
    "author_score",
    "message_score",
    "behavioral_score",
    "roberta_score",
    "behavioral_confidence_weight",
    "roberta_confidence_weight",
    "behavioral_effective_weight",
    "roberta_effective_weight",
    "final_score_before_rules",
    "final_score",
)
REQUIRED_SCORED = tuple(c for c in SCORED_COLUMNS if c not in ("normalized_text", "exclamation_count"))
#: Columns of an explained message, in order.
EXPLANATION_COLUMNS = (
    "author_type",
    "message_score",
    "author_score",
    "behavioral_score",
    "roberta_score",
    "behavioral_confidence_weight",
    "roberta_confidence_weight",
    "behavioral_effective_weight",
    "roberta_effective_weight",
    "final_score_before_rules",
    "final_score",
    "same_text_repeat_component",
    "spam_pattern_component",
    "hashtag_spam_component",
    "token_repetition_component",
    "long_text_component",
    "keyword_signal_component",
    "author_hard_hourly_flag",
    "hard_bot_cluster_flag",
    "hard_same_text_repeat_flag",
)
#: Upper bounds of the score bands, each included, and their names.
SCORE_BANDS = ((0.4, "0.00-0.40"), (0.6, "0.40-0.60"), (0.7, "0.60-0.70"), (0.85, "0.70-0.85"), (0.999999, "0.85-<1.0"), (1.000001, "1.0"))


def store_columns(build_mode: str) -> tuple[str, ...]:
    """Stored columns in order; "debug" adds to the lean ones what they lack."""
    return LEAN_COLUMNS + (tuple(c for c in DEBUG_COLUMNS if c not in LEAN_COLUMNS) if build_mode == "debug" else ())


def fingerprint(columns) -> str:
    """SHA-256 of the sorted column names."""
    return hashlib.sha256("\n".join(sorted(columns)).encode()).hexdigest()
