"""Registered queries of the risk engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import make_config
from .functions import scale as S
from .functions import text as X
from .operators import authors, clean, clusters, messages, reports
from .operators.semantic import ExpressionScorer, NeutralScorer, scorer_for
from .plans.materialize import materialize
from .plans.score import Scored, cluster_messages, deduplicated, languages_kept, score_store, without_texts
from .plans.single import explain_messages, score_with_store
from .sources.messages import table_rows_as_messages

Query = Callable[[SparkSession, str], DataFrame]

#: The defaults; SQL has no compatibility form, which the driver's texts are in already.
CONFIG = make_config()
#: A day's window and a low hourly limit, so that the time rules fire on this data.
DAY = make_config({"thresholds": {"hard_bot_time_window_sec": 86_400, "hard_hourly_bot_threshold": 5}})
#: No floor, a made-up semantic score and supported languages, so that every weight shows.
SEMANTIC = make_config({"dominant_signal_policy": {"enabled": False}, "semantic_adapter": {"supported_languages": ["all"]}})
#: Ranges from quantiles over all messages, and missing texts in no cluster.
QUANTILE = make_config({"runtime": {"refs_mode": "quantile", "null_text_mode": "ignore"}, "dominant_signal_policy": {"enabled": False}})
#: Ranges from quantiles, for messages scored with a history.
HISTORY = make_config({"runtime": {"refs_mode": "quantile"}})
STUB = ExpressionScorer(lambda: F.pmod(F.col("message_id"), F.lit(101)) / 100.0)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_rows_as_messages(spark, sf_dir)


def _store(spark: SparkSession, sf_dir: str, config: dict[str, Any] = CONFIG) -> DataFrame:
    """Clean, deduplicated messages. Texts are worked on where they lie, so that only those a query returns go through the joins."""
    scorer = STUB if config is SEMANTIC else scorer_for(config)
    rows = table_rows_as_messages(spark, sf_dir, lambda own: scorer.apply(clean.clean_texts(own, config), config))
    return deduplicated(clean.clean_contexts(rows, config, languages_kept(_messages(spark, sf_dir), config)), config)


def _kept(spark: SparkSession, sf_dir: str, config: dict[str, Any] = CONFIG) -> DataFrame:
    """What scoring reads of the store, written once."""
    return materialize(without_texts(_store(spark, sf_dir, config)), "messages")


def _run(spark: SparkSession, sf_dir: str, config: dict[str, Any] = CONFIG) -> Scored:
    """Scored messages, which most queries read once, are not kept."""
    return score_store(without_texts(_store(spark, sf_dir, config)), config, keep=lambda df, name: df if name == "scored" else materialize(df, name))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (never minus zero), small integers as long, times left alone: what engines agree on."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return (F.round(F.col(c).cast("double"), 6) + 0.0).alias(c)
        return F.col(c).cast("long").alias(c) if kinds[c] in ("tinyint", "smallint", "int") else F.col(c)

    return df.select(*map(one, df.columns))


REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTERED[function.__name__] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
    return function


@query
def scan_messages(spark, sf_dir):
    return _messages(spark, sf_dir).withColumn("date_us", F.unix_micros("date")).drop("date")


@query
def clean_missing(spark, sf_dir):
    df = _messages(spark, sf_dir)
    return df.select("message_id", *(X.missing_to_null(F.col(c)).alias(c) for c in ("original_text", "primary_theme", "author_hash")))


@query
def clean_text(spark, sf_dir):
    return _messages(spark, sf_dir).select("message_id", X.normalized(F.col("original_text"), nfkc=True).alias("normalized_text"))


@query
def clean_keywords(spark, sf_dir):
    return _messages(spark, sf_dir).select("message_id", X.keywords(F.col("english_keywords")).alias("english_keywords_clean"))


@query
def keyword_count(spark, sf_dir):
    return _messages(spark, sf_dir).select("message_id", X.keyword_count(X.keywords(F.col("english_keywords"))).alias("keyword_count"))


STATISTICS = ("token_count", "unique_token_count", "max_token_frequency", "max_token_ratio", "repeated_token_count_over_2", "hashtag_count", "exclamation_count", "hashtag_density_chars", "hashtag_density_tokens")


@query
def text_stats(spark, sf_dir):
    return _store(spark, sf_dir).select("message_id", "text_length_chars", "token_count", "unique_token_count", "hashtag_count", "exclamation_count", "hashtag_density_chars", "hashtag_density_tokens")


@query
def token_repetition(spark, sf_dir):
    return _store(spark, sf_dir).select("message_id", "max_token_frequency", "max_token_ratio", "repeated_token_count_over_2")


@query
def semantic_text(spark, sf_dir):
    df = _messages(spark, sf_dir)
    return df.select("message_id", X.semantic_input(X.normalized(F.col("original_text"))).alias("semantic_text"))


@query
def domain_parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.domain_parts(F.col("url")).alias("d")).select("page_id", "d.*")


@query
def text_hash(spark, sf_dir):
    return _messages(spark, sf_dir).select("message_id", X.text_hash(X.normalized(F.col("original_text"))).alias("text_hash"))


@query
def time_bucket(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.time_bucket(ts, 300).alias("time_window_bucket"))


@query
def message_flags(spark, sf_dir):
    return _store(spark, sf_dir).select("message_id", "author_type", "author_hash_missing_flag", "is_empty_text", "is_short_text", "is_long_text_flag")


CLEAN_COLUMNS = ("message_id", "original_text", "normalized_text", "text_hash", "english_keywords_clean", "keyword_count", "primary_theme", "sentiment", "language", "registered_domain", "time_window_bucket", "author_hash", "author_type", "text_length_chars", *STATISTICS)


@query
def clean_messages(spark, sf_dir):
    return clean.clean_messages(_messages(spark, sf_dir), CONFIG).select(*CLEAN_COLUMNS)


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, and every third of them once more under a later id."""
    df = _messages(spark, sf_dir)
    return df.union(df.where("message_id % 3 = 0").withColumn("message_id", F.col("message_id") + 10_000_000))


@query
def row_fingerprint_groups(spark, sf_dir):
    df = clean.clean_messages(_twice(spark, sf_dir), CONFIG)
    sizes = df.groupBy("row_fingerprint").agg(F.count("*").alias("copies"))
    return sizes.groupBy("copies").agg(F.count("*").alias("fingerprints"))


@query
def dedup_messages(spark, sf_dir):
    return clean.drop_duplicates(clean.clean_messages(_twice(spark, sf_dir), CONFIG)).select("message_id", "text_hash", "author_hash")


@query
def clean_summary(spark, sf_dir):
    df = clean.clean_messages(_twice(spark, sf_dir), CONFIG)
    return clean.clean_summary(df, clean.drop_duplicates(df))


@query
def language_counts(spark, sf_dir):
    return clean.language_counts(_messages(spark, sf_dir))


@query
def rare_languages(spark, sf_dir):
    return clean.rare_languages(_messages(spark, sf_dir), make_config({"thresholds": {"rare_language_threshold": 140}}))


@query
def text_clusters(spark, sf_dir):
    store = _store(spark, sf_dir).select("message_id", "text_hash", "author_hash", "normalized_text")
    return clusters.text_clusters(materialize(store, "messages"))  # read twice


@query
def text_window_clusters(spark, sf_dir):
    return clusters.text_window_clusters(_store(spark, sf_dir, DAY))


def _clustered(spark: SparkSession, sf_dir: str, config: dict[str, Any]) -> DataFrame:
    store = _kept(spark, sf_dir, config)
    return cluster_messages(store, clusters.text_cluster_counts(store), clusters.text_window_clusters(store), config)


@query
def message_cluster_join(spark, sf_dir):
    return _clustered(spark, sf_dir, DAY).select("message_id", *messages.COUNTS)


@query
def spam_pattern_flag(spark, sf_dir):
    return _clustered(spark, sf_dir, DAY).groupBy("spam_pattern_flag").agg(F.count("*").alias("rows"), F.sum("message_id").alias("ids"))


@query
def hard_bot_cluster_flag(spark, sf_dir):
    return _clustered(spark, sf_dir, DAY).groupBy("hard_bot_cluster_flag").agg(F.count("*").alias("rows"), F.sum("message_id").alias("ids"))


@query
def interpost_gaps(spark, sf_dir):
    return authors.interpost_gaps(authors.known_posts(_store(spark, sf_dir)))


@query
def author_activity(spark, sf_dir):
    return authors.activity(authors.known_posts(_store(spark, sf_dir)))


@query
def author_max_hourly(spark, sf_dir):
    return authors.max_hourly(authors.known_posts(_store(spark, sf_dir)))


@query
def author_hourly_distribution(spark, sf_dir):
    df = authors.hourly_distribution(authors.known_posts(_store(spark, sf_dir)))
    return df.select("author_hash", F.array_join(F.transform("hourly_post_distribution", lambda n: n.cast("string")), ",").alias("hourly_post_distribution"))


@query
def author_timing(spark, sf_dir):
    return authors.timing(authors.known_posts(_store(spark, sf_dir)))


@query
def author_repetition(spark, sf_dir):
    return authors.repetition(authors.known_posts(_store(spark, sf_dir)))


@query
def author_multi_author_ratio(spark, sf_dir):
    store = _kept(spark, sf_dir)
    return authors.multi_author_ratio(authors.known_posts(store), clusters.text_cluster_counts(store))


@query
def author_features(spark, sf_dir):
    store = _kept(spark, sf_dir)
    df = authors.author_features(store, clusters.text_cluster_counts(store))
    return df.withColumns({c: F.when(F.col(c) < float("inf"), F.col(c)).otherwise(-1.0) for c in ("mean_interpost_sec", "median_interpost_sec", "p10_interpost_sec", "interval_cv")}).drop("std_interpost_sec")


def _flat(refs: DataFrame) -> DataFrame:
    out = []
    for field in refs.schema.fields:
        out += [F.col(f"{field.name}.{p}").alias(f"{field.name}_{p}") for p in ("lo", "hi")] if field.dataType.typeName() == "struct" else [F.col(field.name)]
    return refs.select(*out)


@query
def author_refs(spark, sf_dir):
    return _flat(_run(spark, sf_dir).author_refs)


AUTHOR_COLUMNS = ("author_hash", "activity_component", "timing_component", "repetition_component", "diversity_component", "metadata_component", "author_score", "author_hard_hourly_flag", "max_posts_one_hour", "language_nunique", "theme_nunique", "sentiment_std")


@query
def author_scores(spark, sf_dir):
    return _run(spark, sf_dir, DAY).author_scores.select(*AUTHOR_COLUMNS)


@query
def message_refs(spark, sf_dir):
    return _flat(_run(spark, sf_dir, DAY).message_refs)


@query
def message_refs_quantile(spark, sf_dir):
    return _flat(messages.message_refs_quantile(_clustered(spark, sf_dir, DAY), DAY))


@query
def bounded_scale(spark, sf_dir):
    v, lo, hi = F.col("l_quantity"), F.lit(10.0), F.lit(40.0)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_quantity").agg(F.count("*").alias("n")).select(F.col("l_quantity").cast("double").alias("v"), "n", S.bounded(v, lo, hi).alias("scaled"), S.inverse_bounded(v, lo, hi).alias("inverse"))


@query
def log_penalty(spark, sf_dir):
    x = F.col("l_quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_quantity").agg(F.count("*").alias("n")).select(x.cast("double").alias("v"), "n", S.log_penalty(x, 10, F.lit(50.0)).alias("penalty"))


MESSAGE_COLUMNS = ("message_id", *(f"{k}_component" for k in ("same_text_repeat", "spam_pattern", "hashtag_spam", "token_repetition", "long_text", "keyword_signal")), "message_score", "hard_same_text_repeat_flag")


@query
def message_scores(spark, sf_dir):
    return _run(spark, sf_dir, SEMANTIC).scored.select(*MESSAGE_COLUMNS)


@query
def behavioral_scores(spark, sf_dir):
    return _run(spark, sf_dir, SEMANTIC).scored.select("message_id", "author_type", "author_score", "message_score", "behavioral_score")


FINAL_COLUMNS = ("message_id", "behavioral_score", "roberta_score", "behavioral_confidence_weight", "roberta_confidence_weight", "behavioral_effective_weight", "roberta_effective_weight", "final_score_before_rules", "final_score")


@query
def final_scores(spark, sf_dir):
    """With the default floor and no model."""
    return _run(spark, sf_dir).scored.select(*FINAL_COLUMNS)


@query
def final_scores_semantic(spark, sf_dir):
    """Without the floor, with a made-up semantic score."""
    return _run(spark, sf_dir, SEMANTIC).scored.select(*FINAL_COLUMNS)


@query
def final_scores_quantile(spark, sf_dir):
    """With ranges from quantiles, without the floor and without missing texts' cluster."""
    return _run(spark, sf_dir, QUANTILE).scored.select(*FINAL_COLUMNS)


@query
def final_score_histogram(spark, sf_dir):
    scores = materialize(_run(spark, sf_dir, SEMANTIC).scored.select("final_score"), "scores")  # read twice
    return reports.histogram(scores, "final_score", 40)


@query
def semantic_neutral(spark, sf_dir):
    df = NeutralScorer().apply(_messages(spark, sf_dir).select("message_id"), CONFIG)
    return df.groupBy("roberta_score", "semantic_model_applied_flag").agg(F.count("*").alias("rows"))


@query
def semantic_summary(spark, sf_dir):
    return reports.semantic_summary(_store(spark, sf_dir, SEMANTIC))


@query
def keyword_validation(spark, sf_dir):
    return reports.keyword_validation(_clustered(spark, sf_dir, DAY), DAY)


@query
def score_bands(spark, sf_dir):
    return reports.score_bands(_run(spark, sf_dir, SEMANTIC).scored)


@query
def manipulation_map(spark, sf_dir):
    run = _run(spark, sf_dir, SEMANTIC)
    return reports.manipulation_map(run.scored, run.clean, 5)


@query
def top_domains(spark, sf_dir):
    return reports.top_domains(_store(spark, sf_dir))


@query
def domain_coverage(spark, sf_dir):
    return reports.domain_coverage(_store(spark, sf_dir), 3)


@query
def top128_coverage(spark, sf_dir):
    return reports.domain_coverage(_store(spark, sf_dir), 128, "top128_coverage_share")


_AUTHOR_REPORT = ("author_hash", "author_score", "max_posts_one_hour", "language_nunique", "total_posts")


@query
def hourly_heavy_authors(spark, sf_dir):
    config = make_config({"thresholds": {"hourly_penalty_start": 1}})
    return reports.hourly_heavy_authors(_run(spark, sf_dir).author_scores, config).select(*_AUTHOR_REPORT)


@query
def hourly_hard_authors(spark, sf_dir):
    return reports.hourly_hard_authors(_run(spark, sf_dir, DAY).author_scores).select(*_AUTHOR_REPORT)


@query
def language_diversity_authors(spark, sf_dir):
    config = make_config({"thresholds": {"language_penalty_start": 2}})
    return reports.language_diversity_authors(_run(spark, sf_dir).author_scores, config).select(*_AUTHOR_REPORT)


@query
def rapid_fire_authors(spark, sf_dir):
    df = reports.rapid_fire_authors(_run(spark, sf_dir).author_scores)
    return df.select(*_AUTHOR_REPORT, F.when(F.col("median_interpost_sec") < float("inf"), F.col("median_interpost_sec")).alias("median_interpost_sec"))


@query
def hourly_penalty_curve(spark, sf_dir):
    return reports.hourly_penalty_curve(_run(spark, sf_dir).author_scores, CONFIG)


@query
def hourly_histogram(spark, sf_dir):
    return reports.histogram(_run(spark, sf_dir).author_scores, "max_posts_one_hour", 40)


@query
def theme_histogram(spark, sf_dir):
    return reports.histogram(_run(spark, sf_dir).author_scores, "theme_nunique", 30)


@query
def sentiment_histogram(spark, sf_dir):
    return reports.histogram(_run(spark, sf_dir).author_scores, "sentiment_std", 30).select("bin", "n")


@query
def hashtag_spam_examples(spark, sf_dir):
    return reports.spam_examples(_run(spark, sf_dir, SEMANTIC).scored, "hashtag_spam_component").select("message_id", "hashtag_spam_component", "final_score")


@query
def token_spam_examples(spark, sf_dir):
    return reports.spam_examples(_run(spark, sf_dir, SEMANTIC).scored, "token_repetition_component").select("message_id", "token_repetition_component", "final_score")


@query
def hard_bot_examples(spark, sf_dir):
    return reports.hard_bot_examples(_run(spark, sf_dir, DAY).scored).select("message_id", "author_hash", *messages.COUNTS, "hard_same_text_repeat_flag", "final_score")


@query
def message_page(spark, sf_dir):
    return reports.page(_store(spark, sf_dir).select("message_id", "text_hash"), 100, 25)


#: New messages for single scoring: a known hot author with a text of the history, an anonymous and an unknown one.
NEW_MESSAGES = "SELECT 1L AS message_id, 'Bot bot bot #promo !!!' AS original_text, 'bot, promo' AS english_keywords, 'u_hot' AS author_hash, TIMESTAMP '2024-01-01 00:00:00' AS date UNION ALL SELECT 2L, 'Quite a new text about nothing in particular', NULL, NULL, NULL UNION ALL SELECT 3L, '#a #b #c #d #e #f', 'x', 'nobody', NULL"


@query
def score_single(spark, sf_dir):
    return explain_messages(spark.sql(NEW_MESSAGES), _run(spark, sf_dir), CONFIG)


@query
def score_single_with_history(spark, sf_dir):
    return score_with_store(spark.sql(NEW_MESSAGES), _store(spark, sf_dir, HISTORY), HISTORY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTERED["final_scores"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)


