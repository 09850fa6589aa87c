"""Report tables over clean and scored messages. Ties are broken, so every table is the same each time."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scale as S
from ..schema import SCORE_BANDS


def domain_counts(clean: DataFrame) -> DataFrame:
    return clean.where("registered_domain is not null").groupBy("registered_domain").agg(F.count("*").alias("rows"))


def top_domains(clean: DataFrame, n: int = 20) -> DataFrame:
    return domain_counts(clean).orderBy(F.desc("rows"), "registered_domain").limit(n)


def domain_coverage(clean: DataFrame, n: int = 128, share: str = "coverage_share") -> DataFrame:
    """How many domains there are, and what share of rows the ``n`` commonest hold (null without any)."""
    counts = domain_counts(clean)
    top = counts.orderBy(F.desc("rows"), "registered_domain").limit(n).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("top"))
    every = counts.agg(F.count("*").alias("unique_domains"), F.sum("rows").alias("total"))
    return every.crossJoin(F.broadcast(top)).select("unique_domains", (F.col("top") / F.when(F.col("total") > 0, F.col("total"))).alias(share))


def _top_authors(scores: DataFrame, order: list, n: int) -> DataFrame:
    return scores.orderBy(*order, "author_hash").limit(n)


def hourly_heavy_authors(scores: DataFrame, config: dict[str, Any], n: int = 50) -> DataFrame:
    return _top_authors(scores.where(F.col("max_posts_one_hour") > config["thresholds"]["hourly_penalty_start"]), [F.desc("max_posts_one_hour")], n)


def hourly_hard_authors(scores: DataFrame, n: int = 50) -> DataFrame:
    return _top_authors(scores.where("author_hard_hourly_flag = 1"), [F.desc("max_posts_one_hour")], n)


def language_diversity_authors(scores: DataFrame, config: dict[str, Any], n: int = 50) -> DataFrame:
    return _top_authors(scores.where(F.col("language_nunique") > config["thresholds"]["language_penalty_start"]), [F.desc("language_nunique")], n)


def rapid_fire_authors(scores: DataFrame, n: int = 50) -> DataFrame:
    return _top_authors(scores, [F.asc("median_interpost_sec")], n)


def hard_bot_examples(scored: DataFrame, n: int = 50) -> DataFrame:
    return scored.where("hard_bot_cluster_flag = 1 or hard_same_text_repeat_flag = 1").orderBy("message_id").limit(n)


def spam_examples(scored: DataFrame, component: str, n: int = 20) -> DataFrame:
    """Messages with the greatest value of a component, over all messages."""
    return scored.orderBy(F.desc(component), "message_id").limit(n)


def page(df: DataFrame, after: int, n: int) -> DataFrame:
    """The next ``n`` rows by message id."""
    return df.where(F.col("message_id") > after).orderBy("message_id").limit(n)


def keyword_validation(scored: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Keywords and lengths of messages with and without heavy repetition; always two rows."""
    heavy = (F.col("same_text_repeat_count") >= config["thresholds"]["spam_repeat_threshold"]) | (F.col("spam_pattern_flag") == 1)
    found = scored.groupBy(heavy.alias("is_heavy_message")).agg(
        F.sum("keyword_count").alias("k"), F.percentile("keyword_count", F.lit(0.5)).alias("median_keyword_count"), F.avg("text_length_chars").alias("avg_text_length"), F.count("*").alias("rows")
    )
    both = scored.sparkSession.range(2).select((F.col("id") == 1).alias("is_heavy_message"))
    rows = F.coalesce("rows", F.lit(0))
    return F.broadcast(both).join(found, "is_heavy_message", "left").select("is_heavy_message", (F.coalesce("k", F.lit(0)) / F.greatest(rows, F.lit(1))).alias("avg_keyword_count"), "median_keyword_count", "avg_text_length", rows.alias("rows"))


def band_of(score):
    """Name of the band that a score is in; upper bounds belong to their bands."""
    return reduce(lambda chain, b: chain.when(score <= b[0], b[1]), SCORE_BANDS[1:], F.when(score <= SCORE_BANDS[0][0], SCORE_BANDS[0][1]))


def score_bands(scored: DataFrame) -> DataFrame:
    """Messages of each band, empty ones included."""
    found = scored.groupBy(band_of(F.col("final_score")).alias("band")).agg(F.count("*").alias("n"))
    names = scored.sparkSession.range(len(SCORE_BANDS)).select(F.col("id").cast("int").alias("band_order"), F.array(*[F.lit(name) for _, name in SCORE_BANDS])[F.col("id").cast("int")].alias("band"))
    counted = names.join(found, "band", "left").select("band_order", "band", F.coalesce("n", F.lit(0)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # six rows
    return counted.withColumn("share", F.col("rows") / F.greatest(total, F.lit(1))).orderBy("band_order")


def semantic_summary(clean: DataFrame) -> DataFrame:
    score = F.col("roberta_score")
    return clean.agg(F.count("*").alias("rows"), F.avg(score).alias("avg_roberta_score"), F.min(score).alias("min_roberta_score"), F.max(score).alias("max_roberta_score"), F.sum(F.col("semantic_model_applied_flag").cast("long")).alias("semantic_applied_rows"))


def manipulation_map(scored: DataFrame, clean: DataFrame, min_rows: int = 25) -> DataFrame:
    """Mean score and hard flags of each language and domain with enough messages; missing values form groups too. ``clean`` is read
    only where scored messages lack language and domain."""
    context = ("language", "registered_domain")
    if not set(context) <= set(scored.columns):
        scored = scored.select("message_id", "final_score", "hard_bot_cluster_flag", "hard_same_text_repeat_flag").join(clean.select("message_id", *context), "message_id", "left")
    grouped = scored.groupBy("language", "registered_domain").agg(
        F.count("*").alias("rows"),
        F.avg("final_score").alias("avg_final_score"),
        F.sum(F.col("hard_bot_cluster_flag").cast("long")).alias("hard_cluster_rows"),
        F.sum(F.col("hard_same_text_repeat_flag").cast("long")).alias("hard_repeat_rows"),
    )
    out = grouped.where(F.col("rows") >= min_rows).withColumn("coordination_pressure", F.col("hard_cluster_rows") + F.col("hard_repeat_rows"))
    return out.orderBy(F.desc("avg_final_score"), F.desc("coordination_pressure"), F.desc("rows"), F.asc_nulls_last("language"), F.asc_nulls_last("registered_domain"))


def hourly_penalty_curve(scores: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The hourly penalty at each count from 1 to the greatest seen."""
    top = scores.agg(F.max("max_posts_one_hour").cast("long").alias("top")).where("top >= 1")
    points = top.select("top", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("posts"))
    return points.select("posts", S.log_penalty(F.col("posts"), config["thresholds"]["hourly_penalty_start"], F.col("top").cast("double")).alias("penalty"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal bins from the least to the greatest finite value, the last one closed: bin, low, high and count of those not empty."""
    x = F.col(column).cast("double")
    finite = df.where(F.abs(x) < float("inf")).select(x.alias("x"))
    ends = finite.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    wide = (F.col("b") - F.col("a")) / bins
    number = F.least(F.floor((F.col("x") - F.col("a")) / wide), F.lit(bins - 1)).cast("long")
    counted = finite.crossJoin(F.broadcast(ends)).groupBy(number.alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("a") + F.col("bin") * wide).alias("low"), (F.col("a") + (F.col("bin") + 1) * wide).alias("high"), "n")


def qa_tables(clean: DataFrame, scores: DataFrame, scored: DataFrame, summary: DataFrame, config: dict[str, Any]) -> dict[str, DataFrame]:
    """All report tables by name."""
    return {
        "summary": summary,
        "top_domains": top_domains(clean),
        "top128_coverage": domain_coverage(clean, 128, "top128_coverage_share"),
        "hourly_heavy_authors": hourly_heavy_authors(scores, config),
        "hourly_hard_authors": hourly_hard_authors(scores),
        "language_diversity_authors": language_diversity_authors(scores, config),
        "rapid_fire_examples": rapid_fire_authors(scores),
        "hard_bot_examples": hard_bot_examples(scored),
        "keyword_validation": keyword_validation(scored, config),
        "score_bands": score_bands(scored),
        "semantic_adapter_summary": semantic_summary(clean),
        "hashtag_spam_examples": spam_examples(scored, "hashtag_spam_component"),
        "token_spam_examples": spam_examples(scored, "token_repetition_component"),
        "derived_thresholds": derived_thresholds(clean.sparkSession, config),
    }


def derived_thresholds(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Name and value of each derived threshold, by name; no row without any."""
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(config.get("derived_thresholds", {}).items())], "threshold string, value string")


def manifest_table(spark: SparkSession, manifest: dict[str, Any]) -> DataFrame:
    fields = ("pipeline_version", "store_schema_version", "score_schema_version", "store_schema_fingerprint", "score_schema_fingerprint", "created_at", "last_rescore_at", "config_hash_for_store", "config_hash_for_scoring")
    rows = [(f, None if manifest.get(f) is None else str(manifest[f])) for f in fields]
    knee = manifest.get("derived_thresholds", {}).get("hourly_hard_knee")
    return spark.createDataFrame([*rows, ("hourly_hard_knee", None if knee is None else str(knee))], "field string, value string")
