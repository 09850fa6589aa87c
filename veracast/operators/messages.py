"""What a message itself looks like: components, score and hard rules."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scale as S
from .authors import quantile_range
from .quantiles import column_quantiles

COUNTS = ("same_text_repeat_count", "same_text_unique_author_count", "same_text_time_window_count")
FEATURES = (*COUNTS, "hashtag_count", "hashtag_density_chars", "hashtag_density_tokens", "max_token_frequency", "max_token_ratio", "repeated_token_count_over_2", "keyword_count", "text_length_chars")


def message_refs(clean: DataFrame, clusters: DataFrame, windows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One row of ranges (0, greatest value seen), each from the smallest table that has it."""
    start = float(config["thresholds"]["long_text_start"])
    top = lambda c, name: F.coalesce(F.max(c).cast("double"), F.lit(1.0)).alias(name)
    own = clean.agg(*(top(c, c) for c in FEATURES if c not in COUNTS))
    ours = clusters.agg(top("repeat_count", COUNTS[0]), top("unique_author_count", COUNTS[1]))
    theirs = windows.agg(top("window_count", COUNTS[2]))
    one = own.crossJoin(F.broadcast(ours)).crossJoin(F.broadcast(theirs))
    return one.select(*(F.struct(F.lit(0.0).alias("lo"), F.col(c).alias("hi")).alias(c) for c in FEATURES), F.greatest(F.col("text_length_chars") - start, F.lit(1.0)).alias("long_text_excess_max"))


def message_refs_quantile(messages: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One row of ranges from the 5 % to the 99 % quantile over clustered messages."""
    start = float(config["thresholds"]["long_text_start"])
    found = column_quantiles(messages, {c: (0.05, 0.99) for c in FEATURES} | {"text_length_chars": (0.05, 0.99, 1.0)})
    excess = F.greatest(F.coalesce(F.col("text_length_chars")[2] - start, F.lit(1.0)), F.lit(1.0))
    return found.select(*(quantile_range(F.col(c)).alias(c) for c in FEATURES), excess.alias("long_text_excess_max"))


def message_scores(messages: DataFrame, refs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Clustered messages with spam_pattern_flag, plus their components, hard repeat flag and message_score."""
    w, policy = config["weights"]["message"], config["dominant_signal_policy"]
    df = messages.crossJoin(F.broadcast(refs.select(F.struct(*refs.columns).alias("r"))))
    up = lambda c: S.bounded_in(c, f"r.{c}")
    spam = F.col("spam_pattern_flag").cast("double")
    over = F.greatest(F.col("text_length_chars") - float(config["thresholds"]["long_text_start"]), F.lit(0.0))
    long_text = S.clip(F.log1p(over) / F.log1p(F.greatest(F.col("r.long_text_excess_max"), F.lit(1.0))))
    parts = {
        "same_text_repeat": S.weighted([(0.45, up(COUNTS[0])), (0.35, up(COUNTS[1])), (0.20, up(COUNTS[2]))]),
        "spam_pattern": spam,
        "hashtag_spam": S.weighted([(0.40, up("hashtag_count")), (0.30, up("hashtag_density_chars")), (0.30, up("hashtag_density_tokens"))]),
        "token_repetition": S.weighted([(0.35, up("max_token_frequency")), (0.45, up("max_token_ratio")), (0.20, up("repeated_token_count_over_2"))]),
        "long_text": long_text * spam if config["rules"]["long_text_requires_spam"] else long_text,
        "keyword_signal": up("keyword_count"),
    }
    df = df.withColumns({f"{k}_component": v for k, v in parts.items()})
    part = [F.col(f"{k}_component") for k in parts]
    df = df.withColumn("_sum", S.weighted([(w[k], F.col(f"{k}_component")) for k in parts]))
    df = df.withColumn("_base", F.when(loud(), 1.0).otherwise(S.clip(F.col("_sum"))))
    base = F.col("_base")
    repeat = (F.col(COUNTS[0]) > policy["repeat_hard_threshold"]).cast("byte")
    return df.withColumns({"message_score": S.dominant_floor(base, part, policy, "message"), "hard_same_text_repeat_flag": repeat}).drop("r", "_sum", "_base")


def loud():
    """More than five hashtags or ten exclamation marks; missing counts are not loud."""
    return (F.coalesce("hashtag_count", F.lit(0)) > 5) | (F.coalesce("exclamation_count", F.lit(0)) > 10)
