"""Author, message and semantic scores as one behavioral and one final score."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale as S
from .messages import loud


def attach_authors(messages: DataFrame, scores: DataFrame, unknown_score: float | None = None) -> DataFrame:
    """Messages with author_score (null, or ``unknown_score``, for authors without one) and author_hard_hourly_flag (0).

    Messages without an author get a key of their own each, so that no task has to take them all.
    """
    own = F.when(F.col("author_hash").isNull(), F.concat(F.lit("message "), F.col("message_id").cast("string"))).otherwise(F.concat(F.lit("author "), F.col("author_hash")))
    theirs = scores.select(F.concat(F.lit("author "), F.col("author_hash")).alias("_author_key"), "author_score", "author_hard_hourly_flag")
    df = messages.withColumn("_author_key", own).join(theirs, "_author_key", "left").drop("_author_key")
    df = df.withColumn("author_hard_hourly_flag", F.coalesce("author_hard_hourly_flag", F.lit(0)).cast("byte"))
    return df if unknown_score is None else df.withColumn("author_score", F.coalesce("author_score", F.lit(float(unknown_score))))


def _with_neutral_weights(df: DataFrame, left: str, right: str, w_left: Column, w_right: Column, policy: dict, names: tuple[str, str]) -> DataFrame:
    """``names``: the weights of two score columns with a neutral score's dropped. Every step reads columns of the one before,
    so that no expression holds another several times over."""
    a, b = f"_{names[0]}", f"_{names[1]}"
    df = df.withColumns({a: F.when(S.is_neutral(F.col(left), policy), 0.0).otherwise(w_left), b: F.when(S.is_neutral(F.col(right), policy), 0.0).otherwise(w_right)})
    return df.withColumns(dict(zip(names, S.shares(F.col(a), F.col(b)), strict=True))).drop(a, b)


def behavioral_score(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Author and message scores by weight; a strong message dominates, an anonymous one stands alone, a hard repeat is 1."""
    w, policy = config["weights"]["author_vs_message"], config["neutral_score_policy"]
    df = df.withColumns({"_author": S.clip(F.coalesce("author_score", F.lit(0.5))), "_message": S.clip(F.coalesce("message_score", F.lit(0.5)))})
    df = _with_neutral_weights(df, "_author", "_message", F.lit(float(w["author"])), F.lit(float(w["message"])), policy, ("_w_author", "_w_message"))
    df = df.withColumn("_sum", F.col("_author") * F.col("_w_author").cast("double") + F.col("_message") * F.col("_w_message").cast("double"))
    df = df.withColumn("_both", S.clip(F.col("_sum")))
    message, both = F.col("_message"), F.col("_both")
    strong = message >= config["dominant_signal_policy"]["threshold"]
    score = F.when(F.col("hard_same_text_repeat_flag") == 1, 1.0).when(F.col("author_type") == "anonymous", message).when(strong, F.greatest(both, message)).otherwise(both)
    return df.withColumn("behavioral_score", score).drop("_author", "_message", "_w_author", "_w_message", "_sum", "_both")


def final_score(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Behavioral and semantic scores, weighted by how sure each is, then the hard rules."""
    w, dynamic, policy = config["weights"]["behavioral_vs_semantic"], config["dynamic_final_weighting"], config["neutral_score_policy"]
    df = df.withColumns({"_b": S.clip(F.coalesce("behavioral_score", F.lit(0.5))), "_r": S.clip(F.coalesce("roberta_score", F.lit(0.5)))})
    b, r, sure = F.col("_b"), F.col("_r"), ("behavioral_confidence_weight", "roberta_confidence_weight")
    if dynamic["enabled"]:
        df = df.withColumns({c: S.confidence(x, dynamic["min_confidence_weight"], dynamic["power"]) for c, x in zip(sure, (b, r), strict=True)})
        df = df.withColumn("_gap", (F.col(sure[1]) * float(w["semantic"]) - F.col(sure[0]) * float(w["behavioral"])) * float(dynamic["sigmoid_steepness"]))
        df = df.withColumn("_gate", S.sigmoid(F.col("_gap")))
        w_b, w_r = 1.0 - F.col("_gate"), F.col("_gate")
    else:
        df = df.withColumns({c: F.lit(1.0) for c in sure})
        total = float(w["behavioral"] + w["semantic"]) or 1.0
        w_b, w_r = F.lit(w["behavioral"] / total), F.lit(w["semantic"] / total)
    df = _with_neutral_weights(df, "_b", "_r", w_b, w_r, policy, ("behavioral_effective_weight", "roberta_effective_weight"))
    df = df.withColumn("_sum", b * F.col("behavioral_effective_weight").cast("double") + r * F.col("roberta_effective_weight").cast("double"))
    df = df.withColumn("final_score_before_rules", S.clip(F.col("_sum")))
    hard = F.lit(False)
    for flag in ("author_hard_hourly_flag", "hard_bot_cluster_flag", "hard_same_text_repeat_flag"):
        hard = hard | (F.coalesce(flag, F.lit(0)) == 1)
    return df.withColumn("final_score", F.when(hard | loud(), 1.0).otherwise(F.col("final_score_before_rules"))).drop("_b", "_r", "_gap", "_gate", "_sum")
