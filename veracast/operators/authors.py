"""How authors behave: intensity, rhythm, repetition and diversity, and the score made of them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scale as S
from .quantiles import column_quantiles, grouped_quantiles

#: Features and the share of authors cut off at either end of their reference ranges.
QUANTILE_FEATURES = {c: (0.05, 0.99) for c in ("posts_per_day", "posts_per_active_hour", "theme_nunique", "sentiment_std", "same_text_repeat_ratio", "same_text_repeat_max", "multi_author_repeat_ratio")} | {
    c: (0.01, 0.95) for c in ("mean_interpost_sec", "median_interpost_sec", "p10_interpost_sec", "interval_cv")
}
MAX_FEATURES = ("max_posts_one_hour", "language_nunique")


def known_posts(clean: DataFrame) -> DataFrame:
    """Posts of known authors at a known time."""
    return clean.where(F.col("author_hash").isNotNull() & F.col("date").isNotNull())


def activity(posts: DataFrame) -> DataFrame:
    """Totals of each author. Hours are counted first, so that an author with very many posts is summed up on the way."""
    base = posts.groupBy("author_hash").agg(
        F.count("*").alias("total_posts"),
        F.countDistinct(F.date_trunc("DAY", "date")).alias("active_days"),
        F.countDistinct(F.date_trunc("HOUR", "date")).alias("active_hours"),
        F.countDistinct("language").alias("language_nunique"),
        F.countDistinct("primary_theme").alias("theme_nunique"),
        F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0)).alias("sentiment_std"),
    )
    per = lambda n: F.col("total_posts") / F.greatest(F.col(n), F.lit(1))
    return base.withColumns({"posts_per_day": per("active_days"), "posts_per_active_hour": per("active_hours")})


def hourly_posts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("author_hash", F.date_trunc("HOUR", "date").alias("hour")).agg(F.count("*").alias("n"))


def max_hourly(posts: DataFrame) -> DataFrame:
    return hourly_posts(posts).groupBy("author_hash").agg(F.max("n").alias("max_posts_one_hour"))


def hourly_distribution(posts: DataFrame) -> DataFrame:
    """Posts of each active hour, in time order."""
    hours = F.array_sort(F.collect_list(F.struct("hour", "n")))
    return hourly_posts(posts).groupBy("author_hash").agg(F.transform(hours, lambda h: h["n"]).alias("hourly_post_distribution"))


def interpost_gaps(posts: DataFrame) -> DataFrame:
    """Seconds between an author's consecutive posts.

    Gaps within a day come from windows over (author, day), gaps between days from the days' first and last posts, so no
    task holds all posts of one author.
    """
    at = posts.select("author_hash", F.date_trunc("DAY", "date").alias("day"), F.unix_micros("date").alias("at"))
    day = Window.partitionBy("author_hash", "day").orderBy("at")
    within = at.select("author_hash", ((F.col("at") - F.lag("at").over(day)) / F.lit(1e6)).alias("interpost_sec"))
    days = at.groupBy("author_hash", "day").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    before = Window.partitionBy("author_hash").orderBy("day")
    between = days.select("author_hash", ((F.col("first") - F.lag("last").over(before)) / F.lit(1e6)).alias("interpost_sec"))
    return within.union(between).where("interpost_sec is not null")


def timing(posts: DataFrame) -> DataFrame:
    """Mean, median, tenth percentile, deviation and variation of the gaps of authors who have any."""
    gap = F.col("interpost_sec")
    gaps = interpost_gaps(posts)
    out = gaps.groupBy("author_hash").agg((F.sum(F.round(gap * 1e6).cast("long")) / F.count(gap) / 1e6).alias("mean_interpost_sec"), F.stddev_samp(gap).alias("std_interpost_sec"))
    found = grouped_quantiles(gaps.select("author_hash", gap.alias("x")), "author_hash", (0.5, 0.1))
    out = out.join(found, "author_hash").withColumns({"median_interpost_sec": F.col("q")[0], "p10_interpost_sec": F.col("q")[1]})
    cv = F.col("std_interpost_sec") / F.when(F.col("mean_interpost_sec") != 0, F.col("mean_interpost_sec"))
    return out.select("author_hash", "mean_interpost_sec", "median_interpost_sec", "p10_interpost_sec", "std_interpost_sec", cv.alias("interval_cv"))


def repetition(posts: DataFrame) -> DataFrame:
    """The share of an author's posts whose text they posted more than once, and their most repeated text's count."""
    n = F.col("n")
    counts = posts.groupBy("author_hash", "text_hash").agg(F.count("*").alias("n"))
    return counts.groupBy("author_hash").agg((F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)) / F.sum(n)).alias("same_text_repeat_ratio"), F.max(n).alias("same_text_repeat_max"))


def multi_author_ratio(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """The share of an author's posts whose text others posted as well."""
    counts = posts.groupBy("author_hash", "text_hash").agg(F.count("*").alias("n")).join(clusters.select("text_hash", "unique_author_count"), "text_hash", "left")
    shared = F.when(F.col("unique_author_count") > 1, F.col("n")).otherwise(0)
    return counts.groupBy("author_hash").agg((F.sum(shared) / F.sum("n")).alias("multi_author_repeat_ratio"))


def author_features(clean: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each known author; gaps that do not exist are infinite."""
    posts = known_posts(clean)
    df = activity(posts)
    for part in (max_hourly(posts), timing(posts), repetition(posts), multi_author_ratio(posts, clusters)):
        df = df.join(part, "author_hash", "left")
    never = F.lit(float("inf"))
    return df.withColumns({c: F.coalesce(c, never) for c in ("mean_interpost_sec", "median_interpost_sec", "p10_interpost_sec", "interval_cv")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("same_text_repeat_ratio", "multi_author_repeat_ratio")} | {"same_text_repeat_max": F.coalesce("same_text_repeat_max", F.lit(0))})


def quantile_range(q: Column) -> Column:
    """A struct (lo, hi) of an array's first two quantiles, (0, 1) for none, a range one wide at least."""
    lo, hi = F.coalesce(q[0], F.lit(0.0)), F.coalesce(q[1], F.lit(1.0))
    close = F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(hi)
    return F.struct(lo.alias("lo"), F.when(close, lo + 1.0).otherwise(hi).alias("hi"))


def author_refs(features: DataFrame) -> DataFrame:
    """One row of reference ranges and maxima (the last quantile) over all authors."""
    found = column_quantiles(features, QUANTILE_FEATURES | {c: (1.0,) for c in MAX_FEATURES})
    tops = [F.coalesce(F.col(c)[0], F.lit(1.0)).alias(f"{c}_max") for c in MAX_FEATURES]
    return found.select(*(quantile_range(F.col(c)).alias(c) for c in QUANTILE_FEATURES), *tops)


def author_scores(features: DataFrame, refs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Features with their components, score and hourly flag. ``refs`` is one row, read by every author."""
    limits, w = config["thresholds"], config["weights"]["author"]
    df = features.crossJoin(F.broadcast(refs.select(F.struct(*refs.columns).alias("r"))))
    r = lambda c: F.col(f"r.{c}")
    up = lambda c: S.bounded_in(c, f"r.{c}")
    down = lambda c: S.bounded_in(c, f"r.{c}", inverse=True)
    start = float(limits["language_penalty_start"])
    languages = F.greatest(F.col("language_nunique") - start, F.lit(0.0))
    parts = {
        "activity": S.weighted([(0.20, up("posts_per_day")), (0.25, up("posts_per_active_hour")), (0.55, S.log_penalty(F.col("max_posts_one_hour"), limits["hourly_penalty_start"], r("max_posts_one_hour_max")))]),
        "timing": S.weighted([(0.15, down("mean_interpost_sec")), (0.25, down("median_interpost_sec")), (0.35, down("p10_interpost_sec")), (0.25, down("interval_cv"))]),
        "repetition": S.weighted([(0.30, up("same_text_repeat_ratio")), (0.25, up("same_text_repeat_max")), (0.45, up("multi_author_repeat_ratio"))]),
        "diversity": S.weighted([(0.40, S.bounded(languages, F.lit(0.0), F.greatest(r("language_nunique_max") - start, F.lit(1.0)))), (0.30, up("theme_nunique")), (0.30, up("sentiment_std"))]),
        "metadata": F.lit(0.0),
    }
    df = df.withColumns({f"{k}_component": v for k, v in parts.items()})
    part = {k: F.col(f"{k}_component") for k in parts}
    df = df.withColumn("_sum", S.weighted([(w[k], part[k]) for k in parts]))
    df = df.withColumn("_base", S.clip(F.col("_sum")))
    base = F.col("_base")
    score = S.dominant_floor(base, [part[k] for k in parts if k != "metadata"], config["dominant_signal_policy"], "author")
    hard = (F.col("max_posts_one_hour") > limits["hard_hourly_bot_threshold"]).cast("byte")
    return df.withColumns({"author_score": score, "author_hard_hourly_flag": hard}).drop("r", "_sum", "_base")
