"""From raw messages to clean ones: typed columns, statistics, flags, one row for each distinct message."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import RAW_MESSAGE
from .semantic import Scorer, scorer_for


def with_message_id(raw: DataFrame) -> DataFrame:
    """Rows numbered in the order they are read, unless they have a message_id."""
    return raw if "message_id" in raw.columns else raw.withColumn("message_id", F.monotonically_increasing_id())


def _with_columns(df: DataFrame, fields) -> DataFrame:
    absent = [f for f in fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else df


_TEXTS = [f for f in RAW_MESSAGE.fields if f.name in ("original_text", "english_keywords", "language")]
_CONTEXTS = [f for f in RAW_MESSAGE.fields if f not in _TEXTS]


def clean_texts(raw: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Raw rows with what follows from text, keywords and language alone. Where these lie in a table of their own this can be done
    before they meet the rest, so that long texts go through no exchange. ``original_hash`` (SHA-256) stands for the original text
    where rows are compared, as ``text_hash`` does for the normalized one."""
    limits, runtime = config["thresholds"], config["runtime"]
    df = _with_columns(with_message_id(raw), _TEXTS)
    df = df.select(
        F.col("message_id").cast("long").alias("message_id"),
        *(f.name for f in _CONTEXTS if f.name in df.columns),
        X.strip(F.col("original_text").cast("string")).alias("_trimmed"),
        X.keywords(F.col("english_keywords")).alias("english_keywords_clean"),
        X.missing_to_null(F.col("language")).alias("language"),
    )
    text = F.col("normalized_text")
    # step by step, so that no long text is worked on twice
    df = df.withColumn("original_text", X.present(F.col("_trimmed"))).drop("_trimmed")
    df = df.withColumn("_spaced", X.spaced(F.col("original_text"), runtime["nfkc"]))
    df = df.withColumn("normalized_text", F.when(F.col("_spaced") != "", F.col("_spaced"))).drop("_spaced")
    df = df.withColumns({"stats": X.text_statistics(text), "text_length_chars": F.coalesce(F.length(text), F.lit(0))})
    size = F.col("text_length_chars")
    return df.select(
        *(c for c in df.columns if c != "stats"),
        "stats.*",
        X.text_hash(text).alias("text_hash"),
        F.unhex(F.sha2(F.col("original_text"), 256)).alias("original_hash"),
        X.keyword_count(F.col("english_keywords_clean")).alias("keyword_count"),
        text.isNull().cast("byte").alias("is_empty_text"),
        (size < limits["min_text_len"]).cast("byte").alias("is_short_text"),
        (size > limits["long_text_start"]).cast("byte").alias("is_long_text_flag"),
    )


def clean_contexts(texts: DataFrame, config: dict[str, Any], common: DataFrame | None = None) -> DataFrame:
    """Rows of ``clean_texts`` with what follows from author, time, link, theme and the other columns; ``common`` (language), where
    given, has the languages that are not rare."""
    df = _with_columns(texts, _CONTEXTS)
    kinds, names = dict(df.dtypes), {f.name for f in _CONTEXTS}
    df = df.select(
        *(c for c in df.columns if c not in names),
        F.col("sentiment").try_cast("double").alias("sentiment"),
        *(X.missing_to_null(F.col(c)).alias(c) for c in ("main_emotion", "url", "author_hash")),
        F.coalesce(X.missing_to_null(F.col("primary_theme")), F.lit("unknown_theme")).alias("primary_theme"),
        X.to_instant(F.col("date"), kinds["date"]).alias("date"),
    )
    df = df.withColumn("domain", X.domain_parts(F.col("url")))
    known = F.col("author_hash").isNotNull()
    df = df.select(
        *(c for c in df.columns if c != "domain"),
        "domain.*",
        X.row_fingerprint(*map(F.col, ("original_text", "author_hash", "date", "url"))).alias("row_fingerprint"),
        X.time_bucket(F.col("date"), config["thresholds"]["hard_bot_time_window_sec"]).alias("time_window_bucket"),
        F.when(known, "identified").otherwise("anonymous").alias("author_type"),
        (~known).cast("byte").alias("author_hash_missing_flag"),
    )
    if common is not None:
        # broadcast, since an exchange by language would bring all rows of one language together; at most one language for each
        # ``rare_language_threshold`` rows is common, while rare ones may be as many as rows
        often = common.select(F.col("language").alias("common_name"))
        rarely = F.col("language").isNotNull() & F.col("common_name").isNull()
        df = df.join(F.broadcast(often), F.col("language") == F.col("common_name"), "left").withColumn("is_rare_language", rarely.cast("byte")).drop("common_name")
        return df
    return df.withColumn("is_rare_language", F.lit(0).cast("byte"))


def clean_messages(raw: DataFrame, config: dict[str, Any], scorer: Scorer | None = None, common: DataFrame | None = None) -> DataFrame:
    """Every raw row with its derived columns; ``common`` as in ``clean_contexts``."""
    return (scorer or scorer_for(config)).apply(clean_contexts(clean_texts(raw, config), config, common), config)


def drop_duplicates(clean: DataFrame) -> DataFrame:
    """Of rows equal in text, author, time and link, the first; nulls equal one another.

    Texts are compared by ``original_hash`` where there is one, so that they need not go along. Rows are sorted by a hash of the
    four first, so that the four are compared only where that is equal.
    """
    keys = ("original_hash" if "original_hash" in clean.columns else "original_text", "author_hash", "date", "url")
    first = F.row_number().over(Window.partitionBy("_h", *keys).orderBy("message_id"))
    return clean.withColumn("_h", F.xxhash64(*keys)).withColumn("_n", first).where("_n = 1").drop("_n", "_h")


def language_counts(raw: DataFrame) -> DataFrame:
    """Rows of each language, missing ones included, most first."""
    language = X.missing_to_null(F.col("language")).alias("language")
    return raw.groupBy(language).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc_nulls_last("language"))


def _by_language(raw: DataFrame) -> DataFrame:
    language = X.missing_to_null(F.col("language")).alias("language")
    return raw.groupBy(language).agg(F.count("*").alias("rows")).where("language is not null")


def rare_languages(raw: DataFrame, config: dict[str, Any]) -> DataFrame:
    return _by_language(raw).where(F.col("rows") < config["thresholds"]["rare_language_threshold"])


def common_languages(raw: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Every language that is not rare."""
    return _by_language(raw).where(F.col("rows") >= config["thresholds"]["rare_language_threshold"])


def clean_summary(clean: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of counters: flags over all clean rows, and how many of them deduplication keeps."""
    flags = ("author_hash_missing_flag", "is_empty_text", "is_short_text", "is_rare_language", "semantic_model_applied_flag")
    names = ("missing_author_rows", "empty_text_rows", "short_text_rows", "rare_language_rows", "semantic_applied_rows")
    counted = clean.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(F.col("date").isNull()).alias("bad_date_rows"),
        *(F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(n) for f, n in zip(flags, names, strict=True)),
    )
    return counted.crossJoin(kept.agg(F.count("*").alias("clean_rows"))).withColumn("duplicate_rows", F.col("raw_rows") - F.col("clean_rows"))
