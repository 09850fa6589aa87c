"""Where messages come from and where tables are kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_MESSAGE


def scan_messages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw messages of Parquet files; the columns that are used are read, no others. ``limit`` keeps the first rows in the order of
    the files, which then are numbered by it."""
    df = spark.read.parquet(path)
    if limit is None:
        return df
    df = df if "message_id" in df.columns else df.withColumn("message_id", F.monotonically_increasing_id())
    return df.orderBy("message_id").limit(limit)


def row_limit(runtime: dict[str, Any]) -> int | None:
    """How many rows a run reads at most: the sample's, and no more than ``max_batches`` batches."""
    batches = runtime["max_batches"]
    limits = [n for n in (runtime["sample_n_rows"], batches and batches * runtime["batch_size"]) if n is not None]
    return min(limits, default=None)


def parquet_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the files' footers alone."""
    return spark.read.parquet(path).columns


def single_message(spark: SparkSession, text: str, author: str | None = None, date: str | None = None, language: str | None = None, keywords: str | None = None, theme: str | None = None, url: str | None = None) -> DataFrame:
    """One message as a raw row of nine columns."""
    return spark.createDataFrame([(text, keywords, None, None, theme, language, url, author, date)], RAW_MESSAGE)


def write_table(df: DataFrame, path: str, overwrite: bool) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table read in fewer pieces than there are cores, dealt out by a key; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table_rows_as_messages(spark: SparkSession, sf_dir: str, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Messages made of the driver's tables: one of each document, its author, time and link from the event and page of like number.
    ``texts`` is applied to message_id, original_text, english_keywords and language, before these meet the other tables; its columns
    take their place."""
    docs, events, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "events", "pages"))
    docs, events = spread(docs, "doc_id"), events.select("event_id", "user_id", "event_type", "ts", "value")
    i = F.col("doc_id")
    text = F.when(i % 13 == 0, "  n/a ").when(i % 7 == 0, F.concat("text", F.lit(" #promo #deal"))).when(i % 17 == 0, "Bot bot bot #promo !!!").otherwise(F.col("text"))
    words = F.when(i % 3 == 0, F.concat("source", F.lit(", "), "lang", F.lit(" ,, "), "source")).otherwise(F.col("source"))
    own = docs.select(i.alias("message_id"), text.alias("original_text"), words.alias("english_keywords"), F.col("lang").alias("language"))
    own = texts(own) if texts else own
    i = F.col("message_id")
    author = F.when(i % 11 == 0, None).when(F.col("user_id") % 2 == 0, "u_hot").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    # i % 50 has 99 values at most, which rows would be exchanged by: the pages of these numbers are broadcast
    links = F.broadcast(pages.where(F.abs("page_id") < 50).select("page_id", "url"))
    joined = own.join(events, F.col("event_id") == i).join(links, F.col("page_id") == i % 50, "left")
    columns = {
        "sentiment": F.col("value"),
        "main_emotion": F.lit(None).cast("string"),
        "primary_theme": F.when(i % 19 != 0, F.col("event_type")),
        "url": F.col("url"),
        "author_hash": author,
        "date": F.col("ts").cast("timestamp"),
    }
    df = joined.select(*own.columns, *(c.alias(name) for name, c in columns.items()))
    return df if texts else df.select("message_id", *(f.name for f in RAW_MESSAGE.fields))


def raw_columns(df: DataFrame) -> dict[str, Any]:
    """Which of the nine raw columns a table has, with their types."""
    kinds = dict(df.dtypes)
    return {f.name: kinds.get(f.name) for f in RAW_MESSAGE.fields}
