"""A corpus through five operators: language, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the columns of
documents.  Text that no language can be told from goes (if no row has a language to learn from, text without a letter); one document of each near-duplicate component stays; documents
with a twentieth of their words in benchmark passages go, and from others such passages are cut; personal data become their
kind in brackets; what is left is packed.  Texts that a stage shortens get a new n_chars.  Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracast.llm import common, decontam, langid, packing, pii, simhash
from veracast.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    model = langid.train(docs)
    if not model.languages:
        return langid.with_letters(docs.select(*COLUMNS))
    found = langid.predict_languages(docs, model, keep=COLUMNS)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return simhash.one_of_each(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = decontam.decontaminate(docs.select(*COLUMNS), common.read_documents(spark, sf_dir, "benchmark"))
    return _counted(clean)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = pii.find_personal_data(docs, keep=COLUMNS, mask=True)
    return _counted(found.withColumn("text", F.col("masked_text")).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [("language identification", language), ("simhash near-duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("personal data", personal_data), ("packing", pack)]

#: No stage can be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written as Parquet and read again by the next."""
    docs = common.read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
    return docs
