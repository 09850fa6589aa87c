"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, remainder_col


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, as installed alike on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contamination, hit_words

    found = find_contamination(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"), nameless=True).withColumn("n_hit", hit_words())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs = read_documents(spark, sf_dir)
    scored = score_quality(docs, train(docs, read_documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder_col("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_languages, train

    docs = read_documents(spark, sf_dir)
    found = predict_languages(docs, train(docs))
    return found.select("doc_id", (remainder_col("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    found = find_personal_data(read_documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    vectors = read_documents(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_documents

    return score_documents(read_documents(spark, sf_dir))


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(read_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_pack_sequences, op3_simhash_components, op4_score_quality, op5_identify_language, op6_remove_repeats, op7_personal_data, op8_nearest_vectors, op9_language_model, op10_count_tokens)}


#: Words, windows of 13 of them (an item of fewer is one window), and the places in documents where a window occurs.
_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS words FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS words FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, k, n, item FROM places JOIN windows USING (n, words)),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""

#: Bytes as two hexadecimal digits each, so that windows of bytes are windows of digits; pieces of 500 windows, so that none is far from its start.
_OP6 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pieces AS (SELECT r, doc_id, c, substring(x, 1000 * c + 1, 1098) AS y FROM (SELECT r, doc_id, x, unnest(range(0, CAST(len(x) // 1000 AS BIGINT) + 1)) AS c FROM d WHERE len(x) >= 100 AND doc_id IS NOT NULL)),
w AS (SELECT r, doc_id, 500 * c + k AS k, md5_number(substring(y, 2 * k - 1, 100)) AS h FROM (SELECT r, doc_id, c, y, unnest(range(1, CAST(len(y) // 2 AS BIGINT) - 48)) AS k FROM pieces WHERE len(y) >= 100)),
least AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT r, k FROM w JOIN least USING (h) WHERE first < doc_id),
heads AS (SELECT r, k, k + 50 AS e, CASE WHEN k > max(k + 50) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM gone),
spans AS (SELECT r, min(k) AS a, max(e) AS e FROM (SELECT r, k, e, sum(new) OVER (PARTITION BY r ORDER BY k) AS g FROM heads) GROUP BY r, g),
between AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS before FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last, string_agg(substring(x, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) AS head FROM between JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE head || substring(x, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The same in SQL where that can say it: whole rows of two operators."""
    return {"op1_decontaminate": _OP1, "op6_remove_repeats": _OP6}
