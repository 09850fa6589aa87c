"""What keeps the work of one task, and of a query, from growing faster than its input."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from test_engine import CONFIG, raw
from veracast.config import deep_merge
from veracast.functions import text as X
from veracast.operators import reports
from veracast.plans.score import clean_rows, clean_store, score_store, without_texts


def exchanges(df):
    """The exchanges of a plan, each with its keys."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_rows_are_not_brought_together_by_language(spark):
    config = deep_merge(CONFIG, {"runtime": {"refs_mode": "quantile"}, "thresholds": {"rare_language_threshold": 2}})
    rows = raw(spark, [(f"t{k}", "a", "2024-01-01", "t", language) for k, language in enumerate(("en", "en", "de", None, "n/a", " en "))])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size is not known
    try:
        cleaned = clean_rows(rows, config)
        assert [r.is_rare_language for r in cleaned.orderBy("message_id").collect()] == [0, 0, 1, 0, 0, 0]
        assert len(exchanges(cleaned)) == 1  # of the counts by language
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.fixture
def tables(spark, tmp_path):
    """The driver's tables in small, documents in as many files as there are cores."""
    docs = [(k, f"text {k % 5} of many words", "en" if k % 2 else "de", "web") for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    events = spark.range(60).selectExpr("id AS event_id", "id % 7 AS user_id", "'click' AS event_type", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "double(id) AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, f"https://www.site{k}.com/x") for k in range(80)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def carried(df, kinds=("Join", "Window", "Aggregate")):
    """The columns that come out of a plan's joins, windows and aggregates."""
    found, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in kinds:
            found |= {node.output().apply(i).name() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_texts_go_through_no_exchange(spark, tables):
    from veracast import queries

    for config in (queries.CONFIG, queries.SEMANTIC, queries.QUANTILE):
        run = queries._run(spark, tables, config)
        for df in (run._store, run.clean, run.scored):
            assert not {"text", "original_text", "normalized_text", "english_keywords_clean"} & carried(df)
        assert run.scored.count() == 40
    assert {r.url for r in queries._messages(spark, tables).collect()} == {f"https://www.site{k}.com/x" for k in range(40)}


def test_equal_texts_are_found_without_them(spark):
    rows = [("Same", "a", "2024-01-01"), (" Same ", "a", "2024-01-01"), ("same", "a", "2024-01-01"), ("Same", "b", "2024-01-01"), (None, "a", "2024-01-01"), ("nan", "a", "2024-01-01"), ("", None, None)]
    store = without_texts(clean_store(raw(spark, rows), CONFIG))
    assert [r.message_id for r in store.orderBy("message_id").collect()] == [0, 2, 3, 4, 6]


def test_no_table_is_worked_out_that_is_not_asked_for(spark):
    kept = []
    run = score_store(clean_store(raw(spark, [("hello", "a", "2024-01-01")]), CONFIG), CONFIG, keep=lambda df, name: kept.append(name) or df)
    assert run.author_scores.count() == 1 and run.author_scores is run.author_scores
    assert sorted(kept) == ["author-features", "author-refs", "author-scores", "messages", "text-clusters"]
    assert run.scored.count() == 1 and len(kept) == len(set(kept)) == 8


def test_a_map_of_scored_messages_needs_no_join(spark):
    scored = spark.createDataFrame([(k, 0.5, 1, 0, "en", "a.com") for k in range(30)], "message_id long, final_score double, hard_bot_cluster_flag byte, hard_same_text_repeat_flag byte, language string, registered_domain string")
    df = reports.manipulation_map(scored, scored)
    assert not carried(df, ("Join",)) and df.first().rows == 30
    apart = reports.manipulation_map(scored.drop("language", "registered_domain"), scored)
    assert apart.collect() == df.collect()


def test_few_texts_go_through_python(spark):
    texts = ["plain", "Größe naïve Ёлка “quoted” – 日本 ひらがな カタカナ", "ﬁne", "é", "x²", "ＡＢ", "ㄱ", "Iİ", "a b", "が"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(X._UNSTABLE).alias("odd"), X.normalized(F.col("t")).alias("n")).collect()
    assert {r.t for r in found if not r.odd} == {texts[0], texts[1], "Iİ"}
    assert all(r.n == unicodedata.normalize("NFKC", r.t) for r in found)


def test_whether_a_model_would_be_given_anything(spark):
    texts = [None, "", "a", "12 34", "١٢", "http://only.link/", "HTTP://x www.y", "see http://x", "www.x y", "ht tp", "_", "Ⅷ", "½", "#12@", "!!! é", "1" * 50_000, "http://x " * 9_000, "1" * 50_000 + "z", "日"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.has_semantic_input(F.col("t")).alias("some"), (X.semantic_input(F.col("t")) != "").alias("left"))
    rows = df.collect()
    assert all(r.some == r.left for r in rows) and {r.some for r in rows} == {True, False}
