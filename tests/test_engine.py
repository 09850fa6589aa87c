"""Operators, stored runs and single messages."""

import json
from importlib.util import find_spec

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracast import schema
from veracast.config import DEFAULTS, PRESETS, canonical_hash, deep_merge, load_config, make_config, semantic_settings, store_config, write_default_config
from veracast.operators import authors, clean, clusters, fuse, messages, quantiles, reports
from veracast.operators.semantic import ModelScorer, NeutralScorer, check_model_name, pick_device, scorer_for
from veracast.plans.artifacts import Run
from veracast.plans.score import clean_store, score_store
from veracast.plans.single import explain_messages, score_with_history
from veracast.sources.messages import row_limit, single_message
from veracast.streaming.incremental import score_stream, window_clusters

CONFIG = make_config({"semantic_adapter": {"enabled": False}})


def raw(spark, rows):
    """(text, author, date[, theme[, language[, url]]]) as raw messages."""
    full = [(i, r[0], "bot, promo", 0.1 * i, None, r[3] if len(r) > 3 else "t", r[4] if len(r) > 4 else "en", r[5] if len(r) > 5 else "https://news.example.com/x", r[1], r[2]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "message_id long, original_text string, english_keywords string, sentiment double, main_emotion string, primary_theme string, language string, url string, author_hash string, date string")


ROWS = [(f"Text number {k % 7} of many words", f"a{k % 4}" if k % 5 else None, f"2024-01-0{1 + k % 3} 0{k % 9}:{k % 6}0:00") for k in range(40)] + [(None, "a1", "2024-01-05 00:00:00"), ("n/a", None, "bad date")] + [("Same", f"b{k}", f"2024-02-01 00:00:0{k}") for k in range(7)]


@pytest.fixture(scope="module")
def run(spark):
    from veracast.plans.materialize import materialize

    return score_store(clean_store(raw(spark, ROWS), CONFIG), CONFIG, keep=materialize)


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"runtime": {"batch_size": 1234}, "semantic_adapter": {"enabled": False}}))
    config = load_config(path)
    assert config["runtime"]["batch_size"] == 1234 and not config["semantic_adapter"]["enabled"] and config["weights"] == DEFAULTS["weights"]
    assert json.loads(write_default_config(tmp_path / "d" / "x.json").read_text()) == DEFAULTS
    assert set(PRESETS) == {"full_build", "model_test", "demo"} and make_config(preset="demo")["runtime"]["sample_n_rows"] == 5000
    assert canonical_hash({"b": 1, "a": "é"}) == canonical_hash({"a": "é", "b": 1})
    assert canonical_hash(store_config(CONFIG)) != canonical_hash(store_config(deep_merge(CONFIG, {"thresholds": {"min_text_len": 6}})))
    named = make_config({"paths": {"input_parquet": "x", "clean_output_parquet": "y"}, "weights": {"author_components": {"activity": 0.5}}, "derived_thresholds": {"hourly_hard_knee": 7}})
    assert named["paths"]["input"] == "x" and "clean_output_parquet" not in named["paths"] and named["weights"]["author"]["activity"] == 0.5 and named["weights"]["author"]["timing"] == 0.25
    for wrong in ({"thresholds": {"min_text_length": 4}}, {"threshold": {}}, {"weights": {"author": {"mood": 1}}}):
        with pytest.raises(KeyError):
            make_config(wrong)
    with pytest.raises(TypeError):
        make_config({"weights": {"author": 1}})
    assert [row_limit(DEFAULTS["runtime"] | x) for x in ({}, {"sample_n_rows": 7}, {"max_batches": 2, "batch_size": 3}, {"max_batches": 2, "batch_size": 3, "sample_n_rows": 5})] == [None, 7, 6, 5]
    with pytest.raises(KeyError):
        semantic_settings(make_config({"semantic_adapter": {"models": {"a": {}}, "selected_model_key": "b"}}))
    with pytest.raises(ValueError):
        check_model_name({"model_name": "xlmr_base_multilingual"})
    assert [pick_device("auto", c, m) for c, m in ((1, 1), (0, 1), (0, 0))] == ["cuda", "mps", "cpu"] and pick_device("cpu", True, True) == "cpu"


def test_clean_row(spark):
    row = clean.clean_messages(raw(spark, [("Bot bot bot #promo !!!", None, "2024-01-01", None)]), CONFIG).first()
    assert (row.normalized_text, row.english_keywords_clean, row.keyword_count, row.author_type, row.registered_domain) == ("Bot bot bot #promo !!!", "bot, promo", 2, "anonymous", "example.com")
    assert (row.roberta_score, row.semantic_model_applied_flag, row.primary_theme, row.is_long_text_flag) == (0.5, 0, "unknown_theme", 0)


def test_deduplication_keeps_the_first(spark):
    rows = [("x", "a", "2024-01-01"), ("x", "a", "2024-01-01", "other"), ("x", None, None), ("x", None, None), ("x", "b", "2024-01-01")]
    df = clean.clean_messages(raw(spark, rows), CONFIG)
    assert [r.message_id for r in clean.drop_duplicates(df).orderBy("message_id").collect()] == [0, 2, 4]
    a, b = (r.row_fingerprint for r in df.where("message_id < 2").collect())
    assert a == b
    s = clean.clean_summary(df, clean.drop_duplicates(df)).first()
    assert (s.raw_rows, s.clean_rows, s.duplicate_rows, s.missing_author_rows, s.bad_date_rows) == (5, 3, 2, 2, 2)


def test_clusters_and_flags(run):
    same = run.text_clusters.where("normalized_text = 'Same'").first()
    assert (same.repeat_count, same.unique_author_count) == (7, 7)
    assert run.text_clusters.where("normalized_text is null").first().repeat_count == 2
    rows = run.scored.where("normalized_text = 'Same'").collect()
    assert all(r.spam_pattern_flag == r.hard_bot_cluster_flag == r.hard_same_text_repeat_flag == 1 and r.final_score == 1.0 for r in rows)
    assert all(0 <= r.final_score <= 1 for r in run.scored.collect())


def test_null_texts_may_be_ignored(spark):
    df = clean_store(raw(spark, [(None, "a", f"2024-01-0{k}") for k in range(1, 8)]), CONFIG)
    args = df, clusters.text_clusters(df), clusters.text_window_clusters(df)
    assert clusters.attach_clusters(*args).first().same_text_repeat_count == 7
    assert clusters.attach_clusters(*args, "ignore").first().same_text_repeat_count == 0


def test_gaps_across_days(spark):
    df = clean_store(raw(spark, [("a", "u", "2024-01-01 23:59:00"), ("b", "u", "2024-01-02 00:01:00"), ("c", "u", "2024-01-02 00:01:00"), ("d", "u", "2024-01-09 00:01:00"), ("e", "v", "2024-01-01")]), CONFIG)
    gaps = sorted(r.interpost_sec for r in authors.interpost_gaps(authors.known_posts(df)).collect())
    assert gaps == [0.0, 120.0, 7 * 86400.0]
    f = {r.author_hash: r for r in authors.author_features(df, clusters.text_clusters(df)).collect()}
    assert f["v"].mean_interpost_sec == float("inf") and f["u"].median_interpost_sec == 120.0 and f["v"].sentiment_std == 0.0


def one_range(df):
    return quantiles.column_quantiles(df, {"x": (0.05, 0.99)}).select(authors.quantile_range(F.col("x")).alias("x")).first().x


def test_refs_of_nothing_and_of_a_constant(spark):
    empty = spark.createDataFrame([], "x double")
    assert tuple(one_range(empty)) == (0.0, 1.0)
    same = spark.createDataFrame([(3.0,), (3.0,), (float("inf"),)], "x double")
    assert tuple(one_range(same)) == (3.0, 4.0)


def test_quantiles_are_those_of_sorted_values(spark):
    rng = np.random.default_rng(5)
    data = {"hot": np.concatenate([rng.normal(0, 50, 3000).round(1), rng.exponential(1e6, 2000), np.zeros(500)]), "two": np.array([-1.5, 4.0]), "one": np.array([7.25]), "same": np.full(40, -3.0), "near": 1 + rng.random(1000) * 1e-9}
    ps = [0.0, 0.01, 0.1, 0.5, 0.95, 0.99, 1.0]
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "key string, x double")
    found = {r.key: r.q for r in quantiles.grouped_quantiles(df, "key", ps).collect()}
    assert set(found) == set(data)
    for k, values in found.items():
        assert list(values) == pytest.approx(list(np.quantile(data[k], ps)), rel=1e-12, abs=1e-12)
    odd = spark.createDataFrame([(float("nan"), None), (float("inf"), None), (None, None), (1.0, None), (2.0, None)], "x double, y int")
    row = quantiles.column_quantiles(odd, {"x": (0.0, 0.5), "y": (0.5,)}).first()
    assert list(row.x) == [1.0, 1.5] and list(row.y) == [None]


def test_no_known_author(spark):
    run = score_store(clean_store(raw(spark, [("hello there", None, None)]), CONFIG), CONFIG)
    assert run.author_scores.count() == 0 and run.scored.first().author_score is None


def test_anonymous_and_hard_rules(spark):
    df = spark.createDataFrame([("anonymous", 0.9, 0.2, 0), ("identified", 0.9, 0.2, 1), ("identified", 0.2, 0.9, 0)], "author_type string, author_score double, message_score double, hard_same_text_repeat_flag int")
    assert [r.behavioral_score for r in fuse.behavioral_score(df, CONFIG).collect()] == [0.2, 1.0, 0.9]
    kinds = "behavioral_score double, roberta_score double, author_hard_hourly_flag int, hard_bot_cluster_flag int, hard_same_text_repeat_flag int, hashtag_count int, exclamation_count int"
    df = spark.createDataFrame([(0.4, 0.2, 0, 1, 0, 0, 0), (0.4, 0.2, 0, 0, 0, 5, 10), (0.4, 0.2, 0, 0, 0, 6, 0), (0.4, 0.2, 0, 0, 0, 0, 11), (0.4, 0.5, 0, 0, 0, None, None)], kinds)
    out = [r.final_score for r in fuse.final_score(df, CONFIG).collect()]
    assert out[0] == out[2] == out[3] == 1.0 and out[1] < 1 and out[4] == pytest.approx(0.4)
    still = fuse.final_score(df, make_config({"dynamic_final_weighting": {"enabled": False}})).collect()
    assert still[1].final_score == pytest.approx(0.6 * 0.4 + 0.4 * 0.2)


def test_bands_are_closed_above(spark):
    df = spark.createDataFrame([(0.4,), (0.400001,), (0.9999995,), (1.0,)], "final_score double")
    assert {r.band: r.rows for r in reports.score_bands(df).collect()} == {"0.00-0.40": 1, "0.40-0.60": 1, "0.60-0.70": 0, "0.70-0.85": 0, "0.85-<1.0": 0, "1.0": 2}


def test_single_message(spark, run):
    new = single_message(spark, "Bot bot bot #promo !!!", "a1", "2024-01-01T00:00:00Z")
    assert len(new.columns) == 9
    out = explain_messages(new, run, CONFIG)
    assert tuple(out.columns) == ("message_id", *schema.EXPLANATION_COLUMNS)
    row = out.first()
    assert row.author_type == "identified" and 0 <= row.final_score <= 1
    assert explain_messages(single_message(spark, "Same", "stranger"), run, CONFIG).first().author_score == 0.0
    ours = score_with_history(single_message(spark, "Quite new", "stranger"), raw(spark, ROWS), CONFIG).first()
    assert ours.author_score is None


def test_model_scorer(spark):
    scorer = ModelScorer(lambda settings: lambda texts: [len(t) / 100 for t in texts])
    config = make_config({"semantic_adapter": {"supported_languages": ["en"]}})
    rows = clean.clean_messages(raw(spark, [("Hello", "a", None), ("Hallo", "a", None, "t", "de"), (None, "a", None)]), config, scorer).orderBy("message_id").collect()
    assert [(r.roberta_score, r.semantic_model_applied_flag) for r in rows] == [(0.05, 1), (0.5, 0), (0.5, 0)]


def test_a_named_model_scores_or_raises(spark, tmp_path):
    source = str(tmp_path / "in")
    raw(spark, ROWS).write.parquet(source)
    (tmp_path / "stub_model.py").write_text("def lengths(settings):\n    return lambda texts: [len(t) / 100 for t in texts]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "stub_model.py"))  # as users ship their loaders
    paths = {"input": source} | {k: str(tmp_path / k) for k in ("store", "author_scores", "scored_messages", "manifest")}
    config = make_config({"paths": paths, "runtime": {"sample_n_rows": 12}, "semantic_adapter": {"model_name": "stub", "loader": "stub_model:lengths"}})
    built = Run(spark, config).build()
    rows = spark.read.parquet(str(tmp_path / "store" / "cleaned_messages")).orderBy("message_id").collect()
    assert [r.message_id for r in rows] == list(range(12)) and all(r.roberta_score == pytest.approx(len("text number of many words") / 100) and r.semantic_model_applied_flag == 1 for r in rows)
    s = built["summary"].first()
    assert (s.raw_rows, s.clean_rows, s.semantic_applied_rows) == (12, 12, 12)
    with pytest.raises(ValueError):
        scorer_for(make_config({"semantic_adapter": {"model_name": "xlm-roberta-base"}}))
    if find_spec("torch") is None:
        with pytest.raises(ImportError):
            clean_store(raw(spark, ROWS), make_config({"semantic_adapter": {"model_name": "some/model"}}))
    assert isinstance(scorer_for(make_config({"semantic_adapter": {"enabled": False, "model_name": "some/model"}})), NeutralScorer)


def test_derived_thresholds(spark):
    assert [tuple(r) for r in reports.derived_thresholds(spark, make_config({"derived_thresholds": {"b": 2, "a": 1.5}})).collect()] == [("a", "1.5"), ("b", "2")]
    assert reports.derived_thresholds(spark, CONFIG).count() == 0


def test_stored_runs(spark, tmp_path):
    source = str(tmp_path / "in")
    raw(spark, ROWS).write.parquet(source)
    paths = {"input": source} | {k: str(tmp_path / k) for k in ("store", "author_scores", "scored_messages", "manifest")}
    config = deep_merge(CONFIG, {"paths": paths})
    run = Run(spark, config)
    with pytest.raises(FileNotFoundError):
        run.validate()
    built = run.build()
    assert len(built["tables"]) == 14 and set(built["tables"]) >= {"summary", "derived_thresholds", "top_domains", "score_bands", "keyword_validation"} and built["summary"].first().clean_rows == len(ROWS)
    assert tuple(built["scored"].columns) == schema.SCORED_COLUMNS
    before = sorted(tuple(r) for r in built["scored"].select("message_id", "final_score").collect())
    again = run.rescore()
    assert sorted(tuple(r) for r in again["scored"].select("message_id", "final_score").collect()) == before
    assert again["manifest"]["last_rescore_at"] and again["manifest"]["created_at"] == built["manifest"]["created_at"]
    run.validate()
    assert reports.manifest_table(spark, again["manifest"]).count() == 10
    with pytest.raises(RuntimeError):
        Run(spark, deep_merge(config, {"weights": {"author": {"activity": 0.5}}})).validate()
    with pytest.raises(RuntimeError):
        Run(spark, deep_merge(config, {"thresholds": {"min_text_len": 9}})).validate()
    spark.read.parquet(paths["author_scores"]).drop("author_score").write.parquet(str(tmp_path / "less"))
    with pytest.raises(ValueError):
        Run(spark, deep_merge(config, {"paths": {"author_scores": str(tmp_path / "less")}})).validate()
    debug = schema.store_columns("debug")
    assert len(debug) == len(set(debug)) == len(schema.LEAN_COLUMNS) + 5


def test_streams(spark, run, tmp_path):
    source = str(tmp_path / "in")
    raw(spark, ROWS).withColumn("date", F.try_to_timestamp("date")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = score_stream(stream, run, CONFIG, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)
    counted = window_clusters(stream, CONFIG).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    counted.processAllAvailable()
    counted.stop()
    assert spark.sql("SELECT sum(window_count) FROM windows").first()[0] == len(ROWS) - 1


def test_message_refs_default_to_one(spark):
    df = clean_store(raw(spark, [("a", None, None)]).limit(0), CONFIG)
    refs = messages.message_refs(df, clusters.text_clusters(df), clusters.text_window_clusters(df), CONFIG).first()
    assert refs.keyword_count.hi == 1.0 and refs.long_text_excess_max == 1.0
