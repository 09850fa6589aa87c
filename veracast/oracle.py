"""The registered queries in SQL, built from common table expressions that follow the same definitions."""

from __future__ import annotations

import re
from typing import Any

from .operators.authors import QUANTILE_FEATURES
from .operators.messages import COUNTS, FEATURES
from .queries import CONFIG, DAY, FINAL_COLUMNS, HISTORY, MESSAGE_COLUMNS, QUANTILE, SEMANTIC
from .schema import EXPLANATION_COLUMNS, SCORE_BANDS, TWO_PART_SUFFIXES

MESSAGES = """SELECT d.doc_id AS message_id,
  CASE WHEN d.doc_id % 13 = 0 THEN '  n/a ' WHEN d.doc_id % 7 = 0 THEN concat(d.text, ' #promo #deal') WHEN d.doc_id % 17 = 0 THEN 'Bot bot bot #promo !!!' ELSE d.text END AS original_text,
  CASE WHEN d.doc_id % 3 = 0 THEN concat(d.source, ', ', d.lang, ' ,, ', d.source) ELSE d.source END AS english_keywords,
  e.value AS sentiment, CAST(NULL AS VARCHAR) AS main_emotion,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE e.event_type END AS primary_theme, d.lang AS language, p.url AS url,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN e.user_id % 2 = 0 THEN 'u_hot' ELSE concat('u', CAST(e.user_id AS VARCHAR)) END AS author_hash,
  e.ts AS date
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id % 50"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def missing(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) NOT IN ('', 'nan', 'null', 'none', 'n/a') THEN {strip(x)} END"


def normalized(x: str) -> str:
    t = rf"regexp_replace(regexp_replace({missing(x)}, '\r\n?', chr(10), 'g'), '[^\S\n]+', ' ', 'g')"
    return "nullif(" + strip(rf"regexp_replace({t}, ' *\n *', chr(10), 'g')") + ", '')"


def keywords(x: str) -> str:
    """Kept in the order of first occurrence."""
    parts = rf"list_filter(list_transform(string_split({missing(x)}, ','), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"nullif(array_to_string(list_filter({parts}, lambda p, i: list_position({parts}, p) = i), ', '), '')"


def domain(x: str) -> dict[str, str]:
    link = f"CASE WHEN contains({missing(x)}, '://') THEN {missing(x)} ELSE 'https://' || {missing(x)} END"
    host = rf"nullif(trim(lower(regexp_extract({link}, '^[^:/?#]+://(?:[^/?#]*@)?([^:/?#]*)', 1)), '.'), '')"
    labels = f"string_split({host}, '.')"
    two = "','".join(TWO_PART_SUFFIXES)
    keep = f"CASE WHEN array_to_string({labels}[-2:], '.') IN ('{two}') AND len({labels}) >= 3 THEN 3 ELSE 2 END"
    return {
        "raw_url_domain": host,
        "registered_domain": f"CASE WHEN len({labels}) < 2 THEN {host} ELSE array_to_string({labels}[-({keep}):], '.') END",
        "subdomain": f"CASE WHEN len({labels}) >= 2 THEN nullif(array_to_string({labels}[:len({labels}) - ({keep})], '.'), '') END",
    }


def r6(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x.split('.')[-1]}"


def scale(x: str, lo: str, hi: str) -> str:
    top = f"(CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + 1.0 END)"
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(1.0, (CAST({x} AS DOUBLE) - {lo}) / ({top} - {lo}))) END)"


def inverse(x: str, lo: str, hi: str) -> str:
    top = f"(CASE WHEN {hi} > {lo} THEN {hi} ELSE {lo} + 1.0 END)"
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(1.0, ({top} - CAST({x} AS DOUBLE)) / ({top} - {lo}))) END)"


def penalty(x: str, start: float, most: str) -> str:
    return f"least(1.0, ln(1 + greatest({x} - {start}, 0.0)) / ln(1 + greatest({most} - {start}, 1.0)))"


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def ranges(features: dict[str, tuple[float, float]]) -> str:
    out = []
    for c, (lo, hi) in features.items():
        f = f"FILTER (WHERE {c} < 'Infinity'::DOUBLE)"
        low, high = (f"coalesce(quantile_cont(CAST({c} AS DOUBLE), {q}) {f}, {d})" for q, d in ((lo, "0.0"), (hi, "1.0")))
        out += [f"{low} AS {c}_lo", f"CASE WHEN abs({high} - {low}) <= 1e-8 + 1e-5 * abs({high}) THEN {low} + 1.0 ELSE {high} END AS {c}_hi"]
    return ", ".join(out)


def tables(config: dict[str, Any]) -> dict[str, str]:
    """All steps by name, in order."""
    t, policy = config["thresholds"], config["dominant_signal_policy"]
    tokens = r"list_transform(regexp_extract_all(coalesce(normalized_text, ''), '[\p{L}\p{N}_]+'), lambda t: lower(t))"
    floor = lambda base, parts, on: f"CASE WHEN greatest({', '.join(parts)}) >= {policy['threshold']} THEN greatest({base}, {', '.join(parts)}) ELSE {base} END" if on and policy["enabled"] else base
    semantic = config is SEMANTIC
    ok = rf"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(normalized_text, ''), '[@#]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\p{{Nd}}+', ' ', 'g')) <> ''"
    score = f"CASE WHEN {ok} THEN CAST(CAST((message_id % 101) / 100.0 AS FLOAT) AS DOUBLE) ELSE 0.5 END" if semantic else "0.5"
    d = domain("url")
    count = (lambda c: f"CASE WHEN s.normalized_text IS NULL THEN 0 ELSE coalesce({c}, 0) END") if config["runtime"]["null_text_mode"] == "ignore" else (lambda c: f"coalesce({c}, 0)")
    out = {
        "messages": MESSAGES,
        "cleaned": f"""SELECT message_id, {missing('original_text')} AS original_text, {normalized('original_text')} AS normalized_text, {keywords('english_keywords')} AS english_keywords_clean,
            sentiment, coalesce({missing('primary_theme')}, 'unknown_theme') AS primary_theme, {missing('language')} AS language, {missing('author_hash')} AS author_hash, {d['registered_domain']} AS registered_domain, url, date FROM messages""",
        "counted": rf"""SELECT *, sha1(coalesce(normalized_text, '<NA>')) AS text_hash, CAST(floor(epoch_us(date) / ({t['hard_bot_time_window_sec']} * 1e6)) AS BIGINT) AS time_window_bucket,
            CASE WHEN english_keywords_clean IS NULL THEN 0 ELSE len(list_filter(string_split(english_keywords_clean, ','), lambda p: trim(p) <> '')) END AS keyword_count,
            CASE WHEN author_hash IS NULL THEN 'anonymous' ELSE 'identified' END AS author_type, coalesce(length(normalized_text), 0) AS text_length_chars, {tokens} AS tokens,
            len(regexp_extract_all(coalesce(normalized_text, ''), '(^|[^\p{{L}}\p{{N}}_])#[\p{{L}}\p{{N}}_]+')) AS hashtag_count,
            length(coalesce(normalized_text, '')) - length(replace(coalesce(normalized_text, ''), '!', '')) AS exclamation_count, {score} AS roberta_score, {f"CASE WHEN {ok} THEN 1 ELSE 0 END" if semantic else "0"} AS semantic_model_applied_flag FROM cleaned""",
        "store": """SELECT *, len(tokens) AS token_count, len(list_distinct(tokens)) AS unique_token_count, coalesce(list_max(map_values(list_aggregate(tokens, 'histogram'))), 0) AS max_token_frequency,
            coalesce(list_max(map_values(list_aggregate(tokens, 'histogram'))), 0) / greatest(len(tokens), 1) AS max_token_ratio,
            coalesce(len(list_filter(map_values(list_aggregate(tokens, 'histogram')), lambda v: v >= 3)), 0) AS repeated_token_count_over_2,
            hashtag_count / greatest(text_length_chars, 1) AS hashtag_density_chars, hashtag_count / greatest(len(tokens), 1) AS hashtag_density_tokens FROM counted
            QUALIFY row_number() OVER (PARTITION BY original_text, author_hash, date, url ORDER BY message_id) = 1""",
        "text_clusters": "SELECT text_hash, min(normalized_text) AS normalized_text, count(*) AS repeat_count, count(DISTINCT author_hash) AS unique_author_count FROM store GROUP BY text_hash",
        "windows": "SELECT text_hash, time_window_bucket, count(*) AS window_count FROM store WHERE time_window_bucket IS NOT NULL GROUP BY ALL",
        "clustered0": f"""SELECT s.*, {count('c.repeat_count')} AS same_text_repeat_count, {count('c.unique_author_count')} AS same_text_unique_author_count, {count('w.window_count')} AS same_text_time_window_count
            FROM store s LEFT JOIN text_clusters c USING (text_hash) LEFT JOIN windows w ON w.text_hash = s.text_hash AND w.time_window_bucket = s.time_window_bucket""",
        "clustered": f"""SELECT *, CAST(same_text_repeat_count >= {t['spam_repeat_threshold']} OR same_text_unique_author_count >= {t['spam_multi_author_threshold']} OR same_text_time_window_count >= {t['spam_time_cluster_threshold']} AS BIGINT) AS spam_pattern_flag,
            CAST(same_text_repeat_count >= {t['hard_bot_repeat_threshold']} AND same_text_unique_author_count >= {t['hard_bot_multi_author_threshold']} AND same_text_time_window_count >= {t['hard_bot_time_cluster_threshold']} AS BIGINT) AS hard_bot_cluster_flag FROM clustered0""",
        "posts": "SELECT * FROM store WHERE author_hash IS NOT NULL AND date IS NOT NULL",
        "activity": """SELECT author_hash, count(*) AS total_posts, count(DISTINCT date_trunc('day', date)) AS active_days, count(DISTINCT date_trunc('hour', date)) AS active_hours, count(DISTINCT language) AS language_nunique,
            count(DISTINCT primary_theme) AS theme_nunique, coalesce(stddev_samp(sentiment), 0.0) AS sentiment_std, count(*) / greatest(count(DISTINCT date_trunc('day', date)), 1) AS posts_per_day,
            count(*) / greatest(count(DISTINCT date_trunc('hour', date)), 1) AS posts_per_active_hour FROM posts GROUP BY author_hash""",
        "hours": "SELECT author_hash, date_trunc('hour', date) AS hour, count(*) AS n FROM posts GROUP BY ALL",
        "max_hourly": "SELECT author_hash, max(n) AS max_posts_one_hour FROM hours GROUP BY author_hash",
        "gaps": "SELECT * FROM (SELECT author_hash, (epoch_us(date) - lag(epoch_us(date)) OVER (PARTITION BY author_hash ORDER BY date)) / 1e6 AS interpost_sec FROM posts) WHERE interpost_sec IS NOT NULL",
        "timing": """SELECT author_hash, CAST(sum(CAST(round(interpost_sec * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6 AS mean_interpost_sec, quantile_cont(interpost_sec, 0.5) AS median_interpost_sec, quantile_cont(interpost_sec, 0.1) AS p10_interpost_sec, stddev_samp(interpost_sec) AS std_interpost_sec,
            stddev_samp(interpost_sec) / nullif(CAST(sum(CAST(round(interpost_sec * 1e6) AS BIGINT)) AS DOUBLE) / count(*) / 1e6, 0) AS interval_cv FROM gaps GROUP BY author_hash""",
        "author_texts": "SELECT author_hash, text_hash, count(*) AS n FROM posts GROUP BY ALL",
        "repetition": "SELECT author_hash, coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n) AS same_text_repeat_ratio, max(n) AS same_text_repeat_max FROM author_texts GROUP BY author_hash",
        "shared": "SELECT author_hash, coalesce(sum(n) FILTER (WHERE unique_author_count > 1), 0) / sum(n) AS multi_author_repeat_ratio FROM author_texts LEFT JOIN text_clusters USING (text_hash) GROUP BY author_hash",
        "features": """SELECT a.*, max_posts_one_hour, coalesce(mean_interpost_sec, 'Infinity') AS mean_interpost_sec, coalesce(median_interpost_sec, 'Infinity') AS median_interpost_sec, coalesce(p10_interpost_sec, 'Infinity') AS p10_interpost_sec,
            coalesce(interval_cv, 'Infinity') AS interval_cv, same_text_repeat_ratio, same_text_repeat_max, multi_author_repeat_ratio
            FROM activity a JOIN max_hourly USING (author_hash) LEFT JOIN timing USING (author_hash) JOIN repetition USING (author_hash) JOIN shared USING (author_hash)""",
        "author_refs": f"SELECT {ranges(QUANTILE_FEATURES)}, coalesce(max(max_posts_one_hour), 1) AS max_posts_one_hour_max, coalesce(max(language_nunique), 1) AS language_nunique_max FROM features",
    }
    up = lambda c: scale(c, f"r.{c}_lo", f"r.{c}_hi")
    down = lambda c: inverse(c, f"r.{c}_lo", f"r.{c}_hi")
    ls = float(t["language_penalty_start"])
    out["author_parts"] = f"""SELECT f.*, 0.20 * {up('posts_per_day')} + 0.25 * {up('posts_per_active_hour')} + 0.55 * {penalty('max_posts_one_hour', float(t['hourly_penalty_start']), 'r.max_posts_one_hour_max')} AS activity_component,
        0.15 * {down('mean_interpost_sec')} + 0.25 * {down('median_interpost_sec')} + 0.35 * {down('p10_interpost_sec')} + 0.25 * {down('interval_cv')} AS timing_component,
        0.30 * {up('same_text_repeat_ratio')} + 0.25 * {up('same_text_repeat_max')} + 0.45 * {up('multi_author_repeat_ratio')} AS repetition_component,
        0.40 * {scale(f'greatest(language_nunique - {ls}, 0.0)', '0.0', f'greatest(r.language_nunique_max - {ls}, 1.0)')} + 0.30 * {up('theme_nunique')} + 0.30 * {up('sentiment_std')} AS diversity_component, 0.0 AS metadata_component FROM features f, author_refs r"""
    base = clip("0.35 * activity_component + 0.25 * timing_component + 0.30 * repetition_component + 0.10 * diversity_component")
    parts = [f"{k}_component" for k in ("activity", "timing", "repetition", "diversity")]
    out["author_scores"] = f"SELECT *, {floor(base, parts, policy['scope']['author'])} AS author_score, CAST(max_posts_one_hour > {t['hard_hourly_bot_threshold']} AS BIGINT) AS author_hard_hourly_flag FROM author_parts"
    own = [c for c in FEATURES if c not in COUNTS]
    tops = ", ".join([f"(SELECT coalesce(max({c}), 1) FROM store) AS {c}_hi" for c in own] + ["(SELECT coalesce(max(repeat_count), 1) FROM text_clusters) AS same_text_repeat_count_hi", "(SELECT coalesce(max(unique_author_count), 1) FROM text_clusters) AS same_text_unique_author_count_hi", "(SELECT coalesce(max(window_count), 1) FROM windows) AS same_text_time_window_count_hi"])
    out["message_refs"] = f"SELECT {tops}, {', '.join(f'0.0 AS {c}_lo' for c in FEATURES)}, greatest((SELECT coalesce(max(text_length_chars), 1) FROM store) - {float(t['long_text_start'])}, 1.0) AS long_text_excess_max"
    out["message_refs_quantile"] = f"SELECT {ranges({c: (0.05, 0.99) for c in FEATURES})}, greatest(coalesce(max(text_length_chars - {float(t['long_text_start'])}), 1.0), 1.0) AS long_text_excess_max FROM clustered"
    if config["runtime"]["refs_mode"] == "quantile":
        out["message_refs"] = out.pop("message_refs_quantile")
    out["message_parts"] = f"""SELECT m.*, 0.45 * {up('same_text_repeat_count')} + 0.35 * {up('same_text_unique_author_count')} + 0.20 * {up('same_text_time_window_count')} AS same_text_repeat_component, CAST(spam_pattern_flag AS DOUBLE) AS spam_pattern_component,
        0.40 * {up('hashtag_count')} + 0.30 * {up('hashtag_density_chars')} + 0.30 * {up('hashtag_density_tokens')} AS hashtag_spam_component,
        0.35 * {up('max_token_frequency')} + 0.45 * {up('max_token_ratio')} + 0.20 * {up('repeated_token_count_over_2')} AS token_repetition_component,
        least(1.0, ln(1 + greatest(text_length_chars - {float(t['long_text_start'])}, 0.0)) / ln(1 + greatest(r.long_text_excess_max, 1.0))) AS long_text_component, {up('keyword_count')} AS keyword_signal_component FROM clustered m, message_refs r"""
    names = ["same_text_repeat", "spam_pattern", "hashtag_spam", "token_repetition", "long_text", "keyword_signal"]
    total = clip(" + ".join(f"{w} * {k}_component" for k, w in zip(names, ("0.24", "0.25", "0.18", "0.15", "0.10", "0.08"), strict=True)))
    loud = "(hashtag_count > 5 OR exclamation_count > 10)"
    base = f"(CASE WHEN {loud} THEN 1.0 ELSE {total} END)"
    out["message_scores"] = f"SELECT *, {floor(base, [f'{k}_component' for k in names], policy['scope']['message'])} AS message_score, CAST(same_text_repeat_count > {policy['repeat_hard_threshold']} AS BIGINT) AS hard_same_text_repeat_flag FROM message_parts"
    neutral = lambda x: f"abs({x} - 0.5) <= 1e-6"
    share = lambda a, b: f"CAST(CAST(CASE WHEN {a} + {b} > 0 THEN {a} / ({a} + {b}) ELSE 0.5 END AS FLOAT) AS DOUBLE)"
    out["j0"] = f"SELECT m.*, a.author_score, coalesce(a.author_hard_hourly_flag, 0) AS author_hard_hourly_flag, {clip('coalesce(a.author_score, 0.5)')} AS fa, {clip('coalesce(message_score, 0.5)')} AS fm FROM message_scores m LEFT JOIN author_scores a USING (author_hash)"
    out["j1"] = f"SELECT *, CASE WHEN {neutral('fa')} THEN 0.0 ELSE 0.7 END AS ua, CASE WHEN {neutral('fm')} THEN 0.0 ELSE 0.3 END AS um FROM j0"
    out["j2"] = f"SELECT *, {clip('fa * ' + share('ua', 'um') + ' + fm * ' + share('um', 'ua'))} AS both_ FROM j1"
    out["behavioral"] = f"SELECT *, CASE WHEN hard_same_text_repeat_flag = 1 THEN 1.0 WHEN author_type = 'anonymous' THEN fm WHEN fm >= {policy['threshold']} THEN greatest(both_, fm) ELSE both_ END AS behavioral_score FROM j2"
    conf = lambda x: f"greatest(0.2, least(1.0, 0.2 + 0.8 * pow(abs({x} - 0.5) / 0.5, 2.0)))"
    out["k0"] = f"SELECT *, {conf('behavioral_score')} AS behavioral_confidence_weight, {conf('roberta_score')} AS roberta_confidence_weight FROM behavioral"
    out["k1"] = "SELECT *, 1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, 8.0 * (0.4 * roberta_confidence_weight - 0.6 * behavioral_confidence_weight))))) AS gate FROM k0"
    out["k2"] = f"SELECT *, CASE WHEN {neutral('behavioral_score')} THEN 0.0 ELSE 1.0 - gate END AS ub, CASE WHEN {neutral('roberta_score')} THEN 0.0 ELSE gate END AS ur FROM k1"
    out["k3"] = f"SELECT *, {share('ub', 'ur')} AS behavioral_effective_weight, {share('ur', 'ub')} AS roberta_effective_weight FROM k2"
    out["k4"] = f"SELECT *, {clip('behavioral_score * behavioral_effective_weight + roberta_score * roberta_effective_weight')} AS final_score_before_rules FROM k3"
    out["scored"] = f"SELECT *, CASE WHEN author_hard_hourly_flag = 1 OR hard_bot_cluster_flag = 1 OR hard_same_text_repeat_flag = 1 OR {loud} THEN 1.0 ELSE final_score_before_rules END AS final_score FROM k4"
    return out


def sql(select: str, until: str, config: dict[str, Any] = CONFIG, extra: dict[str, str] | None = None) -> str:
    """A query over the steps up to one of them."""
    steps: dict[str, str] = {}
    for name, text in tables(config).items():
        steps[name] = text
        if name == until:
            break
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in (steps | (extra or {})).items()) + " " + select


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


_FLOATS = ("max_token_ratio", "hashtag_density_chars", "hashtag_density_tokens", "sentiment")
_TWICE = {"messages": f"SELECT * FROM ({MESSAGES}) UNION ALL SELECT * REPLACE (message_id + 10000000 AS message_id) FROM ({MESSAGES}) WHERE message_id % 3 = 0"}
_KEY = "original_text, author_hash, date, url"


def _twice(select: str) -> str:
    steps = tables(CONFIG) | _TWICE
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in ("messages", "cleaned", "counted", "store")) + " " + select


def _refs(features, more: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join([r6(f"{c}_{p}") for c in features for p in ("lo", "hi")] + [r6(c) for c in more]) + f" FROM {source}"


_PAGE = domain("url")
_BAND = "CASE " + " ".join(f"WHEN final_score <= {top} THEN {k}" for k, (top, _) in enumerate(SCORE_BANDS)) + " END"
_BANDS = ", ".join(f"({k}, '{name}')" for k, (_, name) in enumerate(SCORE_BANDS))
_AUTHOR = f"author_hash, {r6('author_score')}, {big('max_posts_one_hour', 'language_nunique', 'total_posts')}"


def _hist(column: str, bins: int, table: str = "features", config: dict[str, Any] = CONFIG) -> str:
    ends = f"SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END AS a, CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END AS b FROM {table}"
    return sql(
        f"SELECT bin, {r6(f'a + bin * (b - a) / {bins}', 'low')}, {r6(f'a + (bin + 1) * (b - a) / {bins}', 'high')}, count(*) AS n FROM (SELECT CAST(least(floor(({column} - a) / ((b - a) / {bins})), {bins - 1}) AS BIGINT) AS bin, a, b FROM {table}, ends) GROUP BY bin, a, b",
        table,
        config,
        extra={"ends": ends},
    )


SQL: dict[str, str] = {
    "scan_messages": sql("SELECT message_id, original_text, english_keywords, round(sentiment, 6) + 0.0 AS sentiment, main_emotion, primary_theme, language, url, author_hash, epoch_us(date) AS date_us FROM messages", "messages"),
    "clean_missing": sql(f"SELECT message_id, {missing('original_text')} AS original_text, {missing('primary_theme')} AS primary_theme, {missing('author_hash')} AS author_hash FROM messages", "messages"),
    "clean_text": sql("SELECT message_id, normalized_text FROM cleaned", "cleaned"),
    "clean_keywords": sql("SELECT message_id, english_keywords_clean FROM cleaned", "cleaned"),
    "keyword_count": sql(f"SELECT message_id, {big('keyword_count')} FROM counted", "counted"),
    "text_stats": sql(f"SELECT message_id, {big('text_length_chars', 'token_count', 'unique_token_count', 'hashtag_count', 'exclamation_count')}, {r6('hashtag_density_chars')}, {r6('hashtag_density_tokens')} FROM store", "store"),
    "token_repetition": sql(f"SELECT message_id, {big('max_token_frequency', 'repeated_token_count_over_2')}, {r6('max_token_ratio')} FROM store", "store"),
    "semantic_text": sql(
        r"SELECT message_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(normalized_text, ''), 'http\S+|www\.\S+', ' ', 'gi'), '[@#]', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\p{Nd}+', ' ', 'g'), '\s+', ' ', 'g'))) AS semantic_text FROM cleaned",
        "cleaned",
    ),
    "domain_parts": f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _PAGE.items())} FROM pages",
    "text_hash": sql("SELECT message_id, text_hash FROM counted", "counted"),
    "time_bucket": "SELECT event_id, CAST(floor(epoch_us(ts) / 300e6) AS BIGINT) AS time_window_bucket FROM events",
    "message_flags": sql("SELECT message_id, author_type, CAST(author_hash IS NULL AS BIGINT) AS author_hash_missing_flag, CAST(normalized_text IS NULL AS BIGINT) AS is_empty_text, CAST(text_length_chars < 5 AS BIGINT) AS is_short_text, CAST(text_length_chars > 30 AS BIGINT) AS is_long_text_flag FROM store", "store"),
    "clean_messages": sql(
        f"SELECT message_id, original_text, normalized_text, text_hash, english_keywords_clean, primary_theme, language, registered_domain, time_window_bucket, author_hash, author_type, {', '.join(r6(c) for c in _FLOATS)}, {big('keyword_count', 'text_length_chars', 'token_count', 'unique_token_count', 'max_token_frequency', 'repeated_token_count_over_2', 'hashtag_count', 'exclamation_count')} FROM store",
        "store",
    ),
    "row_fingerprint_groups": _twice(f"SELECT copies, count(*) AS fingerprints FROM (SELECT count(*) AS copies FROM cleaned GROUP BY {_KEY}) GROUP BY copies"),
    "dedup_messages": _twice("SELECT message_id, text_hash, author_hash FROM store"),
    "clean_summary": _twice(
        "SELECT count(*) AS raw_rows, count(*) FILTER (WHERE date IS NULL) AS bad_date_rows, count(*) FILTER (WHERE author_hash IS NULL) AS missing_author_rows, count(*) FILTER (WHERE normalized_text IS NULL) AS empty_text_rows, count(*) FILTER (WHERE text_length_chars < 5) AS short_text_rows, CAST(0 AS BIGINT) AS rare_language_rows, CAST(0 AS BIGINT) AS semantic_applied_rows, (SELECT count(*) FROM store) AS clean_rows, count(*) - (SELECT count(*) FROM store) AS duplicate_rows FROM counted"
    ),
    "language_counts": sql(f"SELECT {missing('language')} AS language, count(*) AS rows FROM messages GROUP BY 1", "messages"),
    "rare_languages": sql(f"SELECT * FROM (SELECT {missing('language')} AS language, count(*) AS rows FROM messages GROUP BY 1) WHERE rows < 140 AND language IS NOT NULL", "messages"),
    "text_clusters": sql("SELECT * FROM text_clusters", "text_clusters"),
    "text_window_clusters": sql("SELECT * FROM windows", "windows", DAY),
    "message_cluster_join": sql(f"SELECT message_id, {', '.join(COUNTS)} FROM clustered", "clustered", DAY),
    "spam_pattern_flag": sql("SELECT spam_pattern_flag, count(*) AS rows, CAST(sum(message_id) AS BIGINT) AS ids FROM clustered GROUP BY 1", "clustered", DAY),
    "hard_bot_cluster_flag": sql("SELECT hard_bot_cluster_flag, count(*) AS rows, CAST(sum(message_id) AS BIGINT) AS ids FROM clustered GROUP BY 1", "clustered", DAY),
    "interpost_gaps": sql(f"SELECT author_hash, {r6('interpost_sec')} FROM gaps", "gaps"),
    "author_activity": sql(f"SELECT author_hash, total_posts, active_days, active_hours, language_nunique, theme_nunique, {r6('sentiment_std')}, {r6('posts_per_day')}, {r6('posts_per_active_hour')} FROM activity", "activity"),
    "author_max_hourly": sql("SELECT * FROM max_hourly", "max_hourly"),
    "author_hourly_distribution": sql("SELECT author_hash, string_agg(CAST(n AS VARCHAR), ',' ORDER BY hour) AS hourly_post_distribution FROM hours GROUP BY author_hash", "hours"),
    "author_timing": sql("SELECT author_hash, " + ", ".join(r6(c) for c in ("mean_interpost_sec", "median_interpost_sec", "p10_interpost_sec", "std_interpost_sec", "interval_cv")) + " FROM timing", "timing"),
    "author_repetition": sql(f"SELECT author_hash, {r6('same_text_repeat_ratio')}, same_text_repeat_max FROM repetition", "repetition"),
    "author_multi_author_ratio": sql(f"SELECT author_hash, {r6('multi_author_repeat_ratio')} FROM shared", "shared"),
    "author_features": sql(
        "SELECT author_hash, total_posts, active_days, active_hours, language_nunique, theme_nunique, max_posts_one_hour, same_text_repeat_max, "
        + ", ".join(r6(c) for c in ("sentiment_std", "posts_per_day", "posts_per_active_hour", "same_text_repeat_ratio", "multi_author_repeat_ratio"))
        + ", "
        + ", ".join(r6(f"CASE WHEN {c} < 'Infinity'::DOUBLE THEN {c} ELSE -1 END", c) for c in ("mean_interpost_sec", "median_interpost_sec", "p10_interpost_sec", "interval_cv"))
        + " FROM features",
        "features",
    ),
    "author_refs": sql(_refs(QUANTILE_FEATURES, {"max_posts_one_hour_max": "", "language_nunique_max": ""}, "author_refs"), "author_refs"),
    "author_scores": sql("SELECT author_hash, " + ", ".join(r6(f"{k}_component") for k in ("activity", "timing", "repetition", "diversity", "metadata")) + f", {r6('author_score')}, author_hard_hourly_flag, {big('max_posts_one_hour', 'language_nunique', 'theme_nunique')}, {r6('sentiment_std')} FROM author_scores", "author_scores", DAY),
    "message_refs": sql(_refs(FEATURES, {"long_text_excess_max": ""}, "message_refs"), "message_refs", DAY),
    "message_refs_quantile": sql(_refs(FEATURES, {"long_text_excess_max": ""}, "message_refs_quantile"), "message_refs_quantile", DAY),
    "bounded_scale": f"SELECT {r6('l_quantity', 'v')}, count(*) AS n, {r6(scale('l_quantity', '10.0', '40.0'), 'scaled')}, {r6(inverse('l_quantity', '10.0', '40.0'), 'inverse')} FROM lineitem GROUP BY l_quantity",
    "log_penalty": f"SELECT {r6('l_quantity', 'v')}, count(*) AS n, {r6(penalty('l_quantity', 10.0, '50.0'), 'penalty')} FROM lineitem GROUP BY l_quantity",
    "message_scores": sql("SELECT message_id, hard_same_text_repeat_flag, " + ", ".join(r6(c) for c in MESSAGE_COLUMNS[1:-1]) + " FROM message_scores", "message_scores", SEMANTIC),
    "behavioral_scores": sql("SELECT message_id, author_type, " + ", ".join(r6(c) for c in ("author_score", "message_score", "behavioral_score")) + " FROM behavioral", "behavioral", SEMANTIC),
    "final_scores": sql("SELECT message_id, " + ", ".join(r6(c) for c in FINAL_COLUMNS[1:]) + " FROM scored", "scored"),
    "final_scores_semantic": sql("SELECT message_id, " + ", ".join(r6(c) for c in FINAL_COLUMNS[1:]) + " FROM scored", "scored", SEMANTIC),
    "final_scores_quantile": sql("SELECT message_id, " + ", ".join(r6(c) for c in FINAL_COLUMNS[1:]) + " FROM scored", "scored", QUANTILE),
    "final_score_histogram": _hist("final_score", 40, "scored", SEMANTIC),
    "semantic_neutral": sql("SELECT CAST(0.5 AS DOUBLE) AS roberta_score, CAST(0 AS BIGINT) AS semantic_model_applied_flag, count(*) AS rows FROM messages", "messages"),
    "semantic_summary": sql(f"SELECT count(*) AS rows, {r6('avg(roberta_score)', 'avg_roberta_score')}, {r6('min(roberta_score)', 'min_roberta_score')}, {r6('max(roberta_score)', 'max_roberta_score')}, CAST(sum(semantic_model_applied_flag) AS BIGINT) AS semantic_applied_rows FROM store", "store", SEMANTIC),
    "keyword_validation": sql(
        f"SELECT h.heavy AS is_heavy_message, {r6('coalesce(sum(keyword_count), 0) / greatest(count(message_id), 1)', 'avg_keyword_count')}, {r6('quantile_cont(keyword_count, 0.5)', 'median_keyword_count')}, {r6('avg(text_length_chars)', 'avg_text_length')}, count(message_id) AS rows FROM (VALUES (false), (true)) h(heavy) LEFT JOIN clustered c ON h.heavy = (same_text_repeat_count >= 3 OR spam_pattern_flag = 1) GROUP BY 1",
        "clustered",
        DAY,
    ),
    "score_bands": sql(f"SELECT CAST(b.k AS BIGINT) AS band_order, b.band, count(s.message_id) AS rows, {r6('count(s.message_id) / (SELECT count(*) FROM scored)', 'share')} FROM (VALUES {_BANDS}) b(k, band) LEFT JOIN scored s ON b.k = {_BAND} GROUP BY 1, 2", "scored", SEMANTIC),
    "manipulation_map": sql(
        f"SELECT language, registered_domain, count(*) AS rows, {r6('avg(final_score)', 'avg_final_score')}, CAST(sum(hard_bot_cluster_flag) AS BIGINT) AS hard_cluster_rows, CAST(sum(hard_same_text_repeat_flag) AS BIGINT) AS hard_repeat_rows, CAST(sum(hard_bot_cluster_flag) + sum(hard_same_text_repeat_flag) AS BIGINT) AS coordination_pressure FROM scored GROUP BY 1, 2 HAVING count(*) >= 5",
        "scored",
        SEMANTIC,
    ),
    "top_domains": sql("SELECT registered_domain, count(*) AS rows FROM store WHERE registered_domain IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "store"),
    "hourly_heavy_authors": sql(f"SELECT {_AUTHOR} FROM author_scores WHERE max_posts_one_hour > 1 ORDER BY author_scores.max_posts_one_hour DESC, author_hash LIMIT 50", "author_scores"),
    "hourly_hard_authors": sql(f"SELECT {_AUTHOR} FROM author_scores WHERE author_hard_hourly_flag = 1 ORDER BY author_scores.max_posts_one_hour DESC, author_hash LIMIT 50", "author_scores", DAY),
    "language_diversity_authors": sql(f"SELECT {_AUTHOR} FROM author_scores WHERE language_nunique > 2 ORDER BY author_scores.language_nunique DESC, author_hash LIMIT 50", "author_scores"),
    "rapid_fire_authors": sql(f"SELECT {_AUTHOR}, {r6(chr(67) + 'ASE WHEN a.median_interpost_sec < ' + chr(39) + 'Infinity' + chr(39) + '::DOUBLE THEN a.median_interpost_sec END', 'median_interpost_sec')} FROM author_scores a ORDER BY a.median_interpost_sec, author_hash LIMIT 50", "author_scores"),
    "hourly_penalty_curve": sql(f"SELECT posts, {r6(penalty('posts', 10.0, 'top'), 'penalty')} FROM (SELECT max(max_posts_one_hour) AS top FROM features), LATERAL (SELECT unnest(range(1, CAST(top AS BIGINT) + 1)) AS posts)", "features"),
    "hourly_histogram": _hist("max_posts_one_hour", 40),
    "theme_histogram": _hist("theme_nunique", 30),
    "sentiment_histogram": f"SELECT bin, n FROM ({_hist('sentiment_std', 30)})",
    "hashtag_spam_examples": sql(f"SELECT message_id, {r6('s.hashtag_spam_component')}, {r6('final_score')} FROM scored s ORDER BY s.hashtag_spam_component DESC, message_id LIMIT 20", "scored", SEMANTIC),
    "token_spam_examples": sql(f"SELECT message_id, {r6('s.token_repetition_component')}, {r6('final_score')} FROM scored s ORDER BY s.token_repetition_component DESC, message_id LIMIT 20", "scored", SEMANTIC),
    "hard_bot_examples": sql(f"SELECT message_id, author_hash, {', '.join(COUNTS)}, hard_same_text_repeat_flag, {r6('final_score')} FROM scored WHERE hard_bot_cluster_flag = 1 OR hard_same_text_repeat_flag = 1 ORDER BY message_id LIMIT 50", "scored", DAY),
    "message_page": sql("SELECT message_id, text_hash FROM store WHERE message_id > 100 ORDER BY message_id LIMIT 25", "store"),
}
for _n, _name, _key in ((3, "coverage_share", "domain_coverage"), (128, "top128_coverage_share", "top128_coverage")):
    SQL[_key] = sql(
        f"SELECT count(*) AS unique_domains, {r6(f'(SELECT sum(n) FROM (SELECT count(*) AS n FROM store WHERE registered_domain IS NOT NULL GROUP BY registered_domain ORDER BY n DESC LIMIT {_n})) / sum(n)', _name)} FROM (SELECT registered_domain, count(*) AS n FROM store WHERE registered_domain IS NOT NULL GROUP BY 1)",
        "store",
    )


_NEW_ROWS = ((1, "'Bot bot bot #promo !!!'", "'bot, promo'", "'u_hot'", "'2024-01-01 00:00:00'"), (2, "'Quite a new text about nothing in particular'", "NULL", "NULL", "NULL"), (3, "'#a #b #c #d #e #f'", "'x'", "'nobody'", "NULL"))


def _new_messages(config: dict[str, Any], replaced: dict[str, str]) -> str:
    """New messages through the same steps as the history, reading its authors and ranges; ``replaced`` gives steps of their own."""
    steps = tables(config)
    own = ["messages", "cleaned", "counted", "store", *(n for n in replaced if n not in steps or n in ("text_clusters", "windows")), "clustered0", "clustered", "message_parts", "message_scores", "j0", "j1", "j2", "behavioral", "k0", "k1", "k2", "k3", "k4", "scored"]
    row = "SELECT CAST({} AS BIGINT) AS message_id, {} AS original_text, {} AS english_keywords, CAST(NULL AS DOUBLE) AS sentiment, CAST(NULL AS VARCHAR) AS primary_theme, CAST(NULL AS VARCHAR) AS language, CAST(NULL AS VARCHAR) AS url, CAST({} AS VARCHAR) AS author_hash, CAST({} AS TIMESTAMP) AS date"
    fixed = {"messages": " UNION ALL ".join(row.format(*r) for r in _NEW_ROWS)} | replaced
    new = {f"new_{n}": fixed[n] if n in fixed else re.sub(rf"\b(FROM|JOIN) ({'|'.join(own)})\b", r"\1 new_\2", steps[n]) for n in own}
    flags = ("author_hard_hourly_flag", "hard_bot_cluster_flag", "hard_same_text_repeat_flag")
    columns = [c for c in EXPLANATION_COLUMNS if c not in (*flags, "author_type")]
    return sql("SELECT message_id, author_type, " + ", ".join(r6(c) for c in columns) + f", {big(*flags)} FROM new_scored", "message_refs", config, new)


def _single() -> str:
    """Against the history's clusters; an unknown author scores 0."""
    j0 = tables(CONFIG)["j0"].replace("FROM message_scores", "FROM new_message_scores")
    j0 = j0.replace("m.*, a.author_score,", "m.*, coalesce(a.author_score, 0.0) AS author_score,").replace("coalesce(a.author_score, 0.5)", "coalesce(a.author_score, 0.0)")
    return _new_messages(CONFIG, {"j0": j0})


def _single_with_history() -> str:
    """Counted together with the history; an unknown author has no score."""
    both = "(SELECT text_hash, author_hash, time_window_bucket FROM store UNION ALL SELECT text_hash, author_hash, time_window_bucket FROM new_store)"
    text = f"SELECT text_hash, count(*) AS repeat_count, count(DISTINCT author_hash) AS unique_author_count FROM {both} GROUP BY text_hash"
    windows = f"SELECT text_hash, time_window_bucket, count(*) AS window_count FROM {both} WHERE time_window_bucket IS NOT NULL GROUP BY ALL"
    return _new_messages(HISTORY, {"text_clusters": text, "windows": windows})


SQL["score_single"] = _single()
SQL["score_single_with_history"] = _single_with_history()
