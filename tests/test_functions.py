"""Column expressions against literal expectations."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veracast.functions import scale as S
from veracast.functions import text as X


def values(spark, kind, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_missing(spark):
    rows = [" nan ", "None", "", "value", None, "N/A", " NULL ", "\x1c a \x1c"]
    assert values(spark, "string", rows, X.missing_to_null(F.col("x"))) == [None, None, None, "value", None, None, None, "a"]


def test_normalized(spark):
    rows = ["  Hello   world \r\n next  ", "ﬁn", "a　b", "a\r\rb", "n/a", "\n"]
    assert values(spark, "string", rows, X.normalized(F.col("x"))) == ["Hello world\nnext", "fin", "a b", "a\n\nb", None, None]


def test_keywords(spark):
    rows = ["bot, bot, spam  , spam", " , ,", "B, b,  two  words", None]
    assert values(spark, "string", rows, X.keywords(F.col("x"))) == ["bot, spam", None, "B, b, two words", None]
    assert values(spark, "string", ["bot, spam", None], X.keyword_count(F.col("x"))) == [2, 0]


def test_domains(spark):
    d = X.domain_parts(F.col("x"))
    rows = ["https://news.example.com/path", "http://news.bbc.co.uk", "localhost", "https://u:p@A_b.com:80/x", "example.com/path", None, "co.uk"]
    assert values(spark, "string", rows, d["raw_url_domain"], d["registered_domain"], d["subdomain"]) == [
        ("news.example.com", "example.com", "news"),
        ("news.bbc.co.uk", "bbc.co.uk", "news"),
        ("localhost", "localhost", None),
        ("a_b.com", "a_b.com", None),
        ("example.com", "example.com", None),
        (None, None, None),
        ("co.uk", "co.uk", None),
    ]


def test_text_statistics(spark):
    def expected(t):
        t = t or ""
        tokens = [w.lower() for w in re.findall(r"\b\w+\b", t)]
        counts = {w: tokens.count(w) for w in tokens}
        tags = len(re.findall(r"(?<!\w)#[\w_]+", t))
        top = max(counts.values(), default=0)
        return (len(tokens), len(counts), top, top / max(len(tokens), 1), sum(c >= 3 for c in counts.values()), tags, t.count("!"), tags / max(len(t), 1), tags / max(len(tokens), 1))

    rows = ["Bot bot bot #promo !!!", None, "", "#a#b ##d #e_f", "café 3² bot_x", "a a a b b b c"]
    got = values(spark, "string", rows, X.text_statistics(F.col("x")))
    assert [tuple(g) for g in got] == [pytest.approx(expected(t)) for t in rows]


def test_semantic_input(spark):
    rows = ["See HTTPS://x.y/z @Bob #Tag, 12 Times!", None, "www.x.y"]
    assert values(spark, "string", rows, X.semantic_input(F.col("x"))) == ["see bob tag times", "", ""]


def test_text_hash_of_missing(spark):
    a, b = values(spark, "string", [None, "<NA>"], X.text_hash(F.col("x")))
    assert a == b == "bd9e38fa" + a[8:]


def test_time_bucket_rounds_down(spark):
    df = spark.sql("SELECT timestamp_micros(-500000) AS a, TIMESTAMP '2024-01-01 00:00:00' AS b, CAST(NULL AS TIMESTAMP) AS c")
    assert tuple(df.select(*(X.time_bucket(F.col(c), 300) for c in "abc")).first()) == (-1, 5680224, None)


def test_scales(spark):
    lo, hi = F.lit(0.0), F.lit(10.0)
    assert values(spark, "double", [5.0, -1.0, 20.0, None], S.bounded(F.col("x"), lo, hi)) == [0.5, 0.0, 1.0, None]
    assert values(spark, "double", [5.0, 20.0, math.inf], S.inverse_bounded(F.col("x"), lo, hi)) == [0.5, 0.0, 0.0]
    assert values(spark, "double", [3.0], S.bounded(F.col("x"), F.lit(3.0), F.lit(3.0))) == [0.0]
    assert values(spark, "double", [10.0, 20.0, None], S.log_penalty(F.col("x"), 10, F.lit(20.0))) == [0.0, 1.0, None]


def test_neutral_override(spark):
    policy = {"neutral_score": 0.5, "epsilon": 1e-6}
    df = spark.createDataFrame([(0.5, 0.9), (0.9, 0.5), (0.5, 0.5), (0.9, 0.1)], "l double, r double")
    got = df.select(*S.neutral_override(F.col("l"), F.col("r"), F.lit(0.7), F.lit(0.3), policy)).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0), (1.0, 0.0), (0.5, 0.5), (pytest.approx(0.7), pytest.approx(0.3))]


def test_sigmoid_gate(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.0, 100.0)], "l double, r double")
    rows = [tuple(r) for r in df.select(*S.sigmoid_gate(F.col("l"), F.col("r"), 8)).collect()]
    assert rows[0] == (0.5, 0.5) and rows[1][1] == pytest.approx(1.0)


def test_compatibility_form_is_only_asked_where_needed():
    assert unicodedata.normalize("NFKC", "".join(map(chr, range(128)))) == "".join(map(chr, range(128)))
