"""The pipeline against the same decisions made one document at a time."""

import corpus_pipeline as P
from test_operators import KIND, brute_contamination, brute_fingerprint

from veracast.llm import pii

ROWS = [(1, "Some words"), (2, "12 34"), (3, None), (4, ""), (5, "\u00e9 7"), (None, "more"), (6, "\u6587")]


def test_unlabelled_texts_stay(spark):
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in ROWS], KIND)
    out = P.language(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.text for r in out.collect()) == ["Some words", "more", "\u00e9 7", "\u6587"]
    assert P.language(spark, docs.limit(0), "").count() == 0


def test_run(spark, tmp_path):
    leak = " ".join(f"leak{k}" for k in range(15))
    words = [f"common{k % 97} other{k % 31} the" for k in range(3000)]
    body = lambda k: " ".join(words[k * 40 : k * 40 + 60])
    rows = [(k, body(k)) for k in range(20)] + [(30, body(3)), (31, leak), (32, " ".join(words[800:1300]) + " " + leak), (33, None), (34, "12 34"), (35, "Reach me: bob.7@mail.example.com or so"), (36, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    root = {i: i for i in left}
    for a in left:
        for b in left:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                new, old = sorted((root[a], root[b]))
                root = {i: new if r == old else r for i, r in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    hits = {i: (n, h) for i, n, h, _ in brute_contamination(list(left.items()), [(1, leak)], 13)}
    left = {i: t.replace(leak, "") for i, t in left.items() if hits[i][1] * 20 < hits[i][0] or not hits[i][1]}
    left = {i: pii.masked(t, pii.base_spans(t)) for i, t in left.items()}
    assert 31 not in left and 30 not in left and left[35] == "Reach me: [EMAIL] or so" and leak not in left[32]

    df = docs
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
    got = df.collect()
    assert {r.doc_id: r.text for r in got} == left and all(r.n_chars == len(r.text) for r in got)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.vocabulary("word_bpe_49k.json"))
    out = P.run(spark, str(tmp_path)).collect()
    sizes = {}
    for r in out:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert P.ORACLE_SQL is None
