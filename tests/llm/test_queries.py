"""The registered queries, column by column: against SQL on the driver's tables, and against brute force over awkward rows."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import KIND, brute_contamination, brute_fingerprint, brute_repeats, brute_scores, brute_spans, lower, made_up, same, words

from veracast.llm import langid, pii, quality, queries

DIR = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    same(got.select(columns).collect(), want.fetchall())


ITEMS = [(1, "ab cd"), (2, "word " * 15), (None, "é"), (4, None), (5, "..")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [*made_up(30), *((200 + k, f"Call +1 (312) 555-01{k:02d} or bob{k}@mail.example.com, 10.0.0.{k}, 4524132264652876") for k in range(12))]
    docs = spark.createDataFrame([(i, t, ("en", "fr", None)[k % 3], "s", len(t or "")) for k, (i, t) in enumerate(rows)], KIND)
    docs.withColumns({c: F.lit("clash") for c in ("id", "score", "h", "row", "words", "spans", "fingerprint", "bucket")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(31)
    spark.createDataFrame([(k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(600)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows


def run(spark, tables, name, *columns):
    return queries.queries()[name](spark, tables[0]).select(*columns).collect()


def held_out(i, modulus):
    return (zlib.crc32(str(i).encode()) if i is not None else 0) % modulus == 2


def test_op1(spark, tables):
    found = brute_contamination(tables[1], [(i, t) for i, t in ITEMS if i is not None], 13)
    every = brute_contamination(tables[1], [(i if i is not None else 0, t) for i, t in ITEMS], 13)
    want = [(i, n, hit, len(ids), sha(",".join(ids)), hit > 0 and 20 * hit >= n) for (i, n, hit, _), (_, _, _, ids) in zip(every, found, strict=True)]
    same(run(spark, tables, "op1_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_op2(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    out = run(spark, tables, "op2_pack_sequences", "*")
    ids = {}
    for i, t in tables[1]:
        full = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault((i, len(full)), []).append(full)
    covered, sequences = {}, {}
    for r in out:
        assert any(zlib.crc32(full[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for full in ids[r.doc_id, r.doc_tokens])
        covered[r.doc_id, r.doc_tokens] = covered.get((r.doc_id, r.doc_tokens), 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {k: k[1] * len(v) for k, v in ids.items()}
    padding = 0
    for pieces in sequences.values():
        total = 0
        for offset, n in sorted(pieces):
            assert offset == total
            total += n
        assert total <= 4096
        padding += 0 if total & (total - 1) == 0 else 4096 - total
    assert padding <= 0.01 * sum(covered.values()) + 4096


def test_op3(spark, tables):
    out = run(spark, tables, "op3_simhash_components", "doc_id", "fingerprint")
    same(out, [(i, f"{brute_fingerprint(t):016x}") for i, t in tables[1]])


def test_op4(spark, tables):
    out = run(spark, tables, "op4_score_quality", "*")
    model = quality.train(spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet"))
    want = {}
    for i, t in tables[1]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x = quality.features(raw, np.array([0, len(raw)]))[0]
        # table by table, one number at a time
        total = model.base if model.flat else model.base + sum(table[sum(c <= v for c in cuts)] for table, cuts, v in zip(model.tables, model.cuts, x, strict=True)) + sum(table[sum(c <= x[a] for c in model.coarse[a]), sum(c <= x[b] for c in model.coarse[b])] for a, b, table in model.pairs)
        want.setdefault(i, []).append(total if model.flat else 1 / (1 + np.exp(-total)))
    assert len(out) == len(tables[1])
    for r in out:
        assert any(r.score == pytest.approx(s, abs=1e-9) for s in want[r.doc_id])
        assert r.predicted == int(r.score >= 0.7) and r.held_out == held_out(r.doc_id, 4)


def test_op5(spark, tables):
    out = run(spark, tables, "op5_identify_language", "*")
    model = langid.train(spark.read.parquet(f"{tables[0]}/documents.parquet"))
    want = {}
    for i, t in tables[1]:
        buckets, _, has = langid.ngrams([t or ""])
        total = model.prior.astype(float).copy()
        for b in np.concatenate(buckets).tolist() if has[0] else ():
            total += model.table[b]
        p = np.exp(total - total.max())
        want.setdefault(i, []).append((model.languages[int(total.argmax())], float(p.max() / p.sum())) if has[0] else ("und", 0.0))
    assert len(out) == len(tables[1])
    for r in out:
        assert any(r.score == pytest.approx(s, abs=1e-3) and (r.lang_pred == lang or s < 0.501) for lang, s in want[r.doc_id])
        assert r.held_out == held_out(r.doc_id, 4)


def test_op6(spark, tables):
    same(run(spark, tables, "op6_remove_repeats", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute_repeats(tables[1]))


def test_op7(spark, tables):
    def base(i, t):
        spans = brute_spans(t or "")
        return (i, *(sum(k == kind for *_, k in spans) for kind in range(4)), sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in spans)))

    out = queries.queries()["op7_personal_data"](spark, tables[0])
    same(out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect(), [base(i, t) for i, t in tables[1]])
    assert all(r.spans == "" or all(s.split(":")[0] in pii.KINDS for s in r.spans.split(",")) for r in out.collect())


def test_op8(spark, tables):
    out = run(spark, tables, "op8_nearest_vectors", "*")
    rows = spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    hits = 0
    for q in range(0, 600, 100):
        near = sorted((float(np.sqrt(((x[q] - x[k]) ** 2).sum())), k) for k in x if k != q)
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, _, _ in got] == list(range(1, 11)) and [(s, k) for _, k, s in got] == sorted((s, k) for _, k, s in got)
        assert all(s == pytest.approx(dict((k, d) for d, k in near)[k], abs=1e-12) for _, k, s in got)
        hits += len({k for _, k, _ in got} & {k for _, k in near[:10]})
    assert hits >= 54


def test_op9(spark, tables):
    out = run(spark, tables, "op9_language_model", "doc_id", "held_out", "score")
    want = brute_scores(tables[1])
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id, 7)) for r in out)
    order = lambda pair: (pair[0] is not None, pair[0] or 0, pair[1])
    got, want = sorted(((r.doc_id, r.score) for r in out), key=order), sorted(want, key=order)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-5, atol=0.02)


def test_op10(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in tables[1]]
    same(run(spark, tables, "op10_count_tokens", "doc_id", "n_bytes", "n_tokens", "over_limit"), want)


def test_words_and_case():
    assert words("Ab-cD é1") == ["ab", "cd", "é1"] and lower("ÀB") == "Àb"
