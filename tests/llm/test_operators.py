"""Operators against brute force, over awkward inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veracast.llm import ann, common, decontam, langid, packing, pii, ppm, quality, queries, simhash, suffix_dedup, token_count
from veracast.llm.components import connected_components

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def documents(spark, rows):
    """(id, text) rows with the other columns, and ones whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, ("en", "fr", None)[k % 3], "s", len(t or "")) for k, (i, t) in enumerate(rows)], KIND)
    return df.withColumns({c: F.lit("clash") for c in ("id", "score", "h", "row", "words", "spans", "fingerprint", "bucket")})


def made_up(seed, n=60, alphabet="ab cd.\né E"):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(30, 120))) for _ in range(8)]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", " ", "x" * 300, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))), rng.choice(pieces)])) for _ in range(n)]
    return [*rows, rows[-1], (7, "word " * 30_000)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_contamination(rows, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    found |= windows[x]
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, block):
    rows = made_up(1)[:-1]
    rng = random.Random(2)
    items = [(k % 5 or None, " ".join(rng.choice(["ab", "b", "é", "cd", "x" * 300]) for _ in range(rng.randint(0, 6)))) for k in range(12)] + [(3, None), (4, "zzz"), (9, "d E")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(documents(spark, rows), bench, 3, block_bytes=block).withColumn("n", decontam.hit_words())
    same(found.select("doc_id", "n_words", "n", "item_ids").collect(), brute_contamination(rows, items, 3))
    empty = decontam.find_contamination(documents(spark, rows), bench.limit(0))
    assert all(r.words == [] for r in empty.collect())


def test_decontaminated_text(spark):
    passage = " ".join(f"leak{k}" for k in range(20))
    long = " ".join(f"fine{k}" for k in range(900))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(spark, [(1, passage), (2, f"{long} {passage}, after"), (3, long), (4, None)])
    out = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()}
    assert out == {2: f"{long} , after", 3: long, 4: None}
    assert decontam.decontaminate(docs, bench).columns == docs.columns


def test_passages_of_items_without_an_id(spark, tmp_path):
    passage, named = (" ".join(f"{w}{k}" for k in range(13)) for w in ("leak", "named"))
    long = " ".join(f"fine{k}" for k in range(900))
    bench = spark.createDataFrame([(None, passage), (None, passage), (5, named), (None, None)], "item_id long, text string")
    docs = documents(spark, [(1, passage), (2, f"{long} {passage}, after"), (3, f"{passage} {named}"), (4, long)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in queries.op1_decontaminate(spark, str(tmp_path)).collect()}
    assert out == {1: (13, 13, 0, True), 2: (914, 13, 0, False), 3: (26, 26, 1, True), 4: (900, 0, 0, False)}
    found = decontam.find_contamination(docs, bench, block_bytes=60, nameless=True)
    assert {r.doc_id: r.item_ids for r in found.collect()} == {1: [], 2: [], 3: ["5"], 4: []}
    assert {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()} == {2: f"{long} , after", 4: long}


def test_packing(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = [*made_up(3), (50, "I'LL go, don't <|endoftext|> ١٢ Σ ＡＢ"), (51, "new \U0001f9cc")]
    df = documents(spark, rows).where("true")
    out = packing.pack_documents(df, path, capacity=256).collect()
    pieces, sequences = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    expected = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected[(i, len(ids))] += len(ids)
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == dict(expected)
    one = next(r for r in out if r.doc_id == 50)
    ids = [*library.encode(rows[-2][1], add_special_tokens=False).ids, 2]
    assert one.ids_crc32 == zlib.crc32(np.array(ids[one.start : one.start + one.length], "<u4").tobytes())
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_fullest_part():
    rng = random.Random(4)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        reach = {0}
        for length, n in counts.items():
            reach = {s + k * length for s in reach for k in range(n + 1)}
        taken = packing.fullest(counts, 50)
        assert all(taken[k] <= counts[k] for k in taken) and sum(k * n for k, n in taken.items()) == max(s for s in reach if s <= 50)


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 300)}" for _ in range(300)]
    rows = made_up(6)[:-1] + [(100 + k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(12)]
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(x for x in (least.get(r), i, math.inf) if x is not None)
    expected = [(i, f - (1 << 64) if f >> 63 else f, None if least[r] == math.inf else least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True)]
    docs = documents(spark, rows)
    same(simhash.near_duplicates(docs).collect(), expected)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for i, _, c in expected if i == c}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_connect_what_is_near():
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(20)}
    for b in list(values)[:3]:
        for _ in range(80):
            x = b
            for _ in range(rng.randint(1, 8)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    v = np.array(sorted(values), np.uint64)
    links = simhash.pivot_links(v, 4)
    near = np.argwhere(np.triu(np.bitwise_count(v[:, None] ^ v[None]) <= 4, 1))

    def groups(pairs):
        root = {int(x): int(x) for x in v}
        for a, b in pairs:
            a, b = root[int(a)], root[int(b)]
            root = {k: a if r == b else r for k, r in root.items()} if a != b else root
        return {frozenset(k for k in root if root[k] == r) for r in root.values()}

    assert groups([(a, b) for x, y in links for a, b in zip(x, y, strict=True)]) == groups([(v[a], v[b]) for a, b in near])


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in edges if a != b) and got[30] == 0 and got[159] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["the", "and", "of", "with"] if k % 2 else ["der", "und", "nicht", "mit"]) for _ in range(20))) for k in range(200)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in rows] + [(None, None, None), (900, "12 !?", "en"), (901, "", None), (902, "the and", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predict_languages(df, langid.train(df)).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") and 0.9 < out[i].lang_score <= 1 for i, _ in rows)
    assert all((out[i].lang_pred, out[i].lang_score) == ("und", 0.0) for i in (None, 900, 901)) and out[902].lang_pred == "en"
    nothing = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict_languages(df, nothing).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(10)
    good = lambda: " ".join("".join(rng.choice("aeioustr") for _ in range(rng.randint(2, 9))) for _ in range(60)) + "."
    rows = [(k, good() if k % 2 else good().upper() + "!! $$$") for k in range(400)] + [(900, None), (901, ""), (None, "x")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train(docs, labels)).collect()}
    assert sum((out[k] >= 0.7) == (k % 2 == 1) for k in range(400)) >= 396 and all(0 <= s <= 1 for s in out.values())
    flat = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, flat).collect()} == {0.5}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def brute_repeats(rows):
    first, out = {}, []
    for i, t in rows:
        s = (t or "").encode()
        for k in range(len(s) - 49 if i is not None else 0):
            w = s[k : k + 50]
            first[w] = min(first.get(w, i), i)
    for i, t in rows:
        s = (t or "").encode()
        gone = np.zeros(len(s) + 1, np.int8)
        for k in range(len(s) - 49 if i is not None else 0):
            if first[s[k : k + 50]] < i:
                gone[k : k + 50] = 1
        kept = bytes(np.frombuffer(s, np.uint8)[gone[:-1] == 0])
        out.append((i, len(s), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_repeats(spark, seed):
    rows = made_up(seed)
    docs = documents(spark, rows)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same(got.collect(), brute_repeats(rows))
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    for length in (10, 64):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(docs, length)


def test_two_stage_sorting():
    rng = random.Random(13)
    for _ in range(200):
        letters = rng.choice([b"ab", b"a", bytes(range(1, 250))])
        t = bytes(rng.choice(letters) for _ in range(rng.randint(1, 150))) * rng.randint(1, 2)
        order = suffix_dedup.two_stage_order(np.frombuffer(t + b"\0" * 64, np.uint8), 56).tolist()
        padded = t + b"\0" * 64
        assert sorted(order) == list(range(len(t))) and all(padded[a : a + 56] <= padded[b : b + 56] for a, b in zip(order, order[1:], strict=False))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    _, _, _, text, lo, hi = suffix_dedup.chunk_anchors(raw, np.array([0, 1000, 1020, 3000]), 50)
    windows = sorted((t, w) for t, a, b in zip(text, lo, hi, strict=True) for w in range(a, b + 1))
    assert windows == [(t, w) for t, n in ((0, 1000), (2, 1980)) for w in range(n - 49)]


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(14)
    for _ in range(5000):
        letters = rng.choice(["a1.@-é ", "12. -+()", "0123456789 -", "a@.+"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_personal_data(spark):
    texts = [None, "", "write to bob.7@mail.example.com", "+1 (269) 555-3296 4524132264652876", "call (312) 555-0123 now", "v1.2.3 on 2024-01-02, no. 1234567890123456", "bob [at] mail [dot] com", "1.2.3.4 " * 20_000]
    out = {r.doc_id: r for r in pii.find_personal_data(documents(spark, list(enumerate(texts))), keep=("text",), mask=True).collect()}
    assert (out[0].spans, out[0].base, out[1].spans) == ("", "", "")
    assert out[2].masked_text == "write to [EMAIL]" and out[2].n_email == 1
    assert out[3].base == "" and out[3].spans == "phone:0:17,card:18:34"
    assert out[4].spans == "phone:5:19" and out[5].spans == "" and out[6].masked_text == "[EMAIL]" and out[7].n_ip == 20_000
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in out.values())
    rng, right, wrong = random.Random(15), 0, 0
    for _ in range(150):
        text, gold = pii._examples(rng)
        found = set(pii.trained_field().best(text, 0, len(text)))
        right, wrong = right + len(found & set(gold)), wrong + len(found ^ set(gold))
    assert right > 150 and wrong <= 8


def path_score(field, text, spans):
    """The score of a segmentation, all tokens outside the spans taken one by one."""
    cuts, candidates = field.candidates(text)
    score = {(a, b): s for (a, b, _), s in zip(candidates, field.scores(candidates), strict=True) if (a, b) not in {(x, y) for x, y, _ in spans} or s[0] == -np.inf}
    single = {(a, b): s for (a, b, _), s in zip(candidates, field.scores(candidates), strict=True) if s[0] > -np.inf}
    total, last, at = 0.0, 0, 0
    for a, b, y in [*sorted(spans), (len(cuts) - 1, None, None)]:
        while at < a:
            total += field.steps[last, 0] + single[at, at + 1][0]
            last, at = 0, at + 1
        if b is not None:
            total += field.steps[last, y] + score[a, b][y]
            last, at = y, b
    return total


def all_segmentations(candidates, n, at=0):
    if at == n:
        yield []
        return
    for a, b, is_span in candidates:
        if a == at:
            for rest in all_segmentations(candidates, n, b):
                if is_span:
                    yield from ([(a, b, y), *rest] for y in range(1, len(pii.KINDS) + 1))
                else:
                    yield rest


def test_best_segmentation_is_that_of_all():
    field, rng = pii.trained_field(), random.Random(22)
    for _ in range(60):
        text = "".join(rng.choice(["+1 ", "269", "555-3296", "(312) ", " ", "4524132264652876", ".", "10.0", "a@b.de", "x"]) for _ in range(rng.randint(2, 5)))
        cuts, candidates = field.candidates(text)
        spans = [(a, b, s[0] == -np.inf) for (a, b, _), s in zip(candidates, field.scores(candidates), strict=True)]
        if sum(s for _, _, s in spans) > 9:
            continue
        at = {c: k for k, c in enumerate(cuts)}
        got = [(at[s], at[e], k + 1) for s, e, k in field.best(text, 0, len(text))]
        most = max(path_score(field, text, found) for found in all_segmentations(spans, len(cuts) - 1))
        assert path_score(field, text, got) == pytest.approx(most, abs=1e-9)


def test_long_numbers_take_bounded_memory(monkeypatch):
    field = pii.trained_field()
    text = " ".join(map(str, range(9000))) + " +1 (269) 555-3296 4524132264652876 " * 200
    whole = field.best(text, 0, len(text))
    monkeypatch.setattr(pii, "SETTLE", 64)
    assert field.best(text, 0, len(text)) == whole and len(whole) > 300
    peaks = []
    for n in (1, 3):
        tracemalloc.start()
        field.best(text[:15_000] * n, 0, 15_000 * n)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 200_000


def test_hashing_selects_and_recalls():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    rotations, probes = ann.plan(len(x), 32)
    assert rotations == 2
    block = ann.QueryBlock(np.arange(0, 20_000, 400), x[::400], ann.TABLES, rotations, probes)
    met = sum(len(q) for q, _ in block.pairs(ann.unit_vectors(x)))
    assert met < 0.6 * 50 * len(x)
    ids, rows, d = block.search(np.arange(len(x)), x, 10)
    hits = 0
    for q in range(0, 20_000, 400):
        true = np.argsort(((x.astype(float) - x[q].astype(float)) ** 2).sum(1), kind="stable")[1:11]
        hits += len({*true.tolist()} & {*rows[ids == q].tolist()})
    assert hits >= 0.9 * 500
    exact = ann.QueryBlock(np.arange(0, 20_000, 4000), x[::4000], 0, rotations, probes)
    ids, rows, d = exact.search(np.arange(len(x)), x, 10)
    true = np.argsort(((x.astype(float) - x[4000].astype(float)) ** 2).sum(1), kind="stable")[1:11]
    assert rows[ids == 4000].tolist() == true.tolist()


def test_probes_follow_the_neighbours_and_not_the_rows():
    assert len({ann.plan(n, 64) for n in (10, 500, 16_383, 16_384, 51_282, 10**7)}) == 1
    rng = np.random.default_rng(22)
    for n in (2_000, 20_000):
        for spread, most in ((0.3, 0.1), (3.0, 0.6)):
            x = (rng.normal(size=(n // 50, 64))[rng.integers(0, n // 50, n)] + spread * rng.normal(size=(n, 64))).astype(np.float32)
            asked, length = np.arange(0, n, n // 50), np.linalg.norm(x, axis=1)
            first = ann.QueryBlock(asked, x[asked], ann.TABLES, *ann.plan(n, 64), np.full(len(asked), -1.0)).search(np.arange(n), x, 10)
            far = np.array([first[2][first[0] == q].max() for q in asked]) / length[asked]
            block = ann.QueryBlock(asked, x[asked], ann.TABLES, *ann.plan(n, 64), far)
            assert sum(len(q) for q, _ in block.pairs(ann.unit_vectors(x))) < most * len(asked) * n
            ids, rows, _ = block.search(np.arange(n), x, 10)
            hits = 0
            for q in asked.tolist():
                true = np.argsort(((x.astype(float) - x[q].astype(float)) ** 2).sum(1), kind="stable")[1:11]
                hits += len({*true.tolist()} & {*rows[ids == q].tolist()})
            assert hits >= 9 * len(asked)


def test_wide_rotations_are_the_dense_ones(monkeypatch):
    x = ann.unit_vectors(np.random.default_rng(3).normal(size=(40, 20)).astype(np.float32))
    dense = ann.CrossPolytope(20, 2, 2)
    monkeypatch.setattr(ann, "DENSE", 0)
    plain = ann.CrossPolytope(20, 2, 2)
    assert np.allclose(dense.turned(x, 1, 1), plain.turned(x, 1, 1), atol=1e-5)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:760] = x[700]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, 2.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = ann.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        true = sorted((s, k) for k, s in enumerate(d) if k != q)[:10]
        assert len(found[q]) == 10 and found[q] == sorted(found[q]) and all(s == pytest.approx(d[k], abs=1e-12) for s, k in found[q])
        hits += len({k for _, k in true} & {k for _, k in found[q]})
    assert hits >= 0.9 * 150 and [k for _, k in found[700]] == list(range(701, 711))
    # whatever is found, distances are exact and ranked; probing every bucket of two rotations finds all
    every = ann.nearest_neighbours(df, df.where("vec_id % 100 = 0"), tables=1, rotations=2, probes=1 << 12, block_bytes=1 << 18).collect()
    for q in range(0, 1500, 300):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        assert len([r for r in every if r.query_id == q]) == 10 and all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in every if r.query_id == q)
    few = ann.nearest_neighbours(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert {r.vec_id for r in few} == {1, 2, 3}
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 3, ppm.HOT_WORDS])
def test_language_model(spark, hot, monkeypatch):
    monkeypatch.setattr(ppm, "DEEP_BUCKETS", 3)  # so that what is asked of a group comes in shares
    rows = made_up(16)
    out = ppm.score_documents(documents(spark, rows), kept=(50, 50, 50), hot=hot).collect()
    counts, tokens = Counter(), []
    for i, t in rows:
        w = [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
        tokens.append(w)
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    expected = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 3)) for (i, _), w in zip(rows, tokens, strict=True)]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out], expected)
    assert all(r.score <= 0 for r in out)
    assert ppm.score_documents(documents(spark, []), kept=(50, 50, 50)).count() == 0


def brute_scores(rows):
    """Log10 probability of each text by all contexts of up to five bytes, one symbol at a time."""
    followers, texts_ = {}, [b"\xff" * 5 + lower(t).encode() + b"\xff" for _, t in rows]
    for (i, _), t in zip(rows, texts_, strict=True):
        for k in range(5, len(t)) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 else ():
            for n in range(6):
                followers.setdefault(t[k - n : k], Counter())[t[k]] += 1

    def p(context, symbol, without=frozenset()):
        """Among the symbols not in ``without``, which the longer context has seen."""
        mine = {s: n for s, n in followers.get(context, {}).items() if s not in without}
        kinds, total = len(mine), sum(mine.values())
        if symbol in mine:
            return mine[symbol] / (total + kinds)
        shorter = p(context[1:], symbol, frozenset(followers.get(context, ())) or without) if context else 1 / (256 - len(followers[b""]))
        return shorter * (kinds / (total + kinds) if kinds else 1)

    cost = functools.cache(lambda context, symbol: math.log10(p(context, symbol)))
    return [(i, round(sum(cost(t[k - 5 : k], t[k]) for k in range(5, len(t))), 3)) for (i, _), t in zip(rows, texts_, strict=True)]


@pytest.mark.parametrize("kept", [(1, 1, 1), (9, 40, 12), ppm.KEPT])
def test_language_model_uses_all_contexts(spark, kept):
    rows = made_up(20, alphabet="abcd eé") + [(k, f"held {k} out ab cd") for k in range(100, 160)]
    out = ppm.score_documents(documents(spark, rows), kept=kept).collect()
    got, expected = (sorted(x, key=key) for x in ([(r.doc_id, r.score) for r in out], brute_scores(rows)))
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert np.allclose([x for _, x in got], [x for _, x in expected], rtol=1e-5, atol=0.01)


def test_language_model_takes_little_of_an_executor(spark, monkeypatch):
    """Blobs are read a few rows at a time, and no task takes a page for a join or its sorts."""
    seen, write, name = [], ppm.stored, "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    monkeypatch.setattr(ppm, "stored", lambda *a: seen.append(int(spark.conf.get(name))) or write(*a))
    out = ppm.score_documents(documents(spark, made_up(16)), kept=(50, 50, 50))
    assert seen and max(seen) <= 64 and spark.conf.get(name) == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_trie_is_a_distribution(spark):
    rng = random.Random(17)
    docs = documents(spark, [(k, "".join(rng.choice("abc ") for _ in range(40))) for k in range(30)])
    trie, total = ppm.train(docs, kept=(20, 20, 20))
    assert total > 0
    p = 10.0 ** trie.log.reshape(-1, trie.width).astype(float)
    unseen = 256 - (trie.width - 1)
    assert np.allclose(p[:, :-1].sum(1) + unseen * p[:, -1], 1, atol=1e-4)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(18)
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    rows = made_up(19) + [(k, "".join(rng.choice(points[: rng.choice((130, 600, 0x3000))]) for _ in range(30))) for k in range(200)] + [(1, "a<|endoftext|> b"), (2, "a" * 5000), (3, "!" * 5000), (4, "\U0001fac6 new")]
    out = token_count.count_tokens(documents(spark, rows), path).collect()
    expected = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected.append((i, len((t or "").encode()), n, n > 1024))
    same(out, expected)


def test_span_hashes_in_blocks(monkeypatch):
    raw = np.random.default_rng(3).integers(0, 255, 5000).astype(np.uint8)
    start = np.sort(np.random.default_rng(4).integers(0, 4900, 300))
    end = start + np.random.default_rng(5).integers(0, 100, 300)
    whole = common.span_hashes(raw, start, end)
    monkeypatch.setattr(common, "HASH_BYTES", 256)
    assert (common.span_hashes(raw, start, end) == whole).all()
    assert whole[0] == common.span_hashes(raw[start[0] : end[0]], np.array([0]), np.array([end[0] - start[0]]))[0]


def test_chunks_lose_no_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 500, "c"])], ["text"])
    assert [t for c in common.chunks([batch], limit=60) for t in c.column("text").to_pylist()] == ["a" * 50, None, "", "b" * 500, "c"]
