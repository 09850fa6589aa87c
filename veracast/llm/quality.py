"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers that describe a text's form (lengths, shares of kinds of characters, repetition of words and lines) are cut into
quantile bins.  Boosting goes round the features in turn; each step fits a shallow tree to one feature's gradient histogram and
adds its leaves to that feature's lookup table.  Pairs whose joint histograms explain most of what is left then get tables of
their own, boosted the same way with one cut on either feature.  A score is the sum of table entries through a logistic curve,
so scoring a batch is a bin search and an addition for each feature.

Labels come from rows whose id's CRC-32 leaves other remainders than the held-out one, at most about ``max_rows`` of them, chosen
by a hash of the id: a documented bound for fitting.  The score is computed from the text alone.

Defined results: a null or empty text is scored by its (zero) features; with no label, or one class alone, every score is the
share of label 1 (0.5 without labels); repeated rows each get a row; an empty table gives an empty result; other columns are
ignored; rows whose label or id is null teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, remainder_col, span_hashes, utf8

FEATURES = ("log_bytes", "word_length", "upper", "digit", "punctuation", "symbol", "exclamation", "bar", "full_stop", "newline", "space", "beyond_ascii", "distinct_words", "top_word", "word_repeats", "distinct_lines", "longest_word", "same_byte", "ends_in_symbol")
BINS, COARSE = 32, 8


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER, _DIGIT, _SPACE = _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b" \t\n\r\v\f")
_PUNCTUATION, _SYMBOL = _table(b".,;:!?'\"()-"), _table(b"#$%&*+/<=>@[\\]^_`{|}~")


def _spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs without gap bytes."""
    inside = ~gap
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def _repetition(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many different values it has and how often its commonest occurs."""
    key = h ^ (owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[first], count)
    return np.bincount(owner[first], minlength=n), top


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a chunk."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(FEATURES)), np.float64)
    out[:, 0] = np.log1p(size)
    if not len(raw):
        return out
    some = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mask, dtype=np.int32)][offsets]) / some

    space = _SPACE[raw]
    for k, mask in ((2, _UPPER[raw]), (3, _DIGIT[raw]), (4, _PUNCTUATION[raw]), (5, _SYMBOL[raw]), (6, raw == 33), (7, raw == 124), (8, raw == 46), (9, raw == 10), (10, space), (11, raw >= 128)):
        out[:, k] = share(mask)
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    same[offsets[offsets < len(raw)]] = False
    out[:, 17] = share(same)
    start, end, owner = _spans(raw, offsets, space)
    n_words = np.bincount(owner, minlength=n)
    words = np.maximum(n_words, 1)
    h = span_hashes(raw, start, end)
    distinct, top = _repetition(h, owner, n)
    out[:, 1] = np.bincount(owner, weights=end - start, minlength=n) / words
    out[:, 12], out[:, 13] = distinct / words, top / words
    again = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
    out[:, 14] = np.bincount(owner[again], minlength=n) / words
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, end - start)
    out[:, 16] = np.log1p(longest)
    tail = _SYMBOL[raw[end - 1]] | (raw[end - 1] == 33)
    out[:, 18] = np.bincount(owner[tail], minlength=n) / words
    start, end, owner = _spans(raw, offsets, raw == 10)
    lines = np.bincount(owner, minlength=n)
    out[:, 15] = _repetition(span_hashes(raw, start, end), owner, n)[0] / np.maximum(lines, 1)
    return out


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """The values of a shallow tree over ordered bins: each leaf's Newton step."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > least) & (hr > least), gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0), -1.0)
    cut = int(gain.argmax())
    if gain[cut] <= g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
        return value
    return np.r_[_leaves(g[: cut + 1], h[: cut + 1], depth - 1, least), _leaves(g[cut + 1 :], h[cut + 1 :], depth - 1, least)]


def _quarters(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts, one on either feature: the four leaves over the grid, and their gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a, top, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, left - a, all_ - top - left + a]

    gs, hs = parts(cg), parts(ch)
    gain = sum(x**2 / (y + 1.0) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for k, where in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        if hs[k][i, j] > least:
            out[where] = gs[k][i, j] / (hs[k][i, j] + 1.0)
    return out, float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0))


class AdditiveModel:
    """Lookup tables of single features and of pairs; ``score`` adds them up."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, n_pairs: int = 10, rate: float = 0.1) -> None:
        n, width = x.shape
        share = float(y.mean()) if n else 0.5
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
        self.coarse = [c[:: max(1, len(c) // COARSE)][:COARSE] if len(c) else c for c in self.cuts]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.flat = not 0 < share < 1
        self.base = share if self.flat else float(np.log(share / (1 - share)))
        if self.flat:
            return
        bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]
        total, least = np.full(n, self.base), max(1.0, n / 4000)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, np.maximum(p * (1 - p), 1e-4)

        for _ in range(rounds):
            for k, table in enumerate(self.tables):
                if len(table) < 2:
                    continue
                g, h = slope()
                step = rate * _leaves(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)), 2, least)
                table += step
                total += step[bins[k]]
        grid = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.coarse)]
        g, h = slope()
        shape = [len(c) + 1 for c in self.coarse]

        def fit(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
            at = grid[a] * shape[b] + grid[b]
            return _quarters(*(np.bincount(at, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (g, h)), least)

        usable = [k for k in range(width) if shape[k] > 1]
        best = sorted(combinations(usable, 2), key=lambda p: -fit(*p, g, h)[1])[:n_pairs]
        self.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for a, b in best]
        for _ in range(pair_rounds):
            for a, b, table in self.pairs:
                step = rate * fit(a, b, *slope())[0]
                table += step
                total += step[grid[a], grid[b]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.base)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fits on at most about ``max_rows`` labelled rows outside the held-out remainder."""
    known = labels.where((remainder_col(id_col, modulus) != held_out) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20))
    sample = known.where(draw < int((1 << 20) * min(1.0, max_rows / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = features(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["label", "x"])

    # the sample's size is bounded above, so its ids may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("label", "text").mapInArrow(lean(run), "label int, x array<double>").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    y = rows.column("label").to_numpy().astype(np.float64) if rows.num_rows else np.zeros(0)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive must not matter
    return AdditiveModel(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of each row; a scan without any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(features(*utf8(batch.column("text")))))], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
