"""Benchmark decontamination with an FM-index per training shard.

A shard is the texts that a worker holds at once.  Its words become symbols of the benchmark's vocabulary; words outside it
end a run, and runs shorter than the shortest window hold no occurrence, so the index covers the other runs, each closed by its
own separator.  The Burrows-Wheeler transform of that sequence is kept as a wavelet matrix.  All windows are searched backwards
together, two ranks a step; rows that remain are located by walking to the nearest sampled suffix position, and the spans
of all occurrences are merged.

The benchmark is the query set: it is taken in blocks of bounded size, each broadcast, and a task reads them one after another
for some megabytes of documents; the blocks' spans are merged without any shuffle of documents.  Neither the driver nor a
task holds more than one block.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no window; items without an id
are left out, or with ``nameless`` searched like any other and only missing from ``item_ids``; repeated item ids count once; repeated documents each get a row; with an empty benchmark nothing is hit; other
columns of either input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, ragged, runs, span_hashes, utf8

#: Bytes of benchmark text searched for at once; what is broadcast is at most about 25 times that.
BLOCK_BYTES = 2 << 20
#: Bytes of documents that several blocks are searched for in together.
GATHERED_BYTES = 8 << 20
#: Every so many places of a run, the suffix's position is kept.
SAMPLE = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each word (digits, letters and all beyond ASCII), and the number of words before each text."""
    low = _LOWER[raw]
    is_word = _WORD[low]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return low, z, z, np.zeros(len(offsets), np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = is_word[edges]
    last[edges - 1] = is_word[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, start, end, np.searchsorted(start, offsets)


class Windows:
    """The distinct windows of a block of items over the block's own vocabulary."""

    def __init__(self, item_ids: list[str | None], item_texts: list[str], size: int) -> None:
        raw, offsets = utf8(pa.array(item_texts, pa.large_string()))
        low, start, end, bounds = words_of(raw, offsets)
        h = span_hashes(low, start, end)
        self.vocab, at, symbol = np.unique(h, return_index=True, return_inverse=True)
        self.length = (end - start)[at].astype(np.int64)
        self.size = size
        counts = np.diff(bounds)
        n_windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(len(counts)), n_windows)
        width = np.minimum(counts, size)[owner]
        begin = ragged(bounds[:-1], n_windows)
        rows = np.zeros((len(owner), size), np.int32)
        for k in range(size):
            inside = k < width
            rows[inside, size - 1 - k] = symbol[begin[inside] + width[inside] - 1 - k] + 1
        # right-aligned: column size - 1 holds a window's last word, and zeros stand before a short one
        self.rows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.width = (self.rows > 0).sum(1)
        self.shortest = int(self.width.min()) if len(self.width) else 0
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.of = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.names = item_ids
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.vocab >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The symbol of each word, from 1; 0 for words of no item."""
        out = np.zeros(len(h), np.int32)
        maybe = np.flatnonzero(self.quick[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), max(len(self.vocab) - 1, 0))
        good = (self.vocab[at] == h[maybe]) & (self.length[at] == length[maybe])
        out[maybe[good]] = at[good] + 1
        return out


class WaveletMatrix:
    """Rank and access over a sequence of symbols, one bit vector a level, for arrays of places at once."""

    def __init__(self, sequence: np.ndarray, n_symbols: int) -> None:
        self.n = len(sequence)
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            word = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(word)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(word), dtype=np.int64)[:-1]])
            self.zeros.append(self.n - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][at] + np.bitwise_count(self.words[level][at] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo = np.zeros_like(i)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones(k, lo), self.ones(k, i)
            lo = np.where(bit, self.zeros[k] + a, lo - a)
            i = np.where(bit, self.zeros[k] + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            at = i >> 6
            bit = (self.words[k][at] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            one = self.ones(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            out = out << 1 | bit
        return out


class FMIndex:
    """Full-text index of symbols from 1 with separators 0; separators differ from one another and sort by place."""

    def __init__(self, sequence: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        n = len(sequence)
        wall = sequence == 0
        n_walls = int(wall.sum())
        rank = sequence.astype(np.int64) + n_walls
        rank[wall] = np.arange(n_walls)
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * np.int64(n + n_walls + n_symbols + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.r_[False, np.diff(key[order]) != 0]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if new.sum() == n - 1:
                break
            step *= 2
        self.walls = n_walls
        self.bwt = WaveletMatrix(sequence[order - 1].astype(np.int64), n_symbols)
        self.first = np.searchsorted(np.sort(sequence), np.arange(n_symbols + 1))
        # kept positions: every so many places, and the start of each run, so that no walk crosses a separator
        kept = (order % sample == 0) | (sequence[order - 1] == 0)
        self.kept = np.full(n, -1, np.int64)
        self.kept[kept] = order[kept]

    def search(self, rows: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of right-aligned patterns: those that occur, with their ranges of rows."""
        last = rows.shape[1] - 1
        which = np.arange(len(rows))
        lo, hi = self.first[rows[:, last]], self.first[rows[:, last] + 1]
        for k in range(1, rows.shape[1]):
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            go = np.flatnonzero(width[which] > k)
            if not len(go):
                break
            symbol = rows[which[go], last - k].astype(np.int64)
            lo[go] = self.first[symbol] + self.bwt.rank(symbol, lo[go])
            hi[go] = self.first[symbol] + self.bwt.rank(symbol, hi[go])
        alive = lo < hi
        return which[alive], lo[alive], hi[alive]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows."""
        out, back = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        todo = np.arange(len(row))
        while len(todo):
            at = self.kept[row]
            done = at >= 0
            out[todo[done]] = at[done] + back[todo[done]]
            todo, row = todo[~done], row[~done]
            back[todo] += 1
            symbol = self.bwt.access(row)
            row = self.first[symbol] + self.bwt.rank(symbol, row)
        return out


def shard_hits(windows: Windows, symbol: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, word after) spans as a mask over the shard's words, and (text, item) pairs, for all occurrences of the windows."""
    n = len(symbol)
    mask, none = np.zeros(n, bool), np.zeros((0, 2), np.int64)
    if not n or not len(windows.rows):
        return mask, none
    known = symbol > 0
    begin, end = runs(known)
    # a text's end also ends a run
    edge = np.flatnonzero(np.diff(text_of)) + 1
    edge = edge[known[edge] & known[edge - 1]]
    begin, end = np.sort(np.r_[begin, edge]), np.sort(np.r_[end, edge])
    long = end - begin >= windows.shortest
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return mask, none
    place = ragged(begin, size + 1)
    sequence = symbol[np.minimum(place, n - 1)].astype(np.int64)
    sequence[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(sequence, len(windows.vocab) + 1)
    which, lo, hi = index.search(windows.rows, windows.width)
    if not len(which):
        return mask, none
    at = place[index.locate(ragged(lo, hi - lo))]
    window = np.repeat(which, hi - lo)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.width[window], -1)
    mask = np.cumsum(change[:-1]) > 0
    pairs = np.unique(np.stack([text_of[at], window], 1), axis=0)
    many = windows.of[pairs[:, 1] + 1] - windows.of[pairs[:, 1]]
    items = windows.items[ragged(windows.of[pairs[:, 1]], many)]
    return mask, np.unique(np.stack([np.repeat(pairs[:, 0], many), items], 1), axis=0)


def _union(a: list[int], b: list[int]) -> list[int]:
    """Two flat lists of spans (start, end, start, end, ...) as one, overlaps merged."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int, nameless: bool) -> Iterator[Windows]:
    items = benchmark.where((F.lit(nameless) | F.col(id_col).isNotNull()) & (F.octet_length(text_col) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = (items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).toArrow()
        yield Windows(part.column("id").to_pylist(), part.column("text").to_pylist(), size)


_SCHEMA = "id {kind}, text string, row {row}, n_words long, words array<long>, bytes array<long>, item_ids array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = (), nameless: bool = False) -> DataFrame:
    """One row for each document: ``id_col``, text, n_words, words and bytes (merged spans of hit words, flat: start, end, ...;
    in words and in UTF-8 bytes), item_ids (distinct, as strings) whose windows occur.

    ``keep`` names columns to carry along, as the fields of a struct ``row``.  ``nameless``: items without an id are searched too.  A window is ``window`` consecutive words of an item, or all words of a shorter one.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*keep).alias("row") if keep else F.lit(None).cast("int").alias("row"))
    kind, row = (out.schema[c].dataType.simpleString() for c in ("id", "row"))
    spark = docs.sparkSession
    # a block is let go of on the driver as soon as it is broadcast
    shared = [spark.sparkContext.broadcast(w) for w in _blocks(benchmark, item_col, item_text_col, window, block_bytes, nameless)]
    out = out.mapInArrow(lean(_search(shared)), _SCHEMA.format(kind=kind, row=row))
    return (out if keep else out.drop("row")).withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def _loaded(shared: list[Broadcast]) -> Iterator[Windows]:
    """The blocks one after another; of several, each is let go of before the next is read."""
    for block in shared:
        yield block.value
        if len(shared) > 1:
            block.__dict__.pop("_value", None)


def _gathered(batches: Iterator[pa.RecordBatch], n_blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Chunks to be searched together, so that several blocks are not read for every chunk."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chunks(batches):
        held.append(batch)
        size += batch.nbytes
        if n_blocks < 2 or size > GATHERED_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def chunk_hits(windows: Windows, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[int]], list[list[str]]]:
    """Of each text: how many words; merged spans of hit words, in words and in bytes; items whose windows occur."""
    raw, offsets = utf8(column)
    low, start, end, bounds = words_of(raw, offsets)
    text_of = np.repeat(np.arange(len(column)), np.diff(bounds))
    symbol = windows.symbols(span_hashes(low, start, end), end - start)
    mask, pairs = shard_hits(windows, symbol, text_of)
    words, cuts, items = ([[] for _ in range(len(column))] for _ in range(3))
    if mask.any():
        split = np.r_[True, np.diff(text_of) != 0]
        first = mask & (split | ~np.r_[False, mask[:-1]])
        last = mask & (np.r_[split[1:], True] | ~np.r_[mask[1:], False])
        for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True):
            k = int(text_of[a])
            words[k] += [a - int(bounds[k]), b + 1 - int(bounds[k])]
            cuts[k] += [int(start[a] - offsets[k]), int(end[b] - offsets[k])]
        for k, item in pairs.tolist():
            if windows.names[item] is not None:
                items[k].append(windows.names[item])
    return np.diff(bounds), words, cuts, items


def _search(shared: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, len(shared)):
            found: list[tuple | None] = [None] * len(held)
            for windows in _loaded(shared):
                for k, batch in enumerate(held):
                    n, words, cuts, items = chunk_hits(windows, batch.column("text"))
                    if found[k] is not None:
                        _, w, c, i = found[k]
                        words, cuts = ([_union(x, y) for x, y in zip(*z, strict=True)] for z in ((words, w), (cuts, c)))
                        items = [[*x, *y] for x, y in zip(items, i, strict=True)]
                    found[k] = n, words, cuts, items
            longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
            for batch, (n, words, cuts, items) in zip(held, found, strict=True):
                items = [sorted(set(x)) for x in items]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), batch.column("row"), pa.array(n), pa.array(words, longs), pa.array(cuts, longs), pa.array(items, strings)], ["id", "text", "row", "n_words", "words", "bytes", "item_ids"])

    return run


def hit_words():
    """Words inside merged spans, from the column ``words``."""
    return F.expr("aggregate(transform(words, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (n, x) -> n + x)")


def without_spans(text: str, flat: list[int]) -> str:
    """A text without the byte spans."""
    raw = text.encode()
    at, out = 0, []
    for s, e in zip(flat[::2], flat[1::2], strict=True):
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, most: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the benchmark: documents of whose words at least the share ``most`` is hit go, from others the merged spans are cut."""
    found = find_contamination(docs, benchmark, window, id_col, text_col, keep=tuple(docs.columns), nameless=True).withColumn("n_hit", hit_words())
    clean = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < most * F.col("n_words"))).select("row", F.col(text_col).alias("text"), "bytes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t if t is None or not flat else without_spans(t, flat) for t, flat in zip(batch.column("text").to_pylist(), batch.column("bytes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "text"])

    out = clean.mapInArrow(lean(cut), f"row {clean.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
