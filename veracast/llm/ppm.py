"""Language-model scoring by prediction by partial matching over bytes.

Contexts of up to five bytes form a trie.  A symbol seen in a context costs its share of n + d (n occurrences, d different
symbols); otherwise the escape's share d is paid and the next shorter context decides among the symbols not excluded, those
that the longer one has seen.  What a context followed by an escape leaves to its suffix depends on the two alone, so
exclusion is worked out when the trie is built: each context kept has one row of complete log-probabilities, and a text is
scored by a table look-up for each byte of context beyond the second, for a batch of texts at once.  A text ends with an end symbol.

Counts of all six-byte strings of all training texts are gathered by an exchange, and all of them make the score.  The trie that
is broadcast has a size bound of its own, whatever the corpus: all contexts of up to two bytes and the ``kept`` commonest of each
greater length.  It settles the places whose longest context it is sure to hold.  The others go to buckets by their last three
bytes of context, where all longer contexts with those three meet: a bucket works out each distinct string from the counts
themselves and sends back sums per document.  So ``kept`` says how much is sent, and nothing about the score.

The base score is a unigram model over words.  Its counts cover the whole vocabulary, which grows with the corpus.  The
``hot`` commonest words' counts are broadcast (a fixed size): any other word is at most one in ``hot`` of all, so that no bucket
gets much for one word.  For the others each chunk of texts sends, to each bucket of word hashes, its distinct words and who holds
them how often, in numpy blobs; buckets add up the counts and send back sums per document.

Defined results: a null or empty text is the end symbol (and one end token); rows without an id are training rows; without any
training row counts are zero and the model is uniform; repeated rows each get a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_of_id, lean, shuffle_parts, span_hashes, stored, utf8

#: Stands before and after each text; the byte occurs in no UTF-8.
END = 0xFF
#: Bytes of the longest context; strings of one more byte are counted, which fit a 64-bit number up to seven.
ORDER = 5
#: Contexts of three, four, ... bytes that are broadcast; the others are scored in buckets.
KEPT = (24_576, 49_152, 49_152)
#: Groups of strings by their last three bytes of context; a bucket is one or more of them.
GROUPS = 1 << 12
#: Training bytes for each bucket of word hashes, and for each task that merges counts; counts that a task holds before it merges them.
BUCKET_BYTES, MERGE_BYTES, HELD = 24 << 20, 64 << 20, 1_500_000
#: Buckets of groups; what is asked of one is dealt out further once there are more buckets of words than that.
DEEP_BUCKETS = 1 << 10
#: Words whose counts are broadcast.
HOT_WORDS = 1 << 17
#: Rows that Spark reads at once, since blobs are long: its vectors are single arrays, for which an executor's heap grows.
READ_ROWS = 64
#: Tasks that add up the strings of three bytes.
PAIR_TASKS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, each after ``ORDER`` end symbols and before one; the places to predict; the first of them for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.full(len(raw) + n * (ORDER + 1), END, np.uint8)
    shift = np.repeat(np.arange(n), size) * (ORDER + 1) + ORDER
    out[np.arange(len(raw)) + shift] = _LOWER[raw]
    ask = np.ones(len(out), bool)
    begin = offsets[:-1] + np.arange(n) * (ORDER + 1)
    for k in range(ORDER):
        ask[begin + k] = False
    return out, np.flatnonzero(ask), offsets[:-1] + np.arange(n)


def strings(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The context and byte at each place, as one number."""
    key = np.zeros(len(at), np.uint64)
    for back in range(ORDER, -1, -1):
        key = key << np.uint64(8) | symbols[at - back]
    return key


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, their counts added."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _mask(n: int) -> np.uint64:
    """The last n bytes of a number."""
    return np.uint64((1 << 8 * n) - 1)


def _group(keys: np.ndarray) -> np.ndarray:
    """The group of each string, the same for all that share their last three bytes of context."""
    return ((keys >> np.uint64(8) & _mask(3)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GROUPS


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number asked for stands in a sorted array, not empty, and whether it does."""
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return place, known[place] == asked


def _is_training(ids: list, modulus: int, held_out: int) -> np.ndarray:
    return np.array([i is None or crc_of_id(i) % modulus != held_out for i in ids], bool)


class Counts:
    """Counts of numbers, merged now and then as they come."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD and len(self.held) > 1:
            self.held = [self.all()]
            self.size = len(self.held[0][0]) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return merged(*(np.concatenate(x) for x in zip(*self.held, strict=True)))


def string_counts(docs: DataFrame, modulus: int, held_out: int, hot: int = HOT_WORDS) -> DataFrame:
    """(part, keys, counts): each group's strings in the training texts, sorted, and how often they occur; with part -1 words by
    their hashes, the ``hot`` commonest among them; with part -2 each task's strings of three bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(GROUPS, max(shuffle_parts(docs.sparkSession), -(-total // MERGE_BYTES)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = Counts(), Counts()
        for batch in chunks(batches):
            batch = batch.filter(pa.array(_is_training(batch.column("id").to_pylist(), modulus, held_out)))
            if batch.num_rows:
                raw, offsets = utf8(batch.column("text"))
                symbols, ask, _ = stream(raw, offsets)
                by_kind[0].add(*np.unique(strings(symbols, ask), return_counts=True))
                if hot:
                    by_kind[1].add(*np.unique(np.r_[_words(raw, offsets)[0], np.repeat(_end_word(), batch.num_rows)], return_counts=True))
        for k, counts in enumerate(by_kind):
            keys, n = counts.all()
            # all strings that share their last context of three bytes meet in one bucket, so longer contexts do as well
            bucket = (_group(keys) if k == 0 else (keys % np.uint64(parts)).astype(np.int64)) % parts
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            rows = [(b + k * parts, keys[o].tobytes(), n[o].astype(np.int64).tobytes()) for b in range(parts) if len(o := order[edges[b] : edges[b + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = Counts(), Counts()
        for batch in batches:
            for b, k, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "counts")), strict=True):
                by_kind[b >= parts].add(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64))
        key, n = by_kind[0].all()
        if len(key):
            three, many = merged(key & _mask(3), n)
            yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([three.tobytes()], pa.binary()), pa.array([many.tobytes()], pa.binary())], ["part", "keys", "counts"])
        part = _group(key)
        order = np.argsort(part, kind="stable")
        key, n, part = key[order], n[order], part[order]
        edges = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)] if len(part) else []
        for a, b in zip(edges, edges[1:], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 1].astype(np.int32)), pa.array([key[a:b].tobytes()], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())], ["part", "keys", "counts"])
        key, n = by_kind[1].all()
        if len(key):
            top = np.lexsort((key, -n))[:hot]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([key[top].tobytes()], pa.binary()), pa.array([n[top].tobytes()], pa.binary())], ["part", "keys", "counts"])

    found = docs.mapInArrow(lean(count), "bucket int, keys binary, counts binary").repartition(parts, "bucket")
    return found.mapInArrow(lean(gather), "part int, keys binary, counts binary")


def hot_words(found: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the ``hot`` commonest words, sorted, and their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["word", "n"])

    top = found.where("part = -1").select("keys", "counts").mapInArrow(lean(rows), "word long, n long").orderBy(F.desc("n"), "word").limit(hot).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def pair_counts(found: DataFrame) -> pa.Table:
    """(context, total): all strings of three bytes.  They are few whatever the corpus, and added up without a hash table of Spark's,
    of which each task would take a page of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held.add(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64))
        key, n = held.all()
        yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["keys", "counts"])

    some, held = found.where("part = -2").select("keys", "counts").coalesce(PAIR_TASKS).mapInArrow(lean(run), "keys binary, counts binary").toArrow(), Counts()
    for k, c in zip(some.column("keys").to_pylist(), some.column("counts").to_pylist(), strict=True):
        held.add(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64))
    key, n = held.all()
    return pa.table({"context": key.astype(np.int64), "total": n})


def context_counts(found: DataFrame) -> DataFrame:
    """(width, context, total, symbols, counts): followers of each context of three to ``ORDER`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                key, n = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                for width in range(ORDER, 2, -1):
                    key, n = merged(key & _mask(width + 1), n)
                    context, symbol = key >> np.uint64(8), (key & np.uint64(255)).astype(np.uint8)
                    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                    last = np.r_[first[1:], len(key)].tolist()
                    rows = [(symbol[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(first.tolist(), last, strict=True)]
                    total = np.add.reduceat(n, first)
                    for at in range(0, len(first), 10_000):
                        part, f = rows[at : at + 10_000], first[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), width, np.int32)), pa.array(context[f].astype(np.int64)), pa.array(total[at : at + 10_000]), pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.binary())], names)

    names = ["width", "context", "total", "symbols", "counts"]
    return found.where("part >= 0").select("keys", "counts").mapInArrow(lean(run), "width int, context long, total long, symbols binary, counts binary")


class Floor:
    """What contexts of up to two bytes say, which all buckets need, and the exact score of strings beyond the trie."""

    def __init__(self, trie: Trie, counts: np.ndarray, below: np.ndarray) -> None:
        self.index, self.width, self.two, self.base = trie.index, trie.width, trie.two, trie.base[2]
        self.log = trie.log[: trie.base[3] * trie.width]
        self.counts, self.below = counts, below
        self.total, self.kinds = counts.sum(1, dtype=np.float64), (counts > 0).sum(1)

    def _rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of the longest context of up to two bytes, and the symbol's column, of each string."""
        symbol, near, far = (self.index[(keys >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)].astype(np.int64) for k in range(3))
        return self.two[far * self.width + near].astype(np.int64), symbol

    def score(self, keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Log10 probability of each string asked for, where ``keys`` has all strings counted in their groups."""
        row, symbol = self._rows(asked)
        out = self.log[row * self.width + symbol].astype(np.float64)
        if not len(keys):
            return out
        at = np.maximum(row - self.base, 0)
        shorter, left = self.counts[at, symbol].astype(np.float64), self.below[at, symbol].astype(np.float64)
        levels, of = {}, {}
        for width in range(ORDER, 2, -1):
            levels[width] = keys, n = merged(keys & _mask(width + 1), n)
        for width in range(3, ORDER + 1):
            key, n = levels[width]
            context = key >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            context, total, kinds = context[first], np.add.reduceat(n, first), np.diff(np.r_[first, len(key)])
            if width == 3:
                row, symbol = self._rows(key)
                seen, suffix = self.counts[row - self.base, symbol].astype(np.float64), row[first] - self.base
                last_total, last_kinds = self.total, self.kinds
            else:
                seen = levels[width - 1][1][_find(levels[width - 1][0], key & _mask(width))[0]]
                known, last_total, last_kinds = of[width - 1]
                suffix = _find(known, context & _mask(width - 1))[0]
            of[width] = context, total, kinds
            d = last_kinds[suffix] - kinds
            room = np.maximum(last_total[suffix] - np.add.reduceat(seen, first) + d, 1)
            beyond = np.where(d > 0, d / room, 1.0)
            q = asked & _mask(width + 1)
            c, ok = _find(context, q >> np.uint64(8))
            place, has = _find(key, q)
            mine = np.where(has, n[place], 0)
            left = np.where(shorter > 0, shorter / room[c], beyond[c] * left)
            p = np.where(has, mine, kinds[c] * left) / (total[c] + kinds[c])
            out[ok] = np.log10(np.maximum(p[ok], 1e-30))
            shorter = mine.astype(np.float64)
        return out


class Trie:
    """Rows of complete log-probabilities for each kept context, and the tables that find a place's row."""

    def __init__(self, rows: dict[int, pa.Table], sizes: dict[int, int]) -> None:
        """``rows``: of width 2 all strings of three bytes; of others the contexts kept, of ``sizes`` that there are."""
        dense = {w: self._dense(rows[w]) if w > 2 else self._pairs(rows[w]) for w in range(2, ORDER + 1)}
        # contexts of one and no byte follow from those of two, all of which are here
        two = dense[2]
        ones = np.unique(two[0] & 255)
        one = np.zeros((len(ones), 256))
        np.add.at(one, np.searchsorted(ones, two[0] & 255), two[1])
        seen = one.sum(0) > 0
        seen[[END]] = True
        self.letters = np.flatnonzero(seen)
        self.width = w = len(self.letters) + 1
        self.index = np.full(256, w - 1, np.int32)
        self.index[self.letters] = np.arange(w - 1)
        levels = [(np.zeros(1, np.int64), one.sum(0, keepdims=True)), (ones, one), *dense.values()]
        self.base, tables, low, at = [], [], None, 0
        states: list[dict | np.ndarray] = []
        for order, (contexts, counts) in enumerate(levels):
            counts = np.concatenate([counts[:, self.letters], np.zeros((len(counts), 1), counts.dtype)], 1)
            if order:
                known = levels[order - 1][0]
                suffix = contexts & ((1 << 8 * (order - 1)) - 1)
                place = np.minimum(np.searchsorted(known, suffix), max(len(known) - 1, 0))
                ok = known[place] == suffix if len(known) else np.zeros(len(suffix), bool)
                contexts, counts, place = contexts[ok], counts[ok], place[ok]
                levels[order] = (contexts, counts)
            log = np.empty((len(contexts), w), np.float32)
            below = np.empty((len(contexts), w), np.float32) if order < ORDER else None
            for k in range(0, len(contexts), 4096):
                s = slice(k, k + 4096)
                n = counts[s].astype(np.float64)
                has = n > 0
                total, kinds = n.sum(1, keepdims=True), has.sum(1, keepdims=True)
                if order:
                    shorter = last_counts[place[s]].astype(np.float64)
                    rest = np.where(has, 0.0, shorter)
                    d = (shorter > 0).sum(1, keepdims=True) - kinds
                    room = np.maximum(rest.sum(1, keepdims=True) + d, 1)
                    beyond = np.where(d > 0, d / room, 1.0) * low[place[s]]
                    left = np.where(shorter > 0, rest / room, beyond)
                else:
                    left = np.full((len(n), w), 1.0 / max(1, 256 - int(kinds[0, 0])))
                p = np.where(has, n, kinds * left) / np.maximum(total + kinds, 1) if total.all() else left
                log[s] = np.log10(np.maximum(p, 1e-30))
                if below is not None:
                    below[s] = left
            self.base.append(at)
            at += len(contexts)
            if order == 2:
                two_counts, two_below = counts, below
            tables.append(log)
            states.append(contexts)
            low, last_counts = below, counts
        self.log = np.concatenate(tables).ravel()
        self._link(states)
        # where all contexts one byte longer are here, a place without one has none, nor any longer still
        whole = [order == ORDER or order < 2 or len(states[order + 1]) == sizes.get(order + 1, 0) for order in range(ORDER + 1)]
        self.sure = np.repeat(whole, [len(x) for x in states])
        self.floor: Floor | None = Floor(self, two_counts, two_below)

    @staticmethod
    def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, n = table.column("context").to_numpy(), table.column("total").to_numpy()
        contexts, row = np.unique(key >> 8, return_inverse=True)
        out = np.zeros((len(contexts), 256), np.float32)
        out[row, key & 255] = n
        return contexts, out

    @staticmethod
    def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        contexts = np.array(table.column("context").to_pylist(), np.int64)
        order = np.argsort(contexts)
        out = np.zeros((len(contexts), 256), np.float32)
        symbols, counts = table.column("symbols").to_pylist(), table.column("counts").to_pylist()
        for row, k in enumerate(order.tolist()):
            out[row, np.frombuffer(symbols[k], np.uint8)] = np.frombuffer(counts[k], np.int64)
        return contexts[order], out

    def _link(self, states: list[np.ndarray]) -> None:
        """``three``: of each three bytes the row of the longest kept context; ``deeper``: for each greater length, of the rows
        one shorter and one byte more the longer row."""
        w, ix = self.width, self.index.astype(np.int64)

        def split(contexts: np.ndarray, n: int) -> list[np.ndarray]:
            return [ix[contexts >> 8 * k & 255] for k in range(n)]  # nearest byte first

        one = np.zeros(w, np.int32)
        one[split(states[1], 1)[0]] = self.base[1] + np.arange(len(states[1]))
        two = np.tile(one, (w, 1))
        a, b = split(states[2], 2)
        two[b, a] = self.base[2] + np.arange(len(states[2]))
        self.two = two.ravel()
        three = np.tile(two, (w, 1, 1))
        a, b, c = split(states[3], 3)
        three[c, b, a] = self.base[3] + np.arange(len(states[3]))
        self.three, self.deeper = three.ravel(), []
        for order in range(4, ORDER + 1):
            shorter, longer = states[order - 1], states[order]
            table = np.repeat((self.base[order - 1] + np.arange(len(shorter), dtype=np.int32))[:, None], w, 1)
            if len(longer):
                place = np.searchsorted(shorter, longer & ((1 << 8 * (order - 1)) - 1))
                table[place, ix[longer >> 8 * (order - 1) & 255]] = self.base[order] + np.arange(len(longer))
            self.deeper.append(table.ravel())

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each text, its end included, over the places that the trie settles; the strings at the others, and
        the text of each."""
        n = len(offsets) - 1
        if not n:
            return np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        symbols, ask, first = stream(raw, offsets)
        s, w = self.index[symbols], np.int32(self.width)
        row = self.three[(s[ask - 3] * w + s[ask - 2]) * w + s[ask - 1]]
        deep = np.flatnonzero(row >= self.base[3])
        for order, table in enumerate(self.deeper, 4):
            if len(deep) and len(table):
                found = table[(row[deep] - np.int32(self.base[order - 1])) * w + s[ask[deep] - order]]
                row[deep] = found
                deep = deep[found >= self.base[order]]
        log = self.log[row.astype(np.int64) * w + s[ask]].astype(np.float64)
        open_ = np.flatnonzero(~self.sure[row])
        log[open_] = 0.0
        return np.add.reduceat(log, first), strings(symbols, ask[open_]), np.searchsorted(first, open_, side="right") - 1


def train(docs: DataFrame, modulus: int = 7, held_out: int = 2, kept: tuple[int, ...] = KEPT, id_col: str = "doc_id", text_col: str = "text") -> tuple[Trie, int]:
    """The trie and the number of symbols that it was counted on."""
    return _train(docs, modulus, held_out, kept, 0, id_col, text_col)[:2]


def _train(docs: DataFrame, modulus: int, held_out: int, kept: tuple[int, ...], hot: int, id_col: str, text_col: str) -> tuple[Trie, int, DataFrame]:
    """The trie, the number of symbols, and all strings and the commonest words counted."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = stored(string_counts(src, modulus, held_out, hot), "strings")
    counts = stored(context_counts(found), "contexts")

    def top(width: int, n: int) -> pa.Table:
        return counts.where(F.col("width") == width).orderBy(F.desc("total"), "context").limit(n).select("context", "symbols", "counts").toArrow()

    pairs = pair_counts(found)
    widths = range(3, ORDER + 1)
    sizes = dict(zip(widths, counts.agg(*(F.count_if(F.col("width") == w) for w in widths)).first(), strict=True))
    total = sum(pairs.column("total").to_pylist())
    return Trie({2: pairs} | {w: top(w, kept[w - 3]) for w in widths}, sizes), total, found


_OUT = "first_key long, row_key long, id {kind}, held_out boolean, n_tokens long, score double, hot_s double, hot_known long, bucket int, blob binary"


def _word_blobs(hashes: np.ndarray, owner: np.ndarray, n_docs: int, n_train: int, first_key: int, n_buckets: int, bucket_of: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> list[tuple[int, bytes]]:
    """For each bucket of word hashes, the chunk's words there, and for each the documents that hold it and how often."""
    words, which = np.unique(hashes, return_inverse=True)
    pair, times = np.unique(which.astype(np.int64) * n_docs + owner, return_counts=True)
    # a count above 255 goes as several
    extra = (times - 1) // 255
    pair = np.repeat(pair, extra + 1)
    size = np.full(len(pair), 255, np.uint8)
    size[np.cumsum(extra + 1) - 1] = times - 255 * extra
    word, doc = pair // n_docs, (pair % n_docs).astype(np.uint16)
    holders = np.bincount(word, minlength=len(words))
    at = bucket_of(words)
    bucket = (at % at.dtype.type(n_buckets)).astype(np.int64)
    order = np.argsort(bucket[word], kind="stable")
    word_order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[word][order], np.arange(n_buckets + 1))
    word_edges = np.searchsorted(bucket[word_order], np.arange(n_buckets + 1))
    out = []
    for b in range(n_buckets):
        o, v = order[edges[b] : edges[b + 1]], word_order[word_edges[b] : word_edges[b + 1]]
        if len(v):
            head = np.array([first_key, n_train, len(v), len(o)], np.int64)
            out.append((b, b"".join((head.tobytes(), words[v].view(np.uint8).reshape(-1, 8).T.tobytes(), holders[v].astype(np.uint32).tobytes(), doc[o].tobytes(), size[o].tobytes()))))
    return out


def _read_blob(blob: bytes) -> tuple:
    first_key, n_train, n_words, n_pairs = np.frombuffer(blob, np.int64, 4).tolist()
    at = 32
    # first bytes of all words, second bytes, ...: sorted strings compress far better so
    words = np.frombuffer(blob, np.uint8, 8 * n_words, at).reshape(8, n_words).T.copy().view(np.uint64).ravel()
    at += 8 * n_words
    holders = np.frombuffer(blob, np.uint32, n_words, at)
    at += 4 * n_words
    doc = np.frombuffer(blob, np.uint16, n_pairs, at)
    return first_key, n_train, words, holders, doc, np.frombuffer(blob, np.uint8, n_pairs, at + 2 * n_pairs)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, its documents' sums of log10(c + 1) and of known words; under key -1 the distinct and all training words."""
    blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
    if not blobs:
        return
    words, counts = [], []
    for blob in blobs:
        _, n_train, w, holders, doc, size = _read_blob(blob)
        held = np.r_[0, np.cumsum(np.where(doc < n_train, size, 0), dtype=np.int64)]
        ends = np.cumsum(holders, dtype=np.int64)
        words.append(w)
        counts.append(held[ends] - held[ends - holders])
    sizes = [len(w) for w in words]
    distinct, which = np.unique(np.concatenate(words), return_inverse=True)
    c = np.bincount(which, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    words.clear()
    counts.clear()
    worth = np.log10(c + 1.0)

    rows, at = [], 0
    for blob, n in zip(blobs, sizes, strict=True):
        first_key, _, _, holders, doc, size = _read_blob(blob)
        mine = np.repeat(which[at : at + n], holders)
        at += n
        s = np.bincount(doc, worth[mine] * size)
        known = np.bincount(doc, np.where(c[mine] > 0, size, 0))
        rows.append((first_key, s.tobytes(), known.astype(np.int64).tobytes()))
    rows.append((-1, np.array([(c > 0).sum()], np.float64).tobytes(), np.array([c.sum()], np.int64).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)), pa.nulls(len(rows), pa.binary())], ["first_key", "s", "known", "deep"])


def _deep_sums(floor: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each chunk, its documents' sums of log10 probabilities over the strings sent; rows with ``counts`` are a group's own strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, blobs = [], [], []
        for batch in batches:
            for blob, c in zip(batch.column("blob").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if c is None:
                    blobs.append(blob)
                else:
                    keys.append(np.frombuffer(blob, np.uint64))
                    counts.append(np.frombuffer(c, np.int64))
        if not blobs:
            return
        asked = [_read_blob(blob)[2] for blob in blobs]
        sizes = [len(x) for x in asked]
        asked, which = np.unique(np.concatenate(asked), return_inverse=True)
        worth = floor.value.score(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts]), asked)
        rows, at = [], 0
        for blob, n in zip(blobs, sizes, strict=True):
            first_key, _, _, holders, doc, size = _read_blob(blob)
            rows.append((first_key, np.bincount(doc, np.repeat(worth[which[at : at + n]], holders) * size).tobytes()))
            at += n
        none = pa.nulls(len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), none, none, pa.array([r[1] for r in rows], pa.binary())], ["first_key", "s", "known", "deep"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each chunk with its buckets' sums added; under key -1 the distinct and all training words."""
    found: dict[int, list[np.ndarray]] = {}
    rows = []
    for batch in batches:
        is_row = pc.is_valid(batch.column("row_key"))
        rows.append(batch.filter(is_row).select(["first_key", "row_key", "id", "held_out", "n_tokens", "score", "hot_s", "hot_known"]))
        batch = batch.filter(pc.invert(is_row))
        for key, *blobs in zip(*(batch.column(c).to_pylist() for c in ("first_key", "s", "known", "deep")), strict=True):
            for k, (blob, kind) in enumerate(zip(blobs, (np.float64, np.int64, np.float64), strict=True)):
                part, have = np.frombuffer(blob or b"", kind), found.setdefault(key, [np.zeros(0), np.zeros(0, np.int64), np.zeros(0)])
                if len(part) > len(have[k]):
                    have[k] = np.r_[have[k], np.zeros(len(part) - len(have[k]), kind)]
                have[k][: len(part)] += part
    names = ["row_key", "id", "held_out", "n_tokens", "score", "s", "known"]
    for some in rows:
        if some.num_rows:
            of, place = some.column("first_key").to_numpy(), some.column("row_key").to_numpy()
            sums = some.column("hot_s").to_numpy().copy(), some.column("hot_known").to_numpy().copy(), some.column("score").to_numpy().copy()
            for key in np.unique(of).tolist():
                mine = np.flatnonzero(of == key)
                for total, have in zip(sums, found.get(key, []), strict=False):
                    at = mine[place[mine] - key < len(have)]
                    total[at] += have[place[at] - key]
            yield pa.RecordBatch.from_arrays([some.column("row_key"), some.column("id"), some.column("held_out"), some.column("n_tokens"), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], names)
    if -1 in found:
        s, known, _ = found[-1]
        kind = rows[0].schema.field("id").type
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array(s), pa.array(known)], names)


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2, kept: tuple[int, ...] = KEPT, hot: int = HOT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row."""
    conf, name = docs.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    before = conf.get(name)
    conf.set(name, str(READ_ROWS))
    try:
        return _score(docs, modulus, held_out, kept, hot, id_col, text_col)
    finally:
        conf.set(name, before)


def _score(docs: DataFrame, modulus: int, held_out: int, kept: tuple[int, ...], hot: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    trie, total, found = _train(docs, modulus, held_out, kept, hot, id_col, text_col)
    common_words = hot_words(found, hot)
    floor, trie.floor = spark.sparkContext.broadcast(trie.floor), None
    shared, words = spark.sparkContext.broadcast(trie), spark.sparkContext.broadcast(common_words)
    n_buckets = max(8, -(-total // BUCKET_BYTES))
    n_deep = min(n_buckets, DEEP_BUCKETS)
    n_shares = -(-n_buckets // n_deep)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        partition, n_chunks = context.partitionId() if context else 0, 0
        key = partition << 40
        hot_hash, hot_n = words.value
        worth = np.log10(hot_n + 1.0)
        for big in chunks(batches, limit=2 << 20):
            for cut in range(0, big.num_rows, 1 << 15):
                batch = big.slice(cut, 1 << 15)
                train_row = _is_training(batch.column("id").to_pylist(), modulus, held_out)
                batch = batch.take(pa.array(np.argsort(~train_row, kind="stable")))  # training rows first
                n, n_train = batch.num_rows, int(train_row.sum())
                score, asked, asker, done = [], [], [], 0
                for part in chunks([batch]):
                    for into, x in zip((score, asked, asker), shared.value.score(*utf8(part.column("text"))), strict=True):
                        into.append(x)
                    asker[-1] += done
                    done += part.num_rows
                score, asked, asker = (np.concatenate(x) for x in (score, asked, asker))
                raw, offsets = utf8(batch.column("text"))
                hashes, owner = _words(raw, offsets)
                tokens = np.bincount(owner, minlength=n) + 1
                hashes, owner = np.r_[hashes, np.repeat(_end_word(), n)], np.r_[owner, np.arange(n)]
                hot_s, hot_known = np.zeros(n), np.zeros(n, np.int64)
                if len(hot_hash):
                    place, ok = _find(hot_hash, hashes)
                    hot_s, hot_known = np.bincount(owner[ok], worth[place[ok]], n), np.bincount(owner[ok], minlength=n)
                    hashes, owner = hashes[~ok], owner[~ok]
                none = pa.nulls(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(key + np.arange(n)), batch.column("id"), pa.array(np.arange(n) >= n_train), pa.array(tokens), pa.array(score), pa.array(hot_s), pa.array(hot_known), none.cast(pa.int32()), none.cast(pa.binary())], names)
                blobs = _word_blobs(hashes, owner, n, n_train, key, n_buckets)
                share = n_buckets + n_deep * ((partition + n_chunks) % n_shares)
                blobs += [(share + b, blob) for b, blob in _word_blobs(asked, asker, n, n_train, key, n_deep, _group)]
                none, m = pa.nulls(len(blobs)), len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, key)), none.cast(pa.int64()), none.cast(batch.schema.field("id").type), none.cast(pa.bool_()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64()), none.cast(pa.int64()), pa.array([b for b, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names)
                key += n
                n_chunks += 1

    names = ["first_key", "row_key", "id", "held_out", "n_tokens", "score", "hot_s", "hot_known", "bucket", "blob"]
    both = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), _OUT.format(kind=kind)), "word-blobs")
    sent = both.where("bucket is not null").select("bucket", "blob")
    sums_kind = "first_key long, s binary, known binary, deep binary"
    at_once = 4 * spark.sparkContext.defaultParallelism  # small buckets follow one another in a task, which takes a page for what it sends on
    cold = sent.where(F.col("bucket") < n_buckets).repartition(n_buckets, "bucket").mapInArrow(lean(_sums), sums_kind).coalesce(max(at_once, n_buckets // 8))
    asked = sent.where(F.col("bucket") >= n_buckets).select((F.col("bucket") - n_buckets).alias("bucket"), "blob", F.lit(None).cast("binary").alias("counts"))
    # every share of what is asked meets a copy of its group's strings
    share = F.explode(F.sequence(F.lit(0), F.lit(n_shares - 1)))
    known = found.where("part >= 0").select((F.col("part") % n_deep).alias("at"), share.alias("share"), F.col("keys").alias("blob"), "counts").select((F.col("at") + n_deep * F.col("share")).cast("int").alias("bucket"), "blob", "counts")
    deep = asked.unionAll(known).repartition(n_deep * n_shares, "bucket").mapInArrow(lean(_deep_sums(floor)), sums_kind).coalesce(max(at_once, n_deep * n_shares // 8))
    shared.unpersist()
    # rows go to where their chunk's sums meet, which needs neither a join nor the pages of its sorts
    sums = cold.unionAll(deep).withColumn("row_key", F.lit(None).cast("long"))
    sums = both.where("bucket is null").drop("bucket", "blob").unionByName(sums, allowMissingColumns=True).repartition(max(shuffle_parts(spark), n_buckets), "first_key")
    sums = stored(sums.mapInArrow(lean(_add_up), f"row_key long, id {kind}, held_out boolean, n_tokens long, score double, s double, known long"), "word-sums")
    floor.unpersist()
    n_types, n_words = sums.where("row_key = -1").agg(F.sum("s"), F.sum("known")).first()
    n_types, n_words = (n_types or 0.0) + len(common_words[0]), (n_words or 0) + int(common_words[1].sum())
    base = F.col("s") - F.col("n_tokens") * float(np.log10(n_words + n_types + 1.0))
    return sums.where("row_key >= 0").select(F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(n_words).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _end_word() -> np.ndarray:
    """The hash that stands for the end of a text among its words."""
    return span_hashes(np.frombuffer(b" ", np.uint8), np.array([0]), np.array([1]))


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, lower-cased, and the text of each."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _LOWER[raw]
    inside = ~_GAP[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(first)
    return span_hashes(low, start, np.flatnonzero(last) + 1), np.searchsorted(offsets, start, side="right") - 1
