"""Sequence packing by minimum bin slack.

Each document becomes its token ids plus one end id.  A document longer than the capacity gives full sequences by itself; the
remainder, shorter than the capacity, joins a window of open remainders of its partition.  A sequence is filled from the
window's multiset of lengths: a bitset of reachable sums (one Python integer, a shift and an or per binary share of a length's
count) gives the sum nearest the capacity, and the stored bitsets give back how many pieces of each length make it.  What is
left when the partition ends is cut into sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: a partition packs its own rows, so a hot source or a group of copies is no concern, and the loss at a
partition's end is at most a dozen short sequences and no padding.  Sequence ids are the partition's number shifted left by 33
bits plus a running number, so they never meet.

Defined results: a null or empty text is the end id alone; repeated rows each get their pieces; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, chunks, lean, ragged, span_hashes, texts

#: Bytes of pre-tokens and their ids that a task remembers, with what Python needs beside them; beyond that the cache is emptied.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 150
#: Open remainders that a sequence is filled from.
WINDOW = 256


def _classes() -> np.ndarray:
    """Of each code point below U+0250: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = [(regex.compile(p), k) for p, k in ((r"\s", 0), (r"\p{L}", 1), (r"\p{N}", 2), (r"", 3))]
    return np.array([next(k for p, k in kinds if p.match(chr(c))) for c in range(0x250)], np.int8)


class WordEncoder:
    """Token ids of texts, by a ``tokenizers`` file of the word kind.

    Texts in Latin letters are cut into pre-tokens as byte arrays; the distinct ones that the bounded cache lacks go to the
    library together, and the ids of all texts are gathered from there.  Other texts, and those holding strings of special
    tokens, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.far = regex.compile("[^\x00-\u024f]")
        self.kinds = _classes()
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def split(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of lower-cased UTF-8 below U+0250; ``first``: where texts start."""
        n = len(raw)
        code = raw.astype(np.int16)
        lead = np.flatnonzero(raw >= 0xC0)
        code[lead] = (code[lead] & 31) << 6 | code[lead + 1] & 63
        code[lead + 1] = code[lead]
        kind = self.kinds[code]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == 2
        new[first[first < n]] = True
        new[lead + 1] = False
        # 's 't 'm 'd 're 've 'll, where the apostrophe opens a run and a letter follows in the same text
        at = np.flatnonzero((raw == 39) & new)
        at = at[at + 1 < n]
        at = at[(kind[at + 1] == 1) & ~np.isin(at + 1, first)]
        if len(at):
            one, two = raw[at + 1], raw[np.minimum(at + 2, n - 1)]
            inside = (at + 2 < n) & ~np.isin(at + 2, first)
            size = np.where(np.isin(one, list(b"stmd")), 1, np.where(inside & ((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)), 2, 0))
            at, size = at[size > 0], size[size > 0]
            new[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < n]
            new[rest] = True
        start = np.flatnonzero(new)
        end = np.r_[start[1:], n]
        word = kind[start] > 0
        return start[word], end[word]

    def learn(self, fresh: list[bytes]) -> None:
        for k in range(0, len(fresh), 2000):
            part = fresh[k : k + 2000]
            ids = np.array(self.library.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.closes[ids]) + 1
            if len(cut) == len(part):
                self.known.update(zip(part, (ids[a:b].tobytes() for a, b in zip([0, *cut.tolist()], cut.tolist(), strict=False)), strict=True))
            else:
                self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.library.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(batch)
        whole, plain, where = [], [], []
        for k, text in enumerate(batch):
            if not text.isascii() and self.far.search(text) or "<|" in text and any(s in text for s in self.special):
                whole.append(k)
            elif text:
                lower = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
                if lower.isascii() or not self.far.search(lower):
                    plain.append(lower.encode())
                    where.append(k)
                else:
                    whole.append(k)
        for k in whole:
            out[k] = np.array(self.library.encode(batch[k], add_special_tokens=False).ids, "<u4").tobytes()
        if not plain:
            return out
        data = b"".join(plain)
        raw = np.frombuffer(data, np.uint8)
        bounds = np.cumsum([0, *map(len, plain)])
        start, end = self.split(raw, bounds[:-1])
        if not len(start):
            return out
        _, at, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        if fresh := [w for w in words if w not in self.known]:
            self.learn(fresh)
            self.size += sum(len(w) + len(self.known[w]) + ENTRY_BYTES for w in fresh)
        ids = [self.known[w] for w in words]
        sizes = np.array([len(i) for i in ids], np.int64) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        size = sizes[which]
        stream = table[ragged((np.cumsum(sizes) - sizes)[which], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.searchsorted(start, bounds)] * 4
        for k, a, b in zip(where, ends.tolist(), ends[1:].tolist(), strict=False):
            out[k] = stream[a:b]
        return out


_ENCODERS: dict[str, WordEncoder] = {}
CACHES.append(_ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of a multiset of lengths (length: count), the part whose sum is nearest the capacity from below: length: pieces taken.

    Bit s of a bitset says that some part sums to s.  A length's count goes in as binary shares (1, 2, 4, ... and the rest), so
    that a length of any count costs a logarithm of it; walking the stored bitsets back tells which shares were used.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, share = counts[length], 1
        while left > 0:
            n = min(share, left)
            if n * length > capacity:
                break
            steps.append((reach, length, n))
            reach = (reach | reach << n * length) & mask
            left, share = left - n, share * 2
        if reach >> capacity:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for before, length, n in reversed(steps):
        if not before >> total & 1:
            total -= n * length
            taken[length] += n
    return dict(taken)


class Packer:
    """Packs the documents of a partition; rows are (document row, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, capacity: int, window: int, first_id: int) -> None:
        self.capacity, self.window, self.next = capacity, window, first_id
        self.open: dict[int, list] = defaultdict(list)
        self.n_open = 0
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, tokens in pieces:
            self.rows.append((key, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, key, ids: bytes) -> None:
        tokens, step = len(ids) // 4, 4 * self.capacity
        whole = tokens // self.capacity
        for k in range(whole):
            self.sequence([(key, k * self.capacity, ids[k * step : (k + 1) * step], tokens)])
        if rest := ids[whole * step :]:
            self.open[len(rest) // 4].append((key, whole * self.capacity, rest, tokens))
            self.n_open += 1
            while self.n_open > self.window:
                self.fill()

    def fill(self) -> None:
        taken = fullest({length: len(p) for length, p in self.open.items()}, self.capacity)
        pieces = []
        for length, n in sorted(taken.items(), reverse=True):
            bucket = self.open[length]
            pieces += bucket[len(bucket) - n :]
            del bucket[len(bucket) - n :]
            if not bucket:
                del self.open[length]
        self.n_open -= len(pieces)
        self.sequence(pieces)

    def close(self) -> None:
        """The rest: full sequences while they come out exact, then pieces cut so that each sequence's length is a power of two."""
        while sum(k * len(p) for k, p in self.open.items()) >= self.capacity:
            if sum(k * n for k, n in fullest({k: len(p) for k, p in self.open.items()}, self.capacity).items()) < self.capacity:
                break
            self.fill()
        left = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        self.open.clear()
        self.n_open = 0
        total = sum(len(p[2]) // 4 for p in left)
        while total:
            room = want = min(self.capacity, 1 << total.bit_length() - 1)
            pieces = []
            while room:
                key, start, ids, tokens = left.pop(0)
                if len(ids) // 4 > room:
                    left.insert(0, (key, start + room, ids[4 * room :], tokens))
                    ids = ids[: 4 * room]
                pieces.append((key, start, ids, tokens))
                room -= len(ids) // 4
            self.sequence(pieces)
            total -= want


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset; a scan without any shuffle.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file, present on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(capacity, window, (context.partitionId() if context else 0) << 33)
        ids_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in chunks(batches):
            ids_type = batch.schema.field("id").type
            for key, ids in zip(batch.column("id").to_pylist(), encoder(vocabulary).encode(texts(batch.column("text"))), strict=True):
                packer.add(key, ids + end)
            yield out()
        packer.close()
        if packer.rows:
            yield out()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(lean(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
