"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones of a batch are laid out as one ragged numpy array of symbol ids.  In each
round every sequence looks up the ranks of its neighbouring pairs, and every occurrence of its own lowest-ranked pair is
merged at once; sequences without a mergeable pair retire, and what survives is the count.  Counts of pre-tokens already met
are kept in a bounded cache per worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get a row; an empty table gives an empty
result; other columns of the input are ignored; texts are taken whole whatever their length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHES, chunks, lean, texts

#: The split pattern that the byte-level vocabulary is defined with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pre-tokens whose counts a task remembers, with what Python needs beside them; beyond that the cache is emptied.
CACHE_BYTES, ENTRY_BYTES = 30 << 20, 150
_NONE = np.int64(1) << 40


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class RankMerger:
    """Symbol counts of byte sequences under a ranked merge list, many sequences at a time."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letters = byte_alphabet()
        self.start = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.base = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        length = np.array([len(w) for w in words], np.int64)
        out = length.copy()
        symbols = self.start[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), length)
        rank = self._ranks(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(owner)])
            lowest = np.minimum.reduceat(rank, first)
            out[owner[first]] = size
            live = lowest < _NONE
            if not live.any():
                break
            if not live.all():
                keep = np.repeat(live, size)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                size, lowest = size[live], lowest[live]
            hit = rank == np.repeat(lowest, size)
            # a run of overlapping hits (one symbol repeated) merges at every other place, from its left end
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            at = np.flatnonzero(hit)
            at = at[(at - run[np.searchsorted(run, at, side="right") - 1]) % 2 == 0]
            symbols[at] = self.into[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            # only the pairs on either side of a merge change rank
            touched = np.zeros(len(symbols), bool)
            touched[at] = True
            symbols, owner, rank, touched = symbols[stay], owner[stay], rank[stay], touched[stay]
            t = np.flatnonzero(touched)
            t = np.unique(np.r_[t, t[t > 0] - 1])
            new = np.full(len(t), _NONE)
            inner = t + 1 < len(symbols)
            ti = t[inner]
            same = owner[ti] == owner[ti + 1]
            new[inner] = np.where(same, self.pair_ranks(symbols[ti], symbols[ti + 1]), _NONE)
            rank[t] = new
        return out

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.pair_ranks(symbols[:-1], symbols[1:]), _NONE)
        return rank


class TokenCounter:
    """Counts tokens of whole texts for a byte-level ``tokenizers`` file; strings of added tokens count as one token each."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(PATTERN)
        self.new = regex.compile(r"[^\x00-\u024f]")
        self.path = path
        self.library = None
        self.known: dict[str, int] = {}
        self.size = 0

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and how many added tokens it holds."""
        if self.special is None or "<" not in text:
            return self.split.findall(text), 0
        parts = self.special.split(text)
        out: list[str] = []
        for part in parts:
            out += self.split.findall(part)
        return out, len(parts) - 1

    def count(self, batch: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in batch]
        odd = [k for k, t in enumerate(batch) if not t.isascii() and any(unicodedata.category(c) == "Cn" for c in set(self.new.findall(t)))]
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        fresh = list(set().union(*(p for p, _ in cut)) - self.known.keys())
        if fresh:
            self.known.update(zip(fresh, self.merger.counts([w.encode() for w in fresh]).tolist(), strict=True))
            self.size += sum(map(len, fresh)) + ENTRY_BYTES * len(fresh)
        of = self.known.__getitem__
        out = [sum(map(of, p)) + extra for p, extra in cut]
        for k in odd:  # characters newer than one of the Unicode tables at hand: their class is the library's to say
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            out[k] = len(self.library.encode(batch[k], add_special_tokens=False).ids)
        return out


_COUNTERS: dict[str, TokenCounter] = {}
CACHES.append(_COUNTERS.clear)


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row; a scan without any shuffle.

    ``vocabulary`` is the path of a byte-level ``tokenizers`` JSON file, present on every executor.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in chunks(batches):
            n = np.array(count(texts(batch.column("text"))), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    out = src.mapInArrow(lean(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
