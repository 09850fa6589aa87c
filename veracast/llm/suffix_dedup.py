"""Repeated-substring removal with suffix arrays built by two-stage sorting.

A byte goes if some string of ``length`` bytes over it also starts in a document with a smaller id.  Two places that share such
a string share the string's anchor, the 25 bytes in it that hash lowest, so the corpus is split by anchors:

0. Of equal texts the one with the smallest id stands for all: the others lose every byte, as each window of theirs is in it.
1. Each chunk of the other texts sends its anchors' hashes to their buckets, each with a byte that tells of the 13 bytes on its left and
   one of those on its right: a shared string reaches at least that far on one side.  Buckets send back to each document the
   anchors that another document has with the same byte on the same side.
2. Documents send the surroundings of these anchors, the windows that have them as their anchor, to the same buckets.
3. A bucket collapses equal surroundings and sorts the suffixes of the different ones.  Suffixes smaller than their successors
   are sorted directly by their first 56 bytes; the others are induced from them, first byte by first byte, each from the suffix
   one place on.  Neighbours in this order with ``length`` bytes in common form groups; a window of a document goes if its group
   holds a smaller id.
4. Spans come back to their documents and are merged.

Texts are compressed before they are dealt out, once for both joins.  Spans go by id and a hash of the text: rows that repeat
both have the same result.  A hot passage is one surrounding per bucket with a list of its places.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose nothing; a row without an id neither loses
bytes nor makes others lose any; rows sharing an id do not count against each other; an empty table gives an empty result; other
columns are ignored.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_part, chunks, from_parts, lean, ragged, shuffle_parts, span_hashes, stored, texts

LENGTH, ANCHOR, SIDE = 50, 25, 13
#: Of a repeated string, the most bytes that the order of suffixes and one-byte sizes of surroundings can settle.
LONGEST = 56
#: Text bytes for each bucket of anchors, and of surroundings; bytes of a text handled at once; bytes of surroundings sorted together.
BUCKET_BYTES, PLACE_BYTES, PIECE, SORT_BYTES = 64 << 20, 24 << 20, 1 << 20, 2 << 20
_HASH_BITS = 40


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _tags(h: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for the bytes left of each anchor and one for those right of it; 0 where no window reaches ``SIDE`` bytes that way.

    ``h`` has the hashes at all places: those ``SIDE`` places off cover the anchor's own bytes and the ones beside it.
    """
    left, right = place - lo >= SIDE, hi >= place - SIDE + 1
    tag = lambda at, ok: np.where(ok, (h[np.clip(at, 0, len(h) - 1)] >> np.uint64(56)).astype(np.int64) % 255 + 1, 0).astype(np.uint8)
    return tag(place - SIDE, left), tag(place + SIDE, right)


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor of some texts laid end to end: hash, left and right byte, text, and the first and last window (places
    within the text) whose anchor it is."""
    windows = np.maximum(np.diff(bounds) - length + 1, 0)
    if not windows.any():
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint8), z.astype(np.uint8), z, z, z
    at = np.arange(len(raw) - ANCHOR + 1)
    h = span_hashes(raw, at, at + ANCHOR)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    place = (sliding_least(key, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = ragged(bounds[:-1], windows)
    text = np.repeat(np.arange(len(windows)), windows)
    place = place[begin]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(place)] - 1
    text, place, lo, hi = text[first], place[first], begin[first], begin[last]
    left, right = _tags(h, place, lo, hi)
    return h[place], left, right, text, lo - bounds[text], hi - bounds[text]


def chunk_anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``anchors`` of all texts of a chunk, a bounded number of bytes at once: short texts together, long ones in pieces."""
    out = []
    n, k = len(offsets) - 1, 0
    while k < n:
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, side="right")) - 1)
        for a in range(int(offsets[k]), max(int(offsets[j]) - length + 1, int(offsets[k]) + 1), PIECE):
            piece = raw[a : min(a + PIECE + length - 1, int(offsets[j]))]
            bounds = offsets[k : j + 1] - offsets[k] if j > k + 1 else np.array([0, len(piece)])
            h, left, right, text, lo, hi = anchors(piece, bounds, length)
            shift = a - int(offsets[k])
            out.append((h, left, right, text + k, lo + shift, hi + shift))
            if j > k + 1:
                break
        k = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else anchors(raw[:0], np.zeros(1, np.int64), length)


def two_stage_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of a byte string in the order of the suffixes' first ``depth`` bytes at least.  ``symbols`` ends in 64 zeros, which are not sorted."""
    n = len(symbols) - 64
    if not n:
        return np.zeros(0, np.int64)
    t = symbols[: n + 1].astype(np.int16)
    t[n] = -1
    # smaller than the successor: by the next place where the symbols differ
    differs = np.flatnonzero(t[1:] != t[:-1])
    next_change = differs[np.searchsorted(differs, np.arange(n))]
    small = t[next_change] < t[next_change + 1]
    # directly: the smaller ones, eight bytes at a time, going on only among those still equal
    words = np.ndarray((n + 57,), ">u8", symbols.tobytes(), strides=(1,))
    s = np.flatnonzero(small)
    s = s[np.argsort(words[s].astype(np.uint64), kind="stable")]
    word = words[s].astype(np.uint64)
    new = np.r_[True, word[1:] != word[:-1]] if len(s) else np.zeros(0, bool)
    for skip in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        word = words[np.minimum(s[at] + skip, n + 56)].astype(np.uint64)
        order = np.lexsort((word, group))
        s[at] = s[at][order]
        word, group = word[order], group[order]
        new[at] = np.r_[True, (word[1:] != word[:-1]) | (group[1:] != group[:-1])]
    # induced: the larger ones, in one sweep over first bytes; within a byte, runs of it in waves
    head = t[s]
    edges = np.searchsorted(head, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not small[n - 1]:
        pending[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        block = []
        while len(wave):
            block.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~small[before]]
        block.append(s[edges[c] : edges[c + 1]])
        full = np.concatenate(block)
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        if len(before):
            by = t[before]
            order = np.argsort(by, kind="stable")
            before, by = before[order], by[order]
            first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by)], strict=True):
                pending[by[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefix_reaches(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether neighbours in the order have ``length`` bytes in common."""
    words = np.ndarray((len(symbols) - 7,), ">u8", symbols.tobytes(), strides=(1,))
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for skip in [*range(0, length - 7, 8), length - 8]:
        ok = words[a[live] + skip] == words[b[live] + skip]
        same[live[~ok]] = False
        live = live[ok]
    return same


def repeated_windows(surroundings: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of each of some different byte strings, one after another, the least id of all strings that hold it
    (``least``: of each string's own places), and where each string's windows begin."""
    size = np.array([len(x) for x in surroundings], np.int64)
    text = np.frombuffer(b"\xff".join(surroundings) + b"\xff" + b"\xff" * 64, np.uint8) + np.uint8(1)  # separators become 0
    start = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(size)), size + 1)
    order = two_stage_order(text, LONGEST)
    inside = order - start[owner[order]] <= size[owner[order]] - length
    order = order[inside]
    windows = size - length + 1
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    if len(order):
        joined = common_prefix_reaches(text, order[:-1], order[1:], length)
        group = np.flatnonzero(np.r_[True, ~joined])
        lowest = np.minimum.reduceat(least[owner[order]], group)
        who = owner[order]
        out[first[who] + order - start[who]] = np.repeat(lowest, np.diff(np.r_[group, len(order)]))
    return out, first


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(_HASH_BITS)).astype(np.int64) % n


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _short(h: np.ndarray) -> bytes:
    """The low 40 bits of hashes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _expanded(batches: Iterator[pa.RecordBatch], needed: str | None = None) -> Iterator[tuple]:
    """Bytes, offsets, ids, hashes and the column ``needed`` (rows without it left out) of texts that have an id and are no copies."""
    expand = zstandard.ZstdDecompressor()
    for batch in chunks(batches, "z", 512 << 10):
        rows = [(i, h, z, x) for i, h, z, of, x in zip(*(batch.column(c).to_pylist() for c in ("id", "h", "z", "copies", needed or "copies")), strict=True) if i is not None and not (of and h in of) and (x is not None or not needed)]
        if rows:
            ids, hs, zs, extra = zip(*rows, strict=True)
            texts_ = [expand.decompress(z) for z in zs]
            yield np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0, *map(len, texts_)]), np.array(ids), np.array(hs), list(extra)


def _send_anchors(n_buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offsets, ids, _, _ in _expanded(batches):
            g, left, right, text, _, _ = chunk_anchors(raw, offsets, length)
            rows = []
            for b, o in _by_bucket(_bucket(g, n_buckets), n_buckets):
                who, count = np.unique(text[o], return_counts=True)
                head = np.array([len(who), len(o)], np.int64).tobytes()
                rows.append((b, head + ids[who].tobytes() + count.astype(np.uint32).tobytes() + _short(g[o]) + left[o].tobytes() + right[o].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of each bucket in a task."""
    by_bucket: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            by_bucket.setdefault(b, []).append(blob)
    while by_bucket:
        yield by_bucket.popitem()[1]


def _in_several(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each key also occurs with another id."""
    order = np.argsort(key, kind="stable")
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first), np.diff(np.r_[first, len(key)]))
    return out


def _shared_anchors(parts: int):
    """For each id the anchors that another id has as well, with the same bytes on one side as far as can be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_key(batches):
            g, who = _bucket_shared(blobs)
            who, count = np.unique(who, return_counts=True)
            yield by_part(who, np.zeros_like(who), 5 * count, _short(g), parts)

    return run


def _bucket_shared(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The shared anchors of a bucket and their ids, in the order of ids."""
    ids, counts, gs, sides = [], [], [], ([], [])
    while blobs:
        blob = blobs.pop()
        d, n = np.frombuffer(blob, np.int64, 2).tolist()
        ids.append(np.frombuffer(blob, np.int64, d, 16))
        counts.append(np.frombuffer(blob, np.uint32, d, 16 + 8 * d))
        at = 16 + 12 * d
        gs.append(_long(blob[at : at + 5 * n]))
        for k, side in enumerate(sides):
            side.append(np.frombuffer(blob, np.uint8, n, at + (5 + k) * n))
    g, who = np.concatenate(gs), np.repeat(np.concatenate(ids), np.concatenate(counts))
    gs.clear()
    keep = np.zeros(len(g), bool)
    for side in sides:
        tag = np.concatenate(side)
        side.clear()
        at = np.flatnonzero(tag > 0)
        if len(at):
            keep[at] |= _in_several(g[at] << np.uint64(8) | tag[at], who[at])
    g, who = g[keep], who[keep]
    order = np.argsort(who, kind="stable")
    return g[order], who[order]


def _send_surroundings(n_buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offsets, ids, hs, shared in _expanded(batches, "shared"):
            g, _, _, text, lo, hi = chunk_anchors(raw, offsets, length)
            wanted = [np.unique(_long(x)) for x in shared]
            n_wanted = np.array([len(x) for x in wanted])
            # one sorted list of (text, anchor) to look up in
            low = g & np.uint64((1 << _HASH_BITS) - 1)
            have = (text.astype(np.uint64) << np.uint64(_HASH_BITS)) | low
            want = (np.repeat(np.arange(len(wanted), dtype=np.uint64), n_wanted) << np.uint64(_HASH_BITS)) | np.concatenate(wanted)
            keep = np.isin(have, want)
            g, text, lo, hi = g[keep], text[keep], lo[keep], hi[keep]
            rows = []
            for b, o in _by_bucket(_bucket(g, n_buckets), n_buckets):
                who, which = np.unique(text[o], return_inverse=True)
                size = hi[o] - lo[o] + length
                body = raw[ragged(offsets[text[o]] + lo[o], size)].tobytes()
                head = np.array([len(who), len(o)], np.int64).tobytes()
                rows.append((b, head + ids[who].tobytes() + hs[who].tobytes() + _short(g[o]) + lo[o].astype(np.uint32).tobytes() + which.astype(np.uint32).tobytes() + size.astype(np.uint8).tobytes() + body))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return run


def _find_repeats(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_key(batches):
            yield from _bucket_repeats(blobs, length, parts)

    return run


def _bucket_repeats(blobs: list[bytes], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    ids, hs, gs, los, whos, sizes, bodies, n_docs = [], [], [], [], [], [], [], 0
    while blobs:
        blob = blobs.pop()
        d, n = np.frombuffer(blob, np.int64, 2).tolist()
        gs.append(_long(blob[16 + 16 * d : 16 + 16 * d + 5 * n]))
        at = 16
        for out, kind, count in ((ids, np.int64, d), (hs, np.int64, d), (None, np.uint8, 5 * n), (los, np.uint32, n), (whos, np.uint32, n), (sizes, np.uint8, n)):
            if out is not None:
                out.append(np.frombuffer(blob, kind, count, at))
            at += count * np.dtype(kind).itemsize
        whos[-1] = whos[-1].astype(np.int64) + n_docs
        n_docs += d
        bodies.append(blob[at:])
    ids, hs, g, lo, who, size = (np.concatenate(x) for x in (ids, hs, gs, los, whos, sizes))
    size, lo = size.astype(np.int64), lo.astype(np.int64)
    body = b"".join(bodies)
    bodies.clear()
    begin = np.cumsum(size) - size
    # equal surroundings (by hash, anchor and size) become one
    full = span_hashes_in_parts(body, begin, size)
    order = np.lexsort((full, g))
    g, full = g[order], full[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (full[1:] != full[:-1])]
    kind = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    place_id = ids[who[order]]
    least = np.minimum.reduceat(place_id, first)
    g_of, at, many = g[first], order[first], size[order[first]]
    # sorted together: whole anchors, up to a bound
    anchor_first = np.flatnonzero(np.r_[True, g_of[1:] != g_of[:-1]])
    before = np.r_[0, np.cumsum(many)]
    spans_doc, spans_start, spans_end = [], [], []
    a = 0
    while a < len(anchor_first):
        b = int(np.searchsorted(before[anchor_first], before[anchor_first[a]] + SORT_BYTES))
        b = max(b, a + 1)
        k0, k1 = int(anchor_first[a]), int(anchor_first[b]) if b < len(anchor_first) else len(first)
        strings = [body[x : x + y] for x, y in zip(begin[at[k0:k1]].tolist(), many[k0:k1].tolist(), strict=True)]
        lowest, where = repeated_windows(strings, least[k0:k1], length)
        p0, p1 = int(first[k0]), int(first[k1]) if k1 < len(first) else len(order)
        for q0 in range(p0, p1, 200_000):  # places, a bounded number at once
            q = slice(q0, min(q0 + 200_000, p1))
            windows = size[order[q]] - length + 1
            gone = lowest[ragged(where[kind[q] - k0], windows)] < np.repeat(place_id[q], windows)
            if gone.any():
                w = np.repeat(np.arange(len(windows)), windows)[gone]
                start = np.repeat(lo[order[q]], windows)[gone] + ragged(np.zeros(len(windows), np.int64), windows)[gone]
                run_first = np.r_[True, (w[1:] != w[:-1]) | (start[1:] != start[:-1] + 1)]
                f = np.flatnonzero(run_first)
                last = np.r_[f[1:], len(w)] - 1
                spans_doc.append(who[order[q]][w[f]])
                spans_start.append(start[f])
                spans_end.append(start[last] + length)
        a = b
    if not spans_doc:
        return
    doc, start, end = (np.concatenate(x) for x in (spans_doc, spans_start, spans_end))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    pairs = np.stack([start, end], 1)
    yield by_part(ids[doc[edges]], hs[doc[edges]], 16 * np.diff(np.r_[edges, len(doc)]), pairs.tobytes(), parts)


def span_hashes_in_parts(body: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of consecutive spans of a long byte string, some megabytes at a time, their sizes mixed in."""
    raw, out = np.frombuffer(body, np.uint8), np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        j = max(k + 1, int(np.searchsorted(begin, begin[k] + (4 << 20))))
        a, b = int(begin[k]), int(begin[j - 1] + size[j - 1])
        out[k:j] = span_hashes(raw[a:b], begin[k:j] - a, begin[k:j] - a + size[k:j])
        k = j
    return out ^ (size.astype(np.uint64) << np.uint64(57))


def merge_spans(pairs: np.ndarray) -> np.ndarray:
    """Spans (start, end) as maximal runs."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], reach[np.r_[first[1:], len(pairs)] - 1]], 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, kept (binary, the bytes that stay), n_bytes, n_removed, n_spans and spans (flat list of byte offsets) of each row."""
    if not ANCHOR + SIDE <= length <= LONGEST:
        raise ValueError(f"length must be from {ANCHOR + SIDE} to {LONGEST}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets, n_places = (max(8, -(-total // b)) for b in (BUCKET_BYTES, PLACE_BYTES))
    parts = max(shuffle_parts(spark), n_buckets)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # equal texts: by two hashes and the length
    key = src.where(F.col("id").isNotNull() & (F.octet_length("text") >= length)).select("id", "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n"))
    firsts = stored(key.groupBy("h", "h2", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "equal-texts")
    copies = key.join(firsts, ["h", "h2", "n"]).where("id > first").groupBy("id").agg(F.collect_set("h").alias("copies"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in chunks(batches, limit=1 << 20):
            z = pa.array([press.compress(t.encode()) for t in texts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), z], ["id", "h", "z"])

    squeezed = src.mapInArrow(lean(squeeze), "id long, h long, z binary").repartition(parts, "id")
    # left joins, so that they all read one and the same exchange of the texts
    marked = squeezed.join(copies.hint("shuffle_hash"), "id", "left").select("id", "h", "z", "copies")
    sent = marked.mapInArrow(lean(_send_anchors(n_buckets, length)), "bucket int, blob binary")
    shared = sent.repartition(n_buckets, "bucket").mapInArrow(lean(_shared_anchors(parts)), "part int, blob binary")
    shared = shared.repartition(parts, "part").mapInArrow(lean(from_parts), "id long, h long, data binary").select("id", F.col("data").alias("shared"))
    near = marked.join(shared.hint("shuffle_hash"), "id", "left").select("id", "h", "z", "copies", "shared")
    places = near.mapInArrow(lean(_send_surroundings(n_places, length)), "bucket int, blob binary").repartition(n_places, "bucket")
    found = places.mapInArrow(lean(_find_repeats(length, parts)), "part int, blob binary")
    found = found.repartition(parts, "part").mapInArrow(lean(from_parts), "id long, h long, data binary")
    spans = found.groupBy("id").agg(F.collect_list(F.struct("h", F.col("data").alias("spans"))).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "z", 1 << 20):
            kept, sizes, gone, runs = [], [], [], []
            for z, h, of, ours in zip(*(batch.column(c).to_pylist() for c in ("z", "h", "copies", "spans")), strict=True):
                raw = expand.decompress(z)
                found = [x["spans"] for x in ours or () if x["h"] == h]
                if of and h in of:
                    found = [np.array([0, len(raw)]).tobytes()]
                pairs = merge_spans(np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)).tolist() if found else []
                at, out = 0, []
                for a, b in pairs:
                    out.append(raw[at:a])
                    at = b
                kept.append(b"".join([*out, raw[at:]]))
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                runs.append([x for p in pairs for x in p])
            counts = [len(r) // 2 for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], ["id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    all_rows = marked.join(spans.hint("shuffle_hash"), "id", "left").select("id", "h", "z", "copies", "spans")
    out = all_rows.mapInArrow(lean(finish), "id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<long>")
    return out.select(F.col("id").cast(kind).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans", "spans")

