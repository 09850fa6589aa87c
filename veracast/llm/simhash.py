"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it.  For a distance of at most d,
fingerprints are cut into so few segments (d // 2 + 1) that two that link differ by at most one bit in some segment: each
distinct fingerprint is indexed under every segment with each one of its bits wiped, an equality join on these variants brings
together all that may link, and the full distance is verified.  A pair is taken from the first variant that both share only.

Variants are dealt out by an exchange and matched in numpy, partition by partition.  In a small bucket all pairs are compared;
in a large one (near copies of one text) members are hung on pivots: whoever is within d of a pivot is linked by a star, and only
those within 2d of the pivot need comparing with the star, by the triangle inequality.  What is emitted is links that
connect, at most one less than a bucket's members, not all pairs.

Exact copies share a fingerprint and are collapsed before indexing.  Components come from large-star/small-star over stored tables.

Defined results: a null, empty or blank text has fingerprint zero, and zero links like any other; repeated rows each get a row; a
null id never names a component (null if there is no other id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, shuffle_parts, stored, utf8
from .components import connected_components

#: Buckets up to this size are compared pair by pair, larger ones by pivots.
SMALL = 33
#: Variants that a task matches at once: partitions grow with the fingerprints, so that a task's rows do not.
PART_ROWS = 1 << 20
#: A fingerprint of more than this part of all rows is joined back by broadcast instead of an exchange.
HOT = 1000

_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text of a chunk, as unsigned 64-bit integers."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    # one gap byte after each text, then one space after each word and nothing else between words
    spaced = np.full(len(raw) + n, 32, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = _LOWER[raw]
    gap = _GAP[spaced]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    flat = spaced[keep]
    is_end = gap[keep]
    flat[is_end] = 32
    end = np.flatnonzero(is_end)
    if not len(end):
        return out
    start = np.r_[0, end[:-1] + 1]
    bounds = np.r_[0, np.cumsum(is_end)][np.r_[0, np.cumsum(keep)][offsets + np.arange(n + 1)]]
    words = np.diff(bounds)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    has = count > 0
    first = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(first - bounds[:-1], count)
    a = start[number]
    b = end[number + np.repeat(np.minimum(words, shingle), count) - 1]
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[i:j], seed) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    where, begin = np.flatnonzero(has), first[has]
    step = 1 << 18
    votes = np.zeros((n, 64), np.int64)
    for k in range(0, len(h), step):  # votes of a bounded number of shingles at once
        bits = np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(begin, k, side="right") - 1, np.searchsorted(begin, k + len(bits))
        votes[where[lo:hi]] += np.add.reduceat(bits, np.maximum(begin[lo:hi] - k, 0), axis=0, dtype=np.int32)
    winners = 2 * votes > count[:, None]
    return np.packbits(winners, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint_documents(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fingerprint (long, the 64 bits) of each row; a scan without any shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(*utf8(batch.column("text")), shingle).view(np.int64))], ["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def segments(distance: int) -> list[tuple[int, int]]:
    """Bit ranges such that fingerprints at most ``distance`` apart differ by at most one bit in one of them."""
    n = distance // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _masks(distance: int) -> np.ndarray:
    """For each wiped bit, the bits of its segment that stay."""
    out = np.zeros(64, np.uint64)
    for a, b in segments(distance):
        whole = ((1 << b) - 1) ^ ((1 << a) - 1)
        for i in range(a, b):
            out[i] = whole ^ (1 << i)
    return out


def pivot_links(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all members of a bucket which are connected by steps of at most ``distance``."""
    links = []
    while len(values) > 1:
        pivot = values[0]
        away = np.bitwise_count(values ^ pivot)
        star, rest = values[away <= distance], values[away > distance]
        if len(star) > 1:
            links.append((np.full(len(star) - 1, pivot), star[star != pivot]))
        near = rest[away[away > distance] <= 2 * distance]
        rows = max(1, (1 << 21) // len(star))
        for k in range(0, len(near), rows):
            part = near[k : k + rows]
            close = np.bitwise_count(part[:, None] ^ star[None, :]) <= distance
            found = close.any(1)
            links.append((star[close.argmax(1)[found]], part[found]))
        values = rest
    return links


def bucket_links(key: np.ndarray, bit: np.ndarray, value: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of equal keys."""
    order = np.lexsort((value, key))
    key, bit, value = key[order], bit[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    large = size > SMALL
    links = []
    for a, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
        links += pivot_links(np.unique(value[a : a + n]), distance)
    small = np.repeat(~large & (size > 1), size)
    key, bit, value = key[small], bit[small], value[small]
    lows = np.zeros(64, np.int64)
    for a, b in segments(distance):
        lows[a:b] = a
    masks = _masks(distance)
    at = np.arange(len(key))
    for ahead in range(1, SMALL):
        at = at[at + ahead < len(key)]
        at = at[key[at] == key[at + ahead]]
        if not len(at):
            break
        x, y = value[at], value[at + ahead]
        diff = x ^ y
        ok = (np.bitwise_count(diff) <= distance) & (diff != 0)
        x, y, diff, b = x[ok], y[ok], diff[ok], bit[at[ok]]
        # the pair counts where its segment is the first that nearly agrees, under the bit that differs or else the lowest
        want = np.full(len(x), -1)
        for a, _ in reversed(segments(distance)):
            here = diff & (masks[a] | np.uint64(1) << np.uint64(a))
            n = np.bitwise_count(here)
            lowest = np.where(n == 1, np.bitwise_count(here - np.uint64(1)), a)
            want = np.where(n <= 1, lowest, want)
        ok = want == b
        links.append((x[ok], y[ok]))
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])


def fingerprint_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect the distinct values of the column fingerprint which are at most ``distance`` bits apart."""
    parts = max(shuffle_parts(distinct.sparkSession), -(-64 * distinct.count() // PART_ROWS))
    masks = _masks(distance).view(np.int64).tolist()
    # a wiped bit's number goes where its segment has no bits
    place = [58 if b <= 58 else 0 for a, b in segments(distance) for _ in range(a, b)]
    table = F.array(*[F.lit(m) for m in masks])
    shift = F.array(*[F.lit(p) for p in place])
    rows = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    key = F.get(table, F.col("bit")).bitwiseAND(F.col("fingerprint")).bitwiseXOR(F.call_function("shiftleft", F.col("bit").cast("long"), F.get(shift, F.col("bit"))))
    rows = rows.select(key.alias("key"), F.col("bit").cast("byte").alias("bit"), "fingerprint").repartition(parts, "key", "bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in ("key", "bit", "fingerprint")] for b in batches]
        if got:
            key, bit, value = (np.concatenate(x) for x in zip(*got, strict=True))
            bit = bit.astype(np.int64)
            a, b = bucket_links(_with_bit(key, bit), bit, value.view(np.uint64), distance)
            for k in range(0, len(a), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + (1 << 18)].view(np.int64)), pa.array(b[k : k + (1 << 18)].view(np.int64))], ["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def _with_bit(key: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Keys of different bits kept apart, should the bit's number and a segment's bits ever look alike."""
    return key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + bit.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint (long) and component_id (smallest id reachable by links, its own included) of each row."""
    found = stored(fingerprint_documents(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = stored(found.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(nodes.select("fingerprint"), distance), "fingerprint-links")
    linked = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = stored(linked, "fingerprint-roots")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(named.join(names, "root").select("fingerprint", "n", "component_id"), "fingerprint-components")
    # rows of the commonest fingerprints, fewer than HOT of them, are named where they are; no task takes all of such a fingerprint's
    is_hot = F.col("n") > found.count() / HOT
    hot, rest = F.broadcast(of.where(is_hot).drop("n")), of.where(~is_hot).drop("n")
    out = found.join(hot, "fingerprint").unionByName(found.join(hot, "fingerprint", "left_anti").join(rest, "fingerprint"))
    return out.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one whose id names the component.

    Of rows that repeat both id and text one stays; different texts that share that id all do.
    """
    near = stored(near_duplicates(docs, distance, shingle, id_col, text_col), "near-duplicates")
    keep = near.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_id")).distinct()
    out = docs.join(keep.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = near.groupBy(id_col).count().where("count > 1").limit(1).count()
    return out.dropDuplicates([id_col, text_col]) if repeated else out
