"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower-cased, with every run of other than letters as one space; n-grams of one to three of them are
hashed to a fixed number of buckets.  Counts of buckets for each language give a matrix of log-probabilities, which is
broadcast (buckets x languages, a fixed size); a batch is scored by gathering its n-grams' rows and adding them text by text.

Training takes rows with a language whose id's CRC-32 leaves other remainders than the held-out one, at most about
``per_language`` documents of each language, chosen by a hash of the id: a documented bound for fitting, with every text of
the sample read whole.  Prediction reads nothing but the text.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; without any training row every
text is; repeated rows each get a row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, remainder_col, texts

BUCKET_BITS = 15
ORDERS = 3
UNKNOWN = "und"
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(batch: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the bucket of each n-gram and its text's number, and whether each text has a letter."""
    lower = [t.lower() for t in batch]
    code = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    owner = np.repeat(np.arange(len(lower), dtype=np.int32), size + 1)[: len(code)]
    letter = letters()[code]
    has = np.bincount(owner[letter], minlength=len(batch)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code, owner = np.where(letter, code, np.uint32(32))[keep], owner[keep]
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint32)
    for k in range(ORDERS):
        h = h[: len(h) - 1] if k else h
        h = (h ^ (code[k:] + np.uint32(k))) * _MIX[k]
        h ^= h >> np.uint32(15)
        same = owner[k:] == owner[: len(owner) - k] if k else slice(None)
        buckets.append((h[same] * _MIX[0]) >> np.uint32(32 - BUCKET_BITS))
        owners.append(owner[: len(owner) - k][same])
        if len(code) <= k + 1:
            break
    return buckets, owners, has


class Model:
    """Languages and the log-probability of each bucket in each."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, smoothing: float = 0.5) -> None:
        self.languages = languages
        total = counts + smoothing
        self.table = np.ascontiguousarray(np.log(total / total.sum(0)), np.float32)
        self.prior = np.log((documents + 1) / (documents.sum() + len(languages)))

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not batch:
            return [UNKNOWN] * len(batch), np.zeros(len(batch))
        buckets, owners, has = ngrams(batch)
        score = np.tile(self.prior, (len(batch), 1))
        for b, o in zip(buckets, owners, strict=True):
            if len(b):
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                for k in range(len(self.languages)):
                    score[o[first], k] += np.add.reduceat(self.table[:, k][b].astype(np.float64), first)
        best = score.argmax(1)
        odds = np.exp(score - score.max(1, keepdims=True))
        top = odds[np.arange(len(batch)), best] / odds.sum(1)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, top, 0.0)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter; a scan without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            yield batch.filter(pa.array([any(map(str.isalpha, t)) for t in texts(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def train(docs: DataFrame, per_language: int = 2500, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most about ``per_language`` rows of each language outside the held-out remainder."""
    rows = docs.where((remainder_col(id_col, modulus) != held_out) & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("draw") < share[F.col("lang")])
    number = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for batch in chunks(batches):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for b, o in zip(*ngrams(texts(batch.column("text")))[:2], strict=True):
                counts += np.bincount(lang[o] << BUCKET_BITS | b, minlength=counts.size).reshape(counts.shape)
        at, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bucket), pa.array(counts[at, bucket])], ["lang", "bucket", "n"])

    found = sample.select("lang", "text").mapInArrow(lean(run), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    counts[found.column("bucket").to_numpy(), found.column("lang").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts, np.array([sizes[lang] for lang in languages], float))


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, lang_pred and score of each row, after the columns ``keep``; a scan without any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lang, score = shared.value.predict(texts(batch.column(text_col)))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score)], [*columns, "lang_pred", "lang_score"])

    columns = list(dict.fromkeys((id_col, *keep)))
    src = docs.select(*dict.fromkeys((*columns, text_col)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return src.mapInArrow(lean(run), f"{schema}, lang_pred string, lang_score double")
