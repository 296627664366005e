"""Language identification by a string kernel.

Two texts are alike by the byte n-grams (N) both have: presence, not counts,
each text's set scaled to length one. Landmark texts stand for the kernel
(Nystroem), and a ridge regression for each language against the rest is solved
on them in closed form. A batch is scored by two matrix products.

The training rows are a sample, PER_LANG of each language at most, taken by a
hash of the id. Tasks sum what the regression needs of them, so the driver gets
the landmarks, a bit vector each, and PARTS partial sums, however many
languages and rows there are.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned; rows with null lang or text
teach nothing; a null doc_id is not held out and teaches nothing; repeated rows
are predicted alike, and of rows with one id and language one teaches; ties go to the language that sorts first; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import discard, materialize, sized, small_batches
from .shingles import mix64, text_bytes

N = (1, 2, 3, 4)
#: The n-grams share this many hashed places.
PLACES = 1 << 13
#: Bounds of the sample: training rows a language, landmarks in all.
PER_LANG, LANDMARKS = 800, 192
RIDGE = 1e-2
#: Tasks that sum the training rows.
PARTS = 16
#: Rows scored at once.
ROWS = 128

_BLANK = np.full(256, 32, np.uint64)
_BLANK[97:123] = _BLANK[65:91] = np.arange(97, 123)
_BLANK[128:] = np.arange(128, 256)


def presence(texts: pa.Array) -> np.ndarray:
    """A row of PLACES zeros and ones a text: which n-grams of its letters it has, whole text, any length."""
    raw, at = text_bytes(texts)
    out = np.zeros((len(texts), PLACES), np.float32)
    for row in range(len(texts)):
        for lo in range(int(at[row]), int(at[row + 1]), 1 << 20):
            # pieces overlap by an n-gram less one byte
            b = _BLANK[raw[lo : min(int(at[row + 1]), lo + (1 << 20) + max(N) - 1)]]
            code = np.zeros(len(b), np.uint64)
            for n in range(1, max(N) + 1):
                code = code[: len(b) - n + 1] * np.uint64(256) + b[n - 1 :]
                if n in N and len(code):
                    out[row, (mix64(code + np.uint64(n << 40)) >> np.uint64(51)).astype(np.int64)] = 1
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)


def rows_of(bits: list[bytes]) -> np.ndarray:
    """Presence rows of packed bits, each scaled to length one."""
    packed = np.frombuffer(b"".join(map(bytes, bits)), np.uint8).reshape(len(bits), PLACES // 8)
    return scaled(np.unpackbits(packed, axis=1).astype(np.float32))


def solve(points: np.ndarray, squares: np.ndarray, by_lang: np.ndarray, n: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights of each landmark for each language, from sums over the n training rows.

    k are a row's kernel values with the landmarks: squares is the sum of
    their outer products, by_lang that of k itself over each language's rows.
    A row's target is 1 for its language and -1 for the others.
    """
    target = 2 * by_lang - by_lang.sum(0)
    a = squares + ridge * n * (points @ points.T).astype(np.float64) + 1e-6 * np.eye(len(points))
    return np.linalg.solve(a, target.T).astype(np.float32)


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> tuple[np.ndarray, np.ndarray, list[str]] | None:
    """The model (landmark rows, weights, languages) of docs (doc_id, text, lang), None if no row teaches anything."""
    rows = small_batches(docs).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("long").alias("k"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # about four times the sample passes a threshold on the hash, however many ids a language has
    ids = materialize(rows.select("k", "lang").distinct(), "ids")
    sizes = materialize(ids.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")), "sizes")
    h = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    few = ids.join(sized(sizes), F.col("lang") == F.col("l")).filter(h.cast("double") * F.col("n") <= float((4 * per_lang) << 30)).select("k", "lang")
    order = W.partitionBy("lang").orderBy(h, "k")
    sample = materialize(few.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_lang), "sample")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                bits = [np.packbits(r > 0).tobytes() for r in presence(part.column("text"))]
                yield pa.record_batch([part.column("k"), part.column("lang"), part.column("at"), pa.array(bits, pa.binary())], ["k", "lang", "at", "bits"])

    taught = rows.join(sized(sample), ["k", "lang"]).select("k", "lang", "at", "text").mapInArrow(told, "k long, lang string, at int, bits binary")
    taught = materialize(taught.groupBy("k", "lang", "at").agg(F.min("bits").alias("bits")), "taught")
    langs = sorted(r.lang for r in taught.select("lang").distinct().collect())
    if not langs:
        discard(ids, sizes, sample, taught)
        return None
    first = taught.filter(F.col("at") <= -(-landmarks // len(langs))).select("lang", "at", "bits").collect()
    points = rows_of([r.bits for r in sorted(first, key=lambda r: (r.lang, r.at))])
    shared = docs.sparkSession.sparkContext.broadcast((points, langs))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names = shared.value
        squares, by_lang, n = np.zeros((len(at), len(at))), np.zeros((len(names), len(at))), 0
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                k = (rows_of(part.column("bits").to_pylist()) @ at.T).astype(np.float64)
                squares += k.T @ k
                np.add.at(by_lang, np.searchsorted(names, part.column("lang").to_pylist()), k)
                n += len(part)
        if n:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([squares.tobytes()], pa.binary()), pa.array([by_lang.tobytes()], pa.binary())], ["part", "n", "squares", "by_lang"])

    sums = taught.repartition(PARTS, "k").sortWithinPartitions("k", "lang").mapInArrow(summed, "part int, n long, squares binary, by_lang binary").collect()
    sums.sort(key=lambda r: r.part)
    total = lambda name, shape: sum(np.frombuffer(bytes(r[name])) for r in sums).reshape(shape)
    discard(ids, sizes, sample, taught)
    shared.unpersist()
    return points, solve(points, total("squares", (len(points), len(points))), total("by_lang", (len(langs), len(points))), sum(r.n for r in sums)), langs


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, list[str]] | None) -> DataFrame:
    """doc_id, lang_pred, score of docs (doc_id, text); the model, a few MB of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column("text").to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if shared.value is not None:
                    points, weights, langs = shared.value
                    margin = scaled(presence(part.column("text"))) @ points.T @ weights
                    best = margin.argmax(1)
                    for i, t in enumerate(texts):
                        if t and any(map(str.isalpha, t)):
                            lang[i], score[i] = langs[best[i]], float(min(1.0, max(0.0, (margin[i, best[i]] + 1) / 2)))
                yield pa.record_batch([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
