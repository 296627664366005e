"""Toxicity by a linear classifier whose scores are held still when groups of people are swapped.

A text's features are its words and the beginnings of its words: whether they
occur, and their share of all words. A logistic regression on those features
that tell toxic from other labelled texts best is fitted with a penalty: in
labelled sentences that name a group of people the name is swapped for others,
and for a word that names none, and squared changes of the score's logit are
added to the loss. So a mention of a group alone does not make a text toxic.

Labelled rows are a sample, LABELLED at most, and swapped sentences are PAIRS
at most, both taken by a hash. Everything else covers all rows and whole texts.

Defined cases: a null text is empty, and an empty text scores as one without
any feature; a null doc_id is not held out, and has no label; without labels of
both kinds every score is the share of toxic ones, or 0; of several labels or
texts of an id each teaches; repeated rows score alike; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import materialize, small_batches
from .shingles import ALNUM, chunks, mix64, words

#: Bounds of the labelled rows and of the swapped sentences that the model is fitted on.
LABELLED, PAIRS = 20_000, 20_000
#: Features that the model has, of those that as many labelled texts have.
FEATURES, SEEN = 1024, 4
#: Bytes of a word's beginnings.
HEADS = (4, 6, 8)
RIDGE = 3e-5
#: Weight of the mean squared change of the logit under swaps.
SWAPS = 5.0
#: Bits of the table that most words fail before they are looked up.
_SIEVE = 20

# By language a neutral word, then names of groups of people; a name is swapped for others of its row.
GROUPS = (
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "foreigners", "gays", "lesbians", "africans", "asians", "mexicans"),
    ("person", "woman", "man", "muslim", "christian", "jew", "hindu", "immigrant", "refugee", "foreigner", "gay", "lesbian", "african", "asian", "mexican"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "ausländer", "schwule", "lesben", "afrikaner", "asiaten", "türken"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "étrangers", "gays", "lesbiennes", "africains", "asiatiques", "arabes"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "extranjeros", "gais", "lesbianas", "africanos", "asiáticos", "gitanos"),
)
_ROW = {name: row for row in reversed(GROUPS) for name in row[1:]}
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 5 == 0


def swaps(sentence: str) -> list[str]:
    """A lower-case sentence with its names of groups swapped: for the neutral word, and for the next two of their rows."""
    found = [w for w in _WORD.findall(sentence) if w in _ROW]

    def other(word: str, k: int) -> str:
        row = _ROW.get(word)
        return word if row is None else row[0] if not k else row[1 + (row.index(word) - 1 + k) % (len(row) - 1)]

    return [_WORD.sub(lambda m: other(m[0], k), sentence) for k in range(3)] if found else []


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, their texts' numbers, how many words each text has)."""
    h, size, at = words(pc.utf8_lower(texts.fill_null("")), ALNUM, True, HEADS)
    n = np.diff(at)
    of = np.repeat(np.arange(len(texts)), n)
    out = [(h[0], of)]
    for k, head in enumerate(HEADS):
        long = size > head
        out.append((mix64(h[1 + k][long] + np.uint64(head)), of[long]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]), n


class Model:
    """Weights of features' presence and of the root of their share, and a constant."""

    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.features, self.weights = features, weights
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[(features & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)] = True

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: (text, column, value)."""
        h, of, n = hashed(texts)
        some = np.flatnonzero(self.sieve[(h & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)])
        h, of = h[some], of[some]
        at = np.minimum(np.searchsorted(self.features, h), max(0, len(self.features) - 1))
        hit = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
        key, often = np.unique(of[hit] * len(self.features) + at[hit], return_counts=True)
        text, column = np.divmod(key, max(1, len(self.features)))
        share = np.sqrt(often / n[text])
        return np.concatenate((text, text)), np.concatenate((column, column + len(self.features))), np.concatenate((np.ones(len(text)), share))

    def logits(self, texts: pa.Array) -> np.ndarray:
        text, column, value = self.rows(texts)
        return np.bincount(text, self.weights[column] * value, len(texts)) + self.weights[-1]


def _minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = 300, memory: int = 10) -> np.ndarray:
    """Where a smooth convex loss is least, by L-BFGS with halved steps."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, factors = -slope, []
        for s, y in reversed(past):
            factors.append(s @ way / (s @ y))
            way = way - factors[-1] * y
        if past:
            way = way * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), f in zip(past, reversed(factors), strict=True):
            way = way + (f - y @ way / (s @ y)) * s
        size = 1.0
        while True:
            there = w + size * way
            new, new_slope = loss(there)
            if new <= value + 1e-4 * size * (slope @ way):
                break
            size /= 2
            if size < 1e-10:
                return w
        s, y = there - w, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        done = value - new < 1e-9
        w, value, slope = there, new, new_slope
        if done:
            break
    return w


def fit(columns: int, text: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, pair: np.ndarray, pair_column: np.ndarray, pair_value: np.ndarray, ridge: float = RIDGE, swapped: float = SWAPS) -> np.ndarray:
    """Weights and a constant that the labels y of sparse rows, and sparse differences of swapped sentences, ask for."""
    n, m = len(y), int(pair.max()) + 1 if len(pair) else 1

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(text, w[column] * value, n) + w[-1]
        d = np.bincount(pair, w[pair_column] * pair_value, m) if len(pair) else np.zeros(m)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out = np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * (w[:-1] @ w[:-1]) + swapped * np.mean(d * d)
        slope = np.append(np.bincount(column, (p - y)[text] * value, columns) / n + ridge * w[:-1], np.mean(p - y))
        if len(pair):
            slope[:-1] += 2 * swapped / m * np.bincount(pair_column, d[pair] * pair_value, columns)
        return float(out), slope

    return _minimum(loss, np.zeros(columns + 1))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """k, y, text of labelled rows: ids are taken by a hash, at most so many."""
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("k"), (F.col("toxic") > 0).cast("int").alias("y"))
    h = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    told = told.filter(h.cast("double") * told.select("k").distinct().count() <= float((2 * most) << 30)).orderBy(h, "k", "y").limit(most)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(told), "k")


def train(docs: DataFrame, labels: DataFrame, swapped: float = SWAPS, most: int = LABELLED) -> Model:
    """The model learned from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = materialize(_sample(docs, labels, most), "labelled")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                f, of, _ = hashed(part.column("text"))
                order = np.lexsort((of, f))
                f, of = f[order], of[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (of[1:] != of[:-1])
                f, y = f[new], part.column("y").to_numpy()[of[new]]
                each, back = np.unique(f, return_inverse=True)
                yield pa.record_batch([pa.array(each.view(np.int64)), pa.array(np.bincount(back, minlength=len(each))), pa.array(np.bincount(back, y, len(each)).astype(np.int64))], ["f", "n", "t"])

    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if total.t in (0, total.n):
        p = total.t / total.n if total.n else 0.0
        return Model(np.zeros(0, np.uint64), np.array([40.0 if p else -800.0]))
    share = total.t / total.n
    far = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = known.mapInArrow(seen, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    best = best.filter(F.col("n") >= SEEN).orderBy(far.desc(), "f").limit(FEATURES).select("f").collect()
    features = np.sort(np.array([r.f for r in best], np.int64).view(np.uint64))
    shared = known.sparkSession.sparkContext.broadcast(features)

    def packed(text: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> list[pa.Array]:
        order = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[order], np.arange(n + 1))
        column, value = column[order].astype(np.int32), value[order]
        return [pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (column, value)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, np.zeros(1))
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.record_batch([part.column("k"), part.column("y"), *packed(*model.rows(part.column("text")), part.num_rows)], ["k", "y", "columns", "values"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, np.zeros(1))
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = [(s, other) for s in _SENTENCE.findall((text or "").lower()) for other in swaps(s)]
                if found:
                    text, column, value = model.rows(pa.array([x for p in found for x in p], pa.string()))
                    value = np.where(text % 2, -value, value)
                    yield pa.record_batch([pa.array([a + "\n" + b for a, b in found]), *packed(text // 2, column, value, len(found))], ["s", "columns", "values"])

    # no more than the sample, also where ids repeat
    got = known.mapInArrow(rows, "k long, y int, columns binary, values binary").orderBy(F.xxhash64("k"), "k", "y", "columns", "values").limit(most).collect()
    told = known.mapInArrow(pairs, "s string, columns binary, values binary").filter("length(columns) > 0").orderBy(F.xxhash64("s"), "s").limit(PAIRS).drop("s").collect()
    sparse = lambda r: (np.repeat(np.arange(len(r)), [len(x.columns) // 4 for x in r]), np.frombuffer(b"".join(bytes(x.columns) for x in r), np.int32), np.frombuffer(b"".join(bytes(x["values"]) for x in r)))
    return Model(features, fit(2 * len(features), *sparse(got), np.array([float(r.y) for r in got]), *sparse(told), swapped=swapped))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                p = 1 / (1 + np.exp(-np.clip(own.logits(part.column("text")), -700, 40)))
                p[p < 1e-300] = 0
                yield pa.record_batch([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
