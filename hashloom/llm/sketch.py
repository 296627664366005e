"""Document fingerprints: threshold-scaled sketches.

The sketch of a text is the set of all its word-shingle hashes below a fixed
fraction of the hash range. Unlike a sketch of fixed size it grows with the
text, so the union of sketches is the sketch of the union, and containment can
be told between a page and a book. A text none of whose hashes is below the
threshold keeps its smallest one, as a short text would have none; merging
keeps to that rule, so the sketch of a union is still that of its parts.

Defined cases: a null text is empty; a text without words has an empty sketch,
and two empty sketches are alike 1.0; the order of rows is doc_id descending,
null last, then a hash of the text; rows equal in id and text follow each
other; a table of one row is followed by itself; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import small_batches
from .shingles import SPACED, chunks, shingles, words

SHINGLE = 5
#: Stands for a null doc_id in the order of rows.
NONE = -(2**63)
#: One hash in FRACTION is kept.
FRACTION = 4


def _threshold(fraction: int) -> np.uint64:
    return np.uint64(((1 << 64) - 1) // fraction)


def sketches(texts: pa.Array, k: int = SHINGLE, fraction: int = FRACTION) -> list[np.ndarray]:
    """The sorted distinct kept hashes of each text."""
    h, at = words(texts, SPACED, fold=False)
    g, off = shingles(h, at, k)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        kept = g[a:b][g[a:b] <= _threshold(fraction)]
        out.append(np.unique(kept) if len(kept) or a == b else g[a:b].min(keepdims=True))
    return out


def to_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    below = both[both <= _threshold(fraction)]
    return below if len(below) else both[:1]


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def resemblance(a: np.ndarray, b: np.ndarray, equal: bool = True) -> float:
    """Shared hashes over all hashes of both; equal is for two empty sketches."""
    both = common(a, b)
    union = len(a) + len(b) - both
    return both / union if union else float(equal)


def containment(a: np.ndarray, b: np.ndarray, equal: bool = True) -> float:
    """The share of a's hashes that b has too; an empty sketch is in any."""
    return common(a, b) / len(a) if len(a) else float(equal)


def fingerprints(docs: DataFrame, k: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """doc_id, fingerprint of each row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array([to_string(s) for s in sketches(part.column("text"), k, fraction)], pa.string())], ["doc_id", "fingerprint"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_sequence(docs: DataFrame) -> DataFrame:
    """(range, echo, doc_id, text): rows dealt into ranges of doc_id, each sorted, each with its successor.

    The ranges' cut points are quantiles, and so as few as the partitions.
    Ids with more rows than a range should have, null among them, are ranges
    of their own, cut further by the texts' hashes. Rows of one range follow
    each other by descending doc_id; the last of them is an echo of the next
    range's first row (of the first range's for the last), so that every row
    meets its successor and texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key, h = F.coalesce(F.col("doc_id"), F.lit(NONE)), F.xxhash64("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    counts = rows.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    total = rows.count()
    hot = {r.k: -(-r.n * ranges // total) for r in counts.filter(F.col("n") * ranges > total).collect()}  # fewer than ranges
    cuts = {int(x) for x in rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)} if parts > 1 else set()
    cuts = sorted(cuts | {x for k in hot for x in (k - 1, k) if x >= NONE})
    at = F.lit(0)
    if cuts:
        table, steps = F.lit(cuts), [1 << b for b in range((len(cuts)).bit_length() - 1, -1, -1)]
        inside = lambda i: (i <= len(cuts)) & (F.get(table, (i - 1).cast("int")) < key)
        at = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(inside(at + step), at + step).otherwise(at))
    below = F.lit(0)
    if hot:
        pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv]), key), F.lit(1))
        below = F.floor((F.shiftright(h, 32) + F.lit(1 << 31)) * pieces / F.lit(1 << 32)).cast("int")
    place = F.struct((-at).alias("at"), below.alias("below"))
    heads = rows.select(place.alias("range"), F.struct(F.bitwise_not(key).alias("k"), h.alias("h")).alias("row")).groupBy("range").agg(F.min("row").alias("row"))
    heads = sorted(heads.collect(), key=lambda r: (r.range.at, r.range.below))
    if not heads:
        return rows.select(place.alias("range"), F.lit(False).alias("echo"), "doc_id", "text")
    to = [(~r.row.k, r.row.h, heads[i - 1].range.at, heads[i - 1].range.below) for i, r in enumerate(heads)]
    to = F.broadcast(spark.createDataFrame(to, "k long, h long, at int, below int"))
    echoes = rows.withColumn("k", key).withColumn("h", h).join(to, ["k", "h"]).groupBy("at", "below").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    echoes = echoes.select(F.struct("at", "below").alias("range"), F.lit(True).alias("echo"), "doc_id", "text")
    own = rows.select(place.alias("range"), F.lit(False).alias("echo"), "doc_id", "text")
    dealt = own.unionByName(echoes).repartition(parts, "range")
    return dealt.sortWithinPartitions("range", "echo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def edit_likeness(docs: DataFrame, k: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of its successor (EDITS).

    The edit replaces the last third of the code points by the first as many
    of the successor.
    """

    def measured(rows: list[tuple], follow: list[str]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, follow, strict=True)]
        own, new = sketches(pa.array([*texts, follow[-1]], pa.large_string()), k, fraction), sketches(pa.array(edited, pa.large_string()), k, fraction)
        # the successor of row i is row i + 1 unless a range ends there
        after = [own[i + 1] if follow[i] is (texts[i + 1] if i + 1 < len(texts) else follow[-1]) else sketches(pa.array([follow[i]], pa.large_string()), k, fraction)[0] for i in range(len(rows))]
        out = []
        for r, t, f, e, s, x, y in zip(rows, texts, follow, edited, own, new, after, strict=False):
            out.append((r[2], len(t), hashlib.sha256(e.encode()).hexdigest(), to_string(s), to_string(x), resemblance(s, x), resemblance(s, y), containment(s, x), containment(s, y)))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4), strict=True)], [x.split()[0] for x in EDITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        rows, follow = [], []
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held is not None and held[0] == row[0] and not held[1]:
                        rows.append(held)
                        follow.append(row[3])
                    held = row
                if rows:
                    yield measured(rows, follow)
                    rows, follow = [], []

    return in_sequence(small_batches(docs)).mapInArrow(run, EDITS)
