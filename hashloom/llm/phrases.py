"""Phrases of two or three words that stand together more often than their parts would.

Texts are cut into pieces at punctuation and line ends. Equal pieces are
counted once, with their multiplicity. Their n-grams, weighted by it, are
dealt into hash buckets, and DuckDB counts each bucket, on disk where memory
does not hold it. A phrase then asks for the counts of its parts: the
requests are shuffled to where the parts are counted, and what they get is
gathered by phrase.

Only n-grams that occur often enough are kept, which loses nothing: a part of
a frequent phrase is as frequent. Trigrams are counted where both of their
bigrams pass a bitmap of fixed size that holds the frequent ones; the bitmap
passes some others too, so it saves work and decides nothing.

Defined cases: a null text is empty, and a null lang is `und`, as is a lang of
that name; a text or piece without words adds nothing; pieces and words may be
of any length; repeated rows count each; equal scores go by count, then by
phrase; an empty table, or one without frequent phrases, gives no rows; other
columns are ignored, whatever their names, and so is doc_id.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import materialize, sized, small_batches
from .shingles import chunks, mix64, shingles, text_bytes, words

#: A phrase is a candidate if it occurs this often.
LEAST = 10
#: A phrase goes if a longer one that holds it has this share of its count, in percent.
WITHIN = 50
#: Phrases that are returned of each language.
TOP = 2000
#: The bitmap of frequent bigrams has two to this power bits: 16 MB.
BITS = 27
#: What DuckDB holds in memory for one bucket.
BUCKET_MEMORY = "256MB"
#: N-grams that are summed at a time, and bytes of pieces that they come from.
GRAMS = 1 << 20
GATHERED = 6 << 20
#: Steps of a language's scores, by their logarithm, of which the lower ones are left out of its ranking.
STEPS = 64

_SEPARATE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def split_pieces(text: str | None) -> list[bytes]:
    """The pieces of a text that have words: A-Z lowered, one space between words."""
    found = (b" ".join(p.split()) for p in (text or "").encode().lower().translate(_SEPARATE).split(b"\n"))
    return [p for p in found if p]


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, m: the distinct pieces of docs (lang, text) and how often each occurs."""
    rows = small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = Counter((lang, p) for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True) for p in split_pieces(text))
                yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "piece", "m"])

    return rows.mapInArrow(run, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _places(begins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bits of (language, bigram) in the bitmap."""
    return (mix64(hashes ^ begins) >> np.uint64(64 - BITS)).astype(np.int64)


def _of_lang(langs: list[str]) -> np.ndarray:
    own = {lang: zlib.crc32(lang.encode()) for lang in set(langs)}
    return mix64(np.array([own[x] for x in langs], np.uint64))


def _strings(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of buf as strings."""
    at = np.concatenate(([0], np.cumsum(end - begin)))
    data = buf[np.repeat(begin - at[:-1], end - begin) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data)])


def grams(batch: pa.RecordBatch, sizes: tuple[int, ...], bitmap: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """lang, g, m of the n-grams of (lang, piece, m), summed over some GRAMS at a time.

    With a bitmap, of n-grams both of whose (n - 1)-grams, bigrams that is, are in it.
    """
    texts, langs = batch.column("piece"), batch.column("lang").to_pylist()
    buf, docs = text_bytes(texts)
    gaps = np.flatnonzero(buf == 32)
    begin, end = np.sort(np.concatenate((docs[:-1], gaps + 1))), np.sort(np.concatenate((docs[1:], gaps)))
    at = np.searchsorted(begin, docs)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    weight, lang = batch.column("m").to_numpy(zero_copy_only=False), pa.array(langs, pa.string())
    for k in sizes:
        first = np.flatnonzero(np.arange(len(begin)) + k <= at[doc + 1])
        if bitmap is not None:
            h, off = shingles(*words(texts, fold=False), 2, short=False)
            place = _places(np.repeat(_of_lang(langs), np.diff(off)), h)
            known = (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            two = first - at[doc[first]] + off[doc[first]]  # a piece's bigrams begin at its words but the last
            first = first[known[two] & known[two + 1]]
        for lo in range(0, len(first), GRAMS):
            f = first[lo : lo + GRAMS]
            table = pa.table([lang.take(pa.array(doc[f])), _strings(buf, begin[f], end[f + k - 1]), pa.array(weight[doc[f]])], ["lang", "g", "m"])
            found = table.group_by(["lang", "g"], use_threads=False).aggregate([("m", "sum")])
            found = found.select(["lang", "g", "m_sum"]).rename_columns(["lang", "g", "m"]).cast(pa.schema([("lang", pa.string()), ("g", pa.string()), ("m", pa.int64())]))
            yield from found.to_batches()


def _gathered(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], bitmap: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """grams() of pieces, GATHERED bytes or one batch at a time."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.nbytes
        if many >= GATHERED:
            yield from grams(pa.concat_batches(held), sizes, bitmap)
            held, many = [], 0
    if held:
        yield from grams(pa.concat_batches(held), sizes, bitmap)


def _counted(parts: DataFrame, least: int) -> DataFrame:
    """lang, g, f of the n-grams that parts (lang, g, m) hold at least so often: a bucket is a partition, and DuckDB counts it.

    What does not fit its memory goes to a folder of the task alone, which
    goes with the task; a lost bucket is counted anew from the shuffle.
    """
    kind = pa.schema([("lang", pa.string()), ("g", pa.string()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as at:
            con = duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": at, "preserve_insertion_order": False})
            bucket = pa.RecordBatchReader.from_batches(kind, batches)  # noqa: F841
            found = con.sql("SELECT lang, g, sum(m)::BIGINT AS f FROM bucket GROUP BY lang, g HAVING sum(m) >= ?", params=[least])
            yield from found.to_arrow_reader(10_000)
            con.close()

    buckets = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(buckets, "lang", "g").mapInArrow(run, "lang string, g string, f long")


def _bitmap(bigrams: DataFrame) -> np.ndarray:
    """The bitmap of frequent bigrams (lang, g): its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _ = shingles(*words(batch.column("g"), fold=False), 2, short=False)
            yield pa.record_batch([pa.array(_places(_of_lang(batch.column("lang").to_pylist()), h) + 1)], ["x"])

    x = F.col("x")
    made = bigrams.select("lang", "g").mapInArrow(run, "x long").groupBy(F.bitmap_bucket_number(x).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in made.collect():
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def counts(found: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, g, k, f of the n-grams of one to three words that pieces (lang, piece, m) hold at least `least` times."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, (1, 2))

    size = F.size(F.split("g", " "))
    short = materialize(_counted(found.mapInArrow(low, "lang string, g string, m long"), least).withColumn("k", size), "grams")
    shared = found.sparkSession.sparkContext.broadcast(_bitmap(short.filter("k = 2")))

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, (3,), shared.value)

    long = materialize(_counted(found.mapInArrow(high, "lang string, g string, m long"), least).withColumn("k", F.lit(3)), "grams")
    return short.unionByName(long)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in numbers of 38 digits."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(a) * big(a), big(left) * big(right))


def scored(frequent: DataFrame, within: int = WITHIN) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates among frequent (lang, g, k, f) that no longer one takes the place of."""
    w = F.split("g", " ")
    join = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    ask = lambda cut, side, part: F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), part.alias("part"))
    two, three = F.array(ask(1, "l", w[0]), ask(1, "r", w[1])), F.array(ask(1, "l", w[0]), ask(1, "r", join(2, 2)), ask(2, "l", join(1, 2)), ask(2, "r", w[2]))
    asked = frequent.filter("k > 1").select("lang", F.col("g").alias("phrase"), F.col("f").alias("a"), "k", F.explode(F.when(F.col("k") == 2, two).otherwise(three)).alias("x"))
    asked = asked.select("lang", "phrase", "a", "k", "x.cut", "x.side", "x.part")
    got = asked.join(frequent.select("lang", F.col("g").alias("part"), "f"), ["lang", "part"])
    of = lambda cut, side: F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f"))).alias(f"{side}{cut}")
    cuts = got.groupBy("lang", "phrase", "a", "k").agg(of(1, "l"), of(1, "r"), of(2, "l"), of(2, "r"))
    a = F.col("a")
    cuts = cuts.withColumn("s1", _score(a, F.col("l1"), F.col("r1"))).withColumn("s2", _score(a, F.col("l2"), F.col("r2")))
    later = F.col("s2").isNotNull() & (F.col("s2") < F.col("s1"))
    pick = lambda one, other: F.when(later, F.col(other)).otherwise(F.col(one))
    best = cuts.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    inside = frequent.filter("k = 3").select("lang", F.explode(F.array(join(1, 2), join(2, 2))).alias("phrase"), F.col("f").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < within * a)).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language of docs (lang, text).

    a, l and r count the phrase and its two parts at its weakest cut, n the
    language's words.
    """
    found = materialize(pieces(docs), "pieces")
    n_words = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    sizes = sized(materialize(found.groupBy("lang").agg(F.sum(F.col("m") * n_words).alias("n")), "sizes"))
    rows = materialize(scored(counts(found, least), within), "scored")
    # a histogram tells from which step on a language has enough phrases, so that only these are ranked
    step = F.floor(F.log2(F.col("score") + 1) * STEPS).cast("int")
    steps = rows.groupBy("lang", step.alias("step")).count()
    above = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    enough = steps.withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0))).filter(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("least_step"))
    high = rows.join(sized(materialize(enough, "steps")), "lang").filter(step >= F.col("least_step")).drop("least_step")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = high.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
