"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. A source's budget is met by all documents
whose hash is at most a threshold, found without sorting: a histogram of
words by source and hash bucket gives the bucket where the budget is reached,
and only that bucket's rows are refined. A second copy of a document is taken
by a second, nested threshold once the whole source is used.

Defined cases: null text has size 0; null source is a source of its own, the
last; a null doc_id hashes as the empty string; rows that repeat a doc_id
share a hash and go in or out together; the document at the threshold goes in
if that brings the source closer to its target; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import materialize, quoted, same, sized

HASH_BITS = 60
#: Bits that each histogram resolves: the first leaves one row in 4096 to the rest.
LEVEL_BITS = 12
WEIGHTS = (5, 2, 1)
#: The mix holds NUM/DEN of all words, and no document more than EPOCHS times.
NUM, DEN, EPOCHS = 3, 2, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits that depend on nothing but the id, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target of (source, source_size): one row a source.

    Sources take weights in turn by code point, null last. A target stops at
    EPOCHS times its source's size, and the excess is shared again by weight:
    in order of size by weight the first sources are full, and the others have
    what remains. Whole numbers until the last division, so any engine agrees.
    """
    big = lambda c: c.cast("decimal(38,0)")
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    all_rows = W.partitionBy(F.lit(0))
    ranked = ranked.select(
        "*",
        F.row_number().over(order).alias("k"),
        F.sum("source_size").over(all_rows).alias("total"),
        (F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))).alias("w_left"),
        F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full"),
    )
    # DEN times what is left to share
    left = big(F.col("total")) * NUM - big(F.col("full")) * (EPOCHS * DEN)
    fits = left * big(F.col("w")) <= big(F.col("source_size")) * (EPOCHS * DEN) * big(F.col("w_left"))
    first = F.min(F.when(fits, F.struct("k", left.alias("left"), "w_left"))).over(all_rows)
    ranked = ranked.withColumn("first", first)
    shared = (big(F.col("w")) * F.col("first.left")).cast("double") / (F.col("first.w_left") * DEN).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("k") < F.col("first.k"), (F.col("source_size") * EPOCHS).cast("double")).otherwise(shared).alias("target"))


def thresholds(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target, copies, upto of a table (source, size, h).

    A document has copies repeats, and one more if h <= upto. The targets are
    one row a source; the rows of the boundary bucket are written once and
    refined until a single hash is left.
    """
    targets = materialize(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    over = F.col("target") > F.col("source_size")
    state = targets.select(
        "source",
        "source_size",
        "target",
        over.cast("long").alias("copies"),
        (F.col("target") - F.when(over, F.col("source_size")).otherwise(0)).alias("budget"),
    )
    bound, rows = None, sizes
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if bound is not None:
            rows = rows.join(sized(bound.select(F.col("source").alias("s"), "bucket")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("bucket"))).select("source", "size", "h")
            rows = materialize(rows, "boundary")
        hist = rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
        before = F.lit(0) if bound is None else F.col("before")
        at = state if bound is None else bound.select(*state.columns, "before")
        at = at.withColumn("start", before.cast("long")).withColumnRenamed("source", "s")
        upto = F.sum("words").over(W.partitionBy("source").orderBy("b"))
        cum = hist.withColumn("upto", upto).join(sized(at), F.col("source").eqNullSafe(F.col("s")))
        cum = cum.withColumn("reached", F.col("start") + F.col("upto") >= F.col("budget"))
        # the first bucket that reaches the budget, else the last of all
        best = F.min_by(F.struct("b", "words", (F.col("start") + F.col("upto") - F.col("words")).alias("before")), F.struct(~F.col("reached"), F.when(F.col("reached"), F.col("b")).otherwise(-F.col("b"))))
        keys = ["source", "source_size", "target", "copies", "budget"]
        bound = cum.groupBy(*keys).agg(best.alias("x")).select(*keys, F.col("x.b").alias("bucket"), F.col("x.words").alias("words"), F.col("x.before").alias("before"))
        bound = materialize(bound, "bounds")
    goes_in = (F.col("before") < F.col("budget")) & (2 * (F.col("budget") - F.col("before")) >= F.col("words"))
    return bound.select("source", "source_size", "target", "copies", (F.col("bucket") - F.when(goes_in, 0).otherwise(1)).alias("upto"))


def mix(docs: DataFrame, weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(rows, limits): docs' (doc_id, source, size, h, source_size, target, repeats), and the thresholds."""
    sizes = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h"))
    sizes = materialize(sizes, "sizes")
    limits = thresholds(sizes.select("source", "size", "h"), weights)
    small = sized(limits)
    rows = sizes.join(small, same(sizes, small, "source")).select(sizes["*"], "source_size", "target", (F.col("copies") + (F.col("h") <= F.col("upto")).cast("long")).alias("repeats"))
    return rows, limits


def mixed_documents(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """docs with each row as many times as the mix takes it; texts are not shuffled."""
    _, limits = mix(docs, weights)
    small = sized(limits.select(F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies"), F.col("upto").alias("__mix_upto")))
    repeats = (F.col("__mix_copies") + (doc_hash(F.col("doc_id")) <= F.col("__mix_upto")).cast("long")).cast("int")
    names = [quoted(c) for c in docs.columns]
    out = docs.join(small, F.col("source").cast("string").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_row", F.explode(F.array_repeat(F.lit(0), repeats)))
    return out.select(*names)


