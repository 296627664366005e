"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidates.

Signatures only propose pairs; a link is confirmed on the documents' full
shingle sets. Documents with the same set are one node from the start. In
each bucket one node, the one with most company, is the star's centre, and
only its pairs are tried. The nodes of buckets that then hold several
components meet again under the rarest of their shingles, which similar sets
must share and nodes with a common passage do not, and around more and more
centres, until all pairs there that are not yet connected have been tried:
stars save pairs, but lose no link. Shingles that stand in the same nodes count
once. Maps of parities as large as the sets, which tell how many hashes two
sets differ in at least, keep most pairs that just miss the threshold from
being tried at all.

Defined cases: null and empty texts, and texts without words, have no
shingles and are linked with nothing; a text of fewer than five words has one
shingle, its whole sequence; rows that repeat a doc_id share its class (the
smallest doc_id reachable from any of them); a null doc_id is linked with
nothing and its component is null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.components import connected_components
from ..storage import materialize, sized, small_batches, tidy
from .shingles import SPACED, chunks, mix64, shingles, words

SHINGLE = 5
#: Links have NUM * intersection >= least * union; DEN is least unless told otherwise.
NUM, DEN = 100, 85
#: A pair at the threshold misses all bands with a chance of about (1 - 0.85 ** ROWS) ** BANDS = 2e-8, at 0.8 of 7e-6.
BANDS, ROWS = 30, 5
BINS = BANDS * ROWS
#: Words of 64 bits that a set's small parity map has; the large one has about a bit a hash.
PARITY_WORDS = 16
#: How many centres a key has in the first retry.
FIRST = 8
#: A node with more pairs than this meets them in several tasks.
CROWD = 2000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = words(texts, SPACED)
    g, off = shingles(h, at, SHINGLE)
    return [np.unique(g[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


@lru_cache(1)
def _probes() -> np.ndarray:
    """For each bin all bins in an order of its own: where an empty bin looks for its value."""
    return np.argsort(mix64(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1, kind="stable")


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation MinHash with optimal densification: a row of BINS values a set.

    The hash range is cut into BINS bins, and a bin's value is its smallest
    hash. An empty bin takes the value of the first non-empty bin in its own
    order of probes, the same for all documents. Sets are not empty.
    """
    out = np.zeros((len(sets), BINS), np.uint64)
    for r, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        out[r, bins[first]] = s[first] | np.uint64(1)
    full, probes = out != 0, _probes()
    row, col = np.nonzero(~full)
    for attempt in range(BINS):
        if not len(row):
            break
        at = probes[col, attempt]
        hit = full[row, at]
        out[row[hit], col[hit]] = mix64(out[row[hit], at[hit]] + np.uint64(attempt))
        row, col = row[~hit], col[~hit]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A bucket key for each band; the band's number is part of it."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    acc = np.broadcast_to(mix64(np.arange(7, 7 + BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(ROWS):
        acc = mix64(acc + parts[:, :, r])
    return acc.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = bands(signatures([sets[i] for i in full])) if full else np.zeros((0, BANDS), np.int64)
            own = np.zeros(len(sets) + 1, np.int32)
            own[[i + 1 for i in full]] = BANDS
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    part.column("row_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.cumsum(own, dtype=np.int32), keys.ravel()),
                ],
                ["doc_id", "row_key", "n_shingles", "set_id", "keys"],
            )


def parities(s: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """A bit for each of 64 * words places: whether an odd number of s's hashes fall there.

    Two sets' maps differ in at most as many bits as the sets in hashes, so a
    pair whose maps differ in more bits than a link allows is no link. The
    halves of a map, combined by exclusive or, are the map of half the words.
    """
    places = (s >> np.uint64(32)).astype(np.int64) % (64 * words)
    return np.packbits(np.bincount(places, minlength=64 * words) & 1 != 0).view(np.int64)


def map_words(n: int) -> int:
    """The words of the large map of n hashes: a power of two, a bit a hash or more."""
    return max(PARITY_WORDS, 1 << (-(-n // 64) - 1).bit_length())


def may_link(a: Column, b: Column, size: Column, least: int = DEN) -> Column:
    """Whether sets with these parity maps, of size hashes together, can be similar enough; never false of a link."""
    bits = reduce(lambda x, y: x + y, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_WORDS)))
    return bits * (NUM + least) <= (NUM - least) * size


def may_link_large(a: Column, b: Column, size: Column, least: int = DEN) -> Column:
    """may_link() of large maps; maps of which one is more than twice the other deny nothing."""
    words = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) == words, x).otherwise(F.zip_with(F.slice(x, 1, words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q)))
    bits = F.aggregate(F.zip_with(fold(a), fold(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    return (F.greatest(F.size(a), F.size(b)) > 2 * words) | (bits * (NUM + least) <= (NUM - least) * size)


LISTED = "node long, n long, grams array<long>, odd array<long>, odd_large array<long>"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = shingle_sets(part.column("text"))
            at = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            grams = pa.ListArray.from_arrays(at, np.concatenate(sets).view(np.int64))
            small = pa.array([parities(s) for s in sets], pa.list_(pa.int64()))
            large = pa.array([parities(s, map_words(len(s))) if map_words(len(s)) > PARITY_WORDS else None for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([part.column("node"), pa.array(np.diff(at), pa.int64()), grams, small, large], [x.split()[0] for x in LISTED.split(", ")])


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _crowds(pairs: DataFrame) -> dict[str, DataFrame]:
    """By side, (side, copies) of the nodes with so many pairs that they are met in several tasks; pairs are a materialized table."""
    if pairs.count() <= CROWD:
        return {}
    ends = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("node")), F.struct(F.lit("b").alias("side"), F.col("b").alias("node")))).alias("x"))
    many = ends.groupBy("x.side", "x.node").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD)
    many = materialize(many.select("side", "node", F.ceil(F.col("m") / CROWD).cast("int").alias("copies")), "crowds")
    if many.isEmpty():
        return {}
    return {side: sized(materialize(many.filter(F.col("side") == side).select(F.col("node").alias(side), "copies"), "crowd")) for side in "ab"}


def _met(rows: DataFrame, side: str, sets: DataFrame, crowd: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows (a, b, ...) joined with sets by the node on one side, those of a crowd over several keys."""
    sets = sets.withColumnRenamed("node", side)
    if crowd is None:
        return rows.join(sets, side, how)
    other = "b" if side == "a" else "a"
    salted = rows.join(crowd, side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("copies")).cast("int"), F.lit(0))).drop("copies")
    copied = sets.join(crowd, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return salted.join(copied, [side, "salt"], how).drop("salt")


def confirm(pairs: DataFrame, sets: DataFrame, least: int = DEN) -> DataFrame:
    """Those of pairs (a, b), a materialized table, whose sets (node, grams) are similar enough."""
    crowds = _crowds(pairs)
    both = _met(pairs, "a", sets.select("node", F.col("grams").alias("ga")), crowds.get("a"))
    both = _met(both, "b", sets.select("node", F.col("grams").alias("gb")), crowds.get("b"))
    both = both.withColumn("i", F.size(F.array_intersect("ga", "gb")).cast("long"))
    return both.filter(F.col("i") * NUM >= least * (F.size("ga") + F.size("gb") - F.col("i"))).select("a", "b")


def sift(pairs: DataFrame, large: DataFrame, least: int = DEN) -> DataFrame:
    """Those of pairs (a, b), a materialized table, that the large maps (node, n, odd_large) do not deny."""
    crowds = _crowds(pairs)
    both = _met(pairs, "a", large.select("node", F.col("n").alias("na"), F.col("odd_large").alias("ma")), crowds.get("a"), "left")
    both = _met(both, "b", large.select("node", F.col("n").alias("nb"), F.col("odd_large").alias("mb")), crowds.get("b"), "left")
    may = F.col("ma").isNull() | F.col("mb").isNull() | may_link_large(F.col("ma"), F.col("mb"), F.col("na") + F.col("nb"), least)
    return materialize(both.filter(may).select("a", "b"), "sifted")


def prefixes(members: DataFrame, sets: DataFrame, least: int = DEN) -> DataFrame:
    """(key, node, n, c, odd): each node under the rarest of its shingles, so that similar nodes share a key.

    Of two similar sets each has a shared shingle among its n - least/NUM n + 1
    rarest. Shingles of one node alone are rarest and lead nowhere, so a node
    with many of them has few keys or none; c counts its other shingles, the
    most it can share with any node. Of keys with the same nodes one is enough:
    a common passage is a few keys, however long it is.
    """
    nodes = materialize(members.select("node").distinct(), "nodes")
    rows = sets.join(sized(nodes), "node", "left_semi").select("node", "n", F.explode("grams").alias("key"))
    df = rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    rows = rows.join(df, "key")
    rows = rows.withColumn("c", F.count("*").over(W.partitionBy("node"))).withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("df", "key")))
    most = F.floor(F.col("n") * (NUM - least) / NUM) + 1 - (F.col("n") - F.col("c"))
    rows = materialize(rows.filter(F.col("at") <= most).select("key", "node", "n", "c"), "prefixes")
    # 128 bits and a count stand for a key's nodes
    told = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("m"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    one = told.filter("size > 1").groupBy("size", "h1", "h2", "m").agg(F.min("key").alias("key")).select("key", "m")
    rows = rows.join(one, "key")
    # a node may be too poor in shared shingles for even the smallest node of a key
    rows = rows.filter(F.col("c") * (NUM + least) >= least * (F.col("n") + F.greatest("m", F.ceil(F.col("n") * least / NUM))))
    return materialize(rows.drop("m").join(sets.select("node", "odd"), "node"), "postings")


def links(members: DataFrame, sets: DataFrame, least: int = DEN) -> tuple[DataFrame, DataFrame]:
    """(links, parts): confirmed links (a, b) that connect all similar nodes of members, and their components (node, part).

    members are the nodes of each bucket (key, node, n); every bucket has two
    at least. A bucket's star comes first. The nodes of buckets that hold
    several components then meet again under the rarest of their shingles,
    where nodes that merely share a passage are apart, around more and more
    centres, which a hash of the node chooses.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("size"))
    company = members.join(counts, "key").groupBy("node").agg(F.sum("size").alias("company"))
    ranked = materialize(members.join(company, "node").withColumn("rank", F.struct((-F.col("company")).alias("c"), F.col("node").alias("id"))).drop("company"), "ranked")
    near = (F.least("n", "cn") * NUM >= F.greatest("n", "cn") * least) & (F.col("node") != F.col("centre"))
    first = ranked.groupBy("key").agg(F.min_by(F.struct("node", "n"), "rank").alias("x")).select("key", F.col("x.node").alias("centre"), F.col("x.n").alias("cn"))
    tried = materialize(ranked.join(first, "key").filter(near).select(*_pair("node", "centre")).distinct(), "pairs")
    large = sets.filter("odd_large IS NOT NULL")
    none_large = large.isEmpty()
    found = materialize(confirm(tried if none_large else sift(tried, large, least), sets, least), "links")
    parts = materialize(_parts(found), "parts")
    rows = _open(ranked, parts).select("key", "node", "n")
    if rows.isEmpty():
        return found, parts
    rows = prefixes(rows, sets, least)
    near = near & (F.least("c", "cc") * (NUM + least) >= least * (F.col("n") + F.col("cn"))) & may_link(F.col("odd"), F.col("codd"), F.col("n") + F.col("cn"), least)
    centres, left = FIRST, None
    while True:
        if left is None:
            left = materialize(_open(rows, parts), "open")
            sizes = materialize(left.groupBy("key").agg(F.count("*").alias("size")), "sizes")
            largest = sizes.agg(F.max("size")).first()[0] or 0
            if not largest:
                return found, parts
        chance = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) * F.col("size") < F.lit(centres << 30)
        best = left.join(sizes, "key").filter((F.col("size") <= centres) | chance)
        best = best.select("key", F.col("node").alias("centre"), F.col("n").alias("cn"), F.col("c").alias("cc"), F.col("odd").alias("codd"), F.col("part").alias("cpart"))
        more = left.join(best, "key").filter((F.col("part") != F.col("cpart")) & near).select(*_pair("node", "centre")).distinct()
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = more if none_large else sift(more, large, least)
        new = materialize(confirm(more, sets, least), "links")
        if not new.isEmpty():
            found = found.union(new)
            parts = materialize(_parts(found), "parts")
        if largest <= centres:  # every node was a centre, so all pairs of different parts have been tried
            return found, parts
        tried = tried.union(more)
        if new.isEmpty():
            centres *= 8
        else:
            left = None


def _parts(found: DataFrame) -> DataFrame:
    return connected_components(found).withColumnRenamed("component", "part")


def _open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows and part, of those keys whose nodes are in several components."""
    parted = rows.join(sized(parts), "node", "left").withColumn("part", F.coalesce("part", "node"))
    split = parted.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("key")
    return parted.join(split, "key", "left_semi")


def _classes(docs: DataFrame, least: int, row_key: Column, by_row: bool) -> DataFrame:
    """doc_id, row_key, n_shingles, class_id, class_key of each row: the smallest row of its class, null without shingles.

    By row, rows with one doc_id but different sets are apart and null ids
    are ids, the last ones; else an id joins its rows' sets, and a null id
    is linked with nothing.
    """
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key.alias("row_key"), F.col("text").cast("string").alias("text"))
    signed = materialize(base.mapInArrow(_signed, "doc_id long, row_key string, n_shingles long, set_id binary, keys array<long>"), "signed")
    own = signed.filter("set_id IS NOT NULL" if by_row else "set_id IS NOT NULL AND doc_id IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    nodes = own.groupBy("set_id").agg(F.min(row).alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = materialize(rows.join(full, "key", "left_semi"), "members")
    in_company = nodes.select("node", "least").join(members.select("node").distinct(), "node", "left_semi")
    wanted = sized(materialize(in_company.select("node", F.col("least.id").alias("w_id"), F.col("least.key").alias("w_key")), "wanted"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_key") == F.col("w_key"))).select("node", "text")
    sets = materialize(texts.mapInArrow(_listed, LISTED), "sets")
    again = materialize(sets.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1").drop("m"), "again")
    if not again.isEmpty():  # rows that are equal in id and text
        few = sized(again)
        sets = materialize(sets.join(few, "node", "left_anti").unionByName(sets.join(few, "node", "left_semi").dropDuplicates(["node"])), "sets")
    found, parts = links(members, sets, least)
    if not by_row:  # an id that repeats with other texts joins their nodes
        h = F.xxhash64("set_id")
        several = materialize(own.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("doc_id"), "several")
        if not several.isEmpty():
            of = materialize(own.join(sized(several), "doc_id", "left_semi").select("doc_id", "set_id").distinct().join(nodes.select("set_id", "node"), "set_id"), "of")
            joins = of.join(of.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
            parts = materialize(_parts(found.union(joins)), "parts")
    classes = nodes.join(sized(parts), "node", "left").filter("part IS NOT NULL OR rows > 1").select("set_id", "least", F.coalesce("part", "node").alias("part"))
    classes = materialize(classes, "classes")
    heads = sized(materialize(classes.groupBy("part").agg(F.min("least").alias("head")), "heads"))
    classes = sized(materialize(classes.join(heads, "part").select("set_id", "head"), "classes"))
    rows = signed.select("doc_id", "row_key", "n_shingles", "set_id").join(classes, "set_id", "left")
    joined = F.lit(True) if by_row else F.col("doc_id").isNotNull()
    alone = F.when(F.col("set_id").isNotNull() & joined, row)
    return rows.withColumn("head", F.when(joined, F.coalesce("head", alone))).select("doc_id", "row_key", "n_shingles", F.col("head.id").alias("class_id"), F.col("head.key").alias("class_key"))


@tidy("near-duplicates")
def near_duplicates(docs: DataFrame, least: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs; links are least hundredths similar or more."""
    rows = _classes(docs, least, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), False)
    component = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@tidy("near-decisions")
def row_decisions(docs: DataFrame, key: Callable[[Column], Column], least: int = DEN) -> DataFrame:
    """doc_id, row_key, kept of each row of docs, where key tells apart texts of one doc_id: one (doc_id, row_key) of a class is kept."""
    rows = _classes(docs, least, key(F.col("text")), True)
    kept = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row_key") == F.col("class_key")))
    return rows.select("doc_id", "row_key", kept.alias("kept"))
