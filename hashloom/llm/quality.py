"""Quality by hierarchical empirical Bayes.

A logistic regression on a document's surface (which bytes and words it is
made of) gives its own evidence. Sites, a host and the paths below it, have
posteriors that are their documents' mean evidence, a path's shrunk toward its
host's and a host's toward the global mean by as much as sparse sites vary. A
document's odds are its own times its path's against the global odds; its own
evidence is left out of its site's.

The regression is fitted on a sample of labelled rows, LABELLED at most, taken
by a hash of the id. Everything else covers all rows.

Defined cases: a null text is empty; null site names are a site of their own;
without labels of both kinds every document's evidence is 0.5; documents below
KEEP are rejected; repeated rows are scored alike; of several labels of one id
each counts; of several texts of a labelled id one teaches; an empty table gives an empty table; score() ignores other
columns, accepted() returns them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import materialize, quoted, sized, small_batches
from .shingles import SPACED, chunks, cuts, text_bytes, words

#: Bound of the labelled sample.
LABELLED = 20_000
RIDGE = 1e-3
#: Odds below which a document is rejected.
KEEP = 0.5
#: Evidence is held within these, so that no document is beyond its site's help.
LEAST, MOST = 1e-3, 1 - 1e-3
#: Bytes of texts that are worked on at a time.
SLICE = 1 << 20
#: Bounds of the prior's weight in documents.
WEIGHT = (1.0, 1e4)

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of surface measures a text: shares of each printable byte, and of kinds of words."""
    raw, at = text_bytes(texts)
    h, w = words(texts, SPACED, fold=False)
    out = np.zeros((len(texts), 96 + 8), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        part, own = raw[a:b], h[w[i] : w[i + 1]]
        n, m = max(1, len(part)), max(1, len(own))
        count = sum((np.bincount(part[lo : lo + SLICE], minlength=256) for lo in range(0, len(part), SLICE)), np.zeros(256, np.int64))
        out[i, :96] = np.sqrt(count[32:128] / n)
        letters = count[_LETTERS].sum()
        out[i, 96:] = (
            np.sqrt(count[10] / n),
            np.sqrt(count[128:].sum() / n),
            np.log1p(len(own)) / 5,
            np.log1p(n / m) / 2,
            len(np.unique(own)) / m,
            count[65:91].sum() / max(1, letters),
            letters / n,
            1 - count[33:48].sum() / n,
        )
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1])
    keep[-1, -1] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> np.ndarray | None:
    """The weights learned from docs (doc_id, text) and labels (doc_id, quality)."""
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("y"))
    # about twice the sample passes a threshold on the hash, however many labels there are
    h = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    told = told.filter(h.cast("double") * told.select("k").distinct().count() <= float((2 * most) << 30)).orderBy(h, "k", "y").limit(most)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("k"), F.col("text").cast("string").alias("text")).join(F.broadcast(told), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", SLICE):
                x = [r.tobytes() for r in features(part.column("text"))]
                yield pa.record_batch([part.column("k"), part.column("y"), pa.array(x, pa.binary())], ["k", "y", "x"])

    # one row an id and label, so that no more than the sample comes to the driver
    told = rows.mapInArrow(run, "k long, y int, x binary").groupBy("k", "y").agg(F.min("x").alias("x"))
    got = sorted(told.collect(), key=lambda r: (r.k, r.y))
    y = np.array([float(r.y > 0) for r in got])
    if not len(got) or y.min() == y.max():
        return None
    return fit(np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), -1), y)


def evidence(docs: DataFrame, weights: np.ndarray | None, within: tuple[str, int] | None = None) -> DataFrame:
    """docs and p_doc, what its text says of each document; within names the struct and the field that hold the text, if no column does."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = batch.column("text") if within is None else pc.struct_field(batch.column(within[0]), [within[1]])
            for lo, n in cuts(texts, SLICE):
                part = batch.slice(lo, n)
                p = np.full(n, 0.5) if w is None else 1 / (1 + np.exp(-np.clip(features(texts.slice(lo, n)) @ w[:-1] + w[-1], -30, 30)))
                yield pa.record_batch([*part.columns, pa.array(np.clip(p, LEAST, MOST))], [*part.schema.names, "p_doc"])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("p_doc", DoubleType())]))


def _weight(mean: Column, spread: Column) -> Column:
    """How many documents the prior counts for, if site means around mean have this variance."""
    return F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), mean * (1 - mean) / F.greatest(spread, F.lit(1e-9)) - 1))


def sites(scored: DataFrame) -> DataFrame:
    """Of each (host, path): sums and counts of it, of its host and of all, and the priors' weights."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p_doc").alias("s_path"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    # the spread of site means, less what chance alone gives means of n documents
    total = hosts.agg(F.sum("n_host").alias("n_all"), F.sum("s_host").alias("s_all"))
    mean = F.col("s_all") / F.col("n_all")
    noise = mean * (1 - mean)
    of_hosts = hosts.join(F.broadcast(total)).groupBy("n_all", "s_all").agg((F.sum(F.col("n_host") * F.pow(F.col("s_host") / F.col("n_host") - mean, 2) - noise) / F.first("n_all")).alias("spread"))
    of_hosts = of_hosts.select("n_all", "s_all", _weight(mean, F.col("spread")).alias("w_host"))
    both = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).select(paths["*"], "n_host", "s_host")
    host_mean = F.col("s_host") / F.col("n_host")
    spread = F.sum(F.col("n_path") * F.pow(F.col("s_path") / F.col("n_path") - host_mean, 2) - host_mean * (1 - host_mean)) / F.sum("n_path")
    of_paths = both.agg(spread.alias("spread_path"))
    out = both.join(F.broadcast(of_hosts)).join(F.broadcast(of_paths))
    return out.select("host", "path", "n_path", "s_path", "n_host", "s_host", "n_all", "s_all", "w_host", _weight(mean, F.col("spread_path")).alias("w_path"))


def _odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def posterior(scored: DataFrame, keep: float = KEEP, all_scored: DataFrame | None = None) -> DataFrame:
    """scored (host, path, p_doc and more) and p_host, p_path, quality, kept; sites are those of all_scored, else of scored.

    Site tables are written, then broadcast if their size allows; else a
    shuffle join is split where a host holds many rows.
    """
    table = sized(materialize(sites(scored), "sites").withColumnRenamed("host", "h").withColumnRenamed("path", "t"))
    rows = scored.join(table, scored.host.eqNullSafe(F.col("h")) & scored.path.eqNullSafe(F.col("t")))
    mean = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("s_all") / F.col("n_all")))
    p_host = (F.col("s_host") - F.col("p_doc") + F.col("w_host") * mean) / (F.col("n_host") - 1 + F.col("w_host"))
    rows = rows.withColumn("p_host", p_host)
    p_path = (F.col("s_path") - F.col("p_doc") + F.col("w_path") * F.col("p_host")) / (F.col("n_path") - 1 + F.col("w_path"))
    rows = rows.withColumn("p_path", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), p_path)))
    odds = _odds(F.col("p_doc")) + _odds(F.col("p_path")) - _odds(mean)
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return rows.select(*[scored[c] for c in scored.columns], "p_host", "p_path", "quality", (F.col("quality") >= keep).alias("kept"))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """doc_id, host, path, p_doc, p_host, p_path, quality, kept of each row of docs."""
    weights = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    scored = materialize(evidence(rows, weights).drop("text"), "evidence")
    return posterior(scored, keep)


def accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """The rows of docs that score() keeps, all columns as they are.

    Texts are read twice, first for the sites' sums and then for the
    decision on each row, so that none of them is shuffled: a row meets only
    its site.
    """
    weights = train(docs, labels)
    site = (host.cast("string").alias("host"), path.cast("string").alias("path"))
    own = F.struct(*[(docs[c].cast("string") if c == "text" else docs[quoted(c)]).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    scored = materialize(evidence(docs.select(*site, F.col("text").cast("string").alias("text")), weights).drop("text"), "evidence")
    rows = evidence(docs.select(*site, own.alias("own")), weights, ("own", docs.columns.index("text")))
    kept = posterior(rows, keep, scored).filter("kept")
    return kept.select(*[F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
