"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

Defined cases: a null text counts as empty, so null and empty texts form one
group; within a batch the smallest doc_id of equal texts stays (a null doc_id
only where the group has no other); against earlier batches the row indexed
first stays, and group_size counts the rows of all batches so far, of batches
of one name those that were added first; rows that
repeat a doc_id share its decision and count in group_size; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import check_warehouse, discard, materialize

#: A digest is hot if it holds this share of a batch's rows: at most HOT of them exist.
HOT = 1000
#: Batches in which documents go into an index of their own.
BATCHES = 3


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class DigestIndex:
    """A table (text_sha256, keep_id, keep_key, n, first, batch), bucketed and sorted by text_sha256.

    It lies in the warehouse, which all executors share. A batch is
    aggregated to one row a digest before it is shuffled and compared with the
    index by a sort-merge anti-join that reads the index without an exchange.
    What is new is appended with the row that stays (first); of digests that
    the index has, the batch's count is appended, so that sizes are sums over
    batches. A batch has a name, and of a digest the index takes one row of a
    batch: a batch that is added again, after it was added wholly or in part,
    changes nothing that was there. A new index has as many buckets as the
    session shuffles into, unless told otherwise; about 128 MB each is best.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        check_warehouse(spark)
        self.spark = spark
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT, keep_key STRING, n BIGINT, first BOOLEAN, batch STRING)"
            f" USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS"
        )
        told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        self.buckets = int(told["Num Buckets"])

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def table(self) -> DataFrame:
        """text_sha256, keep_id, keep_key, group_size: one row a digest; nothing is shuffled."""
        return _summed(self.rows())

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the digests (doc_id, row_key, text_sha256) of a batch; returns its groups (text_sha256, keep_id, keep_key, n)."""
        batch = batch or uuid.uuid4().hex
        least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row_key").alias("key")))
        # written, as the optimizer would push the anti-join below the aggregate, and shuffle every row
        groups = materialize(digests.groupBy("text_sha256").agg(least.alias("x"), F.count("*").alias("n")).select("text_sha256", F.col("x.id").alias("keep_id"), F.col("x.key").alias("keep_key"), "n"), "groups")
        new = groups.withColumn("first", F.lit(True))
        if not self.rows().isEmpty():
            there = lambda f: self.rows().filter(f).select("text_sha256").hint("merge")
            rest = groups.join(there(F.col("batch") == batch), "text_sha256", "left_anti")
            new = rest.join(there("first"), "text_sha256", "left_anti").withColumn("first", F.lit(True))
            new = new.unionByName(rest.join(there("first"), "text_sha256", "left_semi").withColumn("first", F.lit(False)))
        new = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "text_sha256")
        new.select("text_sha256", "keep_id", "keep_key", "n", "first", "batch").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return groups

    def decide(self, digests: DataFrame, groups: DataFrame) -> DataFrame:
        """doc_id, row_key, keep_id, keep_key, group_size, text_sha256 of rows that were added, whose groups are these.

        Rows of the groups' hot digests, at most HOT of them, are answered by
        a broadcast; the others meet the index in a sort-merge join, where no
        key is large.
        """
        total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = F.broadcast(groups.groupBy("text_sha256").agg(F.sum("n").alias("n")).filter(F.col("n") * HOT >= F.lit(total)).select("text_sha256") if total > HOT else groups.limit(0).select("text_sha256"))
        cold = digests.join(hot, "text_sha256", "left_anti").join(self.table().hint("merge"), "text_sha256")
        rows = digests.join(F.broadcast(_summed(self.rows().join(hot, "text_sha256", "left_semi"))), "text_sha256").unionByName(cold)
        return rows.select("doc_id", "row_key", "keep_id", "keep_key", "group_size", "text_sha256")


def _summed(rows: DataFrame) -> DataFrame:
    keep = F.max(F.when(F.col("first"), F.struct("keep_id", "keep_key"))).alias("x")
    rows = rows.groupBy("text_sha256", "batch").agg(keep, F.max("n").alias("n"))
    return rows.groupBy("text_sha256").agg(F.max("x").alias("x"), F.sum("n").alias("group_size")).select("text_sha256", F.col("x.keep_id").alias("keep_id"), F.col("x.keep_key").alias("keep_key"), "group_size")


def _digests(docs: DataFrame, key: Callable[[Column], Column] | None) -> DataFrame:
    row_key = key(F.col("text")) if key else F.lit("")
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key.alias("row_key"), F.sha2(normalized(F.col("text")), 256).alias("text_sha256")), "digests")


def _by_ranges(digests: DataFrame) -> list[DataFrame]:
    """digests in BATCHES parts by ascending ids, rows without an id last."""
    cuts = digests.approxQuantile("doc_id", [k / BATCHES for k in range(1, BATCHES)], 0.01) if BATCHES > 1 else []
    bounds = sorted({int(c) for c in cuts})
    if not bounds:
        return [digests]
    i = F.col("doc_id")
    return [digests.filter(i < bounds[0]), *(digests.filter((i >= lo) & (i < hi)) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)), digests.filter(i.isNull() | (i >= bounds[-1]))]


def _decided(docs: DataFrame, index: DigestIndex | None, key: Callable[[Column], Column] | None, batch: str | None = None) -> DataFrame:
    digests = _digests(docs, key)
    if index is not None:
        return index.decide(digests, index.add(digests, batch))
    own = DigestIndex(docs.sparkSession)  # for this call alone
    try:
        parts = [own.add(part, str(k)) for k, part in enumerate(_by_ranges(digests))]
        found = materialize(own.decide(digests, reduce(DataFrame.unionByName, parts)), "decided")
        discard(digests, *parts)
        return found
    finally:
        own.drop()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs, added to an index as a batch.

    Without an index docs go into a new one, in batches by ascending ids, each
    of which meets what the ones before have left.
    """
    found = _decided(docs, index, None, batch)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def row_decisions(docs: DataFrame, key: Callable[[Column], Column], index: DigestIndex | None = None) -> DataFrame:
    """doc_id, row_key, kept of each row of docs, where key tells apart texts of one doc_id: one (doc_id, row_key) of a group is kept."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_key") == F.col("keep_key"))
    return _decided(docs, index, key).select("doc_id", "row_key", kept.alias("kept"))
