"""A corpus from raw documents: scored, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir), where docs has the columns of
documents, and all but the last return those columns for what they keep.

Decisions are on rows, not on doc_ids: a row is known by its doc_id and its
whole text. Defined cases: rows that share a doc_id but not the text are
decided one by one; a null doc_id is an id like others, the last in order; of
rows equal in both, each dedup stage keeps one, that whose other columns sort
first; a null text is empty and, having no words, is near to nothing; texts may
be of any length; other columns are kept, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hashloom.llm import bpe, exact, mixing, neardup, quality
from hashloom.storage import materialize, quoted, sized

#: The quality model, the signatures and the vocabulary are not SQL.
ORACLE_SQL = None


def _row_key(text: Column) -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("="), text.cast("string")), F.lit("")).cast("binary"))


def _kept_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions (doc_id, row_key, kept) keep, one of those equal in id and text.

    Rows that go, and those that repeat, are narrow tables, broadcast if they
    are small.
    """
    own = F.struct(*[F.col(quoted(n)).alias(f"c{i}") for i, n in enumerate(docs.columns)])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _row_key(F.col("text")).alias("key"), own.alias("own"))
    found = decisions.select(F.col("doc_id").alias("g_id"), F.col("row_key").alias("g_key"), "kept")
    gone = sized(materialize(found.filter("NOT kept").select("g_id", "g_key").distinct(), "gone"))
    again = materialize(found.filter("kept").groupBy("g_id", "g_key").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    same = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key"))
    left = rows.join(gone, same, "left_anti")
    if not again.isEmpty():
        plain = [f"c{i}" for i, (_, t) in enumerate(docs.dtypes) if "map<" not in t and "variant" not in t]
        few = sized(again)
        least = F.min_by("own", F.struct(*[F.col("own")[c] for c in plain])).alias("own")
        left = left.join(few, same, "left_anti").unionByName(left.join(few, same, "left_semi").groupBy("id", "key").agg(least))
    return left.select(*[F.col("own")[f"c{i}"].alias(n) for i, n in enumerate(docs.columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs["source"], docs["lang"])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return _kept_rows(docs, exact.row_decisions(docs, _row_key))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id."""
    return _kept_rows(docs, neardup.row_decisions(docs, _row_key))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of their decoding."""
    done = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
