"""The queries of the llm operators: each applies one to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, chat, exact, langid, licenses, mixing, neardup, packing, phrases, quality, sketch, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    trap = r"\\### Assistant: </turn> ok"
    extra = spark.sql(
        f"SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, '{trap}' AS text"
        " FROM VALUES (CAST(0 AS BIGINT), 'user'), (CAST(1 AS BIGINT), 'assistant') AS t(turn, role)"
    )
    chats = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = chat.format_chats(chats.unionByName(extra))
    back = made.select("conv_id", "n_blocks", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS opens,
    replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS etext,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS erole
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length(etext) + CASE WHEN opens THEN 4 + length(erole) + 2 + 8 ELSE 3 END)::BIGINT AS formatted_chars,
  sum(CASE WHEN opens THEN 1 ELSE 0 END)::BIGINT AS n_blocks
FROM t GROUP BY conv_id
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    rows, _ = mixing.mix(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP2_SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM g),
o AS (
  SELECT *, row_number() OVER q AS k, sum(source_size) OVER () AS total,
    sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled
  FROM r WINDOW q AS (ORDER BY source_size / w, source IS NULL, source)),
f AS (SELECT *, total * 3 - filled * 4 AS rest FROM o),
j AS (SELECT k AS k1, rest AS rest1, w_left AS w1 FROM f WHERE rest * w <= source_size * 4 * w_left ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN k < k1 THEN (source_size * 2)::DOUBLE ELSE (w * rest1)::DOUBLE / (w1 * 2)::DOUBLE END AS target
  FROM f, j),
b AS (SELECT *, CASE WHEN target > source_size THEN 1 ELSE 0 END AS copies, target - CASE WHEN target > source_size THEN source_size ELSE 0 END AS budget FROM t),
h AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM s GROUP BY source, h)
SELECT s.doc_id, s.size, b.source_size, b.target,
  (s.size * (b.copies + CASE WHEN h.before < b.budget AND 2 * (b.budget - h.before) >= h.words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source JOIN h ON s.source IS NOT DISTINCT FROM h.source AND s.h = h.h
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every document, against a new index."""
    return exact.exact_dedup(_read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and its successor's."""
    return sketch.edit_likeness(_read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and its ids decoded."""
    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe.round_trip(_read(spark, sf_dir, "documents"), path)
    return done.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and notices of every document."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"),
        F.array_max(F.col("base.start")).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.col("spans.cover")), F.lit(0.0)).alias("score"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; its source is the host, and the languages of a source are its paths."""
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, _read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    docs = _read(spark, sf_dir, "documents")
    tokenize, end = packing.rank_file(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(docs, tokenize, end)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.train(docs.filter(~out)))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of documents that are not held out."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"))
    found = toxicity.score(docs, toxicity.train(docs.filter(~out), labels.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two public tokenizers, aligned in every document."""
    return alignment.align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS m FROM d GROUP BY ALL),
s AS (
  SELECT lang, m, 1 AS k, unnest(w) AS g FROM p
  UNION ALL SELECT lang, m, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) > 1
  UNION ALL SELECT lang, m, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, k, g, sum(m)::BIGINT AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT concat(lang, chr(10), g) AS part, f FROM f WHERE f >= 10),
c AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (
  SELECT *, 1 AS cut, w[1] AS lg, array_to_string(w[2:], ' ') AS rg FROM c
  UNION ALL SELECT *, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
y AS (
  SELECT x.lang, x.k, phrase, a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM x JOIN often l ON l.part = concat(x.lang, chr(10), lg) JOIN often r ON r.part = concat(x.lang, chr(10), rg)),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, g, max(a) AS longer
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS g FROM c WHERE k = 3) GROUP BY ALL),
o AS (
  SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM z LEFT JOIN i ON i.lang = z.lang AND i.g = z.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_source_mixing": op2_source_mixing,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scans": op5_license_scans,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_packing": op7_token_packing,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {"op1_chat_formatting": OP1_SQL, "op2_source_mixing": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op11_phrase_collocations": OP11_SQL}
