"""Each stage on what the stage before kept."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_mixing import brute as mixed
from test_neardup import brute as near


@pytest.fixture(scope="module")
def made(spark, documents, sf_dir, tmp_path_factory):
    docs, out = documents, [documents.collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_stay(made, documents):
    for rows in made[:-1]:
        assert not rows or rows[0].__fields__ == documents.columns


def test_exact(made):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in made[1]:
        least[key(r.text)] = min(r.doc_id, least.get(key(r.text), r.doc_id))
    assert sorted(r.doc_id for r in made[2]) == sorted(least.values())


def test_near(made):
    want = sorted(d for d, _, _, kept in near([(r.doc_id, r.text) for r in made[2]]) if kept)
    assert sorted(r.doc_id for r in made[3]) == want


def test_mix(made):
    want = mixed([(r.doc_id, r.text, r.source) for r in made[3]])
    have = {}
    for r in made[4]:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        have[r.doc_id] = have.get(r.doc_id, 0) + n
    assert have == {d: taken for (d, _), (_, _, _, taken) in want.items() if taken}


def test_bpe(made):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text or "" for r in made[4]}
    assert sorted(r.doc_id for r in made[5]) == sorted(r.doc_id for r in made[4])
    for r in made[5]:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rejected_by_quality(made, spark, documents, sf_dir):
    from hashloom.llm import quality

    kept = quality.score(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), documents["source"], documents["lang"]).filter("kept")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in made[1])


def test_odd_documents(spark, odd, nobody, empty, sf_dir):
    for docs in (odd.unionByName(nobody), empty):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == docs.columns
            rows = spark.createDataFrame(rows.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count() == rows.count()
    assert rows.count() == 0


def test_run_is_its_stages(spark, sf_dir, made):
    got = corpus_pipeline.run(spark, sf_dir).groupBy().agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    assert (got.n, got.t) == (len(made[5]), sum(r.n_tokens for r in made[5]))


NAMES = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row_key string, `a``b` string, __id long, p_doc double"
WORDS = " ".join(f"w{i}" for i in range(80))


def repeated():
    """Ids repeated over different texts, repeated rows, null ids, and columns named like the stages' own."""
    texts = [(3, "B b"), (9, "A a"), (9, "B b"), (9, "B  b"), (5, "A a"), (5, "A a"), (5, "C c"), (None, "C c"), (None, "D d"), (None, "D d"), (None, None), (7, None), (7, "")]
    texts += [(20, WORDS), (20, WORDS + " x"), (20, "another text with enough words of its own to count"), (21, WORDS + " y"), (None, WORDS + " z"), (22, WORDS + " x"), (22, WORDS + " x")]
    return [(d, t, "en", "a", i % 4, True, "k", f"c{i % 3}", 4, 0.5) for i, (d, t) in enumerate(texts)]


def order(r):
    return (r[0] is None, r[0] or 0, hashlib.md5(("" if r[1] is None else "=" + r[1]).encode()).hexdigest())


def test_exact_loses_no_text_when_ids_repeat(spark, sf_dir):
    rows = repeated()
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    got = corpus_pipeline.exact_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        best[k] = min(best.get(k, r), r, key=order)
    assert sorted((r[:2] for r in map(tuple, got.collect())), key=str) == sorted((r[:2] for r in best.values()), key=str)


def test_near_loses_no_text_when_ids_repeat(spark, sf_dir):
    rows = repeated()
    docs = spark.createDataFrame(rows, NAMES).repartition(3)
    got = corpus_pipeline.minhash_near_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    own = sorted({r[:2] for r in rows}, key=order)
    want = [own[i] for i, _, _, kept in near([(i, t) for i, (_, t) in enumerate(own)]) if kept]
    assert sorted((r[:2] for r in map(tuple, got.collect())), key=str) == sorted(want, key=str)


def test_of_equal_rows_the_first_by_the_other_columns_stays(spark, sf_dir):
    rows = [(1, "same", "en", s, 4, True, "k", c, 4, 0.5) for s, c in (("b", "y"), ("a", "z"), ("a", "x"))]
    got = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(rows, NAMES), sf_dir).collect()
    assert [(r.source, r["a`b"]) for r in got] == [("a", "x")]


def test_quality_and_mix_with_clashing_names(spark, sf_dir):
    docs = spark.createDataFrame(repeated(), NAMES)
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.source_mixing):
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_quality_by_brute_force(made, documents, spark, sf_dir):
    """The stage against plain sums over all rows."""
    import numpy as np
    from plain_newton import newton
    from test_quality import brute, features

    from hashloom.llm import quality

    rows = [(r.doc_id, r.source, r.lang, r.text or "") for r in made[0]]
    text = {d: t for d, _, _, t in rows}
    told = sorted((r.doc_id, int(r.quality)) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.doc_id in text)
    x, y = np.array([features(text[d]) for d, _ in told]), np.array([float(q > 0) for _, q in told])
    w = newton(x, y, quality.RIDGE * len(x))
    p_of = {t: min(1 - 1e-3, max(1e-3, 1 / (1 + np.exp(-(np.array(features(t)) @ w[:-1] + w[-1]))))) for t in text.values()}
    odds = dict(zip(text, (q for _, _, q in brute([(h, q, t) for _, h, q, t in rows], p_of)), strict=True))
    kept = {r.doc_id for r in made[1]}
    assert all((d in kept) == (q >= quality.KEEP) for d, q in odds.items() if abs(q - quality.KEEP) > 5e-3)
