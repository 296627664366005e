"""Toxicity on held-out documents, and the effect of swapped names."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hashloom.llm import shingles, toxicity
from hashloom.llm.queries import QUERIES

PLAIN = "the river ran past old mills and quiet houses where children played until evening came".split()


def sentence(rng, *more):
    own = [rng.choice(PLAIN) for _ in range(12)] + list(more)
    rng.shuffle(own)
    return " ".join(own) + "."


@pytest.fixture(scope="module")
def biased(spark):
    """Labelled texts where women, by chance of the sample, are named in toxic texts mostly."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        name = [rng.choice(["women", "men"])] if bad and i % 8 else []
        name = ["women"] if bad and i % 3 else name
        insult = [rng.choice(["idiot", "moron", "scum"])] if bad and i % 16 else []
        rows.append((i, sentence(rng, *name, *insult), int(bad)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, y string")
    return docs, spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id long, toxic int")


def test_swaps():
    found = toxicity.swaps("the women and the muslims")
    assert found[0] == "the people and the people" and found[1] == "the men and the christians" and len(found) == 3
    assert toxicity.swaps("nobody is named") == []
    assert all(w not in row[:1] for row in toxicity.GROUPS for w in row[1:])


def test_mentions_alone_are_not_toxic(spark, biased):
    neutral = pa.array(["the women came past old houses until evening.", "women played where the river ran."])
    other = pa.array(["the people came past old houses until evening.", "people played where the river ran."])
    toxic = pa.array(["the old idiot came past the mills.", "scum played where the river ran."])
    loose, held = toxicity.train(*biased, swapped=0.0), toxicity.train(*biased)
    gap = lambda m: np.abs(m.logits(neutral) - m.logits(other)).max()
    assert gap(loose) > 2 > 0.5 > gap(held)
    assert (loose.logits(neutral) > 0).any() and (held.logits(neutral) < 0).all() and (held.logits(toxic) > 0).all()


def test_the_same_model_in_every_run(biased):
    a, b = toxicity.train(*biased), toxicity.train(biased[0].repartition(5), biased[1].repartition(3))
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights, atol=1e-6)


def test_fit_against_gradient_descent():
    rng = np.random.default_rng(1)
    x, d = rng.random((60, 5)), rng.random((9, 5)) - 0.5
    y = (x[:, 0] + 0.3 * rng.random(60) > 0.7).astype(float)
    sparse = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
    got = toxicity.fit(5, *sparse(x), y, *sparse(d), ridge=0.01, swapped=0.5)
    w = np.zeros(6)
    for _ in range(60_000):
        z = 1 / (1 + np.exp(-(x @ w[:5] + w[5])))
        w -= 0.3 * np.append(x.T @ (z - y) / 60 + 0.01 * w[:5] + d.T @ (d @ w[:5]) / 9, np.mean(z - y))
    assert np.allclose(got, w, atol=2e-2)


def test_beginnings_of_words():
    h, size, at = shingles.words(pa.array(["Abcdef abc", None, "é"]), shingles.ALNUM, True, (2, 4))
    alone = lambda t: shingles.words(pa.array([t]), shingles.ALNUM)[0][0]
    assert h[0].tolist() == [alone("abcdef"), alone("abc"), alone("é")] and at.tolist() == [0, 2, 2, 3] and size.tolist() == [6, 3, 2]
    assert h[1].tolist()[:2] == [alone("ab")] * 2 and h[2].tolist() == [alone("abcd"), alone("abc"), alone("é")]


def test_odd_rows(spark, odd, empty, nobody, biased):
    model = toxicity.train(*biased)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = 1 / (1 + np.exp(-model.weights[-1]))
    assert all(abs(r.score - none) < 1e-12 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.score(empty, model).collect() == [] and toxicity.score(nobody, model).count() == 1


def test_labels_of_one_kind(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (6, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, labels)).collect()} == {1.0}
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect()} == {0.0}
    assert toxicity.train(empty, labels).logits(pa.array(["a"]))[0] < -700


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = QUERIES["op13_toxicity"](spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    told = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    caught, wrong = [p for t, p in told if t], [p for t, p in told if not t]
    assert sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.01
