"""Fingerprints against exact shingle sets."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from hashloom.llm import sketch


def grams(t, k=5):
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def followed(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    return [(d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows)]


def edit(t, f):
    n = len(t) // 3
    return t[: len(t) - n] + f[:n]


@pytest.mark.parametrize("parts", ["1", "4", "7"])
def test_documents(spark, documents, texts, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r.doc_id: r for r in sketch.edit_likeness(documents.repartition(5)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(texts)
    error = []
    for d, t, f in followed(list(texts.items())):
        r, e = got[d], edit(t, f)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (sketch.from_string(sketch.to_string(s)) for s in sketch.sketches(pa.array([t, e, f])))
        assert (r.fingerprint, r.edited_fingerprint) == (sketch.to_string(a), sketch.to_string(b))
        assert r.near_edited == sketch.resemblance(a, b, t == e) and r.near_next == sketch.resemblance(a, c, t == f)
        A, B = grams(t), grams(e)
        if len(A) > 400:
            error += [r.near_edited - len(A & B) / len(A | B), r.contained_edited - len(A & B) / len(A)]
    assert np.abs(error).mean() < 0.06 and np.abs(np.mean(error)) < 0.02


def test_containment_of_very_unequal_texts_and_merging():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 60_000)]
    part, whole = " ".join(words[10_000:11_500]), " ".join(words)
    a, b, left, right = sketch.sketches(pa.array([part, whole, " ".join(words[:30_000]), " ".join(words[29_996:])]))
    assert sketch.containment(a, b) == 1.0 and sketch.resemblance(a, b) < 0.05
    assert np.array_equal(sketch.merge(left, right), b)
    assert abs(len(b) * sketch.FRACTION / 59_996 - 1) < 0.05


def test_odd(odd, nobody, spark):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = sketch.edit_likeness(odd).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    by = dict(rows)
    last = min(by)
    for r in got:
        if r.doc_id == last:
            assert r.edited_sha256 == hashlib.sha256(edit(by[last], by[max(by)]).encode()).hexdigest()
    assert sketch.edit_likeness(odd.unionByName(nobody)).count() == len(rows) + 1
    one = sketch.edit_likeness(spark.createDataFrame([(3, "abc")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(3, 1.0)]


def test_empty(empty):
    assert sketch.edit_likeness(empty).count() == 0 and sketch.fingerprints(empty).count() == 0


def test_short_texts_have_fingerprints(spark, documents, texts):
    def likeness(a, b):
        return len(a & b) / len(a | b)

    for r in sketch.edit_likeness(documents).collect():
        assert bool(r.fingerprint) == bool(grams(texts[r.doc_id]))
    # over all lengths: unbiased, and with the error that so many hashes allow
    rng, error = np.random.default_rng(9), {5: [], 50: [], 500: []}
    for n, own in error.items():
        for _ in range(300):
            words = [f"w{i}" for i in rng.integers(0, 10**6, n + 4)]
            other = words[: 2 * n // 3] + [f"v{i}" for i in rng.integers(0, 10**6, n // 3)]
            a, b = sketch.sketches(pa.array([" ".join(words), " ".join(other)]))
            assert len(a) and len(b)
            own.append(sketch.resemblance(a, b) - likeness(grams(" ".join(words)), grams(" ".join(other))))
    assert all(abs(np.mean(e)) < 0.06 for e in error.values())
    assert np.abs(error[50]).mean() < 0.15 and np.abs(error[500]).mean() < 0.05


def test_merging_keeps_the_rule_of_the_smallest_hash():
    rng = np.random.default_rng(3)
    for _ in range(200):
        parts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, rng.integers(1, 9))) for _ in range(2)]
        a, b = sketch.sketches(pa.array(parts))
        h = [np.unique(np.concatenate([s for s in sketch.sketches(pa.array([p]), fraction=1)])) for p in parts]
        both = np.union1d(*h)
        below = both[both <= sketch._threshold(sketch.FRACTION)]
        assert np.array_equal(sketch.merge(a, b), below if len(below) else both[:1])


def test_null_and_repeated_ids_are_dealt_over_ranges(spark):
    rows = [(None if i % 2 else 7 if i % 3 else i, f"text {i} with a few words of its own {i * i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = [r["count"] for r in sketch.in_sequence(df).groupBy("range").count().collect()]
    assert max(sizes) < 3 * 3000 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))) and sum(sizes) == 3000 + len(sizes)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = [(d, hashlib.sha256(edit(t, order[(i + 1) % 3000][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order)]
    got = [(r.doc_id, r.edited_sha256) for r in sketch.edit_likeness(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
