"""Held-out accuracy and what is undetermined."""

import numpy as np

from hashloom.llm import langid


def test_held_out_accuracy(spark):
    from hashloom.llm.queries import op8_language_id

    sf = "/root/testdata/sf0.01"
    got = op8_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert got.filter("score NOT BETWEEN 0 AND 1").count() == 0


def test_odd(odd, nobody, empty, spark, documents):
    model = langid.train(documents)
    rows = odd.unionByName(nobody)
    got = {r.doc_id: r for r in langid.predict(rows, model).collect()}
    assert langid.predict(rows, model).count() == rows.count()
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 12}
    assert all(got[d].score == 0 for d in (1, 2, 3, 12))
    assert langid.predict(empty, model).count() == 0
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.predict(rows, None).collect()} == {"und"}


def test_only_presence_counts():
    import pyarrow as pa

    a, b = langid.presence(pa.array(["abc abc abc abc", "abc abc"]))
    assert np.array_equal(a, b)


def grams(t):
    """The places of a text's n-grams, by plain loops."""
    import pyarrow as pa

    b = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in t.encode())
    assert langid.N == (1, 2, 3, 4)
    out = set()
    for n in langid.N:
        for i in range(len(b) - n + 1):
            x = int.from_bytes(b[i : i + n], "big") + (n << 40)
            out.add(int(langid.mix64(np.array([x], np.uint64))[0]) >> 51)
    row = langid.presence(pa.array([t]))[0]
    assert set(np.flatnonzero(row).tolist()) == out
    return out


def test_model_is_the_ridge_regression_of_the_kernel(spark):
    """Against kernels of Python sets and one regression over all rows in numpy."""
    words = {"en": "the of and to in is that", "fr": "le la les des est une né", "zz": "qua zim vor ulo été"}
    rng, rows = np.random.default_rng(2), []
    for i in range(150):
        lang = ("en", "fr", "zz")[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split(), 6)), lang))
    points, weights, langs = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), 40, 12)
    assert langs == ["en", "fr", "zz"] and len(points) == 12
    sets = [(grams(t), lang) for _, t, lang in rows]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [set(np.flatnonzero(p).tolist()) for p in points]
    assert all(any(m == s and lang == langs[i // 4] for s, lang in sets) for i, m in enumerate(marks))
    # the sample is 40 rows a language, by a hash of the id
    h = {r.k: r.h for r in spark.range(150).selectExpr("id AS k", "pmod(xxhash64(id), 1 << 30) AS h").collect()}
    taught = [i for lang in langs for i in sorted((i for i, _, x in rows if x == lang), key=lambda i: (h[i], i))[:40]]
    k = np.array([[kernel(sets[i][0], m) for m in marks] for i in taught])
    y = np.array([[1.0 if sets[i][1] == lang else -1.0 for lang in langs] for i in taught])
    w = np.array([[kernel(a, b) for b in marks] for a in marks])
    want = np.linalg.solve(k.T @ k + langid.RIDGE * len(taught) * w + 1e-6 * np.eye(12), k.T @ y)
    assert np.allclose(weights, want, rtol=1e-2, atol=1e-2)
    new = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    for r in langid.predict(new, (points, weights, langs)).collect():
        margin = np.array([kernel(sets[r.doc_id][0], m) for m in marks]) @ want
        assert abs(r.score - min(1, max(0, (margin.max() + 1) / 2))) < 1e-2
        assert r.lang_pred == langs[int(margin.argmax())] or np.sort(margin)[-1] - np.sort(margin)[-2] < 1e-2


def test_no_language_is_lost_when_ids_repeat(spark):
    for many in (1, 5, 12):
        rows = [(many, f"the cat and the dog {i}", "en") for i in range(3000)] + [(many, "le chat et le chien", "fr"), (many + 1, "der hund und die katze", "de")]
        model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model[2] == ["de", "en", "fr"]
