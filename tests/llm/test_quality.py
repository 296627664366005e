"""Site posteriors and held-out accuracy."""

import pytest

from hashloom.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = "crc32(CAST(doc_id AS STRING)) % 4 = 0"
    got = quality.score(docs, labels.filter(f"NOT {fold}"), docs["source"], docs["lang"])
    rows = got.join(labels.filter(fold).selectExpr("doc_id", "quality AS y"), "doc_id").collect()
    right = sum(r.kept == (r.y > 0) for r in rows) / len(rows)
    good = [r.kept for r in rows if r.y > 0]
    assert right > 0.85 and sum(good) / len(good) > 0.9


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [(i, "big", "p", 0.9) for i in range(400)] + [(1000 + i, "bad", "p", 0.1) for i in range(400)] + [(2000, "big", "rare", 0.2), (3000, "new", "x", 0.2)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double")
    got = {r.doc_id: r for r in quality.posterior(scored).collect()}
    assert got[0].p_path > 0.85 and got[1000].p_path < 0.15
    # its own evidence is left out, so a lone path has its host's mean, a lone host the global one
    assert got[2000].p_path == pytest.approx(got[2000].p_host) and got[2000].p_host > 0.8
    assert got[3000].p_host == pytest.approx((400 * 0.9 + 400 * 0.1 + 0.4) / 802)


def test_odd(odd, nobody, documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = odd.unionByName(nobody)
    got = quality.score(rows, labels, rows["source"], rows["lang"])
    assert got.count() == rows.count()
    assert got.filter("quality IS NULL OR kept IS NULL OR quality NOT BETWEEN 0 AND 1").count() == 0
    assert len({r.quality for r in got.filter("doc_id = 9").collect()}) == 1


def test_without_labels(odd, empty, spark):
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {round(r.p_doc, 9) for r in quality.score(odd, none, odd["source"], odd["lang"]).collect()} == {0.5}
    assert quality.score(empty, none, empty["source"], empty["lang"]).count() == 0


def brute(docs, p_of):
    """{row index: (p_host, p_path, quality)} from plain sums over the rows (host, path, text)."""
    from collections import defaultdict
    from math import exp, log

    n = len(docs)
    p = [p_of[t] for _, _, t in docs]
    mean = sum(p) / n
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, q, _), x in zip(docs, p, strict=True):
        hosts[h].append(x)
        paths[h, q].append(x)
    weight = lambda m, spread: max(1.0, min(1e4, m * (1 - m) / max(spread, 1e-9) - 1))
    avg = lambda xs: sum(xs) / len(xs)
    w_host = weight(mean, sum(len(x) * (avg(x) - mean) ** 2 - mean * (1 - mean) for x in hosts.values()) / n)
    spread = 0.0
    for (h, _), x in paths.items():
        m = avg(hosts[h])
        spread += len(x) * (avg(x) - m) ** 2 - m * (1 - m)
    w_path = weight(mean, spread / n)
    held = lambda x: max(1e-3, min(1 - 1e-3, x))
    odds = lambda x: log(x / (1 - x))
    out = []
    for (h, q, _), x in zip(docs, p, strict=True):
        p_host = (sum(hosts[h]) - x + w_host * held(mean)) / (len(hosts[h]) - 1 + w_host)
        p_path = held((sum(paths[h, q]) - x + w_path * p_host) / (len(paths[h, q]) - 1 + w_path))
        out.append((p_host, p_path, 1 / (1 + exp(-(odds(x) + odds(p_path) - odds(held(mean)))))))
    return out


def features(t):
    """The surface of a text by plain counting."""
    import re
    from math import log, sqrt

    b, w = t.encode(), re.findall(r"[^\x20\x09-\x0D]+", t)
    n, m = max(1, len(b)), max(1, len(w))
    letters = [c for c in b if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128]
    return [sqrt(b.count(c) / n) for c in range(32, 128)] + [
        sqrt(b.count(10) / n), sqrt(sum(c >= 128 for c in b) / n), log(1 + len(w)) / 5, log(1 + n / m) / 2, len(set(w)) / m,
        sum(65 <= c <= 90 for c in b) / max(1, len(letters)), len(letters) / n, 1 - sum(33 <= c < 48 for c in b) / n,
    ]


def test_against_plain_sums(spark, documents, sf_dir):
    import numpy as np
    from plain_newton import newton

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.text or "") for r in documents.collect()]
    text = {d: t for d, _, _, t in rows}
    told = sorted((r.doc_id, int(r.quality)) for r in labels.collect() if r.doc_id in text)
    x, y = np.array([features(text[d]) for d, _ in told]), np.array([float(q > 0) for _, q in told])
    w = newton(x, y, quality.RIDGE * len(x))
    p_of = {t: min(1 - 1e-3, max(1e-3, 1 / (1 + np.exp(-(np.array(features(t)) @ w[:-1] + w[-1]))))) for t in text.values()}
    want = {d: q for (d, *_), q in zip(rows, brute([(h, q, t) for _, h, q, t in rows], p_of), strict=True)}
    got = quality.score(documents, labels, documents["source"], documents["lang"]).collect()
    for r in got:
        assert r.p_doc == pytest.approx(p_of[text[r.doc_id]], abs=2e-3)
        assert (r.p_host, r.p_path, r.quality) == pytest.approx(want[r.doc_id], abs=5e-3)
        assert r.kept == (want[r.doc_id][2] >= quality.KEEP) or abs(want[r.doc_id][2] - quality.KEEP) < 5e-3


def test_accepted_rows_are_those_that_score_keeps(spark, odd, nobody, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = odd.unionByName(nobody).withColumnRenamed("size", "p_doc").withColumnRenamed("hash", "host")
    want = [(r.doc_id, r.host, r.path) for r in quality.score(docs, labels, docs["source"], docs["lang"]).filter("kept").collect()]
    got = quality.accepted(docs, labels, docs["source"], docs["lang"])
    assert got.schema.names == docs.schema.names
    assert sorted(((r.doc_id, r.source, r.lang) for r in got.collect()), key=str) == sorted(want, key=str)


def test_labels_of_repeated_ids(spark):
    """However many labels or texts one id has, the sample keeps the other ids."""
    docs = spark.createDataFrame([(1, f"many texts {i}") for i in range(500)] + [(i, "good words here") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] * 2000 + [(i, 1) for i in range(2, 40)], "doc_id long, quality int")
    assert quality.train(docs, labels, 50) is not None
