"""Collocations against plain loops."""

import random
import re
from collections import Counter

import pytest

from hashloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, within, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in often.items():
        if len(w) == 2 and any(x == lang and len(v) == 3 and w in (v[:2], v[1:]) and 100 * b >= within * a for (x, v), b in often.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def check(spark, rows, least=2, within=50, top=2000):
    docs = spark.createDataFrame([(1, 2, "x", *r) for r in rows], "doc_id int, m int, piece string, lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, within, top).collect())
    assert got == plain(rows, least, within, top)
    return got


def test_random_texts(spark):
    rng = random.Random(5)
    words = ["a", "B", "c", "né", "İ", " x", "漢", "d\x1fe", "f-g"]
    rows = [(rng.choice(["en", None, "und", "x\ny", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\x0b", "\n", "\r\n", "!"]) for _ in range(rng.randrange(30)))) for _ in range(120)]
    assert check(spark, rows + rows[:40])


def test_ties_cuts_and_places_taken(spark):
    rows = [("en", "new york city. new york city. new york. new. york")] * 3 + [("de", "a a a a a a")] * 2 + [("fr", "x y, z w, x y, z w")]
    got = check(spark, rows)
    assert ("en", "new york") not in {(r[0], r[2]) for r in got}  # the longer phrase has two thirds of its count
    check(spark, rows, top=1)
    check(spark, rows, within=90)


def test_odd_rows(odd, empty, nobody):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd, 2).collect()) == plain(rows, 2, 50, 2000)
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(nobody).collect() == []


@pytest.mark.parametrize("n", [1, 7])
def test_long_pieces_in_steps(spark, monkeypatch, n):
    """N-grams come in steps of n, and a bitmap that is full passes all of them."""
    monkeypatch.setattr(phrases, "GRAMS", n)
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch([["en", "de"], ["a b a b a b", "a"], [2, 5]], ["lang", "piece", "m"])
    found = Counter()
    for full in (None, np.full((1 << phrases.BITS) // 8, 255, np.uint8)):
        found.clear()
        for out in phrases.grams(batch, (3,), full):
            found.update({r["g"]: r["m"] for r in out.to_pylist()})
        assert found == {"a b a": 4, "b a b": 4}
    assert list(phrases.grams(batch, (3,), np.zeros((1 << phrases.BITS) // 8, np.uint8))) == []
    assert Counter({r["g"]: r["m"] for out in phrases.grams(batch.slice(1), (1, 2)) for r in out.to_pylist()}) == {"a": 5}


def test_buckets_out_of_core(spark, monkeypatch):
    """DuckDB with little memory counts as it does with more."""
    monkeypatch.setattr(phrases, "BUCKET_MEMORY", "24MB")
    rows = spark.range(0, 400_000, 1, 3).selectExpr("'en' AS lang", "concat('word', id % 150000, ' with a long tail of letters') AS g", "1L AS m")
    got = phrases._counted(rows, 3).collect()
    assert len(got) == 100_000 and {r.f for r in got} == {3}
