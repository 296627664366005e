"""Phrases against a plain search, notices with edits."""

import re

from hashloom.llm import licenses
from hashloom.llm.queries import op5_license_scans

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def places(words):
    return sorted((i, label) for phrase, label in licenses.PHRASES for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split())


def check(df):
    got = sorted((r.doc_id, r.n_words, [(s.start, s.label) for s in r.spans if s.exact]) for r in licenses.scan(df).collect())
    want = sorted((r.doc_id, len(w), places(w)) for r in df.collect() for w in [WORD.findall(lower(r.text))])
    assert [(d, n, sorted(p)) for d, n, p in got] == want


def test_documents(documents):
    check(documents)


def test_odd(odd):
    check(odd)


def test_no_id_and_empty(nobody, empty):
    assert [r.doc_id for r in licenses.scan(nobody).collect()] == [None]
    assert licenses.scan(empty).count() == 0


def test_overlaps_and_edges(spark):
    rows = [(1, "cc by cc by"), (2, "CC-BY, gnu general public license apache license"), (3, "cc"), (4, "by cc"), (5, "apache licenses"), (6, "émit license mit_license MIT\nLICENSE")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_edited_notice(spark):
    notice = licenses.NOTICES[5][0].split()
    text = " ".join(["some", "code", "here", *notice[:8], "really", *notice[8:15], *notice[16:], "and", "more"])
    r = licenses.scan(spark.createDataFrame([(1, text), (2, "a person obtaining a copy of this other thing")], "doc_id long, text string"))
    got = {x.doc_id: [(s.label, s.start, s.end) for s in x.spans] for x in r.collect()}
    assert got[2] == []
    assert len(got[1]) == 1 and got[1][0][0] == "mit-notice" and got[1][0][1] == 3 and abs(got[1][0][2] - 3 - len(notice)) <= 1


def test_one_word_added_anywhere_in_a_notice(spark):
    """Pairs that the notice repeats vote for diagonals between those of its two halves."""
    notice = licenses.NOTICES[1][0].split()
    rows = [(at, " ".join(["some", "code", *notice[:at], "really", *notice[at:], "more"])) for at in range(1, len(notice))]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert len(found) == len(rows)
    for r in found:
        whole = [s for s in r.spans if s.label == "apache-2.0" and s.end - s.start > len(notice) - 3]
        assert len(whole) == 1 and whole[0].cover > 0.9, (r.doc_id, r.spans)


def test_query_columns(spark, sf_dir):
    for r in op5_license_scans(spark, sf_dir).collect():
        base = set(filter(None, r.base_labels.split(",")))
        assert base <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.n_base == 0) == (r.first_word is None) == (r.last_word is None) == (not base)
