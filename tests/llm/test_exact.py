"""Decisions of one batch and of several."""

import hashlib
import re
from collections import defaultdict

from hashloom.llm import exact


def digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_odd(odd, nobody):
    rows = odd.unionByName(nobody)
    groups = defaultdict(list)
    for r in rows.collect():
        groups[digest(r.text)].append(r.doc_id)
    want = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, h) for i in ids]
    got = [tuple(r) for r in exact.exact_dedup(rows).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_second_batch_meets_the_index(spark, odd):
    index = exact.DigestIndex(spark, buckets=4)
    exact.exact_dedup(odd, index).count()
    before = index.table().count()
    batch = spark.createDataFrame([(0, "one two three"), (100, "new"), (101, "new"), (102, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_dedup(batch, index).collect()}
    assert got == {0: (5, False), 100: (100, True), 101: (100, False), 102: (1, False)}
    assert index.table().count() == before + 1
    again = exact.DigestIndex(spark, index.name)
    assert again.buckets == 4 and exact.exact_dedup(batch, again).filter("kept").count() == 1


def test_hot_groups(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact.exact_dedup(df)
    assert got.count() == 3000 and got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 AND keep_id = 0").count() == 1000


def test_empty(empty):
    assert exact.exact_dedup(empty).count() == 0


def test_counts_and_hot_digests_over_batches(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT", 10)
    index = exact.DigestIndex(spark, buckets=4)
    batches = [[(i, "same" if i % 3 == 0 else f"t{i}") for i in range(60)], [(100 + i, "t1" if i < 40 else f"u{i}") for i in range(60)], [(5, "same"), (200, "t1"), (201, "new")], []]
    seen = defaultdict(list)
    for batch in batches:
        for d, t in batch:
            seen[t].append(d)
        got = exact.exact_dedup(spark.createDataFrame(batch, "doc_id long, text string"), index).collect()
        first = {t: next(min(d for d, x in b if x == t) for b in batches if any(x == t for _, x in b)) for _, t in batch}
        want = [(d, first[t], len(seen[t]), d == first[t], digest(t)) for d, t in batch]
        assert sorted(map(tuple, got)) == sorted(want)
    assert {r.text_sha256: r.group_size for r in index.table().collect()} == {digest(t): len(ids) for t, ids in seen.items()}
    name = index.name
    index.drop()
    assert not spark.catalog.tableExists(name)


def test_an_index_for_one_call_goes_with_it(spark, odd):
    before = {t.name for t in spark.catalog.listTables()}
    exact.exact_dedup(odd).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_batch_twice_changes_nothing(spark):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact.DigestIndex(spark, buckets=4)
    first = sorted(map(tuple, exact.exact_dedup(docs, index, "one").collect()))
    assert sorted(map(tuple, exact.exact_dedup(docs, index, "one").collect())) == first
    assert {r[2] for r in first} == {1, 2}
    # a batch that was added in part before it broke
    more = spark.createDataFrame([(4, "b"), (5, "c"), (6, "c")], "doc_id long, text string")
    index.add(exact._digests(more.filter("doc_id = 4"), None), "two")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(more, index, "two").collect()}
    assert got == {4: (3, 2, False), 5: (5, 2, True), 6: (5, 2, False)}
    index.drop()


def test_an_own_index_is_filled_in_ranges(spark, odd, monkeypatch):
    """Later ranges meet an index that is not empty, and the result is that of one batch."""
    added = []
    plain = exact.DigestIndex.add
    monkeypatch.setattr(exact.DigestIndex, "add", lambda self, digests, batch=None: (added.append((self.rows().count(), digests.count())), plain(self, digests, batch))[1])
    got = sorted(map(str, exact.exact_dedup(odd).collect()))
    assert [n for _, n in added] != [odd.count()] and sum(n for _, n in added) == odd.count() and added[-1][0] > 0
    monkeypatch.setattr(exact, "BATCHES", 1)
    assert sorted(map(str, exact.exact_dedup(odd).collect())) == got
