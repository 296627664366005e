"""The shortlist of six versions a name against the sorted votes."""

from collections import defaultdict

from hashloom.plans.queries import QUERIES


def test_six_versions_of_each_name(spark, tmp_path):
    # eight versions of lib0, three of lib1
    items = [(i, "one shared sentence here. " + "of its own. " * (i % 2)) for i in [*range(0, 24, 3), 1, 4, 7]]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "one shared sentence here. of its own"), (2, "one shared sentence here"), (3, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    votes = defaultdict(list)
    for r in QUERIES["jn02_vote_cascade"](spark, str(tmp_path)).collect():
        votes[r.doc_id, f"lib{r.item_id % 3}"].append((-r.votes, r.item_id))
    want = sorted((d, name, i, -v) for (d, name), rows in votes.items() for v, i in sorted(rows)[:6])
    got = QUERIES["top02_top6_per_name"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.name, r.item_id, r.votes) for r in got) == want
    assert len(want) == 18


def test_the_cut_bites(spark):
    """More than six suppliers of a region: the rows that the cut leaves out exist on the given tables."""
    rows = QUERIES["top02_top6_suppliers"](spark, "/root/testdata/sf0.01").collect()
    many = defaultdict(int)
    for r in rows:
        many[r.o_custkey, r.name] += 1
    assert max(many.values()) == 6 and list(many.values()).count(6) > 10
