"""Joins whose keys have many rows on both sides, and what is built on them."""

import json

from pyspark.sql import functions as F

from hashloom.operators import flow
from hashloom.storage import dealt_join, shared_dir


def test_every_pair_once_in_groups_of_bounded_size(spark):
    left = spark.range(60).select((F.col("id") % 3 % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(50).select((F.col("id") % 5 % 2).alias("k"), F.col("id").alias("b"))
    left = left.union(spark.sql("SELECT NULL, 100L")).union(left.filter("a = 3"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    got = dealt_join(left, right, ["k"], cell=4)
    assert sorted(map(tuple, got.collect())) == want
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < len(want) / 4


def _written(spark, tag):
    import glob

    return sum(spark.read.parquet(p).count() for p in glob.glob(f"{shared_dir(spark).removeprefix('file://')}/hashloom/{tag}-*"))


def test_call_graph_writes_no_edges(spark):
    """A hundred methods call a type with a hundred ways to run: 10,000 edges, and no table of as many rows."""
    rows = lambda schema, rs: spark.createDataFrame(rs, schema)
    calls = rows("method string, receiver string, selector string", [(f"m{i}", "top", "f") for i in range(100)] + [("m0", "t1", "f"), ("t5.f", "u", "g"), ("lone", "top", "f")])
    dispatch = rows("type_name string, selector string, target string", [(f"t{i}", "f", f"t{i}.f") for i in range(100)] + [("u", "g", f"m{1}")])
    reach = rows("type_name string, super_name string", [(f"t{i}", "top") for i in range(100)] + [(f"t{i}", f"t{i}") for i in range(100)] + [("u", "u")])
    entries = rows("method string", [("m0",)])
    before = {t: _written(spark, t) for t in ("sites", "edges")}
    got = [tuple(r) for r in flow.call_graph(entries, calls, dispatch, reach).collect()]
    want = {(m, f"t{i}.f") for m in ("m0", "m1") for i in range(100)} | {("t5.f", "m1")}
    assert sorted(got) == sorted(want)
    assert before == {t: _written(spark, t) for t in ("sites", "edges")}, json.dumps(before)
    news = rows("method string, type_name string", [("m0", "t5"), ("t5.f", "u"), ("m1", "t7")])
    got = [tuple(r) for r in flow.call_graph(entries, calls, dispatch, reach, news).collect()]
    assert sorted(got) == sorted({(m, t) for m in ("m0", "m1") for t in ("t5.f", "t7.f")} | {("t5.f", "m1")})


def _pages(spark, at, urls):
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{at}/pages.parquet")


def test_relationships_of_names_without_parents(spark, tmp_path):
    """Also of a name that is spelled as the mark of having no parent."""
    import duckdb

    from compare import lines
    from hashloom.plans.oracle import ORACLES
    from hashloom.plans.queries import QUERIES

    _pages(spark, tmp_path, ["http://<none>/", "http://x/", "http://y/", "http://x/a", "http://x/b", "http://x/a/b", "http://<none>/z", "http://x/a", "ftp"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    told = con.execute(ORACLES["fn12_relationships"])
    df = QUERIES["fn12_relationships"](spark, str(tmp_path))
    assert lines(df.columns, df.collect()) == lines([d[0] for d in told.description], told.fetchall())


def test_pairs_of_a_hot_parent_are_dealt(spark, tmp_path):
    from hashloom.plans.queries import QUERIES

    _pages(spark, tmp_path, [f"http://a.example.org/en/{i}" for i in range(4500)])
    for name in ("fn12_relationships", "jn11_siblings"):
        sizes = [r["count"] for r in QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == (4500 * 4501 if name[0] == "f" else 4500 * 4499) and max(sizes) < sum(sizes) * 0.8
