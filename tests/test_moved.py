"""Operators shuffle no more than they have to."""

from pyspark.sql import functions as F

from hashloom.operators import flow, match as mt

from moved import moved_by


def test_rows_without_postings_are_not_shuffled(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    top = df([(d, 0, f"t{d}", 5) for d in range(200)], "doc long, k0 int, hash string, weight long")
    low = df([(d, 0, f"w{i % 90}", 1) for d in range(200) for i in range(100)] + [(7, 0, None, 1)], "doc long, k0 int, hash string, weight long")
    index = [df([("t3", "a"), ("t3", "a")], "hash string, lib_hash string"), df([("w1", "a"), ("w2", "b"), (None, "a")], "hash string, lib_hash string")]
    n, rows = moved_by(spark, lambda: mt.vote_cascade([top, low], index, [["k0"], ["k0"]], ["doc"], ["doc"]))
    assert sorted(map(tuple, rows)) == sorted([(3, "a", 10)] + [(d, x, 1) for d in range(200) if d != 3 for x in "ab"])
    assert n < 3000


def test_edges_are_shuffled_once_for_all_rounds(spark):
    edges = spark.range(4000).select(F.col("id").alias("src"), (F.col("id") * 7 % 4001).alias("dst")).union(spark.range(8).select("id", F.col("id") + 1)).distinct()
    start = spark.range(1).select(F.col("id").alias("node"))
    n, rows = moved_by(spark, lambda: flow.reachable(edges, start, 6))
    assert {r.node: r.distance for r in rows}[6] == 6
    assert n < 3 * 4008


def test_texts_are_told_within_their_rows(spark):
    from hashloom.plans.queries import fuzzy_texts

    text = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(400)) for i in range(40)] + ["", "  ", None, " w1  int w99 ", "w2 w98"]
    rows = spark.createDataFrame([(i if i < 44 else 43, t) for i, t in enumerate(text)], "doc_id long, text string").select("doc_id", F.split("text", " ").alias("words"))
    known = spark.createDataFrame([(f"w{i}",) for i in range(0, 50, 3)] + [("w2",)], "word string")
    n, got = moved_by(spark, lambda: fuzzy_texts(rows, known))
    assert n < 500
    want = fuzzy_texts(rows, known, inline=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 41


def test_code_is_not_shuffled_to_its_classes(spark):
    from hashloom.operators.fingerprint import fingerprint
    from hashloom.plans.tables import CODE

    line = "named_struct('pc', i, 'opcode', 'op', 'kind', 'invoke', 'ref_class', 'La/B;', 'arg_types', array('V'), 'field_type', 'V')"
    methods = spark.sql(f"SELECT 'app' AS app_id, concat('La/C', id % 3, ';') AS class_desc, CAST(id AS INT) AS method_idx, 'm' AS name, 1 AS access_flags, array('I') AS param_types, 'V' AS return_type, CAST(transform(sequence(1, 5), i -> {line}) AS {CODE}) AS code FROM range(50)")
    classes = spark.sql("SELECT 'app' AS app_id, c AS class_desc, 'Lx/Y;' AS super_desc, 1 AS access_flags, 'f' AS source_file FROM VALUES ('La/C0;'), ('La/C1;'), ('La/C1;') AS t(c)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = fingerprint(classes, methods, spark.sql("SELECT 'V' AS type_desc"))["methods"]
        assert made.count() == 34
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        shuffled = [x for x in plan.splitlines() if "code#" in x and "Exchange" in x]
        below = plan[plan.index("Exchange hashpartitioning(app_id") :]
        assert not shuffled and "md5" in below
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_component_rounds_go_by_numbers(spark):
    import glob

    from hashloom.operators import projections as pj
    from hashloom.storage import shared_dir

    links = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/hashloom/links-*"))
    before = links()
    e = spark.sql("SELECT * FROM VALUES ('1', 'b.z', 'b.y'), ('1', 'b.y', 'a.x'), ('1', 'q', 'q'), ('2', 'b.y', 'c'), ('1', 'own.p.k', 'q') AS t(app_id, src, dst)")
    apps = spark.sql("SELECT * FROM VALUES ('1', 'own.p'), ('2', 'own.p') AS t(app_id, package_name)")
    got = sorted(map(tuple, pj.class_components(e, apps).collect()))
    assert got == sorted([("1", n, "a.x") for n in ("b.z", "b.y", "a.x")] + [("1", "q", "q"), ("2", "b.y", "b.y"), ("2", "c", "b.y")])
    new = links() - before
    assert new and all(t == "bigint" for p in new for _, t in spark.read.parquet(p).dtypes)
