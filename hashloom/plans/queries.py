"""The queries of the core operators on the shared tables, each with its SQL in oracle.py where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import flags as fl, hashes as hs, names as nm, reports as rp
from ..operators import components as cc, edges as ed, filters as ft, flow, hierarchy as hi, index as ix, match as mt, merkle as mk, projections as pj, sets as st, trie as tr
from ..operators.fingerprint import INLINE_TYPES, UNKNOWN, fingerprint, fuzzy
from ..storage import dealt_join, materialize
from ..streaming.landing import windowed_counts
from . import programs
from .tables import customer_orders, decoded_apps, page_names, read, sentences, sentences_of

#: Upper bounds of the price ranges.
BOUNDS = [1000.0, 5000.0, 20000.0, 50000.0, 100000.0, 200000.0, 400000.0]


def _rollup(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    tables = mk.roll_up(customer_orders(spark, sf_dir), [["region", "nation", "customer"], ["region", "nation"], ["region"]], distinct)
    out = None
    for level, df in zip(("customer", "nation", "region"), tables, strict=True):
        one = df.select(F.lit(level).alias("level"), F.col(level).cast("long").alias("key"), "hash", "n_leaves")
        out = one if out is None else out.unionByName(one)
    return out


def agg02_merkle_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir, False)


def agg06_merkle_distinct(spark, sf_dir):
    return _rollup(spark, sf_dir, True)


def fn01_digests(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", *[hs.digest(name, a).alias(a) for a in hs.DIGESTS], hs.to_hex(name.cast("binary"), True).alias("upper_hex"), hs.from_hex(hs.to_hex(name.cast("binary"))).cast("string").alias("back"))


def fn04_names(spark, sf_dir):
    n = F.col("name")
    return page_names(spark, sf_dir).select(
        "page_id", "name", nm.package(n).alias("package"), nm.simple_name(n).alias("simple"), nm.depth(n).cast("long").alias("depth"), nm.first_segments(n, 2).alias("first2"),
        nm.parent(n).alias("parent"), nm.ancestor(n, 2).alias("grandparent"), nm.descriptor(n).alias("descriptor"), nm.dotted(nm.descriptor(n)).alias("round_trip"), nm.quoted(n).alias("quoted"),
    )


def fn12_relationships(spark, sf_dir):
    """A name and the others of its parent, and a name and its parent; what is asked of one name is made once a name."""
    n = F.col("n")
    names = page_names(spark, sf_dir).select(F.col("name").alias("n")).distinct().withColumn("p", nm.parent(n))
    names = materialize(names.select("n", "p", nm.package(n).alias("up"), nm.depth(n).alias("depth")), "names")
    side = lambda x: names.select("p", *[F.col(c).alias(x + c) for c in ("n", "up", "depth")])
    # a name that is its own parent has met the names below it already
    above = names.join(names.select(F.col("n").alias("p"), F.col("p").alias("again")).filter("p = again"), "p", "left_anti")
    p = F.col("p")
    above = above.select(n.alias("an"), F.col("up").alias("aup"), F.col("depth").alias("adepth"), p.alias("bn"), nm.package(p).alias("bup"), nm.depth(p).alias("bdepth"))
    pairs = dealt_join(side("a"), side("b"), ["p"]).select(above.columns).unionByName(above)
    a, b = F.col("an"), F.col("bn")
    near = F.abs(F.col("adepth") - F.col("bdepth")) <= 1
    return pairs.select(a.alias("a"), b.alias("b"), nm.relationship(a, b, F.col("aup"), F.col("bup")).alias("relationship"), near.alias("near"), nm.family(b, a).alias("family"))


def fn13_fuzzy_tokens(spark, sf_dir):
    words = F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]+", " ")), " ")
    known = read(spark, sf_dir, "benchmark").select(F.explode(words).alias("word")).filter("word <> ''").distinct()
    return fuzzy_texts(read(spark, sf_dir, "documents").select("doc_id", words.alias("words")), known)


def fuzzy_texts(rows: DataFrame, known: DataFrame, inline: int = INLINE_TYPES) -> DataFrame:
    """doc_id, hash, n_chars, n_known of words (doc_id, words): up to so many known words are a set in the expression, more are joined.

    With a set each row's words, which have no marks of types, are told within
    the row. Rows of one id are
    one text, word by word, so signatures meet by id; an empty word keeps its
    place until then.
    """
    few = [r.word for r in known.limit(inline + 1).collect()]
    if len(few) <= inline:
        told = F.transform("words", lambda w: F.when((w == "") | w.isin(few) | nm.is_primitive(w), w).otherwise(F.lit(UNKNOWN)))
        own = rows.select("doc_id", F.array_join(told, " ").alias("s"), F.size(F.filter("words", lambda w: w.isin(few))).cast("long").alias("n")).filter("s rlike '[^ ]'")
        met = own.groupBy("doc_id").agg(F.collect_list("s").alias("ss"), F.sum("n").alias("n_known"))
        one = F.filter(F.split(F.col("ss")[0], " "), lambda w: w != "")
        placed = F.flatten(F.transform("ss", lambda s: F.transform(F.split(s, " "), lambda w, i: F.struct(i.alias("pos"), w.alias("t")))))
        several = F.transform(F.sort_array(F.filter(placed, lambda x: x["t"] != "")), lambda x: x["t"])
        made = met.select("doc_id", F.array_join(F.when(F.size("ss") == 1, one).otherwise(several), " ").alias("signature"), "n_known")
    else:
        each = rows.select("doc_id", F.posexplode("words").alias("pos", "word")).filter("word <> ''").join(known.withColumn("known", F.lit(True)), "word", "left")
        made = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", fuzzy(F.col("word"), F.coalesce(F.col("known"), F.lit(False))).alias("t")))), lambda x: x["t"]), " ").alias("signature"), F.count_if(F.col("known")).alias("n_known"))
    return made.select("doc_id", hs.digest(F.col("signature")).alias("hash"), F.length("signature").cast("long").alias("n_chars"), "n_known")


def fn23_reports(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", rp.duration(F.col("o_orderkey") * 98765).alias("duration"), rp.percentage(F.col("o_custkey"), F.col("o_orderkey")).alias("percentage"), rp.comparison(F.element_at(F.array(*map(F.lit, rp.COMPARISONS)), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("operator"))


def flt02_resource_names(spark, sf_dir):
    kind = F.col("p_size") % 5
    name = F.when(kind == 0, F.lit("R")).when(kind == 1, F.lit("R$id")).when(kind == 2, F.lit("BuildConfig")).when(kind == 3, F.lit("Manifest$permission")).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name")).filter(~ft.is_resource(F.col("name")))


def flt05_flag_filters(spark, sf_dir):
    flags = (F.col("p_partkey") * 37 % 32768).cast("int")
    rows = read(spark, sf_dir, "part").select("p_partkey", flags.alias("flags"), "p_name")
    f = F.col("flags")
    return rows.select("p_partkey", fl.written_by_hand(f).alias("hand"), fl.public_only(f).alias("public"), fl.candidate_class(f, F.col("p_name")).alias("candidate_class"), fl.candidate_method(f).alias("candidate_method"), F.array_join(fl.names_of(f), ",").alias("names"))


def flt10_outside_app(spark, sf_dir):
    n, app = F.col("name"), F.lit("com.example.the")
    return page_names(spark, sf_dir).filter(ft.outside_app(n, app)).select("page_id", "name", ft.outside_app(n, F.lit("net.example"), True).alias("not_net"), ft.is_top_level(nm.first_segments(n, 1)).alias("top_level"))


def flt18_not_done(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    lines = read(spark, sf_dir, "lineitem")
    keys = lambda f: lines.filter(f).select(F.col("l_orderkey").alias("key"))
    return ft.not_yet_done(o, "key", keys("l_returnflag = 'R'"), keys("l_quantity > 45"))


def _edges(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    c, s, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    kind = F.when(F.col("l_returnflag") == "R", F.lit("getfield")).otherwise(F.lit("invoke"))
    ends = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst"))
    starts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("src"))
    return li.join(starts, F.col("l_orderkey") == F.col("o_orderkey")).join(ends, F.col("l_suppkey") == F.col("s_suppkey")).select("src", "dst", kind.alias("kind"))


def agg07_edge_weights(spark, sf_dir):
    known = read(spark, sf_dir, "nation").filter("n_regionkey IN (2, 3)").select(F.col("n_name").alias("package"))
    e = ft.known_destinations(ed.weigh(_edges(spark, sf_dir), ()), known, ())
    return e.select("src", "dst", "call_count", "getfield_count", ed.score(F.col("call_count"), F.col("getfield_count")).alias("score")).orderBy(F.concat("src", F.lit("->"), "dst"))


def agg01_fingerprint(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    return fingerprint(t["classes"], t["methods"], t["framework_types"])["methods"].select("app_id", "package", "class_name", "method_idx", "hash", "simple_hash")


def agg04_package_hashes(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    return fingerprint(t["classes"], t["methods"], t["framework_types"])["packages"]


def gr01_dependency_edges(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    return ed.dependency_edges(t["classes"], t["methods"])


def gr02_edge_rules(spark, sf_dir):
    names = page_names(spark, sf_dir).select("page_id", "name")
    nxt = names.select((F.col("page_id") - 1).alias("page_id"), F.col("name").alias("other"))
    e = names.join(nxt, "page_id").select(F.lit("app").alias("app_id"), F.col("name").alias("src"), F.col("other").alias("dst"))
    e = e.unionByName(e.select("app_id", nm.first_segments(F.col("src"), 1).alias("src"), "dst")).distinct()
    apps = spark.sql("SELECT 'app' AS app_id, 'com.example.the' AS package_name")
    return ed.classify(e, apps).select("src", "dst", "rule", "keep", "calls_dst", "called_edge")


def _digest_sets(spark, sf_dir):
    """doc_id, ss: a text's sentences as binary digests, each once."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.transform(sentences_of(F.col("text")), lambda s: F.unhex(F.md5(s)))).alias("ss"))


def _sentence_digests(spark, sf_dir):
    return _digest_sets(spark, sf_dir).select("doc_id", F.explode("ss").alias("s"))


def _shared(spark, sf_dir):
    rows = materialize(_digest_sets(spark, sf_dir), "digests").select("doc_id", F.explode("ss").alias("s"))
    return cc.components_of_groups(rows, "doc_id", "s").withColumnRenamed("node", "doc_id")


def gr03_components(spark, sf_dir):
    return _shared(spark, sf_dir)


def gr07_singletons(spark, sf_dir):
    return cc.singletons_of_groups(_sentence_digests(spark, sf_dir), "doc_id", "s").withColumnRenamed("node", "doc_id")


def gr08_uncalled(spark, sf_dir):
    hit = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("node"))
    return cc.uncalled(_shared(spark, sf_dir).withColumnRenamed("doc_id", "node"), hit)


def top05_largest_component(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("prefix"))
    return cc.largest_component(_shared(spark, sf_dir).join(d, "doc_id"), "prefix")


def _units(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("app_id"), F.md5(F.coalesce("text", F.lit(""))).alias("unit_hash"), F.md5("lang").alias("tree_hash"), F.col("lang").alias("tree"))


def agg09_apps_of_units(spark, sf_dir):
    return ix.apps_of_units(_units(spark, sf_dir)).select("unit_hash", F.array_join("apps", ",").alias("apps"), "n_apps")


def agg11_tree_names(spark, sf_dir):
    return ix.tree_names(_units(spark, sf_dir))


def agg12_tree_counts(spark, sf_dir):
    return ix.tree_counts(_units(spark, sf_dir))


def agg15_source_aware(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    u = d.groupBy(F.col("source").alias("app_id"), F.col("lang").alias("unit_id")).agg(hs.of_children(F.collect_list(F.md5("text"))).alias("unit_hash"), F.collect_set((F.col("n_chars") % 7).cast("string")).alias("source_files"))
    return mk.source_aware(u)


def agg16_unit_hashes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rows = d.select("source", F.concat("lang", F.lit("-"), F.col("n_chars") % 5).alias("package"), F.md5("text").alias("hash"))
    return mk.unit_hash(rows, ["source"])


def _cascade(spark, sf_dir):
    def levels(df, key):
        parts = df.select(key, sentences_of(F.col("text")).alias("ss"), F.coalesce("text", F.lit("")).alias("t"))
        top = parts.select(key, F.lit(0).alias("k0"), F.md5("t").alias("hash"), F.size("ss").cast("long").alias("weight"))
        s = parts.select(key, F.lit(0).alias("k0"), F.posexplode("ss").alias("k1", "s"))
        mid = s.select(key, "k0", "k1", F.md5("s").alias("hash"), F.size(F.split("s", " ")).cast("long").alias("weight"))
        w = s.withColumn("ws", F.split("s", " ")).filter(F.size("ws") >= 5)
        low = w.select(key, "k0", "k1", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 4), lambda i: F.md5(F.array_join(F.slice("ws", i, F.lit(5)), " ")))).alias("hash"), F.lit(1).cast("long").alias("weight"))
        return [top, mid, low]

    docs = levels(read(spark, sf_dir, "documents"), "doc_id")
    items = [x.select("hash", F.col("item_id").alias("lib_hash")) for x in levels(read(spark, sf_dir, "benchmark"), "item_id")]
    return mt.vote_cascade(docs, items, [["k0"], ["k0", "k1"], ["k0", "k1"]], ["doc_id"], ["doc_id"])


def jn02_vote_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir).withColumnRenamed("lib_hash", "item_id")


def top02_top6_per_name(spark, sf_dir):
    libs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("lib_hash"), F.concat(F.lit("lib"), (F.col("item_id") % 3).cast("string")).alias("name"))
    return mt.shortlist(_cascade(spark, sf_dir), libs, ["doc_id"]).withColumnRenamed("lib_hash", "item_id")


def top02_top6_suppliers(spark, sf_dir):
    """Of each customer's suppliers in a region the six with most items: many customers have more."""
    li, o, s, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "nation"))
    votes = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", F.col("l_suppkey").alias("lib_hash")).agg(F.sum(F.col("l_quantity").cast("long")).alias("votes"))
    libs = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("lib_hash"), F.concat(F.lit("region"), "n_regionkey").alias("name"))
    return mt.shortlist(votes, libs, ["o_custkey"]).withColumnRenamed("lib_hash", "l_suppkey")


def _distinct_sentences(spark, sf_dir, table, key):
    return sentences(read(spark, sf_dir, table), key).select(key, F.md5("sentence").alias("s"))


def jn07_overlap(spark, sf_dir):
    return mt.overlap(_distinct_sentences(spark, sf_dir, "documents", "doc_id"), _distinct_sentences(spark, sf_dir, "benchmark", "item_id"), "doc_id", "item_id", "s")


def jn08_containment(spark, sf_dir):
    return mt.contained(_digest_sets(spark, sf_dir), "doc_id", "ss", 0.7)


def jn11_siblings(spark, sf_dir):
    return tr.siblings(page_names(spark, sf_dir))


def jn13_first_app(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    candidates = li.groupBy(F.col("l_suppkey").cast("string").alias("lib_hash"), F.col("l_orderkey").alias("app_id")).agg(F.min("l_linenumber").alias("pos"))
    hashes = li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("app_id"), F.col("l_suppkey").cast("string").alias("lib_hash")).distinct().withColumn("hash", F.col("lib_hash"))
    return mt.first_app(candidates, hashes)


def src17_range_lookup(spark, sf_dir):
    return st.range_lookup(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", BOUNDS)


def set03_difference(spark, sf_dir):
    dear = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("key"))
    return st.difference(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name"), dear, "key")


def set04_bags(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", sentences_of(F.col("text")).alias("a"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(b, "doc_id").select("doc_id", st.bag_intersection(F.col("a"), F.col("b")).cast("long").alias("shared"), st.same_elements(F.col("a"), F.col("b")).alias("same"), F.size(F.array_union("a", "b")).cast("long").alias("either"))


def set06_roots(spark, sf_dir):
    names = page_names(spark, sf_dir).select("name")
    return st.roots(names.unionByName(names.select(nm.parent(F.col("name")).alias("name")).filter(F.length("name") % 2 == 0)))


def top08_prefix_search(spark, sf_dir):
    return st.prefix_search(read(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "Customer#00000001", 7)


def tr07_completion(spark, sf_dir):
    return st.completion(read(spark, sf_dir, "customer"), "c_name", "Cust")


def tr01_trie(spark, sf_dir):
    return tr.build(page_names(spark, sf_dir))


def tr02_roots_of_names(spark, sf_dir):
    names = page_names(spark, sf_dir)
    return tr.root_of(names, names.select(nm.first_segments(F.col("name"), 3).alias("name")).distinct())


def tr04_contained(spark, sf_dir):
    n = F.col("name")
    rel = page_names(spark, sf_dir).select(nm.first_segments(n, 3).alias("name"), F.array_join(F.slice(F.split(n, "[.]"), 4, 1), ".").alias("prefix")).filter("prefix <> ''")
    return tr.contained(rel, rel, "name")


def agg17_trie_summary(spark, sf_dir):
    names = page_names(spark, sf_dir).withColumn("top", nm.first_segments(F.col("name"), 1))
    return tr.summary(tr.build(names, "name", ("top",)), ("top",))


def agg22_trie_hashes(spark, sf_dir):
    trie = tr.build(page_names(spark, sf_dir))
    return tr.merkle_trie(trie.withColumn("hash", F.when(F.col("own") > 0, F.md5("prefix"))))


def _types(spark, sf_dir):
    trie = materialize(tr.build(page_names(spark, sf_dir)), "types")
    return trie.select(F.col("prefix").alias("type_name"), F.when(F.col("parent") != "", F.col("parent")).alias("super_name"))


def ch03_superclasses(spark, sf_dir):
    return hi.closure(_types(spark, sf_dir))


def ch06_least_common(spark, sf_dir):
    names = page_names(spark, sf_dir)
    pairs = names.join(names.select((F.col("page_id") - 1).alias("page_id"), F.col("name").alias("b")), "page_id").select(F.col("name").alias("a"), "b").distinct()
    return hi.least_common(pairs, materialize(hi.closure(_types(spark, sf_dir)), "closure"))


def ch07_subclasses(spark, sf_dir):
    return hi.subclasses(_types(spark, sf_dir)).select("super_name", F.array_join("subclasses", ",").alias("subclasses"))


def _declared(types):
    return types.filter(F.length("type_name") % 3 == 0).select("type_name", F.lit("run").alias("selector"))


def ch08_resolve(spark, sf_dir):
    types = _types(spark, sf_dir)
    return hi.resolve(types.select("type_name", F.lit("run").alias("selector")), _declared(types), hi.closure(types))


def df06_call_targets(spark, sf_dir):
    types = _types(spark, sf_dir)
    return hi.possible_targets(types.select("type_name", F.lit("run").alias("selector")), _declared(types), materialize(hi.closure(types), "closure"))


def fn25_categories(spark, sf_dir):
    return hi.category(hi.closure(_types(spark, sf_dir)), {"com.example": "Com", "net.example": "Net", "com.example.thth": "Other"}, "OTHER")


def df10_call_closure(spark, sf_dir):
    """All that stands above each order, customer, nation and region."""
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    up = lambda df, a, low, b, high: df.select(F.concat(F.lit(a), low).alias("src"), F.concat(F.lit(b), high).alias("dst"))
    return hi.closure(up(o, "o", "o_orderkey", "c", "o_custkey").union(up(c, "c", "c_custkey", "n", "c_nationkey")).union(up(n, "n", "n_nationkey", "r", "n_regionkey")), "src", "dst")


def _trade(spark, sf_dir):
    """All order lines as edges: the customer to the supplier, and of returned lines the supplier back to the customer.

    Customers are their keys, suppliers theirs negated.
    """
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), (-F.col("l_suppkey")).alias("s"), "l_returnflag")
    return e.select(F.col("c").alias("src"), F.col("s").alias("dst")).union(e.filter("l_returnflag = 'R'").select("s", "c")).distinct()


def df13_forward_slice(spark, sf_dir):
    return flow.reachable(_trade(spark, sf_dir), spark.sql("SELECT CAST(-1 AS BIGINT) AS node"))


def df11_pruned_calls(spark, sf_dir):
    return flow.prune(_trade(spark, sf_dir), spark.sql("SELECT CAST(-1 AS BIGINT) AS node"))


def df18_control_flow(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pc")).agg((F.max("l_returnflag") == "R").alias("ends"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity") % 7)).cast("int").alias("target"))
    return flow.control_flow(li, ["l_orderkey"])


def prj04_numbers(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    return pj.numbers(fingerprint(t["classes"], t["methods"], t["framework_types"]))


def prj05_library(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    nodes = fingerprint(t["classes"], t["methods"], t["framework_types"])
    return pj.library(nodes).select("app_id", "name", F.array_join("packages", ",").alias("packages"), "n_classes")


def gr04_class_components(spark, sf_dir):
    """All customers and all suppliers of their orders as classes of one app a region."""
    li, o, c, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    home = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("app_id"))
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(home, "c_nationkey")
    e = e.select("app_id", "c_custkey", "l_suppkey").distinct().select("app_id", F.concat(F.lit("com.c"), "c_custkey").alias("src"), F.concat(F.lit("org.s"), "l_suppkey").alias("dst"))
    return pj.class_components(e, home.select("app_id", F.lit("com.own").alias("package_name")).distinct())


def fn26_lifecycle(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("Activity", "Service", "BroadcastReceiver", "ContentProvider", "Application", "Fragment", "OTHER")))
    methods = F.array(*map(F.lit, ("onCreate()V", "onStart()V", "onDestroy()V", "onCreate()Z", "run()V")))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int")).alias("kind"), F.element_at(methods, (F.col("p_size") % 5 + 1).cast("int")).alias("method"))
    return rows.withColumn("lifecycle", pj.is_lifecycle(F.col("kind"), F.col("method")))


def flt15_useful(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 4 == 0, F.lit("A$1")).when(F.col("p_partkey") % 4 == 1, F.lit("R$id")).otherwise(F.lit("A$b"))
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (F.col("p_size") % 3).alias("methods"))
    return rows.filter(pj.useful(F.col("name"), F.col("methods"), F.lit(0), F.lit(0)))


def str00_windowed_counts(spark, sf_dir):
    out = windowed_counts(read(spark, sf_dir, "events").select("ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("value")))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "total")


def program_cluster(spark, sf_dir):
    return programs.cluster(_profile(spark, sf_dir))


def _profile(spark, sf_dir):
    made = programs.parse({k: v if k == "methods" else materialize(v, k) for k, v in decoded_apps(spark, sf_dir).items()})
    return {k: v if k in ("methods", "classes", "packages") else materialize(v, k) for k, v in made.items()}


def program_match(spark, sf_dir):
    """Two nations' packages of each region as libraries, looked for in all regions."""
    profile = _profile(spark, sf_dir)
    own = profile["packages"].filter(F.substring("package", -1, 1).isin("3", "7")).select(F.concat_ws(":", "app_id", "package").alias("lib_hash"), "app_id", F.array("package").alias("packages"))
    libs = own.select("lib_hash", F.substring_index("lib_hash", ":", -1).alias("name"))
    index = ix.build_index(programs.library_profile(own.select("lib_hash", "app_id"), own.select("lib_hash", "packages"), profile), libs)
    return programs.match(profile, {k: materialize(v, k) for k, v in index.items()})


QUERIES = {k: v for k, v in globals().items() if callable(v) and k.split("_")[0].rstrip("0123456789") in ("agg", "fn", "flt", "gr", "jn", "top", "src", "set", "prj", "tr", "ch", "df", "str", "program") and getattr(v, "__module__", "") == __name__}
