"""Queries of single operators, each with its SQL twin beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import names as nm, reports as rp
from ..operators import edges as ed, filters as ft, flow, hierarchy as hi, merkle as mk, projections as pj, sets as st, trie as tr
from ..operators.fingerprint import fingerprint
from ..sources.sinks import node_statistics
from ..storage import materialize
from . import programs
from .oracle import _CLOSURE, _METHODS, _TRADE, _TRIE, ORACLES as CORE, walk
from .tables import decoded_apps, page_names, read

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def add(query: Callable) -> Callable:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def _types(spark, sf_dir) -> DataFrame:
    trie = materialize(tr.build(page_names(spark, sf_dir)), "types")
    return trie.select(F.col("prefix").alias("type_name"), F.when(F.col("parent") != "", F.col("parent")).alias("super_name"))


@_query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Lcom/a/A$1;' WHEN 1 THEN 'Landroid/support/v4/X;' WHEN 2 THEN 'Lcom/a/R$id;' WHEN 3 THEN 'Lcom/a/B;' ELSE 'Landroid/X;' END AS class_desc
FROM part WHERE p_partkey % 5 IN (3, 4)""")
def flt03_inner_and_support(spark, sf_dir):
    kinds = ("Lcom/a/A$1;", "Landroid/support/v4/X;", "Lcom/a/R$id;", "Lcom/a/B;", "Landroid/X;")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("class_desc"))
    return ft.app_classes(rows, inner=False, support=False)


@_query("SELECT p_partkey, ['<init>', '<clinit>', 'run', 'init'][p_size % 4 + 1] AS name FROM part WHERE p_size % 4 > 1")
def flt06_no_constructors(spark, sf_dir):
    names = F.array(*map(F.lit, ("<init>", "<clinit>", "run", "init")))
    return ft.hashed_methods(read(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_size") % 4 + 1).cast("int")).alias("name")))


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def flt11_excluded(spark, sf_dir):
    out = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return ft.without(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), out, "c_custkey")


_LONGER = ("com", "example", "museum", "gov", "xxx", "comm", "", "name", "arpa")


@_query(f"""WITH a AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c), s AS (SELECT x.c || y.c AS segment FROM a x, a y UNION ALL SELECT unnest({list(_LONGER)}))
SELECT n_nationkey, segment, segment IN {ft.TOP_LEVEL} AS top_level FROM nation, s""")
def flt14_top_level(spark, sf_dir):
    """All words of two letters, and some longer ones."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = F.array(*[F.lit(x + y) for x in letters for y in letters], *map(F.lit, _LONGER))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.explode(words).alias("segment")).withColumn("top_level", ft.is_top_level(F.col("segment")))


_CALLED = ("java.lang.String", "Ljavax/net/A;", "org.apache.http.A", "org.apachex.A", "Lorg/omg/A;", "org.omg.A", "Lcom/sun/A;", "javafx.A")


@_query(f"SELECT p_partkey, {list(_CALLED)}[p_partkey % 8 + 1] AS call, p_partkey % 8 IN (0, 1, 2, 4, 6) AS platform FROM part")
def flt16_platform_calls(spark, sf_dir):
    call = F.element_at(F.array(*map(F.lit, _CALLED)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", call.alias("call")).withColumn("platform", ft.is_platform_call(F.col("call")))


@_query("""SELECT p_partkey, concat_ws('.', nullif(p_brand, ''), nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, '')) AS joined,
  CASE p_size % 3 WHEN 0 THEN 'ILa/B;[J' WHEN 1 THEN '' ELSE '[[Lx/Y$Z;ZD' END AS types,
  CASE p_size % 3 WHEN 0 THEN 'a.B' WHEN 1 THEN 'a.B' ELSE 'c.D' END AS class_name, p_size % 4 < 2 AS register FROM part""")
def fn18_signatures(spark, sf_dir):
    signature = F.element_at(F.array(*map(F.lit, ("La/B;->f(ILa/B;[J)V", "a.B.g()V", "c.D.h([[Lx/Y$Z;ZD)I"))), (F.col("p_size") % 3 + 1).cast("int"))
    register = F.element_at(F.array(*map(F.lit, ("v0", "p12", "x1", "v"))), (F.col("p_size") % 4 + 1).cast("int"))
    parts = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("")))
    return read(spark, sf_dir, "part").select("p_partkey", nm.joined(parts, ".").alias("joined"), F.array_join(nm.argument_types(signature), "").alias("types"), nm.class_of(signature).alias("class_name"), nm.is_register(register).alias("register"))


@_query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b c' WHEN 2 THEN '-1.5' ELSE 'plain' END AS bare, p_size % 4 < 3 AS constant FROM part""")
def fn19_constants(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ('"a"', "'b c'", "-1.5", "plain"))), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", nm.unquoted(text).alias("bare"), nm.is_constant(text).alias("constant"))


@_query("""SELECT o_orderkey, (o_orderkey * 98765 // 3600000) || ' h ' || (o_orderkey * 98765 // 60000 % 60) || ' m ' || (o_orderkey * 98765 // 1000 % 60) || ' s ' || (o_orderkey * 98765 % 1000) || ' ms' AS duration,
  ['==', '!=', '<', '>=', '>', '<='][o_orderkey % 6 + 1] AS operator FROM orders""")
def fn23_durations(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("EQ", "NE", "LT", "GE", "GT", "LE"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", rp.duration(F.col("o_orderkey") * 98765).alias("duration"), rp.comparison(name).alias("operator"))


@_query(f"WITH g AS ({CORE['gr02_edge_rules']}) SELECT DISTINCT 'app' AS app_id, dst AS package FROM g WHERE calls_dst")
def gr05_called(spark, sf_dir):
    from .queries import gr02_edge_rules

    return ed.called(gr02_edge_rules(spark, sf_dir).withColumn("app_id", F.lit("app")))


@_query(f"WITH {_TRIE} SELECT * FROM trie WHERE prefix = 'com.example' OR starts_with(prefix, 'com.example.')")
def tr03_subtree(spark, sf_dir):
    return tr.subtree(tr.build(page_names(spark, sf_dir)), "com.example")


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT -s_suppkey - 1, 'new' FROM supplier""")
def tr07_changes(spark, sf_dir):
    """A table of names after replacements, insertions and deletions."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = rows.filter("c_custkey % 3 = 0").select("c_custkey").union(read(spark, sf_dir, "supplier").select(-F.col("s_suppkey") - 1)).withColumn("c_name", F.lit("new"))
    return st.delete(st.upsert(rows, new, "c_custkey"), rows.filter("c_custkey % 5 = 0"), "c_custkey")


@_query("SELECT DISTINCT n_nationkey AS key FROM nation UNION SELECT DISTINCT c_nationkey FROM customer UNION SELECT s_nationkey + 20 FROM supplier")
def set01_union(spark, sf_dir):
    key = lambda t, c: read(spark, sf_dir, t).select(c.alias("key"))
    return st.union_distinct(key("nation", F.col("n_nationkey")), key("customer", F.col("c_nationkey")), key("supplier", F.col("s_nationkey") + 20))


@_query(f"""WITH {_TRIE}, f AS (SELECT * FROM types WHERE length(type_name) % 2 = 0)
SELECT type_name, super_name, 'framework' AS loader FROM f UNION ALL SELECT type_name, 'own' AS super_name, 'app' FROM types WHERE type_name NOT IN (SELECT type_name FROM f)""")
def ch01_load(spark, sf_dir):
    types = _types(spark, sf_dir)
    return hi.load(types.withColumn("super_name", F.lit("own")), types.filter(F.length("type_name") % 2 == 0))


@_query(f"""WITH {_TRIE}, q AS (SELECT DISTINCT name, CASE length(name) % 3 WHEN 0 THEN name WHEN 1 THEN '[[L' || replace(name, '.', '/') || ';' ELSE 'missing.' || name END AS wanted FROM names)
SELECT wanted, type_name, super_name, CASE WHEN length(name) % 3 = 1 THEN 2 ELSE 0 END AS dimensions FROM q JOIN types ON type_name = name WHERE length(name) % 3 < 2""")
def ch02_lookup(spark, sf_dir):
    n = F.col("name")
    wanted = F.when(F.length(n) % 3 == 0, n).when(F.length(n) % 3 == 1, F.concat(F.lit("[[L"), F.translate(n, ".", "/"), F.lit(";"))).otherwise(F.concat(F.lit("missing."), n))
    return hi.lookup(page_names(spark, sf_dir).select(wanted.alias("wanted")).distinct(), _types(spark, sf_dir))


@_query(f"""{_CLOSURE}, q AS (SELECT DISTINCT a.name AS sub, regexp_replace(b.name, '[.][^.]*$', '') AS super FROM names a JOIN names b ON b.page_id = a.page_id + 1)
SELECT sub, super, EXISTS (SELECT 1 FROM reach WHERE type_name = sub AND super_name = super) AS is_subclass FROM q""")
def ch05_is_subclass(spark, sf_dir):
    names = page_names(spark, sf_dir)
    pairs = names.select("page_id", F.col("name").alias("sub")).join(names.select((F.col("page_id") - 1).alias("page_id"), nm.parent(F.col("name")).alias("super")), "page_id").select("sub", "super").distinct()
    return hi.is_subclass(pairs, hi.closure(_types(spark, sf_dir)))


@_query(f"""{_CLOSURE}, i AS (SELECT type_name AS t FROM types WHERE length(type_name) % 4 = 0)
SELECT type_name, string_agg(super_name, ',' ORDER BY super_name) AS interfaces FROM reach WHERE super_name IN (SELECT t FROM i) AND type_name <> super_name GROUP BY type_name""")
def ch09_interfaces(spark, sf_dir):
    types = _types(spark, sf_dir)
    return hi.interfaces(hi.closure(types), types.filter(F.length("type_name") % 4 == 0)).select("type_name", F.array_join("interfaces", ",").alias("interfaces"))


_STATED = f"""{_CLOSURE}, k AS ({CORE["fn25_categories"].replace(_CLOSURE, "")}),
m AS (SELECT name AS type_name, page_id * 37 % 32768 AS flags FROM names),
h AS (SELECT type_name, count(*) FILTER (WHERE flags & 1 <> 0) AS p, count(*) FILTER (WHERE flags & 1 = 0) AS q FROM m WHERE flags & 4160 = 0 GROUP BY type_name)
SELECT category, count(*) AS classes, 0::BIGINT AS inner, coalesce(sum(p), 0)::BIGINT AS public_methods, coalesce(sum(q), 0)::BIGINT AS other_methods
FROM types JOIN k USING (type_name) LEFT JOIN h USING (type_name) GROUP BY category"""


@_query(_STATED.replace(" AS inner", ' AS "inner"'))
def agg18_statistics(spark, sf_dir):
    types = _types(spark, sf_dir)
    kinds = hi.category(hi.closure(types), {"com.example": "Com", "net.example": "Net", "com.example.thth": "Other"}, "OTHER")
    methods = page_names(spark, sf_dir).select(F.col("name").alias("type_name"), (F.col("page_id") * 37 % 32768).cast("int").alias("access_flags"))
    return hi.statistics(types, kinds, methods)


@_query(f"""WITH {_METHODS} SELECT 'methods' AS kind, count(*) AS n FROM mh UNION ALL SELECT 'classes', count(DISTINCT (app_id, package, class_name)) FROM mh
UNION ALL SELECT 'packages', count(DISTINCT (app_id, package)) FROM mh UNION ALL SELECT 'apps', count(DISTINCT app_id) FROM mh""")
def agg20_node_counts(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    return node_statistics(fingerprint(t["classes"], t["methods"], t["framework_types"], keep=materialize))


@_query(f"""WITH {_METHODS} SELECT DISTINCT app_id, package, class_name, c_mktsegment AS source_file, 'main.' || app_id AS main_activity FROM mh JOIN c USING (app_id, package, class_name) JOIN customer USING (c_custkey)""")
def jn12_enrich(spark, sf_dir):
    """Node tables without files and activities, which are joined from decoded tables."""
    t = decoded_apps(spark, sf_dir)
    profile = {"classes": fingerprint(t["classes"], t["methods"], t["framework_types"])["classes"].withColumn("source_file", F.lit(None).cast("string")), "apps": t["apps"]}
    made = programs.enrich(profile, t["classes"], t["apps"].withColumn("main_activity", F.concat(F.lit("main."), "app_id")))
    return made["classes"].join(made["apps"].select("app_id", "main_activity"), "app_id").select("app_id", "package", "class_name", "source_file", "main_activity")


@_query(f"WITH RECURSIVE {_TRADE}, back AS (SELECT dst AS src, src AS dst FROM trade), {walk('back', '1::BIGINT')} SELECT node FROM reach")
def df03_backward_slice(spark, sf_dir):
    from .queries import _trade

    return flow.backward_slice(_trade(spark, sf_dir), spark.sql("SELECT CAST(1 AS BIGINT) AS node"))


@_query("""SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, n_name AS dst_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def df07_rapid_types(spark, sf_dir):
    li, o, s, n, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "nation", "customer"))
    ends = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("dst"), F.col("n_name").alias("dst_type"))
    calls = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct().join(ends, "dst")
    made = c.filter("c_mktsegment = 'BUILDING'").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("type_name")).distinct()
    return flow.rapid_type_edges(calls, made).select("src", "dst", "dst_type")


@_query(f"""{_CLOSURE} SELECT type_name AS method, string_agg(DISTINCT field, ',' ORDER BY field) AS fields
FROM reach JOIN (SELECT type_name AS callee, 'f' || length(type_name) % 7 AS field FROM types WHERE length(type_name) % 3 = 1) ON super_name = callee GROUP BY 1""")
def df12_effects(spark, sf_dir):
    types = _types(spark, sf_dir)
    reach = hi.closure(types).select(F.col("type_name").alias("method"), F.col("super_name").alias("callee"))
    reads = types.filter(F.length("type_name") % 3 == 1).select(F.col("type_name").alias("method"), F.concat(F.lit("f"), (F.length("type_name") % 7).cast("string")).alias("field"))
    return flow.effects(reach, reads).select("method", F.array_join("fields", ",").alias("fields"))


@_query(f"WITH RECURSIVE {_TRADE}, thin AS (SELECT * FROM trade WHERE (src + dst) % 7 <> 0), {walk('thin', '(-1)::BIGINT')} SELECT node FROM reach")
def df14_thin_slice(spark, sf_dir):
    """The slice along some dependences only, as a thin slice has it."""
    from .queries import _trade

    return flow.forward_slice(_trade(spark, sf_dir).filter("(src + dst) % 7 <> 0"), spark.sql("SELECT CAST(-1 AS BIGINT) AS node"))


@_query(f"""WITH {_METHODS} SELECT app_id, md5(unhex(string_agg(DISTINCT hash, '' ORDER BY hash))) AS hash, count(*) AS n FROM mh GROUP BY app_id""")
def agg06_distinct_methods(spark, sf_dir):
    """Each app's distinct method hashes."""
    t = decoded_apps(spark, sf_dir)
    rows = fingerprint(t["classes"], t["methods"], t["framework_types"])["methods"].withColumn("one", F.lit(1).cast("long"))
    return mk.merkle(rows, ["app_id"], distinct=True, counts={"one": "n"})


@_query(f"WITH {_METHODS} SELECT app_id, hash FROM mh")
def prj04_method_hashes(spark, sf_dir):
    t = decoded_apps(spark, sf_dir)
    return pj.method_hashes(fingerprint(t["classes"], t["methods"], t["framework_types"]))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round(100.0::DOUBLE * o_custkey / (o_orderkey % 3 * 32), 2) END AS percentage FROM orders""")
def fn23_percentages(spark, sf_dir):
    """Shares of 32 and 64, which are exact; of nothing there is none."""
    return read(spark, sf_dir, "orders").select("o_orderkey", rp.percentage(F.col("o_custkey"), F.col("o_orderkey") % 3 * 32).alias("percentage"))


@_query(f"""WITH {_TRIE}, leaf AS (SELECT prefix, parent FROM trie WHERE prefix NOT IN (SELECT parent FROM trie)),
hit AS (SELECT parent AS prefix FROM leaf WHERE parent <> '' GROUP BY parent HAVING count(*) >= 2)
SELECT prefix FROM hit WHERE NOT EXISTS (SELECT 1 FROM hit above WHERE starts_with(hit.prefix, above.prefix || '.'))""")
def tr05_structural_matches(spark, sf_dir):
    """Where the tree of page names has the structure of a node with two childless children."""
    pattern = tr.build(spark.sql("SELECT * FROM VALUES ('p.a'), ('p.b') AS t(name)"))
    return tr.structural_matches(tr.build(page_names(spark, sf_dir)), pattern).select("prefix")


def _trading_types(spark, sf_dir):
    """Suppliers as types below their nations and regions, customers as types alone; what they ship and buy as methods.

    A customer's buy makes the suppliers of its order lines and has its region
    ship; a supplier's ship, its own or else its nation's, makes the customers
    of its returned lines, and has them buy. Entry is the first customer who
    orders.
    """
    li, o, s, c, n = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer", "nation"))
    of = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    types = s.select(of("s", "s_suppkey").alias("type_name"), of("n", "s_nationkey").alias("super_name")).union(n.select(of("n", "n_nationkey"), of("r", "n_regionkey"))).union(c.select(of("c", "c_custkey"), F.lit(None).cast("string")))
    ships = F.concat(F.when(F.col("s_suppkey") % 3 != 0, of("s", "s_suppkey")).otherwise(of("n", "s_nationkey")), F.lit(".ship"))
    dispatch = s.select(of("s", "s_suppkey").alias("type_name"), F.lit("ship").alias("selector"), ships.alias("target"))
    dispatch = dispatch.union(n.select(of("n", "n_nationkey"), F.lit("ship"), F.concat(of("n", "n_nationkey"), F.lit(".ship")))).union(c.select(of("c", "c_custkey"), F.lit("buy"), F.concat(of("c", "c_custkey"), F.lit(".buy"))))
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_returnflag").distinct()
    back = lines.filter("l_returnflag = 'R'").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    buys = F.concat(of("c", "o_custkey"), F.lit(".buy"))
    home = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    calls = lines.select("o_custkey").distinct().join(home, F.col("o_custkey") == F.col("c_custkey")).select(buys.alias("method"), of("r", "n_regionkey").alias("receiver"), F.lit("ship").alias("selector"))
    calls = calls.union(back.select(ships, of("c", "o_custkey"), F.lit("buy"))).distinct()
    news = lines.select(buys.alias("method"), of("s", "l_suppkey").alias("type_name")).union(back.select(ships, of("c", "o_custkey"))).distinct()
    entries = o.agg(F.concat(F.lit("c"), F.min("o_custkey").cast("string"), F.lit(".buy")).alias("method"))
    reach = materialize(hi.closure(types).unionByName(c.select(of("c", "c_custkey").alias("type_name"), of("c", "c_custkey").alias("super_name"), F.lit(0).cast("long").alias("distance"))).distinct(), "types")
    return entries, calls, dispatch, reach, news


_SITES = """l AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ship AS (SELECT s_suppkey AS s, n_nationkey AS n, n_regionkey AS r, CASE WHEN s_suppkey % 3 <> 0 THEN 's' || s_suppkey ELSE 'n' || s_nationkey END || '.ship' AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey),
runs AS (SELECT r, m FROM ship UNION SELECT n_regionkey, 'n' || n_nationkey || '.ship' FROM nation),
sites AS (SELECT DISTINCT 'c' || c || '.buy' AS src, m AS dst FROM (SELECT DISTINCT c FROM l) JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN runs ON r = n_regionkey
  UNION SELECT DISTINCT m, 'c' || l.c || '.buy' FROM l JOIN ship USING (s) WHERE f = 'R')"""


@_query(f"""WITH RECURSIVE {_SITES}, live AS (SELECT 'c' || min(o_custkey) || '.buy' AS m FROM orders UNION SELECT dst FROM live JOIN sites ON m = src)
SELECT src, dst FROM sites WHERE src IN (SELECT m FROM live)""")
def df06_calls_from_entries(spark, sf_dir):
    """What the first customer who orders may set going, by types alone."""
    from ..operators.flow import call_graph

    return call_graph(*_trading_types(spark, sf_dir)[:4])


def df07_calls_of_made_types(spark, sf_dir):
    """The same with the types that are made on the way; SQL has no recursion of two kinds of facts."""
    from ..operators.flow import call_graph

    return call_graph(*_trading_types(spark, sf_dir))


QUERIES["df07_calls_of_made_types"] = df07_calls_of_made_types
