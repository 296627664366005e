"""The core queries in SQL (DuckDB), written from what they mean, not from their Spark form."""

from __future__ import annotations

_ROLL = """
WITH o AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_custkey AS customer, md5(o_orderpriority || o_orderstatus) AS h
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT region, nation, customer, md5(unhex(string_agg({d} h, '' ORDER BY h))) AS h, count(*) AS n FROM o GROUP BY ALL),
n AS (SELECT region, nation, md5(unhex(string_agg({d} h, '' ORDER BY h))) AS h, sum(n) AS n FROM c GROUP BY ALL),
r AS (SELECT region, md5(unhex(string_agg({d} h, '' ORDER BY h))) AS h, sum(n) AS n FROM n GROUP BY ALL)
SELECT 'customer' AS level, customer::BIGINT AS key, h AS hash, n::BIGINT AS n_leaves FROM c
UNION ALL SELECT 'nation', nation, h, n FROM n UNION ALL SELECT 'region', region, h, n FROM r
"""
_NAMES = r"""names AS (
  SELECT page_id, array_to_string(list_concat(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')),
    list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[.].*$', ''), '/'), lambda s: s <> '')), '.') AS name
  FROM pages)"""


def _parent(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN regexp_replace({x}, '[.][^.]*$', '') ELSE '<none>' END"


def _depth(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, '.')) END)"


def _first(x: str, n: int) -> str:
    return f"array_to_string(string_split({x}, '.')[1:{n}], '.')"


_TRIE = f"""{_NAMES},
p AS (SELECT name, array_to_string(string_split(name, '.')[1:i], '.') AS prefix FROM names, LATERAL (SELECT unnest(range(1, len(string_split(name, '.')) + 1)) AS i)),
trie AS (SELECT prefix, CASE WHEN contains(prefix, '.') THEN regexp_replace(prefix, '[.][^.]*$', '') ELSE '' END AS parent,
  {_depth("prefix")}::BIGINT AS depth, sum(CASE WHEN prefix = name THEN 1 ELSE 0 END)::BIGINT AS own, count(*)::BIGINT AS below FROM p GROUP BY prefix),
types AS (SELECT prefix AS type_name, nullif(parent, '') AS super_name FROM trie)"""
_CLOSURE = f"""WITH RECURSIVE {_TRIE},
reach AS (SELECT type_name, type_name AS super_name, 0::BIGINT AS distance FROM types
  UNION ALL SELECT reach.type_name, types.super_name, distance + 1 FROM reach JOIN types ON reach.super_name = types.type_name WHERE types.super_name IS NOT NULL)"""
_DECLARED = "declared AS (SELECT type_name, 'run' AS selector FROM types WHERE length(type_name) % 3 = 0)"
_RESOLVED = f"""{_CLOSURE}, {_DECLARED},
resolved AS (SELECT r.type_name, selector, arg_min(r.super_name, distance) AS target FROM reach r JOIN declared d ON r.super_name = d.type_name GROUP BY ALL)"""
_SENT = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SHARED = f"""WITH RECURSIVE s AS (SELECT DISTINCT doc_id, md5(unnest({_SENT})) AS s FROM documents),
star AS (SELECT s, min(doc_id) AS m FROM s GROUP BY s),
e AS (SELECT DISTINCT doc_id AS a, m AS b FROM s JOIN star USING (s) UNION SELECT m, doc_id FROM s JOIN star USING (s)),
walk AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON walk.other = e.a),
comp AS (SELECT doc_id, min(other) AS component FROM walk GROUP BY doc_id)"""
_UNITS = "u AS (SELECT source AS app_id, md5(coalesce(text, '')) AS unit_hash, md5(lang) AS tree_hash, lang AS tree FROM documents)"


def _levels(table: str, key: str, p: str) -> str:
    return f"""{p}s AS (SELECT {key}, {_SENT} AS ss, coalesce(text, '') AS t FROM {table}),
{p}0 AS (SELECT {key}, md5(t) AS hash, len(ss)::BIGINT AS weight FROM {p}s),
{p}u AS (SELECT {key}, unnest(range(len(ss))) AS k1, unnest(ss) AS s FROM {p}s),
{p}1 AS (SELECT {key}, k1, md5(s) AS hash, len(string_split(s, ' '))::BIGINT AS weight FROM {p}u),
{p}w AS (SELECT {key}, k1, string_split(s, ' ') AS ws FROM {p}u),
{p}2 AS (SELECT {key}, k1, md5(array_to_string(ws[i:i + 4], ' ')) AS hash FROM {p}w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i))"""


_CASCADE = f"""WITH {_levels("documents", "doc_id", "d")},
{_levels("benchmark", "item_id", "b")},
h0 AS (SELECT DISTINCT doc_id FROM d0 WHERE hash IN (SELECT hash FROM b0)),
m1 AS (SELECT * FROM d1 WHERE doc_id NOT IN (SELECT doc_id FROM h0)),
h1 AS (SELECT DISTINCT doc_id, k1 FROM m1 WHERE hash IN (SELECT hash FROM b1)),
m2 AS (SELECT DISTINCT doc_id, hash FROM d2 WHERE doc_id NOT IN (SELECT doc_id FROM h0) AND (doc_id, k1) NOT IN (SELECT (doc_id, k1) FROM h1)),
v AS (SELECT doc_id, item_id, d0.weight FROM d0 JOIN b0 USING (hash) UNION ALL SELECT doc_id, item_id, m1.weight FROM m1 JOIN b1 USING (hash)
  UNION ALL SELECT doc_id, item_id, 1 FROM m2 JOIN b2 USING (hash)),
votes AS (SELECT doc_id, item_id, sum(weight)::BIGINT AS votes FROM v GROUP BY ALL)"""
# all order lines as edges: the customer to the supplier, and of returned lines the supplier back; suppliers are negated
_TRADE = """trade AS (SELECT DISTINCT o_custkey AS src, -l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT -l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""


def walk(edges: str, start: str, most: int = 12) -> str:
    """reach(node, distance): what edges lead to from start, in so many steps."""
    return f"""walk AS (SELECT {start} AS node, 0::BIGINT AS distance UNION SELECT dst, distance + 1 FROM walk JOIN {edges} ON node = src WHERE distance < {most}),
reach AS (SELECT node, min(distance) AS distance FROM walk GROUP BY node)"""


_FLOOD = f"WITH RECURSIVE {_TRADE}, {walk('trade', '(-1)::BIGINT')}"
_METHODS = """c AS (SELECT c_custkey, r_name AS app_id, 'com.' || n_name AS package, 'C' || c_custkey AS class_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, s_suppkey, 'com.' || n_name AS dst, CASE WHEN l_returnflag = 'R' THEN 'X' ELSE 'L' || l_returnflag END AS t
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT l_orderkey, string_agg('op-' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN '(I' || t || 'V)' ELSE '[' || t || ']' END, '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS code,
  coalesce(string_agg(DISTINCT '(I' || t || 'V)', ', ' ORDER BY '(I' || t || 'V)') FILTER (WHERE l_linestatus = 'O'), '') AS calls FROM l GROUP BY l_orderkey),
m AS (SELECT app_id, package, class_name, o_orderkey::INT AS method_idx, '(I' || CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE 'L' || o_orderstatus END || ')V' AS d, coalesce(code, '') AS code, coalesce(calls, '') AS calls
  FROM orders JOIN c ON o_custkey = c_custkey LEFT JOIN g ON o_orderkey = l_orderkey),
mh AS (SELECT app_id, package, class_name, method_idx, md5(code || d) AS hash, md5(d || '[' || calls || ']') AS simple_hash FROM m)"""
_FLAG = "p_partkey * 37 % 32768"
_FLAGS = {"public": 1, "private": 2, "protected": 4, "static": 8, "final": 16, "synchronized": 32, "bridge": 64, "varargs": 128, "native": 256, "interface": 512, "abstract": 1024, "strict": 2048, "synthetic": 4096, "annotation": 8192, "enum": 16384}

ORACLES = {
    "agg02_merkle_rollup": _ROLL.format(d=""),
    "agg06_merkle_distinct": _ROLL.format(d="DISTINCT"),
    "fn01_digests": "SELECT p_partkey, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, hex(p_name) AS upper_hex, p_name AS back FROM part",
    "fn04_names": f"""WITH {_NAMES} SELECT page_id, name, CASE WHEN contains(name, '.') THEN regexp_replace(name, '[.][^.]*$', '') ELSE '' END AS package,
  string_split(name, '.')[-1] AS simple, {_depth("name")}::BIGINT AS depth, {_first("name", 2)} AS first2, {_parent("name")} AS parent,
  {_parent("(" + _parent("name") + ")")} AS grandparent, 'L' || replace(name, '.', '/') || ';' AS descriptor, name AS round_trip, '"' || name || '"' AS quoted FROM names""",
    "fn12_relationships": f"""WITH {_NAMES}, n AS (SELECT DISTINCT name AS a, {_parent("name")} AS p FROM names),
pairs AS (SELECT n.a, o.a AS b FROM n JOIN n o USING (p) UNION SELECT a, p FROM n)
SELECT a, b, CASE WHEN starts_with(b, a || '.') THEN 'PARENT' WHEN starts_with(a, b || '.') THEN 'CHILD'
  WHEN contains(a, '.') AND contains(b, '.') AND regexp_replace(a, '[.][^.]*$', '') = regexp_replace(b, '[.][^.]*$', '') AND a <> b THEN 'SIBLING' ELSE 'UNRELATED' END AS relationship,
  abs({_depth("a")} - {_depth("b")}) <= 1 AS near, starts_with(a, b || '.') AS family FROM pairs""",
    "fn13_fuzzy_tokens": """WITH v AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' ')) AS word FROM benchmark),
d AS (SELECT doc_id, string_split(lower(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' ') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
j AS (SELECT doc_id, pos, v.word IS NOT NULL AS known, coalesce(v.word, 'X') AS t FROM w LEFT JOIN v USING (word) WHERE w.word <> ''),
s AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS signature, count(*) FILTER (WHERE known) AS n_known FROM j GROUP BY doc_id)
SELECT doc_id, md5(signature) AS hash, length(signature)::BIGINT AS n_chars, n_known FROM s""",
    "flt02_resource_names": """SELECT * FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'R$id' WHEN 2 THEN 'BuildConfig' WHEN 3 THEN 'Manifest$permission' ELSE p_brand END AS name FROM part)
WHERE NOT (name IN ('R', 'BuildConfig', 'Manifest') OR starts_with(name, 'R$') OR starts_with(name, 'Manifest$'))""",
    "flt05_flag_filters": f"""SELECT p_partkey, ({_FLAG} & 4160) = 0 AS hand, ({_FLAG} & 1) <> 0 AS public, ({_FLAG} & 1536) = 0 AND NOT contains(p_name, '$') AS candidate_class, ({_FLAG} & 5184) = 0 AS candidate_method,
  array_to_string(list_filter([{", ".join(f"CASE WHEN ({_FLAG} & {v}) <> 0 THEN '{k}' END" for k, v in _FLAGS.items())}], lambda x: x IS NOT NULL), ',') AS names FROM part""",
    "flt10_outside_app": f"""WITH {_NAMES} SELECT page_id, name, NOT (name = 'net.example' OR starts_with(name, 'net.example.')) AS not_net,
  string_split(name, '.')[1] IN ('com', 'org', 'net') AS top_level FROM names WHERE NOT starts_with(name, 'com.example')""",
    "flt18_not_done": "SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 45)",
    "agg07_edge_weights": """SELECT src, dst, call_count, getfield_count, call_count * 10 + getfield_count AS score FROM (
  SELECT c_mktsegment AS src, n_name AS dst, count(*) FILTER (WHERE l_returnflag <> 'R') AS call_count, count(*) FILTER (WHERE l_returnflag = 'R') AS getfield_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE n_regionkey IN (2, 3) GROUP BY ALL)""",
    "agg01_fingerprint": f"WITH {_METHODS} SELECT * FROM mh",
    "agg04_package_hashes": f"""WITH {_METHODS}, ch AS (SELECT app_id, package, class_name, md5(unhex(string_agg(hash, '' ORDER BY hash))) AS hash, count(*) AS n FROM mh GROUP BY ALL)
SELECT app_id, package, md5(unhex(string_agg(hash, '' ORDER BY hash))) AS hash, count(*) AS n_classes, sum(n)::BIGINT AS n_methods FROM ch GROUP BY app_id, package""",
    "gr01_dependency_edges": f"""WITH {_METHODS}, p AS (SELECT DISTINCT app_id, package AS dst FROM c)
SELECT app_id, c.package AS src, dst, count(*) FILTER (WHERE l_linestatus = 'O') AS call_count, count(*) FILTER (WHERE l_linestatus <> 'O') AS getfield_count, false AS inherits
FROM orders JOIN c ON o_custkey = c_custkey JOIN l ON o_orderkey = l_orderkey JOIN p USING (app_id, dst) GROUP BY ALL""",
    "gr02_edge_rules": f"""WITH {_NAMES}, e0 AS (SELECT a.name AS src, b.name AS dst FROM names a JOIN names b ON b.page_id = a.page_id + 1),
e AS (SELECT * FROM e0 UNION SELECT string_split(src, '.')[1], dst FROM e0),
r AS (SELECT *, {_first("src", 2)} <> {_first("dst", 2)} AS apart, CASE WHEN starts_with(src, 'com.example') THEN 1 WHEN starts_with(dst, 'com.example') THEN 2
  WHEN src IN ('', 'com', 'org', 'net') THEN 3 WHEN dst IN ('', 'com', 'org', 'net') THEN 4 WHEN string_split(src, '.')[1] <> string_split(dst, '.')[1] THEN 5
  WHEN {_first("src", 2)} <> {_first("dst", 2)} AND string_split(src, '.')[1] IN ('com', 'net') THEN 6
  WHEN {_first("src", 2)} <> {_first("dst", 2)} AND 'org' NOT IN (SELECT src FROM e) THEN 6 ELSE 7 END AS rule FROM e)
SELECT src, dst, rule, rule = 7 AS keep, rule IN (1, 3, 5, 6) AS calls_dst, rule IN (5, 6) OR (rule = 1 AND apart) AS called_edge FROM r""",
    "gr03_components": f"{_SHARED} SELECT doc_id, component FROM comp",
    "gr07_singletons": f"{_SHARED} SELECT min(doc_id) AS doc_id FROM comp GROUP BY component HAVING count(*) = 1",
    "gr08_uncalled": f"{_SHARED} SELECT component FROM comp GROUP BY component HAVING count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) = 0",
    "top05_largest_component": f"""{_SHARED}, z AS (SELECT source AS prefix, component, count(*) AS size FROM comp JOIN documents USING (doc_id) GROUP BY ALL)
SELECT prefix, component, size FROM z QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY size DESC, component) = 1""",
    "agg09_apps_of_units": f"WITH {_UNITS} SELECT unit_hash, string_agg(app_id, ',' ORDER BY app_id) AS apps, count(*) AS n_apps FROM u GROUP BY unit_hash",
    "agg11_tree_names": f"WITH {_UNITS} SELECT tree_hash, min(tree) AS tree FROM u GROUP BY tree_hash",
    "agg12_tree_counts": f"WITH {_UNITS} SELECT unit_hash, tree_hash, count(*) AS n FROM u GROUP BY ALL",
    "agg15_source_aware": """WITH u AS (SELECT source AS app_id, lang AS unit_id, md5(unhex(string_agg(md5(text), '' ORDER BY md5(text)))) AS h,
  md5('[' || string_agg(DISTINCT (n_chars % 7)::VARCHAR, ', ' ORDER BY (n_chars % 7)::VARCHAR) || ']') AS f FROM documents GROUP BY ALL)
SELECT app_id, unit_id, md5(unhex(h || f)) AS source_hash FROM u""",
    "agg16_unit_hashes": """WITH u AS (SELECT source, md5(unhex(string_agg(md5(text), '' ORDER BY md5(text)))) AS hash,
  '[' || string_agg(DISTINCT lang || '-' || n_chars % 5, ', ' ORDER BY lang || '-' || n_chars % 5) || ']' AS tree FROM documents GROUP BY source) SELECT *, md5(tree) AS tree_hash FROM u""",
    "jn02_vote_cascade": f"{_CASCADE} SELECT * FROM votes",
    "top02_top6_per_name": f"""{_CASCADE}, n AS (SELECT *, 'lib' || item_id % 3 AS name FROM votes),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY votes DESC, item_id) <= 6)
SELECT doc_id, item_id, votes, name, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, item_id)::INT AS rk FROM k""",
    "top02_top6_suppliers": """WITH v AS (SELECT o_custkey, l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
n AS (SELECT v.*, 'region' || n_regionkey AS name FROM v JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey, name ORDER BY votes DESC, l_suppkey) <= 6)
SELECT o_custkey, l_suppkey, votes, name, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, l_suppkey)::INT AS rk FROM k""",
    "jn07_overlap": f"""WITH d AS (SELECT doc_id, unnest({_SENT}) AS s FROM documents), b AS (SELECT item_id, unnest({_SENT}) AS s FROM benchmark)
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL""",
    "jn08_containment": f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_SENT}) AS s FROM documents), n AS (SELECT doc_id AS a, count(*) AS size FROM d GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
SELECT a, b, shared, shared / size AS ratio FROM p JOIN n USING (a) WHERE shared / size >= 0.7""",
    "jn11_siblings": f"""WITH {_NAMES}, n AS (SELECT DISTINCT name, string_split(name, '.') AS w FROM names),
c AS (SELECT name AS sibling, array_to_string(w[:-2], '.') AS root FROM n WHERE len(w) > 1),
q AS (SELECT name, array_to_string(w[:-2], '.') AS root FROM n WHERE len(w) > 2 UNION SELECT name, array_to_string(w[:-3], '.') FROM n WHERE len(w) > 3)
SELECT DISTINCT q.name, sibling FROM q JOIN c USING (root) WHERE q.name <> sibling""",
    "jn13_first_app": """SELECT l_suppkey::VARCHAR AS lib_hash, arg_min(l_orderkey, pos::BIGINT * 1000000000 + l_orderkey) AS app_id FROM (
  SELECT l_suppkey, l_orderkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL HAVING bool_or(l_returnflag = 'A')) GROUP BY l_suppkey""",
    "src17_range_lookup": """SELECT o_orderkey, o_totalprice, (SELECT min(b) FROM (VALUES (1000.0::DOUBLE), (5000), (20000), (50000), (100000), (200000), (400000)) t(b) WHERE b >= o_totalprice) AS bound FROM orders""",
    "set03_difference": "SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "set04_bags": f"""WITH d AS (SELECT doc_id, {_SENT} AS a FROM documents), j AS (SELECT d.doc_id, d.a, e.a AS b FROM d JOIN d e ON e.doc_id = d.doc_id + 1)
SELECT doc_id, len(list_filter(a, lambda x: list_contains(b, x)))::BIGINT AS shared, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same, len(list_distinct(list_concat(a, b)))::BIGINT AS either FROM j""",
    "set06_roots": f"""WITH {_NAMES}, n AS (SELECT name FROM names UNION SELECT {_parent("name")} AS p FROM names WHERE length(p) % 2 = 0)
SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE starts_with(n.name, m.name || '.'))""",
    "top08_prefix_search": "SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name LIMIT 7",
    "tr07_completion": """WITH e AS (SELECT min(c_name) AS lo, max(c_name) AS hi FROM customer WHERE starts_with(c_name, 'Cust'))
SELECT substr(lo, 1, (SELECT max(i) FROM range(1, 200) t(i) WHERE i <= length(lo) AND substr(lo, 1, i::INT) = substr(hi, 1, i::INT))::INT) AS completion FROM e""",
    "tr01_trie": f"WITH {_TRIE} SELECT * FROM trie",
    "tr02_roots_of_names": f"WITH {_NAMES} SELECT DISTINCT name, (SELECT arg_min(r, length(r)) FROM (SELECT DISTINCT {_first('name', 3)} AS r FROM names) WHERE r = n.name OR starts_with(n.name, r || '.')) AS root FROM names n",
    "tr04_contained": f"""WITH {_NAMES}, r AS (SELECT DISTINCT {_first("name", 3)} AS g, coalesce(string_split(name, '.')[4], '') AS prefix FROM names), s AS (SELECT * FROM r WHERE prefix <> '')
SELECT x.g AS a, y.g AS b FROM (SELECT DISTINCT g FROM s) x, (SELECT DISTINCT g FROM s) y WHERE x.g <> y.g AND NOT EXISTS (SELECT 1 FROM s WHERE s.g = x.g AND s.prefix NOT IN (SELECT prefix FROM s t WHERE t.g = y.g))""",
    "agg17_trie_summary": f"""WITH {_TRIE} SELECT string_split(prefix, '.')[1] AS top, count(*) AS nodes, sum(own)::BIGINT AS names, count(*) FILTER (WHERE own > 0) AS non_empty, max(depth) AS max_depth FROM trie GROUP BY 1""",
    "ch03_superclasses": f"{_CLOSURE} SELECT * FROM reach",
    "ch06_least_common": f"""{_CLOSURE}, q AS (SELECT DISTINCT a.name AS a, b.name AS b FROM names a JOIN names b ON b.page_id = a.page_id + 1)
SELECT p.a, p.b, arg_min(x.super_name, x.distance + y.distance) AS least FROM q p JOIN reach x ON x.type_name = p.a JOIN reach y ON y.type_name = p.b AND x.super_name = y.super_name GROUP BY ALL""",
    "ch07_subclasses": f"WITH {_TRIE} SELECT super_name, string_agg(type_name, ',' ORDER BY type_name) AS subclasses FROM types WHERE super_name IS NOT NULL GROUP BY super_name",
    "ch08_resolve": f"{_RESOLVED} SELECT * FROM resolved",
    "df06_call_targets": f"""{_RESOLVED} SELECT * FROM resolved UNION SELECT r.super_name AS type_name, 'run' AS selector, r.type_name AS target FROM reach r JOIN declared d ON r.type_name = d.type_name""",
    "fn25_categories": f"""{_CLOSURE} SELECT type_name, coalesce(arg_min(CASE super_name WHEN 'com.example' THEN 'Com' WHEN 'net.example' THEN 'Net' WHEN 'com.example.thth' THEN 'Other' END, distance), 'OTHER') AS category FROM reach GROUP BY type_name""",
    "df10_call_closure": """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
walk AS (SELECT x AS src, x AS dst, 0::BIGINT AS distance FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) UNION ALL SELECT walk.src, e.dst, distance + 1 FROM walk JOIN e ON walk.dst = e.src)
SELECT * FROM walk""",
    "df13_forward_slice": f"{_FLOOD} SELECT * FROM reach",
    "df11_pruned_calls": f"{_FLOOD} SELECT DISTINCT src, dst FROM trade JOIN reach ON src = node",
    "df18_control_flow": """WITH c AS (SELECT l_orderkey, l_linenumber AS pc, max(l_returnflag) = 'R' AS ends, max(CASE WHEN l_linestatus = 'O' THEN l_quantity::INT % 7 END) AS target FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, pc AS src, CASE WHEN NOT ends THEN lead(pc) OVER (PARTITION BY l_orderkey ORDER BY pc) END AS dst FROM c UNION SELECT l_orderkey, pc, target FROM c)
SELECT * FROM n WHERE dst IS NOT NULL""",
    "prj04_numbers": """SELECT r_name AS app_id, count(DISTINCT n_name) AS n_packages, count(DISTINCT c_custkey) AS n_classes, count(*) AS n_methods
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "prj05_library": """SELECT r_name AS app_id, min('com.' || n_name) AS name, string_agg(DISTINCT 'com.' || n_name, ',' ORDER BY 'com.' || n_name) AS packages, count(DISTINCT c_custkey) AS n_classes
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "gr04_class_components": """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey::VARCHAR AS app_id, 'com.c' || c_custkey AS src, 'org.s' || l_suppkey AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT * FROM e UNION SELECT app_id, dst, src FROM e),
walk AS (SELECT app_id, src AS x, src AS y FROM b UNION SELECT walk.app_id, x, dst FROM walk JOIN b ON walk.app_id = b.app_id AND y = src)
SELECT app_id, x AS class_name, min(y) AS component FROM walk GROUP BY app_id, x""",
    "fn26_lifecycle": """WITH p AS (SELECT p_partkey, ['Activity', 'Service', 'BroadcastReceiver', 'ContentProvider', 'Application', 'Fragment', 'OTHER'][p_partkey % 7 + 1] AS kind,
  ['onCreate()V', 'onStart()V', 'onDestroy()V', 'onCreate()Z', 'run()V'][p_size % 5 + 1] AS method FROM part)
SELECT *, CASE kind WHEN 'Activity' THEN method IN ('onStart()V', 'onDestroy()V') WHEN 'Fragment' THEN method IN ('onStart()V', 'onDestroy()V')
  WHEN 'Service' THEN method IN ('onCreate()V', 'onDestroy()V') WHEN 'ContentProvider' THEN method = 'onCreate()Z' WHEN 'Application' THEN method = 'onCreate()V' ELSE false END AS lifecycle FROM p""",
    "flt15_useful": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A$1' ELSE 'A$b' END AS name, p_size % 3 AS methods FROM part
WHERE p_partkey % 4 IN (2, 3) OR (p_partkey % 4 = 0 AND p_size % 3 <> 0)""",
    "str00_windowed_counts": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL",
}


def _merkle_trie(depth: int) -> str:
    """The digests of a trie, from its deepest level up."""
    own = "CASE WHEN own > 0 THEN md5(prefix) END"
    levels = []
    for k in range(depth, 0, -1):
        up = f"LEFT JOIN (SELECT parent AS prefix, md5(unhex(string_agg(node_hash, '' ORDER BY node_hash))) AS inside FROM l{k + 1} GROUP BY 1) USING (prefix)" if k < depth else ""
        inside = "inside" if k < depth else "NULL::VARCHAR"
        levels.append(f"l{k} AS (SELECT prefix, parent, CASE WHEN {inside} IS NULL THEN coalesce({own}, md5('')) WHEN own = 0 THEN {inside} ELSE md5(unhex({own} || {inside})) END AS node_hash FROM (SELECT * FROM trie WHERE depth = {k}) {up})")
    return f"WITH {_TRIE}, " + ",\n".join(levels) + "\n" + " UNION ALL ".join(f"SELECT prefix, node_hash FROM l{k}" for k in range(1, depth + 1))


#: Names of pages are less deep than this.
ORACLES["agg22_trie_hashes"] = _merkle_trie(12)
