"""The programs from app packages to a report, and against plain loops."""

import hashlib
from collections import Counter, defaultdict

from hashloom.__main__ import main
from hashloom.operators.units import recover
from hashloom.plans import programs
from hashloom.plans.queries import _profile, program_cluster
from hashloom.sources.runs import UnitState
from hashloom.sources.sinks import read_profile, read_provenance, read_unit_hashes
from hashloom.storage import scope
from test_bytecode import FOO, app, dex_of


def of(hashes):
    return hashlib.md5(bytes.fromhex("".join(sorted(hashes)))).hexdigest()


def package(name, n, kind="I"):
    """A class with n methods whose code differs."""
    cls = f"L{name.replace('.', '/')}/A;"
    own = [(f"m{i}", (kind,) * (i + 1), "V", 1, [0x0012] * (i + 1) + [0x106E, ("method", FOO, "m", ("I",), "V"), 0x0000, 0x000E]) for i in range(n)]
    return (cls, "Ljava/lang/Object;", 1, "A.java", own)


def test_from_packages_to_a_report(spark, tmp_path):
    """A library taken from one app is found in another, under other names."""
    (tmp_path / "apks").mkdir()
    (tmp_path / "fw").mkdir()
    app(tmp_path / "apks" / "first.apk", dex_of([package("net.lib.core", 6), package("com.first.ui", 2)]), "com.first")
    app(tmp_path / "apks" / "second.apk", dex_of([package("a.b.c", 6), package("com.second.ui", 3)]), "com.second")
    app(tmp_path / "apks" / "third.apk", dex_of([package("x.y.z", 4, "J"), package("com.third.ui", 3)]), "com.third")
    import zipfile

    with zipfile.ZipFile(tmp_path / "fw" / "fw.jar", "w") as z:
        z.writestr("java/lang/Object.class", b"")
    at = lambda n: str(tmp_path / n)
    main(["PARSE", at("apks"), at("profile"), "--framework", at("fw")])
    apps = {r.package_name: r.app_id for r in read_profile(spark, at("profile"))["apps"].collect()}
    assert set(apps) == {"com.first", "com.second", "com.third"}
    (lib,) = [r.hash for r in read_profile(spark, at("profile"))["packages"].filter(f"app_id = '{apps['com.first']}' AND package = 'net.lib.core'").collect()]
    lib_hash = of([lib])
    (tmp_path / "libs.csv").write_text(f"{lib_hash},net.lib.core\n")
    (tmp_path / "apks.csv").write_text(f"{apps['com.third']}---{lib_hash}\n{apps['com.first']}---{lib_hash}\n")
    main(["STORE", at("profile"), at("found"), "--libs", at("libs.csv"), "--apps", at("apks.csv")])
    assert [tuple(r) for r in read_provenance(spark, at("found")).collect()] == [(lib_hash, apps["com.first"])]
    main(["INDEX", at("profile"), at("index"), "--libs", at("libs.csv"), "--found", at("found")])
    main(["MATCH", at("profile"), at("report"), "--index", at("index")])
    found = {(r.app_id, r.value) for r in spark.read.text(at("report")).collect()}
    assert {a for a, _ in found} == {apps["com.first"], apps["com.second"]}
    assert all(line.endswith("---->net.lib.core") for _, line in found)
    for _ in range(2):
        main(["CLUSTER", at("profile"), at("units"), "--run", "one", "--state", at("state")])
    assert read_unit_hashes(spark, at("units")).filter(f"unit_hash = '{lib_hash}'").count() == 2
    assert [r.n for r in UnitState(spark, at("state")).counts().filter(f"unit_hash = '{lib_hash}'").collect()] == [2]


def test_cluster_by_plain_loops(spark, sf_dir):
    profile = {k: v.collect() for k, v in _profile(spark, sf_dir).items()}
    own = {r.app_id: ".".join(r.package_name.split(".")[:2]) for r in profile["apps"]}
    two = lambda n: n.split(".")[:2]
    kept, called, vertices = defaultdict(list), defaultdict(set), defaultdict(set)
    for e in profile["edges"]:
        vertices[e.app_id] |= {e.src, e.dst}
    tops = {"com", "org"}
    for e in profile["edges"]:
        a, s, d = e.app_id, e.src, e.dst
        if s.startswith(own[a]) or (not d.startswith(own[a]) and s in ("", *tops)):
            called[a].add(d)
        elif d.startswith(own[a]) or d in ("", *tops):
            pass
        elif s.split(".")[0] != d.split(".")[0] or (s.split(".")[0] in tops and s.split(".")[0] not in vertices[a] and two(s) != two(d)):
            called[a].add(d)
        else:
            kept[a].append((s, d))
    packages = defaultdict(dict)
    for r in profile["packages"]:
        if not r.package.startswith(own[r.app_id]) and r.package not in tops:
            packages[r.app_id][r.package] = r.hash
    want = Counter()
    for a, of_app in packages.items():
        root = {}
        find = lambda p: p if root.setdefault(p, p) == p else find(root[p])  # noqa: E731, B023
        for s, d in kept[a]:
            root[find(s)] = find(d)
        groups = defaultdict(list)
        for p in of_app:
            if p in root:
                groups[find(p)].append(p)
        for unit in recover(groups.values(), [p for p in of_app if p not in root], called[a] & set(of_app)):
            want[a, unit[0], of(of_app[p] for p in unit)] += 1
    got = Counter((r.app_id, r.unit_id, r.unit_hash) for r in program_cluster(spark, sf_dir).collect())
    assert got == want


def test_a_scope_leaves_nothing(spark, sf_dir):
    from hashloom.storage import materialize

    with scope():
        kept = materialize(spark.range(5).toDF("n"), "kept")
        path = kept.written_to
        assert spark.read.parquet(path).count() == 5
        programs.candidate_units({k: v for k, v in _profile(spark, sf_dir).items()}).count()
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_parse_reads_code_once(spark, sf_dir, monkeypatch):
    """Hashes and edges come from one written table, which has no code; edges are those of dependency_edges."""
    from hashloom.operators import edges as ed
    from hashloom.plans import queries
    from hashloom.plans.tables import decoded_apps

    kept, write = [], programs.materialize
    for module in (programs, queries):
        monkeypatch.setattr(module, "materialize", lambda df, tag: kept.append(df) or write(df, tag))
    made, t = _profile(spark, sf_dir), decoded_apps(spark, sf_dir)
    assert not any("code" in df.columns for df in kept)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(made["edges"]) == rows(ed.dependency_edges(t["classes"], t["methods"]))


def test_names_by_string_functions(spark):
    from pyspark.sql import functions as F

    from hashloom.functions import names as nm
    from hashloom.operators.fingerprint import bare, element

    n = F.col("n")
    df = spark.createDataFrame([(x,) for x in ("", "a", "a.b", "a.b.c", ".a", "a.", "a..b", "La/b/C;", "LL;", "L", ";", ";;", "[[Lx/Y;", "[I", "I", "é.ü.😀x", None)], "n string")
    dotted = F.translate(F.regexp_replace(F.regexp_replace(n, "^L", ""), ";$", ""), "/", ".")
    old = [F.regexp_replace(n, r"\.?[^.]*$", ""), dotted, F.regexp_replace(n, ";$", ""), F.regexp_replace(F.regexp_replace(n, ";$", ""), r"^\[+", "")]
    for r in df.select(F.array(*old).alias("old"), F.array(nm.package(n), nm.dotted(n), bare(n), element(n)).alias("new")).collect():
        assert r.old == r.new
