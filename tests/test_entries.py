"""Archives read entry by entry, and class files, against the plain scan and built bytes."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from hashloom.operators import hierarchy as hi
from hashloom.sources import archives, entries
from hashloom.sources.classfile import ClassFile, descriptors
from test_bytecode import GOLDEN, app, dex_of


def class_of(name, above=None, interfaces=(), flags=1, fields=(), methods=(), source=None):
    """A class file; fields and methods are (flags, name, descriptor)."""
    pool, seen = [], {}

    def text(t):
        if ("t", t) not in seen:
            raw = t.encode().replace(b"\0", b"\xc0\x80")
            pool.append(b"\x01" + struct.pack(">H", len(raw)) + raw)
            seen["t", t] = len(pool)
        return seen["t", t]

    def ref(t):
        at = text(t)
        if ("c", t) not in seen:
            pool.append(b"\x07" + struct.pack(">H", at))
            seen["c", t] = len(pool)
        return seen["c", t]

    # constants of all kinds; a long takes two numbers
    pool += [b"\x05" + b"\0" * 8, b"", b"\x03" + b"\0" * 4, b"\x08\0\x01", b"\x0c\0\1\0\1", b"\x0f\1\0\1", b"\x12" + b"\0" * 4]
    body = struct.pack(">HHH", flags, ref(name), ref(above) if above else 0)
    body += struct.pack(f">H{len(interfaces)}H", len(interfaces), *map(ref, interfaces))
    for own in (fields, methods):
        body += struct.pack(">H", len(own))
        for f, n, d in own:
            body += struct.pack(">HHHHHI3s", f, text(n), text(d), 1, text("Extra"), 3, b"abc")
    body += struct.pack(">HHIH", 1, text("SourceFile"), 2, text(source)) if source else struct.pack(">H", 0)
    return b"\xca\xfe\xba\xbe\0\0\0\x34" + struct.pack(">H", len(pool) + 1) + b"".join(pool) + body


def rows(df):
    return sorted(map(str, df.drop("path").collect()))


@pytest.fixture(scope="module")
def packages(tmp_path_factory):
    at = tmp_path_factory.mktemp("packages")
    many = lambda k: dex_of([(f"Lcom/x/C{k}_{i};", "Ljava/lang/Object;", 1, None, [("f", (), "V", 1, [0x000E])]) for i in range(3)] + GOLDEN)
    with zipfile.ZipFile(at / "four.apk", "w") as z:
        for k, n in enumerate(("classes.dex", "classes2.dex", "classes3.dex", "classes4.dex")):
            z.writestr(n, many(k))
        z.writestr("lib/none.dex", b"not at the root")
    app(at / "one.apk", dex_of(GOLDEN))
    (at / "bare.apk").write_bytes(dex_of(GOLDEN))
    with zipfile.ZipFile(at / "broken.apk", "w") as z:
        z.writestr("classes.dex", many(9))
        z.writestr("classes2.dex", many(8)[:90])
    (at / "no.apk").write_bytes(b"no archive at all")
    return str(at)


@pytest.mark.parametrize("split", [0, 1000, entries.SPLIT_BYTES])
def test_the_same_rows_as_the_plain_scan(spark, packages, split):
    plain, own = archives.scan(spark, packages, code=True), entries.scan_entries(spark, packages, code=True, split_bytes=split)
    assert own.columns == plain.columns
    # error texts differ where a broken part is found on the way to it
    ok = lambda df: rows(df.filter("error IS NULL"))
    assert ok(own) == ok(plain) and len(ok(own)) == 15
    failed = lambda df: sorted((r.path.rsplit("/")[-1], r.app_id) for r in archives.failures(df).collect())
    assert failed(own) == failed(plain) and [n for n, _ in failed(own)] == ["broken.apk", "no.apk"]


def test_four_dex_files_in_four_tasks(spark, packages):
    entries.register(spark)
    source = spark.read.format("archive_entries").options(code="true", splitbytes="0").load(f"{packages}/four.apk")
    of = source.filter("kind = 'class'").groupBy(F.spark_partition_id()).agg(F.collect_set("entry").alias("entries")).collect()
    assert sorted(r.entries for r in of) == [["classes.dex"], ["classes2.dex"], ["classes3.dex"], ["classes4.dex"]]


def test_filters_reach_the_source(spark, packages):
    reader = entries.EntryReader({"path": packages, "splitbytes": "0"})
    list(reader.pushFilters([entries.EqualTo(("entry",), "classes2.dex")]))
    assert [p for part in reader.partitions() for _, p in part.archives if p] == [[1], [1]]
    entries.register(spark)
    source = spark.read.format("archive_entries").options(code="true", splitbytes="0").load(packages)
    found = source.filter("class_desc = 'Lcom/x/C2_1;'")
    assert [(r.entry, len(r.methods)) for r in found.collect()] == [("classes3.dex", 1)]
    assert source.filter("kind = 'digest'").count() == 5
    one = reader.rows(f"{packages}/four.apk", None)
    reader.classes = {"Lcom/x/C1_0;"}
    assert [r["class_desc"] for r in one if r["kind"] == "class"] == ["Lcom/x/C1_0;"]


def test_class_files():
    data = class_of("a/B", "a/A", ["i/I", "i/J"], 0x21, [(2, "f", "[I")], [(1, "<init>", "()V"), (9, "g", "(I[Ljava/lang/String;[[JLa/B;)La/B;")], "B.java")
    row = ClassFile(data).row(True)
    assert row["class_desc"] == "La/B;" and row["super_desc"] == "La/A;" and row["interfaces"] == ["Li/I;", "Li/J;"] and row["access_flags"] == 0x21 and row["source_file"] == "B.java"
    assert row["fields"] == [{"name": "f", "type": "[I", "access_flags": 2}]
    assert [(m["name"], m["param_types"], m["return_type"]) for m in row["methods"]] == [("<init>", [], "V"), ("g", ["I", "[Ljava/lang/String;", "[[J", "La/B;"], "La/B;")]
    assert ClassFile(class_of("java/lang/Object")).above is None and descriptors("") == []
    for n in range(len(data)):
        with pytest.raises((ValueError, IndexError, KeyError)):
            ClassFile(data[:n])


def test_a_framework_fills_a_hierarchy(spark, tmp_path):
    classes = {"java/lang/Object": (None, []), "a/I": ("java/lang/Object", []), "a/J": ("java/lang/Object", ["a/I"]), "a/A": ("java/lang/Object", ["a/J"]), "a/B": ("a/A", []), "a/C": ("a/B", ["a/I"]), "b/D": ("java/lang/Object", [])}
    with zipfile.ZipFile(tmp_path / "fw.jar", "w") as z:
        for n, (above, interfaces) in classes.items():
            z.writestr(f"{n}.class", class_of(n, above, interfaces, 0x600 if n in ("a/I", "a/J") else 1, methods=[(1, "run", "()V")] if n in ("a/I", "a/B") else []))
        z.writestr("module-info.class", b"skipped")
    (tmp_path / "bad.jar").write_bytes(b"PK nothing")
    with zipfile.ZipFile(tmp_path / "cut.jar", "w") as z:
        z.writestr("a/X.class", class_of("a/X")[:20])
    scanned = archives.scan(spark, str(tmp_path), ".jar", code=True)
    assert sorted(r.path.rsplit("/")[-1] for r in archives.failures(scanned).collect()) == ["bad.jar", "cut.jar"]
    assert rows(entries.scan_entries(spark, str(tmp_path), ".jar", code=True, split_bytes=0).filter("error IS NULL")) == rows(scanned.filter("error IS NULL"))
    types = archives.hierarchy(scanned)
    got = {(r.type_name, r.super_name): r.distance for r in hi.closure(types).collect()}
    want, dotted = {}, lambda n: n.replace("/", ".")
    for n in classes:
        far, level = {n: 0}, [n]
        while level:
            level = [u for x in level for u in [classes[x][0], *classes[x][1]] if u and far.setdefault(u, far[x] + 1) == far[x] + 1]
        want |= {(dotted(n), dotted(u)): d for u, d in far.items()}
    assert got == want
    reach = hi.closure(types)
    faces = types.filter("is_interface").select("type_name").distinct()
    assert {r.type_name: r.interfaces for r in hi.interfaces(reach, faces).collect()} == {"a.J": ["a.I"], "a.A": ["a.I", "a.J"], "a.B": ["a.I", "a.J"], "a.C": ["a.I", "a.J"]}
    declared = archives.methods(scanned).select(F.regexp_replace(F.regexp_replace("class_desc", "^L|;$", ""), "/", ".").alias("type_name"), F.col("name").alias("selector"))
    calls = spark.createDataFrame([("a.C", "run"), ("a.A", "run"), ("b.D", "run")], "type_name string, selector string")
    assert {r.type_name: r.target for r in hi.resolve(calls, declared, reach).collect()} == {"a.C": "a.B", "a.A": "a.I"}
