"""Archives, manifests, lists, sinks, landing folders."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from hashloom.plans import programs
from hashloom.plans.tables import decoded_apps
from hashloom.sources import archives, lists, manifest, sinks
from hashloom.streaming.landing import match_landing, windowed_counts


def dex(classes):
    """A dex file of class definitions only: (descriptor, super or None, flags, file or None)."""
    strings = sorted({s for c in classes for s in (c[0], c[1], c[3]) if s})
    types = sorted({s for c in classes for s in c[:2] if s})
    head, at = 112, 112
    string_ids, at = at, at + 4 * len(strings)
    type_ids, at = at, at + 4 * len(types)
    defs, at = at, at + 32 * len(classes)
    data, offs = b"", []
    for s in strings:
        offs.append(at + len(data))
        data += bytes([len(s)]) + s.encode() + b"\0"
    out = bytearray(head)
    out[:8] = b"dex\n035\0"
    struct.pack_into("<II", out, 56, len(strings), string_ids)
    struct.pack_into("<II", out, 64, len(types), type_ids)
    struct.pack_into("<II", out, 96, len(classes), defs)
    out += struct.pack(f"<{len(strings)}I", *offs) + struct.pack(f"<{len(types)}I", *(strings.index(t) for t in types))
    for c, sup, flags, file in classes:
        none = archives.NONE
        out += struct.pack("<8I", types.index(c), flags, types.index(sup) if sup else none, 0, strings.index(file) if file else none, 0, 0, 0)
    return bytes(out) + data


def axml(package, activity):
    """A binary manifest with one launcher activity."""
    words = ["manifest", "package", package, "activity", "name", activity, "intent-filter", "action", manifest.MAIN, "category", manifest.LAUNCHER, "versionCode", "7"]
    body, offs = b"", []
    for w in words:
        offs.append(len(body))
        body += struct.pack("<H", len(w)) + w.encode("utf-16-le") + b"\0\0"
    begin = 28 + 4 * len(words)
    pool = struct.pack("<HHI5I", manifest.POOL, 28, begin + len(body), len(words), 0, 0, begin, 0) + struct.pack(f"<{len(words)}I", *offs) + body
    none = 0xFFFFFFFF

    def tag(name, /, **attributes):
        rows = b"".join(struct.pack("<IIIHBBI", none, words.index(k), words.index(v), 8, 0, manifest.STRING, words.index(v)) for k, v in attributes.items())
        return struct.pack("<HHIII", manifest.START, 16, 36 + len(rows), 1, none) + struct.pack("<IIHHHHHH", none, words.index(name), 20, 20, len(attributes), 0, 0, 0) + rows

    end = lambda name: struct.pack("<HHIIIII", manifest.END, 16, 24, 1, none, none, words.index(name))
    parts = pool + tag("manifest", package=package, versionCode="7") + tag("activity", name=activity) + tag("intent-filter") + tag("action", name=manifest.MAIN) + end("action") + tag("category", name=manifest.LAUNCHER) + end("category") + end("intent-filter") + end("activity") + end("manifest")
    return struct.pack("<HHI", 3, 8, 8 + len(parts)) + parts


@pytest.fixture
def apk(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("classes.dex", dex([("Lcom/x/A;", "Ljava/lang/Object;", 1, "A.java"), ("Lcom/x/B;", None, 0x200, None)]))
        z.writestr("classes2.dex", dex([("Lcom/x/A;", None, 2, None)]))
        z.writestr("AndroidManifest.xml", axml("com.x", ".Main"))
    return tmp_path


def test_archive(spark, apk):
    rows = archives.classes(spark, str(apk)).orderBy("class_desc").collect()
    assert [(r.entry, r.class_desc, r.super_desc, r.access_flags, r.source_file) for r in rows] == [
        ("classes.dex", "Lcom/x/A;", "Ljava/lang/Object;", 1, "A.java"),
        ("classes.dex", "Lcom/x/B;", None, 0x200, None),
    ]


def test_manifest(spark, apk):
    r = manifest.apps(spark, str(apk)).first()
    assert (r.package_name, r.version_code, r.version_name, r.main_activity) == ("com.x", "7", None, "com.x.Main")


def test_framework_jar(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("java/lang/Object.class", b"")
        z.writestr("readme.txt", b"")
    (tmp_path / "fw.jar").write_bytes(out.getvalue())
    assert [r.type_desc for r in archives.framework_types(spark, str(tmp_path)).collect()] == ["Ljava/lang/Object;"]


def test_not_a_dex():
    with pytest.raises(ValueError):
        archives.dex_classes(b"nothing")


def test_lists(spark, tmp_path):
    (tmp_path / "libs.csv").write_text("h1,p.a/p.b\nh2,h1,q\n\n")
    (tmp_path / "apks.csv").write_text("s1---h1,h2\nnone\n")
    (tmp_path / "names.txt").write_text(" a \n\nb\n")
    assert [(r.lib_hash, r.representative, r.packages) for r in lists.libraries(spark, str(tmp_path / "libs.csv")).orderBy("lib_hash").collect()] == [("h1", "h1", ["p.a", "p.b"]), ("h2", "h1", ["q"])]
    assert [(r.app_id, r.pos, r.lib_hash) for r in lists.app_libraries(spark, str(tmp_path / "apks.csv")).collect()] == [("s1", 0, "h1"), ("s1", 1, "h2")]
    assert sorted(r.key for r in lists.words(spark, str(tmp_path / "names.txt")).collect()) == ["a", "b"]


def test_profile_round_trip_and_resume(spark, sf_dir, tmp_path):
    tables = decoded_apps(spark, sf_dir)
    for n, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{n}")
    programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/out")
    first = lists.profile(spark, f"{tmp_path}/out")["apps"].count()
    assert first == tables["apps"].count() > 0
    programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/out", resume=True)
    assert lists.profile(spark, f"{tmp_path}/out")["apps"].count() == first
    programs.run(spark, "CLUSTER", f"{tmp_path}/out", f"{tmp_path}/units")
    assert sinks.read_unit_hashes(spark, f"{tmp_path}/units").count() > 0
    assert {r.kind for r in sinks.node_statistics(lists.profile(spark, f"{tmp_path}/out")).collect()} == {"apps", "packages", "classes", "methods", "edges"}


def test_report_lines(spark, tmp_path):
    found = spark.createDataFrame([("app", "u", "L", True), ("app", "v", "M", False)], "app_id string, unit_id string, name string, fully boolean")
    sinks.write_report(found, f"{tmp_path}/r")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/r").collect()) == ["Fully found lib: u---->L", "found lib: v---->M"]


def test_landing(spark, tmp_path):
    rows = "app_id string, unit_id string, hash string, weight long"
    spark.createDataFrame([("a", "u", "h", 3), ("a", "u", "no", 9)], rows).write.parquet(f"{tmp_path}/land")
    index = spark.createDataFrame([("h", "lib")], "hash string, lib_hash string")
    libs = spark.createDataFrame([("lib", "Lib")], "lib_hash string, name string")
    match_landing(spark, f"{tmp_path}/land", rows, index, libs, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [(r.name, r.votes) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("Lib", 3)]


def test_windows_agree_with_the_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("value"))
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events).collect()))
