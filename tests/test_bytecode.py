"""Dex files with code: from the bytes of an app to golden hashes."""

import struct
import zipfile

import pytest

from hashloom.operators.fingerprint import fingerprint
from hashloom.plans import programs
from hashloom.sources import archives, bytecode
from test_sources_and_streams import axml


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def dex_of(classes):
    """A dex file of (class, super, flags, file, [(name, arguments, returned, flags, units or None)]); units name what they refer to."""
    protos, methods, fields, strings = [], [], [], set()

    def add(table, x):
        if x not in table:
            table.append(x)
        return table.index(x)

    for cls, above, _, file, own in classes:
        strings |= {cls, above, file} - {None}
        for name, args, returned, _, units in own:
            add(methods, (cls, add(protos, (args, returned)), name))
            for u in units or ():
                if isinstance(u, tuple) and u[0] == "method":
                    add(methods, (u[1], add(protos, (u[3], u[4])), u[2]))
                elif isinstance(u, tuple):
                    add(fields, u[1:])
    methods.sort(key=lambda m: (m[0] != classes[0][0], m[0]))
    types = {t for p in protos for t in (*p[0], p[1])} | {m[0] for m in methods} | {t for f in fields for t in f[:2]} | {c[0] for c in classes} | {c[1] for c in classes if c[1]}
    strings |= types | {m[2] for m in methods} | {f[2] for f in fields}
    strings, types = sorted(strings), sorted(types)
    at, places = 112, []
    for n, size in ((len(strings), 4), (len(types), 4), (len(protos), 12), (len(fields), 8), (len(methods), 8), (len(classes), 32)):
        places.append((n, at))
        at += n * size
    data = bytearray()

    def put(b, align=1):
        data.extend(b"\0" * (-(at + len(data)) % align))
        data.extend(b)
        return at + len(data) - len(b)

    strings_at = [put(number(len(s)) + s.encode() + b"\0") for s in strings]
    lists = [put(struct.pack(f"<I{len(a)}H", len(a), *map(types.index, a)), 4) if a else 0 for a, _ in protos]
    defs = b""
    for cls, above, flags, file, own in classes:
        rows = []
        for name, args, returned, f, units in own:
            told = []
            for u in units or ():
                if isinstance(u, tuple):
                    u = methods.index((u[1], protos.index((u[3], u[4])), u[2])) if u[0] == "method" else fields.index(u[1:])
                told.append(u)
            code = put(struct.pack(f"<4H2I{len(told)}H", 4, 1, 1, 0, 0, len(told), *told), 4) if units is not None else 0
            rows.append((methods.index((cls, protos.index((args, returned)), name)), f, code))
        rows.sort()
        body = number(0) * 2 + number(0) + number(len(rows))
        for i, (k, f, code) in enumerate(rows):
            body += number(k - (rows[i - 1][0] if i else 0)) + number(f) + number(code)
        none = bytecode.NONE
        defs += struct.pack("<8I", types.index(cls), flags, types.index(above) if above else none, 0, strings.index(file) if file else none, 0, put(body), 0)
    head = bytearray(112)
    head[:8] = b"dex\n035\0"
    for where, (n, place) in zip((56, 64, 72, 80, 88, 96), places, strict=True):
        struct.pack_into("<II", head, where, n, place)
    ids = struct.pack(f"<{len(strings)}I", *strings_at) + struct.pack(f"<{len(types)}I", *map(strings.index, types))
    ids += b"".join(struct.pack("<3I", 0, types.index(r), p) for (_, r), p in zip(protos, lists, strict=True))
    ids += b"".join(struct.pack("<HHI", types.index(c), types.index(t), strings.index(n)) for c, t, n in fields)
    ids += b"".join(struct.pack("<HHI", types.index(c), p, strings.index(n)) for c, p, n in methods)
    return bytes(head) + ids + defs + bytes(data)


S, O, FOO = "Ljava/lang/String;", "Ljava/lang/Object;", "Lcom/x/Foo;"
# const/4; invoke-virtual Foo.m(I)V; iget-object Foo.s; return-object
CODE = [0x0012, 0x106E, ("method", FOO, "m", ("I",), "V"), 0x0000, 0x0054, ("field", FOO, S, "s"), 0x0011]
GOLDEN = [("Lcom/x/A;", O, 1, "A.java", [("f", (FOO, "I"), S, 1, CODE), ("g", (), "V", 0x401, None), ("<init>", (), "V", 1, [0x000E])])]


def app(path, data, package="com.x"):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("classes.dex", data)
        z.writestr("AndroidManifest.xml", axml(package, ".Main"))


def test_opcodes():
    known = bytecode.instructions()
    assert len(known) == 218 and max(known) == 0xE2
    # some of the public description, from all over it
    told = {0x00: "nop", 0x05: "move-wide/from16", 0x09: "move-object/16", 0x0D: "move-exception", 0x11: "return-object", 0x12: "const/4", 0x19: "const-wide/high16", 0x1A: "const-string", 0x21: "array-length", 0x28: "goto", 0x2D: "cmpl-float", 0x30: "cmpg-double", 0x31: "cmp-long", 0x37: "if-le", 0x38: "if-eqz", 0x44: "aget", 0x4A: "aget-short", 0x4B: "aput", 0x54: "iget-object", 0x5F: "iput-short", 0x60: "sget", 0x6D: "sput-short", 0x6E: "invoke-virtual", 0x72: "invoke-interface", 0x78: "invoke-interface/range", 0x7B: "neg-int", 0x80: "neg-double", 0x81: "int-to-long", 0x84: "long-to-int", 0x8C: "double-to-float", 0x8D: "int-to-byte", 0x8F: "int-to-short", 0x90: "add-int", 0x9A: "ushr-int", 0x9B: "add-long", 0xA6: "add-float", 0xAF: "rem-double", 0xB0: "add-int/2addr", 0xCF: "rem-double/2addr", 0xD0: "add-int/lit16", 0xD1: "rsub-int", 0xD7: "xor-int/lit16", 0xD8: "add-int/lit8", 0xD9: "rsub-int/lit8", 0xE2: "ushr-int/lit8"}
    assert {op: known[op][0] for op in told} == told
    units = {0x01: 1, 0x02: 2, 0x03: 3, 0x14: 3, 0x18: 5, 0x1B: 3, 0x29: 2, 0x2A: 3, 0x2B: 3, 0x26: 3, 0x6E: 3, 0x90: 2, 0xB0: 1, 0xD0: 2, 0x24: 3}
    assert {op: known[op][1] for op in units} == units


def test_tables_of_values_are_no_instructions():
    units = [0x002B, 4, 0, 0x000E, bytecode.PACKED, 1, 0, 0, 7, 0, 0x0000, bytecode.SPARSE, 1, 1, 0, 2, 0, bytecode.VALUES, 1, 3, 0, 0x0201, 0x0003, 0x000E]
    data = dex_of([("La/A;", None, 1, None, [("f", (), "V", 1, units)])])
    dex = bytecode.Dex(data)
    (cls,) = dex.classes()
    (m,) = dex.class_methods(cls[4])
    assert [(i["pc"], i["opcode"]) for i in m["code"]] == [(0, "packed-switch"), (3, "return-void"), (10, "nop"), (23, "return-void")]


def test_golden_hashes_from_bytes(spark, tmp_path):
    app(tmp_path / "a.apk", dex_of(GOLDEN))
    framework = spark.createDataFrame([(S,), (O,)], "type_desc string")
    t = archives.decoded_apps(spark, str(tmp_path), framework)
    assert [(r.package_name, r.main_activity) for r in t["apps"].collect()] == [("com.x", "com.x.Main")]
    nodes = fingerprint(t["classes"], t["methods"], t["framework_types"])
    assert {r.hash for r in nodes["methods"].collect()} == {"3d6e75a7ac45c5db7bf83449cef3e0c4", "62febe830a4a6764c634d9e263964cee"}
    assert {r.simple_hash for r in nodes["methods"].collect()} == {"51bb443c4af926fc729e3bbf46c59a0d", "c3aece59bb18d8f8113b0775f7feb3c5"}
    assert [r.hash for r in nodes["classes"].collect()] == ["6a4ee1724224816fd17c6a69b9db8e4d"]
    assert [r.hash for r in nodes["packages"].collect()] == ["528b0250e7e147807e87de91f55842e3"]
    assert [r.hash for r in nodes["apps"].collect()] == ["fbd1b827715ecece24549edf0664562a"]
    profile = programs.parse(t)
    assert profile["apps"].count() == 1 and profile["methods"].count() == 2


def test_a_broken_archive_leaves_the_others(spark, tmp_path):
    app(tmp_path / "good.apk", dex_of(GOLDEN))
    app(tmp_path / "bad_code.apk", dex_of([("La/A;", None, 1, None, [("f", (), "V", 1, [0x0073])])]))
    (tmp_path / "no.apk").write_bytes(b"no archive at all")
    with zipfile.ZipFile(tmp_path / "no_manifest.apk", "w") as z:
        z.writestr("classes.dex", dex_of(GOLDEN)[:60])
    scanned = archives.scan(spark, str(tmp_path), code=True).cache()
    assert {r.class_desc for r in archives.methods(scanned).collect()} == {"Lcom/x/A;"}
    assert sorted(r.path.rsplit("/")[-1] for r in archives.failures(scanned).collect()) == ["bad_code.apk", "no.apk", "no_manifest.apk"]
    from hashloom.sources import manifest

    assert manifest.apps(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("inline", [20_000, 1])
def test_framework_types_in_the_expression_or_joined(spark, sf_dir, inline):
    from hashloom.operators.fingerprint import method_nodes
    from hashloom.plans.tables import decoded_apps

    t = decoded_apps(spark, sf_dir)
    rows = [tuple(r) for r in method_nodes(t["methods"], t["framework_types"], inline=inline).orderBy("class_desc", "method_idx").collect()]
    assert len(rows) == t["methods"].count()
    assert rows == [tuple(r) for r in method_nodes(t["methods"], t["framework_types"]).orderBy("class_desc", "method_idx").collect()]


def edges_of(spark, path):
    from hashloom.operators.flow import block_leaders, method_flow

    code = archives.flows(spark, path).filter("error IS NULL")
    edges = method_flow(code)
    of = lambda df, *c: sorted(tuple(r) for r in df.select("method_idx", *c).collect())
    return of(edges, "src", "dst", "exceptional"), of(block_leaders(code, edges), "pc")


def test_flow_of_built_methods(spark, tmp_path):
    """A loop, a switch with its table, and jumps of all widths."""
    loop = [0x0012, 0x0038, 5, 0x00D8, 0x01FF, 0xFB28, 0x000E]  # 0 const; 1 if-eqz +5; 3 add; 5 goto -5; 6 return
    switch = [0x002B, 10, 0, 0x0029, 4, 0x0000, 0x0000, 0x002A, 0xFFFE, 0xFFFF, bytecode.PACKED, 2, 0, 0, 5, 0, 7, 0]
    app(tmp_path / "a.apk", dex_of([("La/A;", None, 1, None, [("f", (), "V", 1, loop), ("g", (), "V", 1, switch)])]))
    edges, leaders = edges_of(spark, str(tmp_path))
    assert [e[1:3] for e in edges if e[0] == 0] == [(0, 1), (1, 3), (1, 6), (3, 5), (5, 0)]
    assert [e[1:3] for e in edges if e[0] == 1] == [(0, 3), (0, 5), (0, 7), (3, 7), (5, 6), (6, 7), (7, 5)]
    assert leaders == [(0, 0), (0, 3), (0, 6), (1, 0), (1, 3), (1, 5), (1, 7)]
    assert not any(e[3] for e in edges)


def test_flow_with_handlers():
    """Tries of a code item: typed handlers, one for all, and instructions that cannot throw."""
    units = [0x0012, 0x001D, 0x000E, 0x000D, 0x000E]  # const; monitor-enter; return; move-exception; return
    lists = number(2) + bytes([0x7F]) + number(5) + number(3) + number(2) + bytes([0x01]) + number(6) + number(3)
    data = struct.pack("<4H2I5HH", 1, 0, 0, 2, 0, 5, *units, 0) + struct.pack("<IHH", 0, 2, 1) + struct.pack("<IHH", 1, 1, 5) + lists
    assert bytecode.handlers(data, 0) == [(0, 2, [3, 2]), (1, 2, [3])]
    rows = bytecode.flow(data, 0)
    assert [(r["pc"], r["handlers"]) for r in rows] == [(0, []), (1, [2, 3]), (2, []), (3, []), (4, [])]
    assert [bytecode.sleb(bytes(b), 0)[0] for b in ([0x7F], [0x00], [0x01], [0x80, 0x7F], [0x3F], [0x40])] == [-1, 0, 1, -128, 63, -64]


def test_flows_of_broken_archives(spark, tmp_path):
    app(tmp_path / "good.apk", dex_of(GOLDEN))
    (tmp_path / "no.apk").write_bytes(b"no archive at all")
    rows = archives.flows(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/")[-1] for r in rows if r.error] == ["no.apk"]
    assert {r.opcode for r in rows if not r.error} == {"const/4", "invoke-virtual", "iget-object", "return-object", "return-void"}


def test_thrown_types_of_a_built_method(spark, tmp_path):
    """An annotation directory behind a dex file: one method throws two types, and another annotation is passed over."""
    io, other = "Ljava/io/IOException;", "Lcom/x/Wrong;"
    named = [("f", (io, other, bytecode.THROWS, "Lcom/x/Note;"), "V", 1, [0x000E]), ("value", (), "V", 1, [0x000E])]
    data = bytearray(dex_of([("Lcom/x/A;", O, 1, None, named)]))
    dex = bytecode.Dex(bytes(data))
    k = next(i for i, (_, p, n) in enumerate(dex.methods) if n == "f")
    t, name = dex.types.index, dex.strings.index("value")
    values = bytes([0x1C]) + number(2) + b"".join(bytes([0x18]) + number(t(x)) for x in (io, other))
    notes = [bytes([0]) + number(t("Lcom/x/Note;")) + number(3) + number(name) + bytes([0x1E]) + number(name) + bytes([0x3F]) + number(name) + bytes([0x24, 5, 1]), bytes([2]) + number(t(bytecode.THROWS)) + number(1) + number(name) + values]
    at = []
    for n in notes:
        at.append(len(data))
        data += n
    data += b"\0" * (-len(data) % 4)
    own = len(data)
    data += struct.pack("<3I", 2, *at)
    directory = len(data)
    data += struct.pack("<4I", 0, 1, 1, 0) + struct.pack("<II", 0, 0) + struct.pack("<II", k, own)
    (defs,) = struct.unpack_from("<I", data, 100)
    struct.pack_into("<I", data, defs + 20, directory)
    assert bytecode.Dex(bytes(data)).thrown() == {k: [io, other]}
    app(tmp_path / "a.apk", bytes(data))
    (tmp_path / "no.apk").write_bytes(b"no archive at all")
    found = archives.throws(spark, str(tmp_path))
    assert sorted((r.class_desc, r.type_name) for r in archives.thrown_types(found).collect()) == [("Lcom/x/A;", "com.x.Wrong"), ("Lcom/x/A;", "java.io.IOException")]
    assert [r.path.rsplit("/")[-1] for r in archives.failures(found).collect()] == ["no.apk"]
    assert bytecode.Dex(dex_of(GOLDEN)).thrown() == {}
