"""Methods and their code in dex files, as the tables that fingerprint.py takes (SRC-03, UDF-04).

What is decoded follows the public description of the dex format: the id
sections, class data, code items, and instructions as far as their names,
lengths and the methods and fields that they refer to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

NONE = 0xFFFFFFFF
# What dex files, and dex files optimized for a device, begin with.
DEX, ODEX = b"dex\n", b"dey\n"
# The annotation of what a method throws, and the kinds of encoded values that are not a number of bytes.
THROWS = "Ldalvik/annotation/Throws;"
ARRAY, ANNOTATION, NULL, BOOLEAN, TYPE = 0x1C, 0x1D, 0x1E, 0x1F, 0x18
#: Units that begin a table of a switch or of an array's values, which is no instruction.
PACKED, SPARSE, VALUES = 0x0100, 0x0200, 0x0300


# The opcodes of dex files, their names, and their lengths in 16-bit units.
OPCODES = """
00 nop 1
01 move 1
02 move/from16 2
03 move/16 3
04 move-wide 1
05 move-wide/from16 2
06 move-wide/16 3
07 move-object 1
08 move-object/from16 2
09 move-object/16 3
0a move-result 1
0b move-result-wide 1
0c move-result-object 1
0d move-exception 1
0e return-void 1
0f return 1
10 return-wide 1
11 return-object 1
12 const/4 1
13 const/16 2
14 const 3
15 const/high16 2
16 const-wide/16 2
17 const-wide/32 3
18 const-wide 5
19 const-wide/high16 2
1a const-string 2
1b const-string/jumbo 3
1c const-class 2
1d monitor-enter 1
1e monitor-exit 1
1f check-cast 2
20 instance-of 2
21 array-length 1
22 new-instance 2
23 new-array 2
24 filled-new-array 3
25 filled-new-array/range 3
26 fill-array-data 3
27 throw 1
28 goto 1
29 goto/16 2
2a goto/32 3
2b packed-switch 3
2c sparse-switch 3
2d cmpl-float 2
2e cmpg-float 2
2f cmpl-double 2
30 cmpg-double 2
31 cmp-long 2
32 if-eq 2
33 if-ne 2
34 if-lt 2
35 if-ge 2
36 if-gt 2
37 if-le 2
38 if-eqz 2
39 if-nez 2
3a if-ltz 2
3b if-gez 2
3c if-gtz 2
3d if-lez 2
44 aget 2
45 aget-wide 2
46 aget-object 2
47 aget-boolean 2
48 aget-byte 2
49 aget-char 2
4a aget-short 2
4b aput 2
4c aput-wide 2
4d aput-object 2
4e aput-boolean 2
4f aput-byte 2
50 aput-char 2
51 aput-short 2
52 iget 2
53 iget-wide 2
54 iget-object 2
55 iget-boolean 2
56 iget-byte 2
57 iget-char 2
58 iget-short 2
59 iput 2
5a iput-wide 2
5b iput-object 2
5c iput-boolean 2
5d iput-byte 2
5e iput-char 2
5f iput-short 2
60 sget 2
61 sget-wide 2
62 sget-object 2
63 sget-boolean 2
64 sget-byte 2
65 sget-char 2
66 sget-short 2
67 sput 2
68 sput-wide 2
69 sput-object 2
6a sput-boolean 2
6b sput-byte 2
6c sput-char 2
6d sput-short 2
6e invoke-virtual 3
6f invoke-super 3
70 invoke-direct 3
71 invoke-static 3
72 invoke-interface 3
74 invoke-virtual/range 3
75 invoke-super/range 3
76 invoke-direct/range 3
77 invoke-static/range 3
78 invoke-interface/range 3
7b neg-int 1
7c not-int 1
7d neg-long 1
7e not-long 1
7f neg-float 1
80 neg-double 1
81 int-to-long 1
82 int-to-float 1
83 int-to-double 1
84 long-to-int 1
85 long-to-float 1
86 long-to-double 1
87 float-to-int 1
88 float-to-long 1
89 float-to-double 1
8a double-to-int 1
8b double-to-long 1
8c double-to-float 1
8d int-to-byte 1
8e int-to-char 1
8f int-to-short 1
90 add-int 2
91 sub-int 2
92 mul-int 2
93 div-int 2
94 rem-int 2
95 and-int 2
96 or-int 2
97 xor-int 2
98 shl-int 2
99 shr-int 2
9a ushr-int 2
9b add-long 2
9c sub-long 2
9d mul-long 2
9e div-long 2
9f rem-long 2
a0 and-long 2
a1 or-long 2
a2 xor-long 2
a3 shl-long 2
a4 shr-long 2
a5 ushr-long 2
a6 add-float 2
a7 sub-float 2
a8 mul-float 2
a9 div-float 2
aa rem-float 2
ab add-double 2
ac sub-double 2
ad mul-double 2
ae div-double 2
af rem-double 2
b0 add-int/2addr 1
b1 sub-int/2addr 1
b2 mul-int/2addr 1
b3 div-int/2addr 1
b4 rem-int/2addr 1
b5 and-int/2addr 1
b6 or-int/2addr 1
b7 xor-int/2addr 1
b8 shl-int/2addr 1
b9 shr-int/2addr 1
ba ushr-int/2addr 1
bb add-long/2addr 1
bc sub-long/2addr 1
bd mul-long/2addr 1
be div-long/2addr 1
bf rem-long/2addr 1
c0 and-long/2addr 1
c1 or-long/2addr 1
c2 xor-long/2addr 1
c3 shl-long/2addr 1
c4 shr-long/2addr 1
c5 ushr-long/2addr 1
c6 add-float/2addr 1
c7 sub-float/2addr 1
c8 mul-float/2addr 1
c9 div-float/2addr 1
ca rem-float/2addr 1
cb add-double/2addr 1
cc sub-double/2addr 1
cd mul-double/2addr 1
ce div-double/2addr 1
cf rem-double/2addr 1
d0 add-int/lit16 2
d1 rsub-int 2
d2 mul-int/lit16 2
d3 div-int/lit16 2
d4 rem-int/lit16 2
d5 and-int/lit16 2
d6 or-int/lit16 2
d7 xor-int/lit16 2
d8 add-int/lit8 2
d9 rsub-int/lit8 2
da mul-int/lit8 2
db div-int/lit8 2
dc rem-int/lit8 2
dd and-int/lit8 2
de or-int/lit8 2
df xor-int/lit8 2
e0 shl-int/lit8 2
e1 shr-int/lit8 2
e2 ushr-int/lit8 2
"""


@lru_cache(1)
def instructions() -> dict[int, tuple[str, int]]:
    """Of each opcode its name and length."""
    return {int(op, 16): (name, int(units)) for op, name, units in map(str.split, OPCODES.split("\n")[1:-1])}


# Opcodes that jump, that choose by a table, that end the flow, and beginnings of the names of those that may throw.
GOTO, GOTO_16, GOTO_32, SWITCHES, TESTS = 0x28, 0x29, 0x2A, (0x2B, 0x2C), range(0x32, 0x3E)
ENDS = frozenset((*range(0x0E, 0x12), 0x27, GOTO, GOTO_16, GOTO_32))
MAY_THROW = ("const-string", "const-class", "monitor", "check-cast", "instance-of", "array-length", "new-", "filled-new-array", "throw", "aget", "aput", "iget", "iput", "sget", "sput", "invoke", "div-int", "rem-int", "div-long", "rem-long")
CALLS = frozenset((*range(0x6E, 0x73), *range(0x74, 0x79)))
READS = frozenset((*range(0x52, 0x59), *range(0x60, 0x67)))


def sleb(data: bytes, at: int) -> tuple[int, int]:
    """(value, end) of the signed variable-length number at an offset."""
    begin = at
    value, at = uleb(data, at)
    bits = 7 * (at - begin)
    return value - (1 << bits) if value >> (bits - 1) & 1 else value, at


def _signed(low: int, high: int | None = None) -> int:
    """A number of one 16-bit unit, or of two."""
    value, bits = (low, 16) if high is None else (low | high << 16, 32)
    return value - (1 << bits) if value >> (bits - 1) else value


def handlers(data: bytes, at: int) -> list[tuple[int, int, list[int]]]:
    """(first pc, pc behind the last, pcs of the handlers) of the tries of the code item at an offset."""
    n_tries, n = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<I", data, at + 12)[0]
    if not n_tries:
        return []
    tries = at + 16 + 2 * (n + n % 2)
    lists, out = tries + 8 * n_tries, []
    for i in range(n_tries):
        begin, size, offset = struct.unpack_from("<IHH", data, tries + 8 * i)
        many, where = sleb(data, lists + offset)
        found = []
        for _ in range(abs(many)):
            _, where = uleb(data, where)
            to, where = uleb(data, where)
            found.append(to)
        if many <= 0:
            found.append(uleb(data, where)[0])
        out.append((begin, begin + size, found))
    return out


def flow(data: bytes, at: int) -> list[dict]:
    """The instructions of a code item as (pc, opcode, ends, targets, handlers): where each jumps to, and where it goes if it throws.

    A switch jumps to what its table names, and goes on as well.
    """
    n = struct.unpack_from("<I", data, at + 12)[0]
    units, tries, out = struct.unpack_from(f"<{n}H", data, at + 16), handlers(data, at), []
    for pc, op, name in _walked(units):
        if op == GOTO:
            targets = [pc + (units[pc] >> 8) - (256 if units[pc] >> 15 else 0)]
        elif op == GOTO_16 or op in TESTS:
            targets = [pc + _signed(units[pc + 1])]
        elif op == GOTO_32:
            targets = [pc + _signed(units[pc + 1], units[pc + 2])]
        elif op in SWITCHES:
            table = pc + _signed(units[pc + 1], units[pc + 2])
            size = units[table + 1]
            first = table + (4 if units[table] == PACKED else 2 + 2 * size)
            targets = [pc + _signed(units[first + 2 * k], units[first + 2 * k + 1]) for k in range(size)]
        else:
            targets = []
        caught = [h for begin, end, own in tries if begin <= pc < end for h in own] if name.startswith(MAY_THROW) else []
        out.append({"pc": pc, "opcode": name, "ends": op in ENDS, "targets": sorted(set(targets)), "handlers": sorted(set(caught))})
    return out


def _walked(units: tuple[int, ...]) -> Iterator[tuple[int, int, str]]:
    """(pc, opcode, name) of each instruction; tables are none."""
    known, pc = instructions(), 0
    while pc < len(units):
        unit = units[pc]
        if unit in (PACKED, SPARSE):
            pc += 4 + 2 * units[pc + 1] if unit == PACKED else 2 + 4 * units[pc + 1]
        elif unit == VALUES:
            pc += 4 + (units[pc + 1] * (units[pc + 2] | units[pc + 3] << 16) + 1) // 2
        else:
            op = unit & 0xFF
            if op not in known:
                raise ValueError(f"no opcode {op:#x}")
            yield pc, op, known[op][0]
            pc += known[op][1]


def uleb(data: bytes, at: int) -> tuple[int, int]:
    """(value, end) of the variable-length number at an offset."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at


class Dex:
    """The id sections of one dex file, and what is read by them."""

    def __init__(self, data: bytes):
        if data[:4] == ODEX:
            begin, length = struct.unpack_from("<II", data, 8)
            data = data[begin : begin + length]
        if data[:4] != DEX:
            raise ValueError("not a dex file")
        self.data = data
        self.strings = self._strings()
        self.types = [self.strings[i] for (i,) in self._section(64, "<I")]
        protos = self._section(72, "<3I")
        self.protos = [(self._type_list(at), self.types[returned]) for _, returned, at in protos]
        self.fields = [(self.types[c], self.types[t]) for c, t, _ in self._section(80, "<HHI")]
        self.methods = [(self.types[c], p, self.strings[n]) for c, p, n in self._section(88, "<HHI")]

    def _section(self, header: int, form: str) -> list[tuple]:
        n, at = struct.unpack_from("<II", self.data, header)
        size = struct.calcsize(form)
        return [struct.unpack_from(form, self.data, at + size * i) for i in range(n)]

    def _strings(self) -> list[str]:
        out = []
        for (at,) in self._section(56, "<I"):
            _, begin = uleb(self.data, at)
            # modified UTF-8: surrogates are written one by one, and NUL as two bytes
            raw = self.data[begin : self.data.index(b"\0", begin)].replace(b"\xc0\x80", b"\0")
            out.append(raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
        return out

    def _type_list(self, at: int) -> list[str]:
        n = struct.unpack_from("<I", self.data, at)[0] if at else 0
        return [self.types[i] for i in struct.unpack_from(f"<{n}H", self.data, at + 4)] if n else []

    def classes(self) -> Iterator[tuple[str, str | None, int, str | None, int, list[str]]]:
        """(descriptor, super, flags, source file, offset of the class's data, interfaces) of each definition."""
        for cls, flags, above, interfaces, source, _, members, _ in self._section(96, "<8I"):
            yield self.types[cls], None if above == NONE else self.types[above], flags, None if source == NONE else self.strings[source], members, self._type_list(interfaces)

    def declared(self, members: int) -> Iterator[tuple[int, int, int]]:
        """(method id, flags, offset of the code or 0) of the methods in a class's data."""
        if not members:
            return
        at, counts = members, []
        for _ in range(4):
            n, at = uleb(self.data, at)
            counts.append(n)
        for _ in range(2 * (counts[0] + counts[1])):
            _, at = uleb(self.data, at)
        for n in counts[2:]:
            k = 0
            for _ in range(n):
                step, at = uleb(self.data, at)
                flags, at = uleb(self.data, at)
                code, at = uleb(self.data, at)
                k += step
                yield k, flags, code

    def code(self, at: int) -> list[dict] | None:
        """The instructions of a code item, None without one."""
        if not at:
            return None
        n = struct.unpack_from("<I", self.data, at + 12)[0]
        units, out = struct.unpack_from(f"<{n}H", self.data, at + 16), []
        for pc, op, name in _walked(units):
            one = {"pc": pc, "opcode": name, "kind": "other", "ref_class": None, "arg_types": None, "field_type": None}
            if op in CALLS:
                cls, proto, _ = self.methods[units[pc + 1]]
                arguments, returned = self.protos[proto]
                one |= {"kind": "invoke", "ref_class": cls, "arg_types": [*arguments, returned]}
            elif op in READS:
                cls, kind = self.fields[units[pc + 1]]
                one |= {"kind": "getfield", "ref_class": cls, "field_type": kind}
            out.append(one)
        return out

    def class_methods(self, members: int) -> list[dict]:
        """The methods that a class declares, with their code."""
        out = []
        for i, (k, flags, at) in enumerate(self.declared(members)):
            _, proto, name = self.methods[k]
            arguments, returned = self.protos[proto]
            out.append({"method_idx": i, "name": name, "access_flags": flags, "param_types": arguments, "return_type": returned, "code": self.code(at)})
        return out

    def _value(self, at: int) -> tuple[int, object, int]:
        """(kind, value, end) of the encoded value at an offset; a type is its name, an array a list of (kind, value)."""
        head = self.data[at]
        kind, size, at = head & 0x1F, (head >> 5) + 1, at + 1
        if kind == ARRAY:
            n, at = uleb(self.data, at)
            out = []
            for _ in range(n):
                one, value, at = self._value(at)
                out.append((one, value))
            return kind, out, at
        if kind == ANNOTATION:
            found, at = self._annotation(at)
            return kind, found, at
        if kind in (NULL, BOOLEAN):
            return kind, None if kind == NULL else bool(size - 1), at
        number = int.from_bytes(self.data[at : at + size], "little")
        return kind, self.types[number] if kind == TYPE else number, at + size

    def _annotation(self, at: int) -> tuple[tuple[str, dict[str, tuple[int, object]]], int]:
        """((type, values by name), end) of the encoded annotation at an offset."""
        of, at = uleb(self.data, at)
        n, at = uleb(self.data, at)
        values = {}
        for _ in range(n):
            name, at = uleb(self.data, at)
            kind, value, at = self._value(at)
            values[self.strings[name]] = kind, value
        return (self.types[of], values), at

    def method_annotations(self) -> Iterator[tuple[int, str, dict[str, tuple[int, object]]]]:
        """(method id, type, values by name) of the annotations of all methods."""
        for *_, directory, _, _ in self._section(96, "<8I"):
            if not directory:
                continue
            _, n_fields, n_methods, _ = struct.unpack_from("<4I", self.data, directory)
            for i in range(n_methods):
                method, own = struct.unpack_from("<II", self.data, directory + 16 + 8 * (n_fields + i))
                for (at,) in struct.iter_unpack("<I", self.data[own + 4 : own + 4 + 4 * struct.unpack_from("<I", self.data, own)[0]]):
                    (of, values), _ = self._annotation(at + 1)  # behind the visibility
                    yield method, of, values

    def thrown(self) -> dict[int, list[str]]:
        """The types that each method id says it throws (FN-30)."""
        out: dict[int, list[str]] = {}
        for method, of, values in self.method_annotations():
            if of == THROWS and values.get("value", (None, None))[0] == ARRAY:
                out.setdefault(method, []).extend(v for kind, v in values["value"][1] if kind == TYPE)
        return out

    def class_throws(self, members: int, thrown: dict[int, list[str]]) -> Iterator[tuple[int, list[str]]]:
        """(number, thrown types) of the methods of a class that throw any."""
        for i, (k, _, _) in enumerate(self.declared(members)):
            if k in thrown:
                yield i, thrown[k]

    def class_flows(self, members: int) -> Iterator[tuple[int, list[dict]]]:
        """(number, flow) of the methods with code that a class declares."""
        for i, (_, _, at) in enumerate(self.declared(members)):
            if at:
                yield i, flow(self.data, at)
