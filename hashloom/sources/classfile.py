"""Class files: names, supers, interfaces, flags, fields and methods (SRC-19), by the public description of their format."""

from __future__ import annotations

import struct

# What class files begin with, and how many bytes the constants of each kind have.
CLASS = b"\xca\xfe\xba\xbe"
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
TEXT, LONG, DOUBLE, REFERENCE = 1, 5, 6, 7


def modified_utf8(raw: bytes) -> str:
    """Surrogates are written one by one, and NUL as two bytes."""
    return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def descriptors(text: str) -> list[str]:
    """The types that follow each other in a descriptor."""
    out, at = [], 0
    while at < len(text):
        end = at
        while text[end] == "[":
            end += 1
        end = text.index(";", end) + 1 if text[end] == "L" else end + 1
        out.append(text[at:end])
        at = end
    return out


class ClassFile:
    """One class file, read from its beginning to its end."""

    def __init__(self, data: bytes):
        if data[:4] != CLASS:
            raise ValueError("not a class file")
        self.data, self.at = data, 8
        self.constants: dict[int, str | int | None] = {}
        n, i = self.number(2), 1
        while i < n:
            kind = self.number(1)
            if kind == TEXT:
                size = self.number(2)
                self.constants[i] = modified_utf8(self.take(size))
            elif kind == REFERENCE:
                self.constants[i] = self.number(2)
            elif kind in SIZES:
                self.take(SIZES[kind])
            else:
                raise ValueError(f"no constant of kind {kind}")
            i += 2 if kind in (LONG, DOUBLE) else 1  # these two take two numbers
        self.flags = self.number(2)
        self.name, self.above = self.type_of(self.number(2)), self.type_of(self.number(2))
        self.interfaces = [self.type_of(self.number(2)) for _ in range(self.number(2))]
        self.fields, self.methods = self.members(), self.members()
        self.source = None
        for name, body in self.attributes():
            if name == "SourceFile":
                self.source = self.text(struct.unpack(">H", body)[0])

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the class file ends too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n))

    def text(self, i: int) -> str:
        found = self.constants.get(i)
        if not isinstance(found, str):
            raise ValueError(f"constant {i} is no text")
        return found

    def type_of(self, i: int) -> str | None:
        """The descriptor of a class that is referred to; 0 is no class."""
        if not i:
            return None
        name = self.text(self.constants.get(i, 0) or 0)
        return name if name[:1] == "[" else f"L{name};"

    def attributes(self) -> list[tuple[str, bytes]]:
        return [(self.text(self.number(2)), self.take(self.number(4))) for _ in range(self.number(2))]

    def members(self) -> list[tuple[int, str, str]]:
        """(flags, name, descriptor) of fields or methods."""
        out = []
        for _ in range(self.number(2)):
            out.append((self.number(2), self.text(self.number(2)), self.text(self.number(2))))
            self.attributes()
        return out

    def row(self, methods: bool) -> dict:
        """The class as it is scanned, with its methods on demand; their code is not decoded."""
        own = []
        for i, (flags, name, told) in enumerate(self.methods if methods else ()):
            arguments, returned = told[1:].split(")")
            own.append({"method_idx": i, "name": name, "access_flags": flags, "param_types": descriptors(arguments), "return_type": returned, "code": None})
        fields = [{"name": n, "type": t, "access_flags": f} for f, n, t in self.fields]
        return {"class_desc": self.name, "super_desc": self.above, "access_flags": self.flags, "source_file": self.source, "interfaces": self.interfaces, "fields": fields, "methods": own if methods else None}
