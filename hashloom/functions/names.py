"""Names as columns: dotted and slashed names, prefixes, descriptors (FN-04..12, FN-18..22, PRJ-01..03)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What a name without a dot has for a parent.
NO_PARENT = "<none>"
# The primitive types of descriptors.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def _mapped(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def dotted(descriptor: Column) -> Column:
    """Lcom/x/A; as com.x.A (FN-04, PRJ-02)."""
    name = F.when(descriptor.startswith("L"), F.substring(descriptor, 2, 1 << 30)).otherwise(descriptor)
    return F.translate(unended(name), "/", ".")


def unended(name: Column) -> Column:
    """A descriptor without its end mark."""
    return F.when(name.endswith(";"), name.substr(F.lit(1), F.length(name) - 1)).otherwise(name)


def descriptor(name: Column) -> Column:
    """com.x.A[] as [Lcom/x/A; and int as I (FN-05)."""
    base = F.regexp_replace(name, r"(\[\])+$", "")
    depth = ((F.length(name) - F.length(base)) / 2).cast("int")
    codes = _mapped({v: k for k, v in PRIMITIVES.items()})
    return F.concat(F.repeat(F.lit("["), depth), F.coalesce(F.element_at(codes, base), F.concat(F.lit("L"), F.translate(base, ".", "/"), F.lit(";"))))


def package(name: Column) -> Column:
    """All but the last segment; empty for the default package (PRJ-03)."""
    return name.substr(F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)


def simple_name(name: Column) -> Column:
    """The last segment, without a descriptor's end mark (PRJ-01)."""
    return F.regexp_replace(F.regexp_extract(name, r"[^./]*$", 0), ";$", "")


def depth(name: Column) -> Column:
    """Segments of a name, 0 of an empty one (FN-12)."""
    return F.when(name == "", F.lit(0)).otherwise(F.size(F.split(name, r"\.")))


def first_segments(name: Column, n: int) -> Column:
    """The first n segments (FN-06, FN-07 with n = 2)."""
    return F.substring_index(name, ".", n)


def parent(name: Column) -> Column:
    """The name above, or NO_PARENT (FN-09)."""
    return F.when(F.instr(name, ".") > 0, package(name)).otherwise(F.lit(NO_PARENT))


def ancestor(name: Column, up: int) -> Column:
    """The name up levels above, or NO_PARENT where there is none (JN-10)."""
    for _ in range(up):
        name = parent(name)
    return name


def prefixes(name: Column) -> Column:
    """All prefixes of a name, itself included, as an array (TR-01)."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def near_depth(a: Column, b: Column) -> Column:
    """Whether depths differ by one at most (FN-10)."""
    return F.abs(depth(a) - depth(b)) <= 1


def family(first: Column, last: Column) -> Column:
    """Whether last lies below first (FN-11)."""
    return last.startswith(F.concat(first, F.lit(".")))


def relationship(a: Column, b: Column, above_a: Column | None = None, above_b: Column | None = None) -> Column:
    """PARENT, CHILD, SIBLING or UNRELATED: a to b (FN-12); their packages may be given."""
    above_a, above_b = package(a) if above_a is None else above_a, package(b) if above_b is None else above_b
    return F.when(family(a, b), F.lit("PARENT")).when(family(b, a), F.lit("CHILD")).when((above_a == above_b) & (a != b) & (above_a != ""), F.lit("SIBLING")).otherwise(F.lit("UNRELATED"))


def joined(parts: Column, separator: str) -> Column:
    """An array's texts that are not empty, joined (FN-18)."""
    return F.array_join(F.filter(parts, lambda x: x != ""), separator)


def quoted(text: Column) -> Column:
    """Within double quotes, those inside escaped (FN-19)."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def unquoted(text: Column) -> Column:
    """Without the double or single quotes around (FN-19)."""
    return F.regexp_replace(text, "^[\"'](.*)[\"']$", "$1")


def is_constant(text: Column) -> Column:
    """Whether a value is quoted or a number (FN-19)."""
    return text.rlike("^([\"'].*[\"']|-?[0-9]+(\\.[0-9]+)?)$")


def argument_types(signature: Column) -> Column:
    """The argument descriptors of (IL..;[J)V as an array (FN-20)."""
    return F.regexp_extract_all(F.regexp_extract(signature, r"\(([^)]*)\)", 1), F.lit(r"(\[*(?:[VZBSCIJFD]|L[^;]+;))"), 1)


def class_of(signature: Column) -> Column:
    """The class of Lcom/x/A;->f()V or com.x.A.f()V (FN-21)."""
    return F.when(signature.contains("->"), dotted(F.substring_index(signature, "->", 1))).otherwise(package(F.substring_index(signature, "(", 1)))


def is_primitive(type_name: Column) -> Column:
    return type_name.isin(*PRIMITIVES, *PRIMITIVES.values())


def is_array(type_name: Column) -> Column:
    return type_name.startswith("[") | type_name.endswith("[]")


def is_register(name: Column) -> Column:
    """v0, p1 and the like (FN-22)."""
    return name.rlike("^[vp][0-9]+$")
