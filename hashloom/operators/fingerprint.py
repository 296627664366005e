"""Fingerprints of classes and methods from decoded tables (AGG-01, FN-13..16, JN-01).

methods has a row a method with its code as an array of
(pc, opcode, kind, ref_class, arg_types, field_type); kind is invoke, getfield
or other, and arg_types are an invoke's parameter types and its return type.
Names never enter a hash, and types outside the framework become X, so hashes
do not change when identifiers do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names as nm
from ..functions.hashes import digest, rendered
from ..functions.flags import public_only
from .edges import used_packages
from .filters import CONSTRUCTORS, app_classes, app_methods, hashed_methods
from ..storage import sized
from .merkle import merkle

UNKNOWN = "X"
METHOD = ["app_id", "class_desc", "method_idx"]
#: So many framework types may stand in an expression.
INLINE_TYPES = 20_000


@dataclass(frozen=True)
class FingerprintConfig:
    """What is hashed (UDF-02)."""

    distinct: bool = False
    public_only: bool = False
    inner_classes: bool = True
    support_classes: bool = True
    algorithm: str = "md5"


def bare(type_name: Column) -> Column:
    """A type without its end mark."""
    return nm.unended(type_name)


def element(type_name: Column) -> Column:
    """An array's element type, any other type itself."""
    return F.when(type_name.startswith("["), F.regexp_replace(bare(type_name), r"^\[+", "")).otherwise(bare(type_name))


def fuzzy(type_name: Column, known: Column, field: bool | Column = False) -> Column:
    """A type as it is hashed (FN-13..16): primitives and known types by name, others X.

    A field's primitive type is X too, but arrays of primitives are not.
    """
    field = F.lit(field) if isinstance(field, bool) else field
    own = nm.is_primitive(element(type_name)) & (~field | nm.is_array(type_name))
    return F.when(own | known, bare(type_name)).otherwise(F.lit(UNKNOWN))


def method_nodes(methods: DataFrame, framework: DataFrame, config: FingerprintConfig = FingerprintConfig(), inline: int = INLINE_TYPES, uses: bool = False) -> DataFrame:
    """app_id, class_desc, package, class_name, method_idx, access_flags, hash, simple_hash.

    Up to so many framework types are a set in the expression, and each
    method's hashes are made within its row; more types are joined. uses keeps
    all methods that people wrote, and adds hashed, whether a method is one of
    those otherwise returned, and what its code uses (invoked, read).
    """
    rows, more = hashed_methods(app_methods(methods, config.public_only)), []
    if uses:
        hashed = ~F.col("name").isin(*CONSTRUCTORS)
        hashed = hashed & public_only(F.col("access_flags")) if config.public_only else hashed
        rows = app_methods(methods).select("*", F.coalesce(hashed, F.lit(False)).alias("hashed"), *used_packages(F.col("code")))
        more = ["hashed", "invoked", "read"]
    types = framework.select(element(F.col("type_desc")).alias("known_type")).filter("known_type IS NOT NULL").distinct()
    few = [r.known_type for r in types.limit(inline + 1).collect()]
    made = _within_rows(rows, few, more) if len(few) <= inline else _by_join(rows, types)
    made = made.join(rows.select(*METHOD, *more), METHOD) if more and len(few) > inline else made
    name = nm.dotted(F.col("class_desc"))
    return made.select(
        "app_id",
        "class_desc",
        nm.package(name).alias("package"),
        nm.simple_name(name).alias("class_name"),
        "method_idx",
        "access_flags",
        digest(F.concat("code_text", "descriptor"), config.algorithm).alias("hash"),
        digest(F.concat("descriptor", rendered(F.col("calls"))), config.algorithm).alias("simple_hash"),
        *more,
    )


def _within_rows(rows: DataFrame, known: list[str], more: list[str]) -> DataFrame:
    """METHOD, access_flags, descriptor, code_text, calls and more of methods, with these framework types."""
    is_known = lambda t: F.coalesce(element(t).isin(known), F.lit(False)) if known else F.lit(False)
    args = lambda ts: F.concat(F.lit("("), F.array_join(F.transform(F.coalesce(ts, F.array().cast("array<string>")), lambda t: fuzzy(t, is_known(t))), ""), F.lit(")"))
    code = F.coalesce(F.col("code"), F.array().cast(rows.schema["code"].dataType))

    def told(i: Column) -> Column:
        read = F.concat(F.lit("["), fuzzy(i["field_type"], is_known(i["field_type"]), True), F.lit("]"))
        call = F.when(i["kind"] == "invoke", args(i["arg_types"]))
        return F.struct(F.coalesce(i["opcode"], F.lit(UNKNOWN)).alias("opcode"), call.alias("call"), F.when(i["kind"] == "getfield", read).alias("read"))

    descriptor = F.concat(args(F.col("param_types")), fuzzy(F.col("return_type"), is_known(F.col("return_type"))))
    # types are told once an instruction, for both of its texts
    made = rows.select(*METHOD, "access_flags", *more, descriptor.alias("descriptor"), F.transform(code, told).alias("told"))
    text = F.array_join(F.transform("told", lambda i: F.concat(i["opcode"], F.coalesce(i["call"], i["read"], F.lit("")))), "")
    calls = F.array_distinct(F.filter(F.col("told")["call"], lambda c: c.isNotNull()))
    return made.select(*METHOD, "access_flags", *more, "descriptor", text.alias("code_text"), calls.alias("calls"))


def _by_join(rows: DataFrame, types: DataFrame) -> DataFrame:
    """The same with any number of framework types.

    Code is exploded to tokens; each token that is a type meets the framework
    types once, and tokens are put together again within the same partitions.
    """
    text = lambda s: F.struct(F.lit(s).alias("text"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("field"))
    typed = lambda t, field: F.struct(F.lit(None).cast("string").alias("text"), t.alias("type"), F.lit(field).alias("field"))
    empty = F.array().cast("array<struct<text:string,type:string,field:boolean>>")

    def tokens(i: Column) -> Column:
        word = F.struct(i["opcode"].alias("text"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("field"))
        args = F.transform(F.coalesce(i["arg_types"], F.array().cast("array<string>")), lambda t: typed(t, False))
        invoke = F.concat(F.array(text("(")), args, F.array(text(")")))
        read = F.array(text("["), typed(i["field_type"], True), text("]"))
        return F.concat(F.array(word), F.when(i["kind"] == "invoke", invoke).when(i["kind"] == "getfield", read).otherwise(empty))

    # the descriptor is part 0, before the code's parts
    descriptor = F.concat(F.array(text("(")), F.transform("param_types", lambda t: typed(t, False)), F.array(text(")"), typed(F.col("return_type"), False)))
    code = F.coalesce(F.col("code"), F.array().cast(rows.schema["code"].dataType))
    parts = F.concat(F.array(F.struct(F.lit(False).alias("invoke"), descriptor.alias("tokens"))), F.transform(code, lambda i: F.struct((i["kind"] == "invoke").alias("invoke"), tokens(i).alias("tokens"))))
    rows = rows.repartition(*METHOD).select(*METHOD, "access_flags", F.posexplode(parts).alias("part", "x"))
    rows = rows.select(*METHOD, "access_flags", "part", F.col("x.invoke").alias("invoke"), F.posexplode("x.tokens").alias("at", "t"))
    rows = rows.join(sized(types), element(F.col("t.type")) == F.col("known_type"), "left")
    word = F.coalesce(F.col("t.text"), fuzzy(F.col("t.type"), F.col("known_type").isNotNull(), F.col("t.field")))
    by_part = rows.groupBy(*METHOD, "access_flags", "part", "invoke").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))).alias("ws"))
    by_part = by_part.withColumn("words", F.col("ws.w"))
    by_part = by_part.withColumn("text", F.array_join("words", "")).withColumn("call", F.when(F.col("invoke"), F.array_join(F.slice("words", 2, F.size("words")), "")))
    made = by_part.groupBy(*METHOD, "access_flags").agg(
        F.max(F.when(F.col("part") == 0, F.col("text"))).alias("descriptor"),
        F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", "text")))).alias("code"),
        F.collect_set("call").alias("calls"),
    )
    return made.select(*METHOD, "access_flags", "descriptor", F.array_join(F.col("code.text"), "").alias("code_text"), "calls")


def fingerprint(classes: DataFrame, methods: DataFrame, framework: DataFrame, config: FingerprintConfig = FingerprintConfig(), keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, uses: bool = False) -> dict[str, DataFrame]:
    """methods, classes, packages, apps: nodes with hashes, classes without methods left out (FLT-08).

    Methods are hashed before those of other classes go, as hashes are shuffled
    for less than code. Each level is made of the one below; with materialize as keep, levels are
    written one after the other and none is computed twice. uses adds a table
    of that name for edges_of_uses, so that code is read once for both.
    """
    kept = app_classes(classes, config.inner_classes, config.support_classes)
    # an inner join, as Spark pushes a semi-join below the hashing
    known = (app_classes(classes) if uses else kept).select("app_id", "class_desc").distinct()
    m = keep(method_nodes(methods, framework, config, uses=uses).join(known, ["app_id", "class_desc"]), "methods")
    used = m.select("app_id", "class_desc", "invoked", "read") if uses else None
    if uses:
        m = m.filter("hashed").drop("hashed", "invoked", "read")
        m = m if config.inner_classes and config.support_classes else m.join(kept.select("app_id", "class_desc"), ["app_id", "class_desc"], "left_semi")
    one = m.withColumn("n_methods", F.lit(1).cast("long"))
    c = merkle(one, ["app_id", "package", "class_name", "class_desc"], "hash", config.distinct, config.algorithm, {"n_methods": "n_methods"})
    c = c.join(kept.select("app_id", "class_desc", "access_flags", "source_file"), ["app_id", "class_desc"]).withColumn("n_classes", F.lit(1).cast("long"))
    c = keep(c, "classes")
    p = merkle(c, ["app_id", "package"], "hash", config.distinct, config.algorithm, {"n_classes": "n_classes", "n_methods": "n_methods"})
    p = keep(p, "packages")
    a = merkle(p, ["app_id"], "hash", config.distinct, config.algorithm, {"n_classes": "n_classes", "n_methods": "n_methods"})
    return {"methods": m, "classes": c.drop("n_classes"), "packages": p, "apps": a} | ({"uses": used} if uses else {})
