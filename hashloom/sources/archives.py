"""Classes and methods of archives: dex files in app packages, and framework jars (SRC-01..05, SRC-19).

Archives are read by Spark as binary files, one a row, and decoded in the
tasks, one at a time. An archive that cannot be read gives one row with what
was wrong, and the others go on.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.names import dotted
from . import manifest
from .bytecode import DEX, NONE, ODEX, Dex  # noqa: F401
from .classfile import ClassFile
from .lists import files

CODE = "array<struct<pc:int,opcode:string,kind:string,ref_class:string,arg_types:array<string>,field_type:string>>"
METHODS = f"array<struct<method_idx:int,name:string,access_flags:int,param_types:array<string>,return_type:string,code:{CODE}>>"
FIELDS = "array<struct<name:string,type:string,access_flags:int>>"
SCANNED = f"path string, app_id string, entry string, class_desc string, super_desc string, access_flags int, source_file string, interfaces array<string>, fields {FIELDS}, methods {METHODS}, error string"
# Fixed value: the flag of interfaces.
INTERFACE = 0x200
#: Classes that go to Spark at once.
CLASSES_AT_ONCE = 200


def dex_classes(data: bytes) -> list[tuple[str, str | None, int, str | None]]:
    """(descriptor, super, flags, source file) of the class definitions of a dex file."""
    return [c[:4] for c in Dex(data).classes()]


def entry_names(z: zipfile.ZipFile) -> list[str]:
    """The entries of an archive that hold classes: dex files at its root, and class files, in order."""
    names = sorted(z.namelist())
    of_class = [n for n in names if n.endswith(".class") and not n.endswith("module-info.class") and not n.startswith("META-INF/")]
    return [n for n in names if n.endswith(".dex") and "/" not in n] + of_class


def dex_entry(data: bytes, code: bool, wanted: set[str] | None = None) -> Iterator[dict]:
    """The classes of a dex file, or those that are wanted, with their methods on demand."""
    dex = Dex(data)
    for cls, above, flags, source, members, interfaces in dex.classes():
        if wanted is None or cls in wanted:
            yield {"class_desc": cls, "super_desc": above, "access_flags": flags, "source_file": source, "interfaces": interfaces, "methods": dex.class_methods(members) if code else None}


def archive_classes(content: bytes, code: bool = False) -> Iterator[dict]:
    """The classes of an app package, a jar or a dex file, with their methods on demand; of two classes with one name the first stays.

    An empty class file stands for a class of the entry's name.
    """
    seen: set[str] = set()
    z = None if content[:4] in (DEX, ODEX) else zipfile.ZipFile(io.BytesIO(content))
    for entry in entry_names(z) if z else [""]:
        data = z.read(entry) if z else content
        if entry.endswith(".class"):
            rows = [ClassFile(data).row(code) if data else {"class_desc": f"L{entry[: -len('.class')]};", "access_flags": 0}]
        else:
            rows = dex_entry(data, code)
        for row in rows:
            if row["class_desc"] not in seen:
                seen.add(row["class_desc"])
                yield {"entry": entry} | row


def scan(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = False, code: bool = False) -> DataFrame:
    """SCANNED rows: the classes of all archives below path, or a row with the error of one that cannot be read.

    app_id is the archive's SHA-256. An error anywhere in an archive leaves
    out all of it.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCANNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                told = {"path": at.as_py(), "app_id": hashlib.sha256(data).hexdigest()}
                try:
                    rows = [told | c for c in archive_classes(data, code)]
                except Exception as e:  # noqa: BLE001  whatever a broken file leads to
                    rows = [told | {"error": f"{type(e).__name__}: {e}"}]
                for lo in range(0, len(rows), CLASSES_AT_ONCE):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + CLASSES_AT_ONCE], schema)

    return files(spark, path, suffix, deep, content=True).select("path", "content").mapInArrow(run, SCANNED)


FLOWS = "path string, app_id string, class_desc string, method_idx int, pc int, opcode string, ends boolean, targets array<int>, handlers array<int>, error string"


def flows(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = False) -> DataFrame:
    """FLOWS rows: the instructions of all methods below path with where they go, or a row with the error of an archive that cannot be read (DF-18).

    Of two classes with one name the first counts.
    """

    def rows(dex: Dex, members: int) -> Iterator[dict]:
        for i, own in dex.class_flows(members):
            yield from ({"method_idx": i} | one for one in own)

    return _of_dex_classes(spark, path, suffix, deep, FLOWS, lambda dex: lambda members: rows(dex, members))


THROWN = "path string, app_id string, class_desc string, method_idx int, thrown array<string>, error string"


def throws(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = False) -> DataFrame:
    """THROWN rows: the types that methods say they throw, a row a method that has any, or a row with the error of an archive that cannot be read (FN-30)."""

    def of(dex: Dex):
        told = dex.thrown()
        return lambda members: ({"method_idx": i, "thrown": types} for i, types in dex.class_throws(members, told))

    return _of_dex_classes(spark, path, suffix, deep, THROWN, of)


def thrown_types(found: DataFrame) -> DataFrame:
    """app_id, class_desc, method_idx, type_name: a row a thrown type, dotted, of throws()."""
    return found.filter("error IS NULL").select("app_id", "class_desc", "method_idx", F.explode("thrown").alias("t")).withColumn("type_name", dotted(F.col("t"))).drop("t").distinct()


def _of_dex_classes(spark: SparkSession, path: str, suffix: str, deep: bool, ddl: str, reader: Callable[[Dex], Callable[[int], Iterator[dict]]]) -> DataFrame:
    """Rows of ddl that a reader makes of each class of the dex files of each archive; of two classes with one name the first counts."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def of(content: bytes) -> Iterator[dict]:
        seen: set[str] = set()
        z = None if content[:4] in (DEX, ODEX) else zipfile.ZipFile(io.BytesIO(content))
        for entry in entry_names(z) if z else [""]:
            if entry.endswith(".class"):
                continue
            dex = Dex(z.read(entry) if z else content)
            read = reader(dex)
            for cls, *_, members, _ in dex.classes():
                if cls not in seen:
                    seen.add(cls)
                    yield from ({"class_desc": cls} | one for one in read(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                told = {"path": at.as_py(), "app_id": hashlib.sha256(data).hexdigest()}
                try:
                    rows = [told | one for one in of(data)]
                except Exception as e:  # noqa: BLE001  whatever a broken file leads to
                    rows = [told | {"error": f"{type(e).__name__}: {e}"}]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 10_000], schema)

    return files(spark, path, suffix, deep, content=True).select("path", "content").mapInArrow(run, ddl)


def classes(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = False) -> DataFrame:
    """path, app_id, entry, class_desc, super_desc, access_flags, source_file of the archives that can be read."""
    return scan(spark, path, suffix, deep).filter("error IS NULL").drop("interfaces", "fields", "methods", "error")


def failures(scanned: DataFrame) -> DataFrame:
    """path, app_id, error of the archives that cannot be read."""
    return scanned.filter("error IS NOT NULL").select("path", "app_id", "error")


def methods(scanned: DataFrame) -> DataFrame:
    """app_id, class_desc and the columns of each method of archives that were scanned with their code."""
    return scanned.filter("error IS NULL").select("app_id", "class_desc", F.inline("methods"))


def decoded_apps(spark: SparkSession, path: str, framework: DataFrame, suffix: str = ".apk", deep: bool = False) -> dict[str, DataFrame]:
    """The tables apps, classes, methods and framework_types that PARSE takes, from app packages and framework types (type_desc).

    An app without a readable manifest has a null package name, which no
    package belongs to.
    """
    scanned = scan(spark, path, suffix, deep, code=True)
    told = manifest.apps(spark, path, suffix, deep).select("path", "package_name", "version_code", "version_name", "main_activity")
    apps = scanned.filter("error IS NULL").select("path", "app_id").distinct().join(told, "path", "left").drop("path").dropDuplicates(["app_id"])
    own = scanned.filter("error IS NULL").select("app_id", "class_desc", "super_desc", "access_flags", "source_file")
    return {"apps": apps, "classes": own.dropDuplicates(["app_id", "class_desc"]), "methods": methods(scanned).dropDuplicates(["app_id", "class_desc", "method_idx"]), "framework_types": framework}


def hierarchy(scanned: DataFrame) -> DataFrame:
    """type_name, super_name, is_interface of scanned classes: a row for the super and for each interface, dotted (CH-01).

    A type without either has one row, with a null.
    """
    above = F.array_compact(F.concat(F.array("super_desc"), F.coalesce("interfaces", F.array().cast("array<string>"))))
    rows = scanned.filter("error IS NULL").select(dotted(F.col("class_desc")).alias("type_name"), (F.col("access_flags").bitwiseAND(INTERFACE) != 0).alias("is_interface"), F.explode_outer(above).alias("up"))
    return rows.select("type_name", dotted(F.col("up")).alias("super_name"), "is_interface").distinct()


def framework_types(spark: SparkSession, path: str, suffix: str = ".jar") -> DataFrame:
    """type_desc of all classes of framework archives (SRC-05, SRC-19)."""
    return classes(spark, path, suffix, deep=True).select(F.col("class_desc").alias("type_desc")).distinct()
