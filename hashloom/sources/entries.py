"""A data source that reads archives entry by entry (SRC-01, SRC-02, SRC-19).

    spark.dataSource.register(ArchiveEntries)
    spark.read.format("archive_entries").option("suffix", ".apk").load(path)

Small archives are dealt to tasks in groups. Of large ones the directory is
read first, and each dex file, and each few hundred class files, is a task of
its own that reads nothing but its entries. Filters on entry and class_desc
are pushed down: entries that are not asked for are not read, and of classes
that are not asked for no method is decoded.

Paths are local, or of a store that pyarrow's file systems reach.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import materialize, sized
from .archives import CLASSES_AT_ONCE, SCANNED, dex_entry, entry_names
from .bytecode import DEX, ODEX
from .classfile import ClassFile

#: An archive of so many bytes is read entry by entry, and smaller ones are grouped up to as many.
SPLIT_BYTES = 8 << 20
#: Class files of an archive that are read together.
CLASS_FILES = 500
ENTRIES = SCANNED.replace("entry string,", "entry string, place int, kind string,")
DIGEST, CLASS_ROW, ERROR = "digest", "class", "error"


@dataclass
class Part(InputPartition):
    """Of each archive (path, places of entries): all entries if there are none, only the digest if they are empty."""

    archives: list[tuple[str, list[int] | None]]

    def __init__(self, archives: list[tuple[str, list[int] | None]]):
        self.archives = archives


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str, deep: bool) -> list[tuple[str, int]]:
    """(path, size) of the files below a path, in order."""
    store, at = _opened(path)
    start = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=deep))
    return sorted((start + f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, f"*{suffix}"))


class EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType | None = None):
        self.rows_of = schema
        self.path, self.suffix = options["path"], options.get("suffix", ".apk")
        self.deep, self.code = options.get("deep", "false") == "true", options.get("code", "false") == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.entries: set[str] | None = None
        self.classes: set[str] | None = None
        self.kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the name is Spark's
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            name = {"entry": "entries", "class_desc": "classes", "kind": "kinds"}.get(column)
            if name is None:
                yield f
                continue
            told = {f.value} if isinstance(f, EqualTo) else set(f.value)
            setattr(self, name, told if getattr(self, name) is None else getattr(self, name) & told)
            yield f  # rows are few by then, and Spark looks at them again

    def partitions(self) -> list[Part]:
        whole, parts, group, many = [], [], [], 0
        for path, size in listed(self.path, self.suffix, self.deep):
            if size >= self.split:
                whole.append(path)
                continue
            group.append((path, None))
            many += size
            if many >= SPLIT_BYTES:
                parts.append(Part(group))
                group, many = [], 0
        if group:
            parts.append(Part(group))
        with ThreadPoolExecutor(32) as pool:
            for path, places in zip(whole, pool.map(self.places, whole), strict=True):
                parts += [Part([(path, p)]) for p in (places if places == [None] else [[], *places])]
        return parts or [Part([])]

    def places(self, path: str) -> list[list[int] | None]:
        """The places of the entries that go together; an archive that cannot be read is left to a task."""
        try:
            store, at = _opened(path)
            with store.open_input_file(at) as file:
                if file.read(4) in (DEX, ODEX):
                    return [None]
                names = entry_names(zipfile.ZipFile(file))
        except Exception:  # noqa: BLE001  the task reports it
            return [None]
        wanted = [i for i, n in enumerate(names) if self.entries is None or n in self.entries]
        of_class = [i for i in wanted if names[i].endswith(".class")]
        return [[i] for i in wanted if not names[i].endswith(".class")] + [of_class[lo : lo + CLASS_FILES] for lo in range(0, len(of_class), CLASS_FILES)]

    def rows(self, path: str, places: list[int] | None) -> Iterator[dict]:
        store, at = _opened(path)
        with store.open_input_file(at) as file:
            if not places and (self.kinds is None or DIGEST in self.kinds):
                digest = hashlib.sha256()
                while block := file.read(1 << 20):
                    digest.update(block)
                yield {"kind": DIGEST, "app_id": digest.hexdigest()}
            if places == [] or self.kinds == {DIGEST}:
                return
            file.seek(0)
            if file.read(4) in (DEX, ODEX):
                file.seek(0)
                yield from self.dex_rows("", 0, file.read())
                return
            z = zipfile.ZipFile(file)
            names = entry_names(z)
            for i in range(len(names)) if places is None else places:
                if self.entries is None or names[i] in self.entries:
                    yield from self.dex_rows(names[i], i, z.read(names[i])) if names[i].endswith(".dex") else self.class_rows(names[i], i, z.read(names[i]))

    def dex_rows(self, entry: str, place: int, data: bytes) -> Iterator[dict]:
        for row in dex_entry(data, self.code, self.classes):
            yield {"kind": CLASS_ROW, "entry": entry, "place": place} | row

    def class_rows(self, entry: str, place: int, data: bytes) -> Iterator[dict]:
        row = ClassFile(data).row(self.code) if data else {"class_desc": f"L{entry[: -len('.class')]};", "access_flags": 0}
        if self.classes is None or row["class_desc"] in self.classes:
            yield {"kind": CLASS_ROW, "entry": entry, "place": place} | row

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema, held = to_arrow_schema(self.rows_of), []
        for path, places in partition.archives:
            try:
                for row in self.rows(path, places):
                    held.append({"path": path} | row)
                    if len(held) >= CLASSES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
            except Exception as e:  # noqa: BLE001  whatever a broken file leads to
                held.append({"path": path, "kind": ERROR, "error": f"{type(e).__name__}: {e}"})
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class ArchiveEntries(DataSource):
    """Rows of ENTRIES: an archive's digest, its classes, and an error for each part of it that cannot be read."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> EntryReader:
        return EntryReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and switch on the filters of such sources, which Spark has off by itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveEntries)


def scan_entries(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = False, code: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of archives.scan(), with the entries of large archives in tasks of their own.

    What is decoded is written once. Then errors leave out their archives,
    and of two classes of a name the one in the first entry stays; both are
    found by narrow tables.
    """
    register(spark)
    source = spark.read.format("archive_entries").options(suffix=suffix, deep=str(deep).lower(), code=str(code).lower(), splitbytes=str(split_bytes)).load(path)
    rows = materialize(source, "entries")
    ids = sized(materialize(rows.filter(F.col("kind") == DIGEST).select("path", "app_id"), "ids"))
    failed = rows.filter(F.col("kind") == ERROR).groupBy("path").agg(F.min("error").alias("error"))
    failed = sized(materialize(failed, "failed"))
    classes = rows.filter(F.col("kind") == CLASS_ROW).withColumn("number", F.monotonically_increasing_id())
    order = Window.partitionBy("path", "class_desc").orderBy("place", "number")
    again = classes.select("path", "class_desc", "place", "number").withColumn("k", F.row_number().over(order)).filter("k > 1")
    again = sized(materialize(again.select("path", "number"), "again"))
    good = classes.join(failed, "path", "left_anti").join(again, ["path", "number"], "left_anti").drop("number", "kind", "place", "app_id", "error")
    columns = [c.split()[0] for c in ("path string", "app_id string", "entry string", "class_desc string", "super_desc string", "access_flags int", "source_file string", "interfaces", "fields", "methods", "error string")]
    good = good.join(ids, "path").withColumn("error", F.lit(None).cast("string")).select(columns)
    bad = failed.join(ids, "path", "left").select("path", "app_id", "error")
    return good.unionByName(bad, allowMissingColumns=True)
