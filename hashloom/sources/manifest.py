"""App manifests in their binary form (SRC-06..09): package, versions and launcher activity.

One archive is one row; its manifest is decoded in the task that reads it.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .lists import files

APPS = "path string, package_name string, version_code string, version_name string, main_activity string"
# Chunk types and value types of the binary XML format.
POOL, START, END = 0x0001, 0x0102, 0x0103
REFERENCE, ATTRIBUTE, STRING, FLOAT, DECIMAL, HEX, BOOLEAN = 1, 2, 3, 4, 16, 17, 18
COLOURS = range(28, 32)
UTF8 = 1 << 8
MAIN, LAUNCHER = "android.intent.action.MAIN", "android.intent.category.LAUNCHER"
STARTS = {"action": MAIN, "category": LAUNCHER}


def string_pool(data: bytes, at: int) -> list[str]:
    """The strings of the pool chunk at an offset, UTF-16 or UTF-8 (SRC-09)."""
    n, _, flags, begin = struct.unpack_from("<4I", data, at + 8)
    out = []
    for off in struct.unpack_from(f"<{n}I", data, at + 28):
        p = at + begin + off
        if flags & UTF8:
            for _ in range(2):  # characters, then bytes; a set high bit means two bytes
                size, p = (data[p], p + 1) if data[p] < 128 else ((data[p] & 127) << 8 | data[p + 1], p + 2)
            out.append(data[p : p + size].decode("utf-8", "replace"))
        else:
            size, p = struct.unpack_from("<H", data, p)[0], p + 2
            if size & 0x8000:
                size, p = (size & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0], p + 2
            out.append(data[p : p + 2 * size].decode("utf-16-le", "replace"))
    return out


def value(kind: int, raw: int, strings: list[str]) -> str:
    """A typed attribute value as text (SRC-08)."""
    if kind == STRING:
        return strings[raw]
    if kind == FLOAT:
        return repr(struct.unpack("<f", struct.pack("<I", raw))[0])
    if kind == BOOLEAN:
        return "true" if raw else "false"
    if kind in (REFERENCE, ATTRIBUTE):
        return ("@" if kind == REFERENCE else "?") + f"{raw:08x}"
    if kind == HEX:
        return f"0x{raw:x}"
    if kind in COLOURS:
        return f"#{raw:08x}"
    return str(raw - (1 << 32) if raw >> 31 else raw)


def elements(data: bytes) -> Iterator[tuple[bool, str, dict[str, str]]]:
    """(whether it begins, name, attributes) of each tag of a binary XML file."""
    at, strings = struct.unpack_from("<H", data, 2)[0], []
    while at + 8 <= len(data):
        kind, head, size = struct.unpack_from("<HHI", data, at)
        if kind == POOL:
            strings = string_pool(data, at)
        elif kind in (START, END):
            name = strings[struct.unpack_from("<I", data, at + head + 4)[0]]
            attributes = {}
            if kind == START:
                first, step, n = struct.unpack_from("<3H", data, at + head + 8)
                for i in range(n):
                    _, key, text, _, _, what, raw = struct.unpack_from("<IIIHBBI", data, at + head + first + step * i)
                    attributes[strings[key]] = strings[text] if what == STRING and text < len(strings) else value(what, raw, strings)
            yield kind == START, name, attributes
        at += max(8, size)


def manifest(data: bytes) -> tuple[str | None, str | None, str | None, str | None]:
    """(package, version code, version name, main activity); without a launcher the last activity (SRC-07)."""
    package = code = version = activity = None
    inside = {"action": False, "category": False}
    for begins, name, attributes in elements(data):
        if begins and name == "manifest":
            package, code, version = (attributes.get(k) for k in ("package", "versionCode", "versionName"))
        elif begins and name == "activity":
            activity, inside = attributes.get("name"), dict.fromkeys(inside, False)
        elif begins and name in inside and activity:
            inside[name] |= attributes.get("name") == STARTS[name]
        elif not begins and name == "activity" and all(inside.values()):
            break
    if activity and package:
        activity = package + activity if activity.startswith(".") else activity if "." in activity else f"{package}.{activity}"
    return package, code, version, activity


def scan(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = True) -> DataFrame:
    """APPS and error of all archives below path; one without a manifest that can be read has a row with what was wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf.path, pdf.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        rows.append((p, *manifest(z.read("AndroidManifest.xml")), None))
                except Exception as e:  # noqa: BLE001  whatever a broken file leads to
                    rows.append((p, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*(x.split()[0] for x in APPS.split(", ")), "error"])

    return files(spark, path, suffix, deep, content=True).mapInPandas(run, f"{APPS}, error string")


def apps(spark: SparkSession, path: str, suffix: str = ".apk", deep: bool = True) -> DataFrame:
    """APPS of all archives below path whose manifest can be read."""
    return scan(spark, path, suffix, deep).filter("error IS NULL").drop("error")
