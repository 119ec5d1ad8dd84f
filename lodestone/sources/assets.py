"""Packaged assets: which files are read, the header's tables, and the reference graph they give.

Defined cases: a file that is no package, or ends within a table, gives a row with `error` and no edges, null content likewise; a name table that ends early keeps what it has,
other tables that begin beyond the file are empty; an unknown index in a chain reads None.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths

# Fixed values of the format.
TAGS = (0x9E2A83C1, 0xC1832A9E)
EDITOR_ONLY_STRIPPED = 0x80000000
LONGEST_CHAIN = 17
LONGEST_TEXT, LONGEST_WIDE_TEXT = 32768, 16384
# Fixed values of the scan.
PREFIXES = ("BP_", "ABP_", "WBP_", "AM_", "DA_", "DT_")
SKIPPED_FOLDERS = ["intermediate", "binaries", "build", "saved", ".git", ".vs"]
CONTENT_DEPTH = 4
TYPE_LETTERS = "AUFETS"

SCHEMA = "path string, asset_path string, parent_class string, imports array<string>, functions array<string>, error string"


class Cursor:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def one(self, code: str):
        (value,) = struct.unpack_from("<" + code, self.data, self.at)
        self.at += struct.calcsize("<" + code)
        return value

    def skip(self, n: int) -> None:
        self.at += n

    def text(self) -> str:
        """A counted text with its closing zero: bytes, or of a negative count UTF-16."""
        n = self.one("i")
        size, most, code = (n, LONGEST_TEXT, "utf-8") if n >= 0 else (-2 * n, 2 * LONGEST_WIDE_TEXT, "utf-16-le")
        if size > most or self.at + size > len(self.data):
            raise ValueError(f"text of {size} bytes")
        raw = self.data[self.at : self.at + size]
        self.at += size
        return raw[: -1 if n > 0 else -2].decode(code, "replace") if n else ""


@dataclass
class Entry:
    name: str
    outer: int
    kind: str = ""  # of an import, its class
    parent: int = 0  # of an export, its super and class
    own_class: int = 0


@dataclass
class Header:
    name: str
    imports: list[Entry]
    exports: list[Entry]

    def path(self, index: int) -> str:
        """Negative indexes are imports, positive ones exports; outer entries come first."""
        chain: list[tuple[Entry, bool]] = []
        while index and len(chain) < LONGEST_CHAIN:
            table, at = (self.imports, -index - 1) if index < 0 else (self.exports, index - 1)
            if at >= len(table):
                break
            chain.append((table[at], index < 0))
            index = table[at].outer
        out = "None" if index or not chain else ""
        for entry, imported in reversed(chain):
            name = entry.name.replace("Default__", "") if imported and entry.name.startswith("Default__") else entry.name
            mark = "." if not imported or out.startswith("/") else "/"
            if imported and out.startswith("/") and entry.kind == "Function":
                mark = ":"
            out = out + mark + name if out else name
        return out

    def references(self) -> tuple[list[str], list[str]]:
        """Rooted import paths: assets and classes, and functions."""
        found: tuple[list[str], list[str]] = ([], [])
        for i, entry in enumerate(self.imports):
            path = self.path(-i - 1)
            if path.startswith("/"):
                found[entry.kind == "Function"].append(path)
        return found

    def parent_class(self) -> str | None:
        """What the asset's own class derives from; else the native class of the first outermost object."""
        own = (self.path(e.parent) for e in self.exports if e.name in (self.name, self.name + "_C") and e.parent)
        native = (p for e in self.exports if not e.outer and e.own_class < 0 and (p := self.path(e.own_class)).startswith("/Script/") and "BlueprintGeneratedClass" not in p)
        return next(own, None) or next(native, None)


def decode(data: bytes) -> Header:
    c = Cursor(data)
    if c.one("I") not in TAGS:
        raise ValueError("no package tag")
    legacy = c.one("i")
    c.skip(4 if legacy != -4 else 0)
    v4 = c.one("i")
    v5 = c.one("i") if legacy <= -8 else 0
    c.skip(4)  # licensee version
    c.skip(24 if legacy <= -9 else 0)  # saved hash, header size
    if legacy <= -2:
        customs = c.one("i")
        c.skip(20 * customs if 0 < customs < 2000 else 0)
    c.skip(4 if legacy > -9 else 0)
    package = c.text()
    flags, name_count, name_at = c.one("I"), c.one("i"), c.one("i")
    c.skip(8 if v5 >= 4 else 0)  # soft object paths
    editor = not flags & EDITOR_ONLY_STRIPPED
    if editor:
        c.text()  # localisation id
    c.skip(8)  # gatherable text
    export_count, export_at, import_count, import_at = (c.one("i") for _ in range(4))
    if not 0 < name_at < len(data):
        raise ValueError("name table outside the file")

    c, names = Cursor(data, name_at), []
    for _ in range(name_count):
        try:
            names.append(c.text())
        except (ValueError, struct.error):
            break
        c.skip(4 if v4 >= 504 else 0)
    name = lambda i: names[i] if 0 <= i < len(names) else ""

    imports, exports = [], []
    if 0 < import_at < len(data):
        c = Cursor(data, import_at)
        for _ in range(import_count):
            c.skip(8)  # class package
            kind, outer, own = c.one("q"), c.one("i"), c.one("q")
            c.skip((8 if editor else 0) + (4 if v5 >= 12 else 0))
            imports.append(Entry(name(own & 0x7FFFFFFF), outer, name(kind & 0x7FFFFFFF)))
    if 0 < export_at < len(data):
        # the part after name and flags has a fixed size a version: sizes, three flags, guid or script offsets, inherited, package flags, editor load, asset, hash, preload
        tail = (16 if v4 >= 511 else 8) + 12 + 16 + (4 if v5 >= 6 else 0) + 4 + 4 * ((v4 >= 384) + (v4 >= 510) + (v5 >= 7)) + (20 if v4 >= 504 else 0)
        c = Cursor(data, export_at)
        for _ in range(export_count):
            own_class, parent = c.one("i"), c.one("i")
            c.skip(4 if v4 >= 517 else 0)  # template
            outer, own = c.one("i"), c.one("q")
            c.skip(4 + tail)
            if c.at > len(data):
                raise ValueError("export table outside the file")
            exports.append(Entry(name(own), outer, parent=parent, own_class=own_class))
    return Header(package.rpartition("/")[2], imports, exports)


def essential(path: Column) -> Column:
    """Maps, and assets whose names start with one of the prefixes, below a content folder at most CONTENT_DEPTH deep; path is relative to the project."""
    name, ext = paths.filename(path), paths.extension(path)
    named = F.lit(False)
    for p in PREFIXES:
        named = named | name.startswith(p)
    shallow = path.rlike(rf"^/?(?:[^/]+/){{0,{CONTENT_DEPTH - 1}}}Content/")
    return shallow & ~paths.in_directories(F.regexp_extract(path, "^(.*?)/?Content/", 1), SKIPPED_FOLDERS) & ((ext == "umap") | ((ext == "uasset") & named))


def asset_path(path: Column) -> Column:
    """/Game/ and what follows the first content folder, less the extension; other paths as they are."""
    inner = F.regexp_extract(path, r"^.*?/Content/(.*)$", 1)
    return F.when(path.contains("/Content/"), F.concat(F.lit("/Game/"), F.regexp_replace(inner, r"\.[^.]*$", ""))).otherwise(path)


def headers(files: DataFrame) -> DataFrame:
    """SCHEMA rows for files(path, content); the extra columns of files are not read."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, at, content in zip(b["path"], b["asset_path"], b["content"], strict=True):
                try:
                    head = decode(content or b"")
                    imports, functions = head.references()
                    rows.append((path, at, head.parent_class(), imports, functions, None))
                except (ValueError, struct.error) as e:
                    rows.append((path, at, None, [], [], str(e)))
            yield pd.DataFrame(rows, columns=["path", "asset_path", "parent_class", "imports", "functions", "error"])

    return files.select("path", asset_path(F.col("path")).alias("asset_path"), "content").mapInPandas(run, SCHEMA)


def refreshed(cached: DataFrame, listing: DataFrame, parsed: DataFrame) -> DataFrame:
    """The asset table after a scan: cached rows of files that are still listed with the same mtime, and the parsed rows of the others. All have path and mtime."""
    return cached.join(listing.select("path", "mtime"), ["path", "mtime"], "left_semi").unionByName(parsed)


def to_parse(cached: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files that the cache has not, or with another mtime."""
    return listing.join(cached.select("path", "mtime"), ["path", "mtime"], "left_anti")


def edges(assets: DataFrame) -> DataFrame:
    """(kind, target, asset), lower-cased and distinct: references, derived and functions."""
    own = F.lower("asset_path").alias("asset")
    ref = assets.select(F.lit("references").alias("kind"), F.explode("imports").alias("target"), own)
    derived = assets.where("parent_class is not null").select(F.lit("derived"), "parent_class", own)
    called = assets.select(F.lit("functions"), F.explode("functions"), own)
    return ref.union(derived).union(called).select("kind", F.lower("target").alias("target"), "asset").distinct()


def spellings(name: str) -> list[str]:
    """How a class is found: its last segment if it is a script path, and that without a type letter."""
    name = name.rpartition(".")[2] if name.startswith("/Script/") else name
    bare = [name[1:].lower()] if len(name) > 1 and name[0].upper() in TYPE_LETTERS and name[1].isupper() else []
    return [name.lower(), *bare]


def _targets(name: str, kind: str) -> Column:
    out, t = F.lit(False), F.col("target")
    for s in spellings(name):
        out = out | (t == s) | t.endswith("." + s)
        if kind == "functions":
            out = out | t.contains(":" + s)
    return (F.col("kind") == kind) & out


def usages(graph: DataFrame, name: str) -> DataFrame:
    """(relation, asset) of what references or derives from name. One filtered pass over the edges."""
    derived = _targets(name, "derived")
    rows = graph.where(_targets(name, "references") | _targets(name, "functions") | derived)
    return rows.select(F.when(F.col("kind") == "derived", "derived").otherwise("references").alias("relation"), "asset").distinct()


def dependencies(assets: DataFrame) -> DataFrame:
    """asset_path with its sorted, distinct imports and its parent."""
    return assets.select("asset_path", F.array_sort(F.array_distinct("imports")).alias("dependencies"), "parent_class")


def all_assets(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("kind") != "functions").select("asset").distinct().orderBy("asset")


def derived_assets(graph: DataFrame, base: str, known: DataFrame) -> DataFrame:
    """(name, path, symbol_type) of assets that derive from base and are not in known(path)."""
    rows = graph.where(_targets(base, "derived")).select(F.col("asset").alias("path")).distinct().withColumn("_k", F.lower("path"))
    rest = rows.join(known.select(F.lower("path").alias("_k")), "_k", "left_anti")
    return rest.select(F.regexp_replace(paths.filename(F.col("path")), r"\.uasset", "").alias("name"), "path", F.lit("uasset").alias("symbol_type"))
