"""The file walk: what lies under the roots, as one listing job; contents are read only where a query asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths

# What is listed, and folders that are not entered.
EXTENSIONS = ["uproject", "cpp", "h", "hpp", "inl", "ini", "cs", "usf", "ush"]
EXCLUDED = ["intermediate", "binaries", "saved", ".git", ".vs", "templates"]
PARSED = ["h", "hpp", "inl", "cpp"]


def _either_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def relative(path: Column, roots: list[str]) -> Column:
    """path below the first root that holds it; null if none does."""
    cases = [F.when(path.startswith(r.rstrip("/") + "/"), path.substr(F.lit(len(r.rstrip("/")) + 2), F.length(path))) for r in roots]
    return F.coalesce(*cases)


def walk(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """(path, filename, extension, mtime in seconds, size, content) of files with one of the extensions; folders are tested below the root, letter case aside.

    Spark's own listing leaves out files without a byte, and files and folders whose names begin with _ or a full stop. A name pattern keeps other files from being opened; a plan that does not select content opens none."""
    kinds = EXTENSIONS if extensions is None else extensions
    glob = "*.{" + ",".join(map(_either_case, kinds)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    rows = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    inner = relative(F.col("path"), [*sorted(roots, key=len, reverse=True), "/"])
    kept = rows.where(~paths.in_directories(paths.parent(F.coalesce(inner, F.col("path"))), EXCLUDED if excluded is None else [e.lower() for e in excluded]))
    return kept.select("path", paths.filename(F.col("path")).alias("filename"), paths.extension(F.col("path")).alias("extension"), "mtime", "size", "content")


def texts(rows: DataFrame) -> DataFrame:
    """(path, content as text); bytes that are no UTF-8 become replacement characters."""
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def hashes(rows: DataFrame) -> DataFrame:
    """(path, file_hash): SHA-256 of the content, in hex."""
    return rows.select("path", F.sha2("content", 256).alias("file_hash"))
