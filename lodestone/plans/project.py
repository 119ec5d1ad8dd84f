"""A project's modules by kind and scope, and what lies in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.service import CodeIndex

SCOPES = ("game", "engine", "runtime", "editor", "full")


def bucket(kind: Column) -> Column:
    """program, developer, editor or runtime, of a module's type."""
    t = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(t.isin("program", "developer"), t).when(t.contains("editor") | (t == "uncookedonly"), "editor").otherwise("runtime")


def _under(path: Column, root: Column) -> Column:
    low = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    return F.coalesce(low(path).startswith(F.concat(F.regexp_replace(low(root), "/$", ""), F.lit("/"))), F.lit(False))


def scoped(modules: DataFrame, components: DataFrame, scope: str = "runtime", deep: bool = True) -> DataFrame:
    """(name), distinct: the modules of a scope, with all that they depend on if deep.

    modules: name, type, owner, root_path, deep_dependencies; components: name, type, root_path, of which the game and the engine are one row each."""
    kind, t = F.col("type"), F.lower(F.coalesce("type", F.lit("")))
    if scope in ("game", "engine", "runtime"):
        one = components.where(F.col("type") == ("Engine" if scope == "engine" else "Game")).agg(F.max(F.struct("name", "root_path")).alias("c")).first()["c"]  # one row
        name, root = (F.lit(one and one[k]).cast("string") for k in ("name", "root_path"))
        own = F.coalesce(F.col("owner") == name, F.lit(False))
        rows, fits = modules, own | (F.coalesce(kind == "Runtime", F.lit(False)) if scope == "runtime" else _under(F.col("root_path"), root))
    elif scope == "editor":
        rows, fits = modules, t.isin("runtime", "developer", "uncookedonly") | t.contains("editor")
    elif scope == "full":
        rows, fits = modules, ~F.coalesce(kind == "Program", F.lit(False))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    seeds = rows.where(fits)
    names = seeds.select("name")
    return (names.union(seeds.select(F.explode("deep_dependencies"))) if deep else names).distinct()


def maps(index: CodeIndex) -> DataFrame:
    """Every module with its bucket and the component whose root holds it."""
    return index.modules.select("name", "type", "scope", F.col("root_path").alias("module_root"), "owner", "deep_dependencies", bucket(F.col("type")).alias("bucket")).orderBy("name")


def _in_scope(rows: DataFrame, index: CodeIndex, scope: str, deep: bool) -> DataFrame:
    names = scoped(index.modules, index.components, scope, deep).withColumnRenamed("name", "module_name")
    return rows.join(names, "module_name", "left_semi")


def items(index: CodeIndex, scope: str = "runtime", deep: bool = True) -> DataFrame:
    """(path, display, type): the scope's files, displayed as module/relative path."""
    rows = _in_scope(index._files(), index, scope, deep)
    inner = F.when(_under(F.col("path"), F.col("module_root")), F.col("path").substr(F.length("module_root") + 2, F.length("path"))).otherwise(F.col("path"))
    return rows.select("path", F.concat_ws("/", "module_name", inner).alias("display"), F.lit("file").alias("type"))


def classes(index: CodeIndex, scope: str = "runtime", deep: bool = True, symbol_type: str | None = None) -> DataFrame:
    """(path, items): the scope's classes by file, in order of lines."""
    rows = _in_scope(index._classes(), index, scope, deep)
    rows = rows if symbol_type is None else rows.where(F.col("symbol_type") == symbol_type)
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "symbol_type", "base_class"))).alias("items"))
