"""Roots by their marker files: the nearest folder above a path that holds one. Works on a listing of paths; each path joins its own folders, no path meets all markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths

# Marker files.
PROJECT, MODULE = r"\.uproject$", r"\.[Bb]uild\.cs$"


def _order(strategy: str, marker: Column, base: Column) -> Column:
    if strategy == "shortest":
        return F.struct(F.length(base), base)
    if strategy == "longest":
        return F.struct(-F.length(base), base)
    if strategy in ("first", "alphabetical"):  # a listing has no order of its own, so the first is the first by name
        return F.struct(F.lit(0), base)
    raise ValueError(f"unknown strategy {strategy!r}")


def roots(starts: DataFrame, listed: DataFrame, pattern: str, strategy: str = "first", max_depth: int | None = None) -> DataFrame:
    """(path, root, marker, name): for each start path the nearest folder, itself included, that holds a file whose name fits the pattern, and which of its files
    the strategy picks: first, shortest, longest or alphabetical. Starts without one have no row. max_depth: so many folders up at most."""
    leaf = paths.filename(F.col("path"))
    base = F.regexp_replace(leaf, pattern, "")
    held = listed.where(leaf.rlike(pattern)).select(paths.parent(F.col("path")).alias("root"), F.col("path").alias("marker"), base.alias("name"))
    picked = held.groupBy("root").agg(F.min_by(F.struct("marker", "name"), _order(strategy, F.col("marker"), F.col("name"))).alias("m")).select("root", "m.*")
    start = F.regexp_replace("path", "(?<=.)/+$", "")
    above = starts.select("path", F.explode(paths.prefixes(start)).alias("root"), F.size(F.split(start, "/")).alias("depth"))
    if max_depth is not None:
        above = above.where(F.col("depth") - F.size(F.split("root", "/")) <= max_depth)
    near = above.select("path", "root").distinct().join(picked, "root")
    best = near.groupBy("path").agg(F.max_by(F.struct("root", "marker", "name"), F.length("root")).alias("b"))
    return best.select("path", "b.*")


def projects(starts: DataFrame, listed: DataFrame, strategy: str = "first", max_depth: int | None = None) -> DataFrame:
    return roots(starts, listed, PROJECT, strategy, max_depth)


def modules(starts: DataFrame, listed: DataFrame) -> DataFrame:
    return roots(starts, listed, MODULE)


def engines(starts: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, root): the nearest folder above each start that has a folder Engine with a file in it."""
    tops = listed.select(F.regexp_extract("path", "^(.*?)/Engine/", 1).alias("root")).where("root <> ''").distinct()
    above = starts.select("path", F.explode(paths.prefixes(F.col("path"))).alias("root"))
    return above.join(tops, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def engine_association(association: Column) -> Column:
    """What an association names: embedded (none), guid, path or version."""
    text = F.trim(F.coalesce(association, F.lit("")))
    guid = r"(?i)^\{?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?$"
    return F.when(text == "", "embedded").when(text.rlike(guid), "guid").when(text.rlike(r"^([A-Za-z]:[/\\]|/)"), "path").otherwise("version")


def manifest(project_root: Column, project: Column, platform: Column, configuration: Column, editor: Column) -> Column:
    """Where the header tool's manifest of a project's target lies."""
    target = F.concat(project, F.when(editor, "Editor").otherwise(""))
    return F.concat_ws("/", project_root, F.lit("Intermediate/Build"), platform, target, configuration, F.concat(target, F.lit(".uhtmanifest")))
