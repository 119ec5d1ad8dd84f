"""Which configuration files make up a platform's stack, and in which order. Works on a listing of paths, so folders without a file are not seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import overlay
from lodestone.sources import files

# Platforms that count by their folder alone, and families that share a file.
MAJOR = ["Windows", "Mac", "Linux", "Android", "IOS", "TVOS", "Apple", "Unix"]
FAMILIES = {"Apple": ["Mac", "IOS", "TVOS", "Apple"], "Unix": ["Linux", "Unix"]}
DEFAULT, DEFAULT_NAME = "Default", "Default (Editor)"


def _below(path: Column, folder: str) -> Column:
    """The path below a folder, else null."""
    return F.when(path.startswith(folder + "/"), path.substr(F.lit(len(folder) + 2), F.length(path)))


def _homes(project: str, engine: str | None) -> list[str]:
    return ([f"{engine}/Engine/Config", f"{engine}/Engine/Platforms"] if engine else []) + [f"{project}/Config", f"{project}/Platforms"]


def platforms(listed: DataFrame, project: str, engine: str | None = None) -> DataFrame:
    """(platform), sorted: folders of the configuration and platform trees that hold a marker, and the major ones that are there. listed: path of every file."""
    rest = F.explode(F.array_compact(F.array(*(_below(F.col("path"), home) for home in _homes(project, engine)))))
    rows = listed.select(rest.alias("rest")).where(F.col("rest").contains("/"))
    name, inner = F.substring_index("rest", "/", 1), F.regexp_replace("rest", "^[^/]*/", "")
    marked = inner.isin("DataDrivenPlatformInfo.ini") | (inner == F.concat("name", F.lit("Engine.ini"))) | inner.startswith("Config/")
    return rows.withColumn("name", name).where(~F.col("name").startswith(".") & (marked | F.col("name").isin(MAJOR))).select(F.col("name").alias("platform")).distinct().orderBy("platform")


def stacks(listed: DataFrame, names: list[str], project: str, engine: str | None = None) -> DataFrame:
    """(platform, stack_rank, file, path): the files of each platform's stack, the least rank first; file: the name shown, with its folder where that is not Config.

    A family that is a platform itself has its file twice, as its family's and as its own. names: the platforms, a short list. Each rule gives its tier to the paths it fits; one pass over the listing, no join."""
    path = F.col("path")
    leaf = paths.filename(path)
    in_folder = lambda folder: (paths.parent(path) == folder) & leaf.endswith(".ini") & (F.length(leaf) > 4)
    rules: list[Column] = []

    def rule(fits: Column, who: list[str]) -> None:
        if who:
            rules.append(F.when(fits, F.struct(F.lit(len(rules)).alias("tier"), F.array(*map(F.lit, who)).alias("who"))))

    others = [n for n in names if n != DEFAULT]
    if engine:
        rule(path == f"{engine}/Engine/Config/Base.ini", names)
        rule(path == f"{engine}/Engine/Config/BaseEngine.ini", names)
        for family, members in FAMILIES.items():
            rule(path == f"{engine}/Engine/Config/{family}/{family}Engine.ini", [n for n in names if n in members])
        for n in others:
            rule(path == f"{engine}/Engine/Config/{n}/{n}Engine.ini", [n])
            rule(in_folder(f"{engine}/Engine/Platforms/{n}/Config"), [n])
    rule(path == f"{project}/Config/DefaultEngine.ini", names)
    rule(in_folder(f"{project}/Platforms/Config"), names)
    for n in others:
        rule(path == f"{project}/Config/{n}/{n}Engine.ini", [n])
        rule(in_folder(f"{project}/Platforms/{n}/Config"), [n])
    hits = listed.select("path", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("path", "r.tier", F.explode("r.who").alias("platform"))
    folder = paths.filename(paths.parent(path))
    shown = F.when(folder != "Config", F.concat_ws("/", folder, leaf)).otherwise(leaf)
    rank = F.row_number().over(Window.partitionBy("platform").orderBy("tier", leaf))
    return hits.select("platform", rank.alias("stack_rank"), shown.alias("file"), "path")


def config_data(spark: SparkSession, project: str, engine: str | None = None) -> DataFrame:
    """name, platform, is_profile, sections: the default's and every platform's configuration, nested and sorted; a platform without a line has no sections."""
    project, engine = project.rstrip("/"), engine.rstrip("/") if engine else None
    listed = files.walk(spark, [project, *([engine] if engine else [])], ["ini"], [])
    names = [DEFAULT, *(r["platform"] for r in platforms(listed.select("path"), project, engine).collect())]  # a folder each
    stack = stacks(listed.select("path"), names, project, engine)
    texts = files.texts(listed)
    lines = overlay.parse_ini(stack.join(texts, "path").select("platform", "stack_rank", "file", "content"))
    every = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "platform string, place int")
    found = every.join(overlay.nested(lines).withColumnRenamed("name", "platform"), "platform", "left")
    empty = F.array().cast(found.schema["sections"].dataType)
    name = F.when(F.col("platform") == DEFAULT, DEFAULT_NAME).otherwise(F.col("platform"))
    return found.orderBy("place").select(name.alias("name"), "platform", F.lit(False).alias("is_profile"), F.coalesce("sections", empty).alias("sections"))
