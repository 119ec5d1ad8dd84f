"""The load job: from folders to the index's tables, and back from where they were written.

Ids are 64-bit hashes of what names a row (path; path, line and name; name and root), so a file's rows keep their ids over loads and no counter is shared.
Among 100 million rows two share an id with a chance of 3 in 10,000. Sources are parsed once: their symbols are kept in the checkpoint folder.
Defined cases: no files, an empty index; a file under no module belongs to _Global; a second rules file in a folder is ignored (the smallest path stays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import graph, incremental
from lodestone.operators.storage import cut
from lodestone.plans.service import CodeIndex
from lodestone.sources import build_rules, cpp, files

TABLES = ["modules", "files", "classes", "members", "enum_values", "inheritance", "file_includes", "components", "calls"]


def _last(root: str) -> str:
    return root.rstrip("/").rpartition("/")[2]


def components(walked: DataFrame, project: str, engine: str | None) -> DataFrame:
    """The project, the engine and each plugin manifest's folder; of equal names the shortest root."""
    spark = walked.sparkSession
    fixed = [(_last(project), _last(project), "Game", _last(project), project)] + ([(_last(engine), "Engine", "Engine", _last(engine), engine)] if engine else [])
    base = spark.createDataFrame(fixed, "name string, display_name string, type string, owner string, root_path string")
    root = paths.parent(F.col("path"))
    owner = owner_of(root, project, engine)
    plugins = walked.where("extension = 'uplugin'").select(paths.filename(root).alias("name"), paths.stem(F.col("path")).alias("display_name"), F.lit("Plugin").alias("type"), owner.alias("owner"), root.alias("root_path"))
    return graph.best_per(base.union(plugins), ["name"], [F.length("root_path"), F.col("root_path"), F.col("display_name")]).select("name", "display_name", "type", "owner", "root_path")


def owner_of(root: Column, project: str, engine: str | None) -> Column:
    return F.when(root.startswith(engine + "/"), _last(engine)).otherwise(_last(project)) if engine else F.lit(_last(project))


def modules(walked: DataFrame, project: str, engine: str | None) -> DataFrame:
    """Rules files as modules with all they depend on, public and private, transitively (a cycle's members reach each other), and the fixed ones."""
    rules = build_rules.parse(files.texts(walked.where(F.lower("filename").endswith(".build.cs"))))
    rules = rules.select(F.substring_index(paths.filename(F.col("path")), ".", 1).alias("name"), paths.parent(F.col("path")).alias("root_path"), "path", "public", "private")
    rules = cut(graph.best_per(rules, ["root_path"], [F.col("path")]))
    edges = rules.select(F.col("name").alias("src"), F.explode(F.array_union("public", "private")).alias("dst")).distinct()
    deep = graph.reach(rules.select(F.col("name").alias("origin"), F.col("name").alias("node")), edges).where("depth > 0").join(rules.select(F.col("name").alias("node")).distinct(), "node", "left_semi")
    deep = deep.groupBy(F.col("origin").alias("name")).agg(F.array_sort(F.collect_set("node")).alias("deep_dependencies"))
    own = rules.join(deep, "name", "left").select("name", F.lit("Runtime").alias("type"), F.lit("Individual").alias("scope"), "root_path", "deep_dependencies", owner_of(F.col("root_path"), project, engine).alias("owner"))
    fixed = [("_GameConfig", "Config", "Individual", f"{project}/Config", _last(project)), ("_Global", "Global", "Game", project, None)]
    fixed += [("_EngineConfig", "Config", "Individual", f"{engine}/Engine/Config", _last(engine)), ("_EngineShaders", "Shader", "Individual", f"{engine}/Engine/Shaders", _last(engine))] if engine else []
    base = walked.sparkSession.createDataFrame(fixed, "name string, type string, scope string, root_path string, owner string")
    both = own.unionByName(base.withColumn("deep_dependencies", F.lit(None).cast("array<string>")))
    return both.select(F.xxhash64("name", "root_path").alias("id"), "name", "type", "scope", "root_path", F.coalesce("deep_dependencies", F.array().cast("array<string>")).alias("deep_dependencies"), "owner")


def build(spark: SparkSession, project: str, engine: str | None = None, extensions: list[str] | None = None, excluded: list[str] | None = None, fast: bool = False) -> CodeIndex:
    """Walks the folders once for names and once for the contents that are parsed. fast: headers without a sign of an indexed symbol are listed, but not parsed."""
    kinds = files.EXTENSIONS if extensions is None else extensions
    project, engine = project.rstrip("/"), engine.rstrip("/") if engine else None
    walked = files.walk(spark, [project] + ([engine] if engine else []), sorted({*kinds, "uplugin", "cs"}), excluded)
    mods = cut(modules(walked, project, engine))
    listed = walked.where(F.col("extension").isin(kinds)).select("path", "filename", "extension", "mtime")
    roots = mods.where("name <> '_Global'").select(F.col("root_path").alias("root"), "name")
    held = paths.longest_prefix(listed, roots).withColumn("root", F.coalesce("root", F.lit(project)))
    sources = walked.where(F.col("extension").isin(files.PARSED))
    table = held.select(
        F.xxhash64("path").alias("id"), F.xxhash64(paths.parent(F.col("path"))).alias("dir_id"), F.col("path").alias("full_path"), "filename", "extension", "mtime",
        F.xxhash64("name", "root").alias("module_id"), F.col("extension").isin("h", "hpp").alias("is_header"),
    )
    table = cut(table.join(files.hashes(sources).withColumnRenamed("path", "full_path"), "full_path", "left"))
    texts = files.texts(sources)
    texts = texts.where(cpp.worth_parsing(F.col("path"), F.col("content"))) if fast else texts
    return CodeIndex(mods, table, *parsed(texts, table), components(walked, project, engine), call_table(texts))


def call_table(sources: DataFrame) -> DataFrame:
    """(file_id, name, line) of the call sites of sources(path, content)."""
    return cpp.calls(sources).select(F.xxhash64("path").alias("file_id"), "name", "line")


def parsed(sources: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """classes, members, enum_values, inheritance and file_includes of sources(path, content); parents and includes are resolved against the symbols given and the file table."""
    found = cut(cpp.symbols(sources).withColumn("id", F.xxhash64("path", "line", "name", "symbol_type")).withColumn("file_id", F.xxhash64("path")))
    classes = found.select("id", "name", "namespace", F.try_element_at("bases", F.lit(1)).alias("base_class"), "file_id", "line", "end_line", "symbol_type")
    item = found.select(F.col("id").alias("class_id"), "file_id", F.posexplode("members").alias("at", "m")).select("class_id", "file_id", "at", "m.*")
    members = item.where("type <> 'enum_item'").select(
        F.xxhash64("class_id", "at").alias("id"), "class_id", "name", "type", "flags", "access", "detail", "return_type", F.col("flags").contains("static").alias("is_static"), "line", "file_id"
    )
    values = item.where("type = 'enum_item'").select(F.col("class_id").alias("enum_id"), "name", "line", "file_id")
    bases = found.select(F.col("id").alias("child_id"), F.explode("bases").alias("parent_name"))
    inheritance = incremental.resolve_any(bases, "parent_name", classes, "name", "id", "parent_class_id").select("child_id", "parent_name", "parent_class_id")
    lines = cpp.includes(sources).select(F.xxhash64("path").alias("file_id"), "include_path", "base_filename")
    includes = incremental.resolve_unique(lines, "base_filename", table, "filename", "id", "resolved_file_id").select("file_id", "include_path", "base_filename", "resolved_file_id")
    return classes, members, values, inheritance, includes


def updated(index: CodeIndex, sources: DataFrame, deleted: DataFrame | None = None) -> CodeIndex:
    """The index after changed or new sources(path, content) and deleted(path): only these are parsed, rows of other files stay, and names are resolved anew over all rows.

    A file's child rows go with it. A new file gets its module by its place, and a null mtime and hash until the next walk. A path both changed and deleted is deleted."""
    gone = sources.select("path").limit(0) if deleted is None else deleted.select("path")
    fresh = sources.join(gone, "path", "left_anti")
    touched = cut(fresh.select("path").union(gone).select(F.xxhash64("path").alias("file_id")).distinct())
    without = lambda df, key: df.join(touched.select(F.col("file_id").alias(key)), key, "left_anti").select(df.columns)
    old = cut(index.classes.join(touched, "file_id", "left_semi").select("id"))
    without_classes = lambda df, key: df.join(old.select(F.col("id").alias(key)), key, "left_anti").select(df.columns)

    roots = index.modules.where("name <> '_Global'").select(F.col("root_path").alias("root"), "name")
    global_id = index.modules.where("name = '_Global'").agg(F.min("id")).first()[0]
    new = paths.longest_prefix(fresh.select("path"), roots)
    ext = paths.extension(F.col("path"))
    new = new.select(
        F.xxhash64("path").alias("id"), F.xxhash64(paths.parent(F.col("path"))).alias("dir_id"), F.col("path").alias("full_path"), paths.filename(F.col("path")).alias("filename"), ext.alias("extension"),
        F.lit(None).cast("long").alias("mtime"), F.when(F.col("root").isNull(), F.lit(global_id).cast("long")).otherwise(F.xxhash64("name", "root")).alias("module_id"), ext.isin("h", "hpp").alias("is_header"),
    )
    kept = index.files.join(gone.select(F.col("path").alias("full_path")), "full_path", "left_anti").select(index.files.columns)
    table = cut(kept.unionByName(new.join(kept.select("id"), "id", "left_anti"), allowMissingColumns=True))

    classes, members, values, inheritance, includes = parsed(fresh, table)
    classes = cut(without(index.classes, "file_id").unionByName(classes))
    bases = without_classes(index.inheritance, "child_id").unionByName(inheritance).drop("parent_class_id")
    lines = without(index.file_includes, "file_id").unionByName(includes).drop("resolved_file_id")
    return CodeIndex(
        index.modules, table, classes, without(index.members, "file_id").unionByName(members), without_classes(index.enum_values, "enum_id").unionByName(values),
        incremental.resolve_any(bases, "parent_name", classes, "name", "id", "parent_class_id"), incremental.resolve_unique(lines, "base_filename", table, "filename", "id", "resolved_file_id"), index.components,
        None if index.calls is None else without(index.calls, "file_id").unionByName(call_table(fresh)),
    )


SCHEMA_VERSION = 2
SNAPSHOT = "version long, schema_version int, saved_at timestamp, project_revision string, engine_revision string, meta map<string,string>"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The log of saved versions; empty where nothing was saved."""
    if not _there(spark, f"{folder}/snapshots"):
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(f"{folder}/snapshots")


def latest(spark: SparkSession, folder: str) -> Row | None:
    """The newest version of this schema, with its revisions and meta keys."""
    return _snapshots(spark, folder).where(F.col("schema_version") == SCHEMA_VERSION).orderBy(F.desc("version")).limit(1).first()


def save(index: CodeIndex, folder: str, project_revision: str | None = None, engine_revision: str | None = None, meta: dict[str, str] | None = None) -> int:
    """Writes the index as a new version beside the older ones, then enters it in the log, and gives its number. Readers of an older version, also the plans
    of an index that was loaded from here and updated, keep their files."""
    spark = index.classes.sparkSession
    version = (_snapshots(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    for name in TABLES:
        if getattr(index, name) is not None:
            getattr(index, name).write.parquet(f"{folder}/v{version}/{name}")
    entry = spark.createDataFrame([(version, SCHEMA_VERSION, project_revision, engine_revision, meta or {})], "version long, schema_version int, project_revision string, engine_revision string, meta map<string,string>")
    entry.withColumn("saved_at", F.current_timestamp()).select(*(c.split(" ")[0] for c in SNAPSHOT.split(", "))).coalesce(1).write.mode("append").parquet(f"{folder}/snapshots")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None) -> CodeIndex:
    """A saved version, the newest if none is named."""
    if version is None:
        entry = latest(spark, folder)
        if entry is None:
            raise ValueError(f"no index of schema {SCHEMA_VERSION} in {folder}")
        version = entry["version"]
    return CodeIndex(*(spark.read.parquet(f"{folder}/v{version}/{name}") for name in TABLES if name != "calls" or _there(spark, f"{folder}/v{version}/{name}")))


def needs_full_refresh(spark: SparkSession, folder: str, engine_revision: str | None = None) -> bool:
    """Is there no index of this schema, one of another engine revision, or one without files or classes?"""
    entry = latest(spark, folder)
    if entry is None or engine_revision is not None and entry["engine_revision"] != engine_revision:
        return True
    index = load(spark, folder, entry["version"])
    return index.files.isEmpty() or index.classes.isEmpty()


def cleanup(spark: SparkSession, folder: str, keep: int = 1) -> None:
    """Deletes the files of all but the newest `keep` versions (0: the whole index), once nothing reads them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(conf)
    if keep <= 0:
        system.delete(place, True)
        return
    known = [r["version"] for r in _snapshots(spark, folder).select("version").orderBy(F.desc("version")).collect()]  # a number a version
    for version in known[keep:]:
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/v{version}"), True)


def replaced_components(old: DataFrame, new: DataFrame, engine_owner: str | None, engine_changed: bool) -> DataFrame:
    """Components or modules after a refresh: all of the new ones, and where the engine did not change the old ones of the engine that the refresh did not read."""
    if engine_changed or engine_owner is None:
        return new
    kept = old.where(F.col("owner") == engine_owner).join(new.select("name"), "name", "left_anti")
    return new.unionByName(kept.select(new.columns))


def engine_version(spark: SparkSession, engine: str) -> dict[str, str]:
    """The meta keys of the engine's version file; none without it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "Build.version").option("recursiveFileLookup", "true")
    if not _there(spark, f"{engine}/Engine/Build"):
        return {}
    fields = "MajorVersion int, MinorVersion int, PatchVersion int, BranchName string"
    rows = found.load(f"{engine}/Engine/Build").where(F.col("path").endswith("/Engine/Build/Build.version")).select(F.from_json(F.col("content").cast("string"), fields).alias("v")).select("v.*").dropna()
    first = rows.first()
    return {} if first is None else {f"ue_version_{k}": str(first[c]) for k, c in (("major", "MajorVersion"), ("minor", "MinorVersion"), ("patch", "PatchVersion"), ("branch", "BranchName"))}


def missing_includes(index: CodeIndex, sources: DataFrame) -> DataFrame:
    """(path, symbol, header, line): for sources(path, content), the header of each used class that none of its includes brings, directly or not.

    A class counts as used where its name stands as an identifier. Candidates are headers of the file's own module and its deep dependencies; a symbol with any covered
    candidate is covered; else the best is a public header, then the shortest path. A header is named once a file. All files are checked in the same joins."""
    rows = index._files()
    own = sources.select("path").join(rows, "path").select("path", F.col("file_id").alias("own_id"), "module_name")
    deps = index.modules.select(F.col("name").alias("module_name"), F.explode(F.array_union(F.array("name"), "deep_dependencies")).alias("dep")).join(own.select("module_name").distinct(), "module_name", "left_semi").distinct()
    headers = rows.where("is_header").select("file_id", F.col("path").alias("header_path"), F.col("module_name").alias("dep"), paths.include_path(F.col("path"), F.col("module_root")).alias("header"))
    defined = index.classes.select(F.col("name").alias("symbol"), "file_id").distinct().join(headers, "file_id")
    visible = defined.join(deps, "dep").select("module_name", "symbol", "file_id", "header")  # what each module of the sources sees
    used = cpp.words(sources).withColumnRenamed("name", "symbol").join(own, "path")
    candidates = used.join(visible, ["module_name", "symbol"]).where("file_id <> own_id").select("path", "symbol", "line", "file_id", "header")

    lines = cpp.includes(sources)
    open_ = candidates.select("path").distinct()  # only files with a candidate close their includes
    seeds = lines.join(open_, "path", "left_semi").join(index.files.select("id", F.col("filename").alias("base_filename")), "base_filename").select(F.col("path").alias("origin"), F.col("id").alias("node"))
    reached = graph.reach(seeds, cut(graph.effective_includes(index.file_includes, index.files))).select(F.col("origin").alias("path"), F.col("node").alias("file_id"), F.lit(1).alias("reached"))
    direct = lines.select("path", F.lower("include_path").alias("low"), F.lit(1).alias("direct")).distinct()
    marked = candidates.withColumn("low", F.lower("header")).join(direct, ["path", "low"], "left").join(reached, ["path", "file_id"], "left")
    picked = marked.groupBy("path", "symbol").agg(
        F.bool_or(F.col("direct").isNotNull() | F.col("reached").isNotNull()).alias("covered"), F.min("line").alias("line"),
        F.min_by("header", F.struct(~F.col("header").contains("Public/"), F.length("header"), "header")).alias("header"),
    )
    once = picked.where("not covered").groupBy("path", "header").agg(F.min(F.struct("symbol", "line")).alias("s"))
    return once.select("path", "s.symbol", "header", "s.line")


def insert_line(content: Column) -> Column:
    """Where an include goes: before the generated header, else after the last include, else line 1."""
    numbered = F.transform(F.split(content, "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.rlike(r"^\s*#\s*include\b").alias("is"), t.rlike(r"^\s*#\s*include\b.*\.generated\.h").alias("gen")))
    generated = F.array_min(F.transform(F.filter(numbered, lambda x: x["gen"]), lambda x: x["line"]))
    last = F.array_max(F.transform(F.filter(numbered, lambda x: x["is"]), lambda x: x["line"]))
    return F.coalesce(F.when(generated.isNotNull(), F.greatest(generated - 1, F.lit(1))), last + 1, F.lit(1))
