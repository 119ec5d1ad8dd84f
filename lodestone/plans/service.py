"""The code index: typed tables and one method per query kind. Every method returns a DataFrame.

Tables (names inlined, full_path materialised once): directories(id, parent_id, name, full_path), modules(id, name, type, scope, root_path, deep_dependencies),
files(id, dir_id, full_path, filename, extension, mtime, module_id, is_header), classes(id, name, namespace, base_class, file_id, line, end_line, symbol_type),
members(id, class_id, name, type, flags, access, detail, return_type, is_static, line, file_id), enum_values(enum_id, name, line, file_id),
inheritance(child_id, parent_name, parent_class_id), file_includes(file_id, include_path, base_filename, resolved_file_id), components(name, display_name, type, owner, root_path),
calls(file_id, name, line), which an index may lack.
Every limit has a total order.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import graph, text
from lodestone.sources import cpp

# Pointer wrappers, and what their members give.
POINTERS = ["TWeakObjectPtr", "TObjectPtr", "TSharedPtr", "TSharedRef", "TUniquePtr", "TWeakPtr", "TStrongObjectPtr", "TSoftObjectPtr"]
POINTEES, CHECKS = ("Get", "GetChecked", "operator*", "operator->"), ("IsValid", "IsStale", "IsExplicitlyNull")
# Symbol types of the three kinds of global completions, with the number an editor shows each by.
GLOBALS = [{"class": 7, "struct": 7, "enum": 13, "namespace": 9}, {"define": 15}, {"global_function": 3, "global_var": 6, "type_alias": 25, "delegate": 7, "log_category": 6}]


@dataclass
class CodeIndex:
    modules: DataFrame
    files: DataFrame
    classes: DataFrame
    members: DataFrame
    enum_values: DataFrame
    inheritance: DataFrame
    file_includes: DataFrame
    components: DataFrame
    calls: DataFrame | None = None
    cache: dict = field(default_factory=dict)

    # joins that most queries share

    def _files(self) -> DataFrame:
        m = self.modules.select(F.col("id").alias("module_id"), F.col("name").alias("module_name"), F.col("root_path").alias("module_root"))
        return self.files.join(m, "module_id", "left").select(F.col("id").alias("file_id"), F.col("full_path").alias("path"), "filename", "extension", "is_header", "module_name", "module_root")

    def _classes(self) -> DataFrame:
        return self.classes.join(self._files(), "file_id")

    def _members(self) -> DataFrame:
        c = self.classes.select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
        return self.members.join(c, "class_id")

    # point lookups, filters, projections

    def get_classes(self, where: Column | None = None) -> DataFrame:
        rows = self._classes() if where is None else self._classes().where(where)
        return rows.select("name", "base_class", "path", "line", "symbol_type").orderBy("name", "path", "line")

    def find_class_by_name(self, name: str) -> DataFrame:
        return self.get_classes(F.col("name") == name)

    def search_classes_prefix(self, prefix: str, limit: int = 200) -> DataFrame:
        return self.get_classes(F.col("name").ilike(prefix + "%")).limit(limit)

    def get_structs(self) -> DataFrame:
        return self.get_classes(F.col("symbol_type").isin("struct", "USTRUCT"))

    def get_structs_only(self) -> DataFrame:
        rows = self._classes().where((F.col("symbol_type") == "struct") & ~F.col("name").startswith("(") & F.col("module_name").isNotNull())
        return rows.select("name", "base_class", "symbol_type", "path", "module_name").orderBy("name", "path")

    def get_class_members(self, name: str, kind: str | None = None) -> DataFrame:
        rows = self._members().where(F.col("class_name") == name)
        rows = rows if kind is None else rows.where(F.col("type") == kind)
        return rows.select("name", "type", "access", "flags", "line", "detail", "return_type", "is_static").orderBy("line", "name")

    def get_class_methods(self, name: str) -> DataFrame:
        return self.get_class_members(name, "function")

    def get_class_properties(self, name: str) -> DataFrame:
        return self.get_class_members(name, "property")

    def get_class_members_by_id(self, class_id: int) -> DataFrame:
        return self.members.where(F.col("class_id") == class_id).select("name", "type", "access", "line").orderBy("line", "name")

    def get_enum_values(self, enum: str) -> DataFrame:
        """Of the enum by its full name, else by its last segment."""
        found = self.classes.where(F.col("name").isin(enum, enum.rpartition("::")[2]))
        best = found.select("id", (F.col("name") != enum).cast("int").alias("tier")).groupBy().agg(F.min(F.struct("tier", "id")).alias("b")).select(F.col("b.id").alias("enum_id"))
        return self.enum_values.join(best, "enum_id").select("name", "line").orderBy("line", "name")

    def get_modules(self) -> DataFrame:
        return self.modules.select("name", "type", "scope", F.col("root_path").alias("module_root"), "id").orderBy("name", "id")

    def get_module_by_name(self, name: str) -> DataFrame:
        return self.get_modules().where(F.col("name") == name).limit(1)

    def get_module_id_by_name(self, name: str) -> DataFrame:
        return self.get_module_by_name(name).select("id")

    def get_module_root_path(self, name: str) -> DataFrame:
        return self.get_module_by_name(name).select("module_root")

    def get_files_in_module(self, module_id: int) -> DataFrame:
        return self.files.where(F.col("module_id") == module_id).select(F.col("full_path").alias("path"), "filename", "extension").orderBy("path")

    def get_module_files_by_name_and_root(self, name: str, root: str) -> DataFrame:
        """Files of the module of that name at that root: names alone need not be unique."""
        return self._files().where((F.col("module_name") == name) & (F.col("module_root") == root)).select("path", "filename", "extension").orderBy("path")

    def get_module_dirs_by_name_and_root(self, name: str, root: str) -> DataFrame:
        return self.get_module_files_by_name_and_root(name, root).select(paths.parent(F.col("path")).alias("directory")).distinct().orderBy("directory")

    def get_assets(self, limit: int = 1000) -> DataFrame:
        """Asset files that the index holds, the first `limit` by path."""
        return self.files.where(F.lower("extension").isin("uasset", "umap")).select(F.col("full_path").alias("path"), "filename").orderBy("path").limit(limit)

    def get_components(self) -> DataFrame:
        return self.components.dropna(subset=["name", "display_name", "type", "root_path"]).orderBy("name")

    def load_component_data(self, name: str) -> DataFrame:
        """A component with the modules under its root."""
        own = self.components.where(F.col("name") == name).select(F.col("name").alias("component"), F.col("root_path").alias("component_root"))
        under = self.modules.select(F.col("name").alias("module"), F.explode(paths.prefixes(F.col("root_path"))).alias("component_root"))
        return own.join(under, "component_root", "left").select("component", "module").orderBy("module")

    def get_class_file_path(self, name: str) -> DataFrame:
        return self._classes().where(F.col("name") == name).select("path").orderBy("path").limit(1)

    def get_all_file_paths(self) -> DataFrame:
        return self.files.select(F.col("full_path").alias("path"))

    def get_all_files_metadata(self) -> DataFrame:
        return self._files().select("filename", "path", "module_name")

    def get_target_files(self) -> DataFrame:
        return self._files().where(F.col("filename").ilike("%.target.cs")).select("filename", "path")

    def get_build_targets(self) -> DataFrame:
        stem = F.regexp_replace("filename", r"(?i)\.target\.cs$", "")
        kind = F.when(stem.endswith("Editor"), "Editor").when(stem.endswith("Server"), "Server").when(stem.endswith("Client"), "Client").otherwise("Game")
        return self.get_target_files().select(stem.alias("target"), kind.alias("kind"), "path")

    def get_all_ini_files(self) -> DataFrame:
        return self._files().where(F.lower("extension") == "ini").select("filename", "path")

    def get_program_files(self) -> DataFrame:
        return self._files().where(F.col("path").contains("/Programs/")).select("filename", "path")

    def get_files_in_modules(self, modules: list[str], extensions: list[str] | None = None, part: str | None = None) -> DataFrame:
        rows = self._files().where(F.col("module_name").isin(modules))
        rows = rows if not extensions else rows.where(F.lower("extension").isin([e.lower() for e in extensions]))
        rows = rows if part is None else rows.where(F.col("path").contains(part))
        return rows.select("path", "module_name", "module_root", "extension")

    def get_directories_in_module(self, module: str) -> DataFrame:
        return self._files().where(F.col("module_name") == module).select(paths.parent(F.col("path")).alias("directory")).distinct()

    def search_files_by_path_part(self, part: str, limit: int = 500) -> DataFrame:
        return self._files().where(paths.matches_all(F.col("filename"), part)).select("filename", "path", "module_name", "module_root").orderBy("filename", "path").limit(limit)

    def search_files_in_modules(self, modules: list[str], part: str, limit: int = 100) -> DataFrame:
        return self.get_files_in_modules(modules).where(F.col("path").ilike(f"%{part}%")).orderBy("path").limit(limit)

    def get_files_in_favorite_paths(self, directories: list[str], exact: list[str]) -> DataFrame:
        keep = F.col("path").isin(exact)
        for d in directories:
            keep = keep | F.col("path").startswith(d.rstrip("/") + "/")
        return self._files().where(keep).select("path", "filename", "module_name", "module_root", "extension").orderBy("filename", "path")

    def get_classes_in_modules(self, modules: list[str], symbol_type: str | None = None) -> DataFrame:
        rows = self._classes().where(F.col("module_name").isin(modules))
        rows = rows if symbol_type is None else rows.where(F.col("symbol_type") == symbol_type)
        return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "symbol_type", "base_class"))).alias("items")).orderBy("path")

    def get_file_symbols(self, path: str) -> DataFrame:
        """Classes of a file with their members; the full path, else the file name."""
        hit = self._files().where((F.col("path") == path) | (F.col("filename") == path.rpartition("/")[2]))
        best = hit.groupBy().agg(F.min(F.struct((F.col("path") != path).cast("int"), "path", "file_id")).alias("b")).select(F.col("b.file_id").alias("file_id"))
        members = self.members.groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line", "name", "type", "access"))).alias("members"))
        return self.classes.join(best, "file_id").join(members, "id", "left").select("name", "line", "end_line", "symbol_type", "members").orderBy("line", "name")

    def enclosing_class(self, probes: DataFrame) -> DataFrame:
        """(file_id, line) to the innermost class that holds the line."""
        inside = probes.join(self.classes.select("file_id", "name", F.col("line").alias("start"), "end_line"), "file_id").where("line >= start and (end_line is null or line <= end_line)")
        return inside.groupBy("file_id", "line").agg(F.max_by("name", F.struct("start", "name")).alias("class_name"))

    # hierarchies

    def find_derived_classes(self, base: str) -> DataFrame:
        children = self.inheritance.where(F.col("parent_name") == base).select(F.col("child_id").alias("id")).distinct()
        return self._classes().join(children, "id").select("name", "path", "line", "symbol_type", "module_name").orderBy("name", "path")

    def _edges(self, up: bool) -> DataFrame:
        e = self.inheritance.where("parent_class_id is not null")
        return e.select(F.col("child_id").alias("src"), F.col("parent_class_id").alias("dst")) if up else e.select(F.col("parent_class_id").alias("src"), F.col("child_id").alias("dst"))

    def get_recursive_derived_classes(self, base: str) -> DataFrame:
        seeds = self.inheritance.where(F.col("parent_name") == base).select(F.lit(0).alias("origin"), F.col("child_id").alias("node"))
        found = graph.reach(seeds, self._edges(up=False)).select(F.col("node").alias("id"))
        return self._classes().join(found, "id").select("name", "path", "line", "symbol_type").orderBy("name", "path")

    def _ancestors(self, name: str, limit: int | None = None) -> DataFrame:
        seeds = self.classes.where(F.col("name") == name).select(F.lit(0).alias("origin"), F.col("id").alias("node"))
        return graph.reach(seeds, self._edges(up=True), limit).select(F.col("node").alias("id"), "depth")

    def get_recursive_parent_classes(self, name: str) -> DataFrame:
        """Ancestors by name with their least depth and best definition: headers first, then the smallest id; the farthest first."""
        rows = self._classes().join(self._ancestors(name, 50), "id").where("depth > 0")
        best = graph.best_per(rows.select("name", "depth", "path", "line", "is_header", "id"), ["name"], [F.col("depth"), ~F.col("is_header"), F.col("id")])
        return best.select("name", "depth", "path", "line").orderBy(F.desc("depth"), "name")

    def find_symbol_in_inheritance_chain(self, name: str, symbol: str) -> DataFrame:
        """The nearest member of that name up the chain: not an implementation, headers first."""
        m = self.members.where(F.col("name") == symbol).select("class_id", F.col("name").alias("symbol_name"), "access", F.col("line").alias("line_number"), F.col("id").alias("member_id"), F.col("file_id").alias("member_file"))
        c = self.classes.select("id", F.col("name").alias("class_name"), F.col("file_id").alias("class_file"))
        rows = self._ancestors(name).join(m, F.col("id") == F.col("class_id")).drop("class_id").join(c, "id")
        rows = rows.withColumn("file_id", F.coalesce("member_file", "class_file")).join(self._files(), "file_id").withColumn("k", F.lit(0))
        ext = F.when(F.col("extension") == "h", 0).when(F.col("extension") == "hpp", 1).otherwise(2)
        best = graph.best_per(rows, ["k"], [F.col("depth"), (F.col("access") == "impl").cast("int"), ext, F.col("member_id")])
        return best.select("symbol_name", "line_number", F.col("path").alias("file_path"), "class_name")

    def get_virtual_functions_in_inheritance_chain(self, name: str) -> DataFrame:
        """Virtual functions of a class and its ancestors, each by its nearest definition that is no implementation."""
        m = self.members.where((F.col("type") == "function") & F.col("flags").contains("virtual") & (F.col("access") != "impl"))
        m = m.select("class_id", "name", "return_type", "access", "line", F.col("id").alias("member_id"), F.col("file_id").alias("member_file"))
        c = self.classes.select("id", F.col("name").alias("class_name"), F.col("file_id").alias("class_file"))
        rows = self._ancestors(name).join(m, F.col("id") == F.col("class_id")).drop("class_id").join(c, "id").withColumn("file_id", F.coalesce("member_file", "class_file"))
        best = graph.best_per(rows.join(self._files().select("file_id", "path"), "file_id"), ["name"], [F.col("depth"), F.col("path"), F.col("line"), F.col("member_id")])
        return best.select("name", "class_name", "return_type", "access", "path", "line").orderBy("name")

    def get_class_members_recursive(self, name: str, prefix: str = "", limit: int = 2000) -> DataFrame:
        rows = self._ancestors(name).join(self.members.drop("id"), F.col("id") == F.col("class_id")).where(F.col("name").startswith(prefix) & (F.col("access") != "impl"))
        best = graph.best_per(rows.select("name", "return_type", "type", "access", "depth", "line"), ["name", "return_type"], [F.col("depth"), F.col("line")])
        return best.select("name", "return_type", "type", "access").orderBy("name", "return_type").limit(limit)

    def get_parent_class_name(self, name: str) -> DataFrame:
        """The name of the first base of a class, by the smallest definition that has one."""
        rows = self.classes.where((F.col("name") == name) & F.col("base_class").isNotNull())
        return rows.agg(F.min_by("base_class", "id").alias("parent")).where("parent is not null")

    def is_subclass_of(self, child: str, parent: str) -> bool:
        return not self._ancestors(child).where("depth > 0").join(self.classes.where(F.col("name") == parent), "id", "left_semi").isEmpty()

    # includes

    def get_depend_files(self, path: str, recursive: bool = False, game_only: bool = False) -> DataFrame:
        start = self.files.where(F.col("full_path") == path).select(F.lit(0).alias("origin"), F.col("id").alias("node"))
        edges = self.file_includes.where("resolved_file_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"))
        found = graph.reach(start, edges, None if recursive else 1).where("depth > 0").select(F.col("node").alias("file_id"))
        rows = self._files().join(found, "file_id")
        rows = rows.where(~F.col("path").contains("/Engine/")) if game_only else rows
        return rows.select("path", "module_name", "module_root", "extension").orderBy("path")

    def find_includers(self, path: str) -> DataFrame:
        """Files that include a file (of a source its header), also by bare name; included headers bring their sources."""
        name = path.rpartition("/")[2]
        header = name[:-4] + ".h" if name.endswith(".cpp") else name
        target = self.files.where(F.col("filename") == header).select(F.col("id").alias("resolved_file_id"))
        by_id = self.file_includes.join(target, "resolved_file_id", "left_semi").select("file_id")
        by_name = self.file_includes.where(F.col("resolved_file_id").isNull() & (F.col("base_filename") == header)).select("file_id")
        found = self._files().join(by_id.union(by_name).distinct(), "file_id")
        stem = lambda c: paths.stem(F.col(c))
        peers = self._files().where("extension = 'cpp'").withColumn("stem", stem("path")).withColumn("dir", paths.parent(F.col("path")))
        near = found.where("is_header").select(stem("path").alias("stem"), paths.parent(F.col("path")).alias("dir"))
        return found.select("path", "module_name").union(peers.join(near, ["stem", "dir"], "left_semi").select("path", "module_name")).distinct().orderBy("path")

    def get_include_completions(self, module: str, part: str) -> DataFrame:
        """Headers of a module and its deep dependencies, as they are included."""
        own = self.modules.where(F.col("name") == module)
        names = own.select("name").union(own.select(F.explode("deep_dependencies"))).distinct()
        rows = self._files().where("is_header").join(names.withColumnRenamed("name", "module_name"), "module_name", "left_semi")
        rows = rows.where(~F.col("path").rlike("/(Private|Internal)/")).select(paths.include_path(F.col("path"), F.col("module_root")).alias("label"), F.col("path").alias("full_path"))
        return rows.where(F.col("label").ilike(f"%{part}%")).orderBy("label", "full_path")

    # search and definitions

    def search_symbols(self, pattern: str, limit: int = 100) -> DataFrame:
        classes = self._classes().select("name", F.col("symbol_type").alias("type"), F.lit("").alias("class_name"), "path")
        m = self._members().select("name", "type", "class_name", "file_id").join(self._files(), "file_id").select("name", "type", "class_name", "path")
        return text.match(classes.union(m), pattern, ["name", "type"]).orderBy("name", "class_name", "path").limit(limit)

    def search_symbols_in_modules(self, modules: list[str], pattern: str, symbol_type: str | None = None, limit: int = 100) -> DataFrame:
        """Classes and members of the modules whose names hold every token, the first `limit` by name."""
        own = self._files().where(F.col("module_name").isin(modules)).select("file_id", "path", "module_name")
        classes = self.classes.join(own, "file_id").select("name", F.col("symbol_type").alias("type"), F.lit("").alias("class_name"), "path", "line", "module_name")
        members = self._members().join(own, "file_id").select("name", "type", "class_name", "path", "line", "module_name")
        rows = classes.union(members).where(paths.matches_all(F.col("name"), pattern))
        rows = rows if symbol_type is None else rows.where(F.col("type") == symbol_type)
        return rows.orderBy("name", "class_name", "path", "line").limit(limit)

    def with_member_return_type(self, class_name: str, member: str, return_type: str) -> CodeIndex:
        """The index with the return type of a class's member set; save it to keep it."""
        own = self.classes.where(F.col("name") == class_name).select(F.col("id").alias("class_id")).distinct().withColumn("_own", F.lit(True))
        hit = F.col("_own") & (F.col("name") == member)
        members = self.members.join(own, "class_id", "left").withColumn("return_type", F.when(hit, return_type).otherwise(F.col("return_type"))).select(self.members.columns)
        return replace(self, members=members, cache={})

    def find_symbol_in_module(self, module: str, symbol: str) -> DataFrame:
        """A class of that name in the module, else a member."""
        c = self._classes().where((F.col("module_name") == module) & (F.col("name") == symbol)).select(F.lit(0).alias("tier"), "name", "path", "line")
        m = self.members.where(F.col("name") == symbol).join(self._files().where(F.col("module_name") == module), "file_id").select(F.lit(1).alias("tier"), "name", "path", "line")
        return c.union(m).orderBy("tier", "path", "line").limit(1)

    def get_modules_by_scope(self, scope: str, deep: bool = False) -> DataFrame:
        own = self.modules if scope == "full" else self.modules.where(F.lower("scope") == scope)
        names = own.select("name")
        return (names.union(own.select(F.explode("deep_dependencies"))) if deep else names).distinct().orderBy("name")

    def _header_first(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        ext = F.when(F.col("extension") == "h", 0).when(F.col("extension") == "hpp", 1).otherwise(2)
        columns = ["symbol_name", "line_number", "file_path", "class_name"]
        best = graph.best_per(rows.withColumn("k", F.lit(0)), ["k"], [*order, ext, F.col("file_path"), F.col("line_number")])
        return best.select(*columns)

    def find_type_definition(self, name: str) -> DataFrame:
        """The definition of a type, in a header if there is one."""
        rows = self._classes().where(F.col("name") == name)
        return self._header_first(rows.select(F.col("name").alias("symbol_name"), F.col("line").alias("line_number"), F.col("path").alias("file_path"), F.col("name").alias("class_name"), "extension"), [])

    def find_member_anywhere(self, name: str) -> DataFrame:
        """A member of that name in any class: no implementation, then headers, first."""
        rows = self._members().where(F.col("name") == name).join(self._files(), "file_id")
        rows = rows.select(F.col("name").alias("symbol_name"), F.col("line").alias("line_number"), F.col("path").alias("file_path"), "class_name", "extension", "access")
        return self._header_first(rows, [(F.col("access") == "impl").cast("int")])

    def _first_text(self, df: DataFrame, column: Column, order: list[Column]) -> str | None:
        found = df.orderBy(*order).select(paths.clean_type(column)).first()
        return found[0] if found else None

    def resolve_typedef(self, name: str) -> str:
        """What an alias stands for, at most five steps on: Class::Alias by the class's members, other names by typedef symbols. A driver loop over single lookups."""
        for _ in range(5):
            owner, _, alias = name.partition("::")
            found = None
            if alias:
                rows = self._members().where((F.col("class_name") == owner) & (F.col("name") == alias) & (F.col("type") == "type_alias"))
                found = self._first_text(rows, F.col("return_type"), [F.col("id")])
            if not found:
                found = self._first_text(self.classes.where((F.col("name") == name) & (F.col("symbol_type") == "typedef")), F.col("base_class"), [F.col("id")])
            if not found or found == name:
                break
            name = found
        return name

    def find_member_return_type(self, class_type: str, member: str) -> str | None:
        """The cleaned type a member gives, from the nearest class up the chain; T and void only if nothing else, longer texts first."""
        outer, _, inner = class_type.strip().partition("<")
        if inner and outer.strip() in POINTERS:
            if member in CHECKS:
                return "bool"
            if member in POINTEES:
                return self.classes.sparkSession.range(1).select(paths.clean_type(F.lit(inner.rpartition(">")[0].strip()))).first()[0]
        plain = self.classes.sparkSession.range(1).select(paths.clean_type(F.lit(class_type))).first()[0]
        rows = self._ancestors(self.resolve_typedef(plain)).join(self.members.where(F.col("name") == member).drop("id"), F.col("id") == F.col("class_id")).where("return_type is not null")
        return self._first_text(rows, F.col("return_type"), [F.col("depth"), F.col("return_type").isin("T", "T*", "void"), -F.length("return_type"), F.col("return_type")])

    def fetch_global_symbols(self, prefix: str, each: int = 80) -> DataFrame:
        """label, kind, detail of globals that start so, at most `each` of types, of macros and of the rest, by name."""
        found = None
        for kinds in GLOBALS:
            number = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("symbol_type")]
            rows = self.classes.where(F.col("symbol_type").isin(*kinds) & F.col("name").ilike(prefix.replace("\\", "\\\\") + "%"))
            rows = rows.select(F.col("name").alias("label"), number.alias("kind"), F.col("symbol_type").alias("detail")).distinct().orderBy("label", "detail").limit(each)
            found = rows if found is None else found.unionByName(rows)
        return found

    def fetch_uobject_subclasses(self, prefix: str, limit: int = 200) -> DataFrame:
        rows = self.classes.where(F.col("symbol_type").isin("class", "struct") & F.col("name").ilike(prefix.replace("\\", "\\\\") + "%") & F.col("name").rlike("^[UAI]"))
        return rows.select(F.col("name").alias("label"), F.when(F.col("symbol_type") == "class", 7).otherwise(22).alias("kind"), F.col("symbol_type").alias("detail")).orderBy("label", "detail").limit(limit)

    def search_scope(self, symbol: str, header: str | None = None) -> DataFrame:
        """path, module_name, module_root of the files in which uses are looked for: a known header or else the files that define the symbol, what includes them (by resolved
        edge, or by bare name), and the sources beside the headers among these."""
        own = self.files.where(F.col("full_path") == header) if header else None
        if own is None or own.isEmpty():
            own = self.files.join(self.classes.where(F.col("name") == symbol).select(F.col("file_id").alias("id")), "id", "left_semi")
        own = own.select("id", "filename")
        by_id = self.file_includes.join(own.select(F.col("id").alias("resolved_file_id")), "resolved_file_id", "left_semi").select("file_id")
        by_name = self.file_includes.where("resolved_file_id is null").join(own.select(F.col("filename").alias("base_filename")), "base_filename", "left_semi").select("file_id")
        found = self._files().join(own.select(F.col("id").alias("file_id")).union(by_id).union(by_name).distinct(), "file_id", "left_semi")
        place = [paths.parent(F.col("path")).alias("dir"), paths.stem(F.col("path")).alias("stem")]
        near = found.where("is_header").select(*place).distinct()
        peers = self._files().where("extension = 'cpp'").select("*", *place).join(near, ["dir", "stem"], "left_semi")
        columns = ["path", "module_name", "module_root"]
        return found.select(*columns).union(peers.select(*columns)).distinct()

    def get_call_sites(self, name: str, limit: int = 300) -> DataFrame:
        """path, module_name, line where a function of that name is called, from the table of calls; the first `limit` by place."""
        if self.calls is None:
            raise ValueError("this index has no table of calls")
        return self.calls.where(F.col("name") == name).join(self._files(), "file_id").select("path", "module_name", "line").orderBy("path", "line").limit(limit)

    def find_symbol_usages(self, sources: DataFrame, symbol: str, header: str | None = None, method: str | None = None, limit: int = 300) -> DataFrame:
        """path, module_name, module_root, line, column, context of a type's uses, or of its method's, in sources(path, content) of the scope; the first `limit` by place."""
        scope = self.search_scope(symbol, header)
        uses = cpp.references(sources.join(scope.select("path"), "path", "left_semi"), method or symbol, symbol if method else None)
        return uses.join(scope, "path").select("path", "module_name", "module_root", "line", "column", "context").orderBy("path", "line", "column").limit(limit)
