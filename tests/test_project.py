"""Configuration stacks, root finders, project scopes and saved versions, on hand-made trees and listings."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import load, project
from lodestone.plans.service import CodeIndex
from lodestone.sources import config_files, finders


def listing(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_platforms_and_stacks(spark):
    listed = listing(
        spark, "/e/Engine/Config/Base.ini", "/e/Engine/Config/BaseEngine.ini", "/e/Engine/Config/Mac/Some.ini", "/e/Engine/Config/Apple/AppleEngine.ini", "/e/Engine/Platforms/XB/Config/b.ini",
        "/e/Engine/Platforms/XB/Config/a.ini", "/e/Engine/Platforms/XB/Config/deep/c.ini", "/e/Engine/Platforms/None/x.ini", "/e/Engine/Platforms/.Hid/Config/x.ini", "/g/Config/DefaultEngine.ini", "/g/Config/XB/XBEngine.ini", "/g/Config/DefaultGame.ini",
        "/g/Platforms/Config/All.ini", "/g/Platforms/PS/DataDrivenPlatformInfo.ini",
    )
    names = [r[0] for r in config_files.platforms(listed, "/g", "/e").collect()]
    assert names == ["Apple", "Mac", "PS", "XB"]
    assert [r[0] for r in config_files.platforms(listed, "/g").collect()] == ["PS", "XB"]
    got = {}
    for r in config_files.stacks(listed, ["Default", *names], "/g", "/e").orderBy("platform", "stack_rank").collect():
        got.setdefault(r["platform"], []).append(r["file"])
    base, own = ["Base.ini", "BaseEngine.ini"], ["DefaultEngine.ini", "All.ini"]
    assert got == {"Default": base + own, "PS": base + own, "Apple": [*base, "Apple/AppleEngine.ini", "Apple/AppleEngine.ini", *own], "Mac": [*base, "Apple/AppleEngine.ini", *own], "XB": [*base, "a.ini", "b.ini", *own, "XB/XBEngine.ini"]}


def test_config_data(spark, tmp_path):
    for name, text in {
        "g/Config/DefaultEngine.ini": "[S]\nA=1\n+L=x\n", "g/Config/Win/WinEngine.ini": "[S]\nA=2\n+L=y\n[R]\nB=long\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = config_files.config_data(spark, f"{tmp_path}/g").collect()
    assert [(r["name"], r["platform"], r["is_profile"]) for r in got] == [("Default (Editor)", "Default", False), ("Win", "Win", False)]
    tree = {r["name"]: {s["name"]: {p["key"]: (p["value"], [(h["file"], h["value"], h["op"], h["line"]) for h in p["history"]]) for p in s["parameters"]} for s in r["sections"]} for r in got}
    first = [("DefaultEngine.ini", "1", "", 2)]
    assert tree["Default (Editor)"] == {"S": {"A": ("1", first), "L": ("x", [("DefaultEngine.ini", "x", "+", 3)])}}
    assert tree["Win"]["S"]["A"] == ("2", [*first, ("Win/WinEngine.ini", "2", "", 2)]) and tree["Win"]["S"]["L"][0] == "[Array x2] y" and tree["Win"]["R"]["B"][0] == "long"
    assert [s["name"] for s in got[1]["sections"]] == ["R", "S"]


def test_root_finders(spark):
    listed = listing(spark, "/w/Proj/Foo.uproject", "/w/Proj/BarLongName.uproject", "/w/Proj/Zeta.uproject", "/w/Proj/Src/M/M.Build.cs", "/w/Other.uproject", "/w/Proj/deep/nest/file.cpp", "/u/Engine/Build/x.txt")
    start = listing(spark, "/w/Proj/deep/nest/file.cpp", "/w/Proj/Src/M/a.h", "/nowhere/x")
    picked = lambda s: {(r["path"].rpartition("/")[2], r["root"], r["name"]) for r in finders.projects(start, listed, s).collect()}
    for strategy, name in (("shortest", "Foo"), ("longest", "BarLongName"), ("alphabetical", "BarLongName"), ("first", "BarLongName")):
        assert picked(strategy) == {("file.cpp", "/w/Proj", name), ("a.h", "/w/Proj", name)}
    assert finders.projects(start, listed, max_depth=2).isEmpty() and finders.projects(start, listed, max_depth=3).count() == 2
    assert [tuple(r) for r in finders.modules(start, listed).collect()] == [("/w/Proj/Src/M/a.h", "/w/Proj/Src/M", "/w/Proj/Src/M/M.Build.cs", "M")]
    assert [tuple(r) for r in finders.engines(listing(spark, "/u/Samples/X/X.uproject"), listed).collect()] == [("/u/Samples/X/X.uproject", "/u")]
    with pytest.raises(ValueError, match="strategy"):
        finders.projects(start, listed, "newest")
    kinds = spark.createDataFrame([("",), (None,), ("5.3",), ("UEQ-5.5.3",), ("C:/UE",), ("/opt/ue",), ("{0123ABCD-0123-4567-89ab-0123456789ab}",)], "a string")
    assert [r[0] for r in kinds.select(finders.engine_association(F.col("a"))).collect()] == ["embedded", "embedded", "version", "version", "path", "path", "guid"]
    one = spark.range(1).select(finders.manifest(F.lit("/p"), F.lit("Game"), F.lit("Win64"), F.lit("Development"), F.lit(True)))
    assert one.first()[0] == "/p/Intermediate/Build/Win64/GameEditor/Development/GameEditor.uhtmanifest"


def small_index(spark):
    make = spark.createDataFrame
    modules = make([(1, "Game", "Runtime", "Individual", "/g/Source/Game", ["Core"], "G"), (2, "Core", "Runtime", "Individual", "/e/Core", [], "E"), (3, "Ed", "UnrealEditor", "Individual", "/e/Ed", ["Core"], "E"),
        (4, "Prog", "Program", "Individual", "/e/Prog", [], "E"), (5, "Tools", "Developer", "Individual", "/g/Tools", ["Ed"], "X")], "id long, name string, type string, scope string, root_path string, deep_dependencies array<string>, owner string")
    files = make([(10, 0, "/g/Source/Game/Public/A.h", "A.h", "h", 0, 1, True), (11, 0, "/e/Core/B.h", "B.h", "h", 0, 2, True), (12, 0, "/g/Content/BP_X.uasset", "BP_X.uasset", "uasset", 0, 1, False)],
        "id long, dir_id long, full_path string, filename string, extension string, mtime long, module_id long, is_header boolean")
    classes = make([(100, "AThing", None, "ABase", 10, 3, 9, "class"), (101, "ABase", None, None, 11, 1, 8, "class")], "id long, name string, namespace string, base_class string, file_id long, line int, end_line int, symbol_type string")
    members = make([(1, 101, "Tick", "function", "virtual", "public", None, "void", False, 2, 11), (2, 100, "Tick", "function", "virtual override", "public", None, "void", False, 4, 10), (3, 100, "Tick", "function", "virtual", "impl", None, "void", False, 1, 10),
        (4, 101, "Stop", "function", "virtual", "public", None, "int", False, 3, 11), (5, 101, "Plain", "function", "", "public", None, "int", False, 5, 11)],
        "id long, class_id long, name string, type string, flags string, access string, detail string, return_type string, is_static boolean, line int, file_id long")
    empty = lambda s: make([], s)
    components = make([("G", "G", "Game", "G", "/g"), ("E", "Engine", "Engine", "E", "/e")], "name string, display_name string, type string, owner string, root_path string")
    inheritance = make([(100, "ABase", 101)], "child_id long, parent_name string, parent_class_id long")
    return CodeIndex(modules, files, classes, members, empty("enum_id long, name string, line int, file_id long"), inheritance, empty("file_id long, include_path string, base_filename string, resolved_file_id long"), components)


def test_scopes_and_queries(spark):
    index = small_index(spark)
    names = lambda *a: sorted(r[0] for r in project.scoped(index.modules, index.components, *a).collect())
    assert names("game") == ["Core", "Ed", "Game", "Tools"] and names("game", False) == ["Game", "Tools"]
    assert names("engine", False) == ["Core", "Ed", "Prog"] and names("runtime", False) == ["Core", "Game"]
    assert names("editor", False) == ["Core", "Ed", "Game", "Tools"] == names("full", False)
    assert {r["name"]: r["bucket"] for r in project.maps(index).collect()} == {"Game": "runtime", "Core": "runtime", "Ed": "editor", "Prog": "program", "Tools": "developer"}
    assert sorted(tuple(r) for r in project.items(index, "runtime").collect()) == [
        ("/e/Core/B.h", "Core/B.h", "file"), ("/g/Content/BP_X.uasset", "Game//g/Content/BP_X.uasset", "file"), ("/g/Source/Game/Public/A.h", "Game/Public/A.h", "file"),
    ]
    assert {r["path"]: [i["name"] for i in r["items"]] for r in project.classes(index, "game").collect()} == {"/g/Source/Game/Public/A.h": ["AThing"], "/e/Core/B.h": ["ABase"]}
    assert [tuple(r)[:2] for r in index.get_virtual_functions_in_inheritance_chain("AThing").collect()] == [("Stop", "ABase"), ("Tick", "AThing")]
    assert [(r["name"], r["class_name"]) for r in index.search_symbols_in_modules(["Core"], "t").collect()] == [("Stop", "ABase"), ("Tick", "ABase")]
    changed = index.with_member_return_type("ABase", "Stop", "bool")
    assert {r["name"]: r["return_type"] for r in changed.get_class_members("ABase").collect()} == {"Stop": "bool", "Tick": "void", "Plain": "int"}
    assert [r["filename"] for r in index.get_assets().collect()] == ["BP_X.uasset"] and [r["filename"] for r in index.get_files_in_module(2).collect()] == ["B.h"]
    assert [r["filename"] for r in index.get_module_files_by_name_and_root("Core", "/e/Core").collect()] == ["B.h"] and index.get_module_files_by_name_and_root("Core", "/x").isEmpty()
    assert [r[0] for r in index.get_module_dirs_by_name_and_root("Core", "/e/Core").collect()] == ["/e/Core"]
    assert index.get_module_id_by_name("Core").first()[0] == 2 and index.get_module_root_path("Ed").first()[0] == "/e/Ed"


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert load.needs_full_refresh(spark, folder) and load.latest(spark, folder) is None
    with pytest.raises(ValueError, match="no index"):
        load.load(spark, folder)
    assert load.save(small_index(spark), folder, "p1", "e1", {"ue_version_major": "5"}) == 1
    first = load.load(spark, folder)
    entry = load.latest(spark, folder)
    assert (entry["project_revision"], entry["engine_revision"], entry["meta"]) == ("p1", "e1", {"ue_version_major": "5"})
    assert not load.needs_full_refresh(spark, folder) and load.needs_full_refresh(spark, folder, "e2") and not load.needs_full_refresh(spark, folder, "e1")
    # an updated index is saved beside the one that it still reads
    changed = first.with_member_return_type("ABase", "Stop", "bool")
    assert load.save(changed, folder, "p2", "e1") == 2
    assert load.load(spark, folder).members.where("return_type = 'bool'").count() == 1 and first.members.where("return_type = 'bool'").isEmpty()
    load.cleanup(spark, folder)
    assert load.load(spark, folder).members.count() == 5 and not (tmp_path / "index" / "v1").exists()
    load.cleanup(spark, folder, 0)
    assert load.needs_full_refresh(spark, folder)


def test_engine_rows_stay_when_the_engine_did_not_change(spark):
    old = spark.createDataFrame([("Core", "E"), ("Game", "G"), ("Old", "G")], "name string, owner string")
    new = spark.createDataFrame([("Game", "G"), ("New", "G")], "name string, owner string")
    names = lambda changed: sorted(r["name"] for r in load.replaced_components(old, new, "E", changed).collect())
    assert names(False) == ["Core", "Game", "New"] and names(True) == ["Game", "New"]


def test_engine_version(spark, tmp_path):
    assert load.engine_version(spark, str(tmp_path)) == {}
    (tmp_path / "Engine/Build").mkdir(parents=True)
    (tmp_path / "Engine/Build/Build.version").write_text('{"MajorVersion": 5, "MinorVersion": 3, "PatchVersion": 2, "BranchName": "++main"}')
    assert load.engine_version(spark, str(tmp_path)) == {"ue_version_major": "5", "ue_version_minor": "3", "ue_version_patch": "2", "ue_version_branch": "++main"}
