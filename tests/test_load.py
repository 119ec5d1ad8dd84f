import pytest
from pyspark.sql import functions as F

from lodestone.plans import load
from lodestone.sources import cpp, files

TREE = {
    "Game/Game.uproject": "{}",
    "Game/Source/Game/Game.Build.cs": 'public class Game : ModuleRules { void X() { PublicDependencyModuleNames.AddRange(new string[] { "Core" }); } }',
    "Game/Source/Game/Private/Player.cpp": '#include "Player.h"\nvoid APlayer::Go() { FBase b; FMath m; FFar f; }\n',
    "Game/Source/Game/Public/Player.h": '#pragma once\n#include "Pawn.h"\nclass APlayer : public APawn { public: void Go(); };\n',
    "Game/Plugins/Tool/Tool.uplugin": "{}",
    "Game/Saved/Old.h": "class Old {};",
    "Game/readme.txt": "x",
    "Eng/Core/Core.build.cs": 'PrivateDependencyModuleNames.Add("Low");',
    "Eng/Core/Public/Pawn.h": '#include "Base.h"\nclass APawn {};\n',
    "Eng/Core/Public/Base.h": "struct FBase { int X; };\nenum class EKind { One, Two };\n",
    "Eng/Low/Low.Build.cs": 'PublicDependencyModuleNames.Add("Core");',
    "Eng/Low/Public/Math.h": "struct FMath {};",
    "Eng/Far/Far.Build.cs": "//",
    "Eng/Far/Public/Far.H": "struct FFar {};",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    load.save(load.build(spark, f"{tree}/Game", f"{tree}/Eng"), folder)
    return load.load(spark, folder)


def test_walk(spark, tree):
    names = {r[0] for r in files.walk(spark, [f"{tree}/Game"]).select("filename").collect()}
    assert names == {"Game.uproject", "Game.Build.cs", "Player.cpp", "Player.h"}
    assert {r[0] for r in files.walk(spark, [f"{tree}/Eng"], ["h"]).select("extension").collect()} == {"h"}


def test_tables(index):
    mods = {r["name"]: (r["type"], r["owner"], r["deep_dependencies"]) for r in index.modules.collect()}
    assert mods["Game"] == ("Runtime", "Game", ["Core", "Low"]) and mods["Core"] == ("Runtime", "Eng", ["Low"]) and set(mods) == {"Game", "Core", "Low", "Far", "_Global", "_GameConfig", "_EngineConfig", "_EngineShaders"}
    assert {r["filename"]: r["module_name"] for r in index.get_all_files_metadata().collect()}["Player.cpp"] == "Game"
    assert {r["filename"]: r["module_name"] for r in index.get_all_files_metadata().collect()}["Game.uproject"] == "_Global"
    assert [r["name"] for r in index.get_components().collect()] == ["Eng", "Game", "Tool"]
    assert index.files.where("extension = 'h'").where(F.length("file_hash") == 64).count() == 5
    assert [r["name"] for r in index.get_enum_values("EKind").collect()] == ["One", "Two"]
    assert [r["name"] for r in index.get_recursive_parent_classes("APlayer").collect()] == ["APawn"]
    assert index.find_symbol_in_inheritance_chain("APlayer", "Go").first()["file_path"].endswith("Player.h")


def test_missing_includes(spark, tree, index):
    sources = files.texts(files.walk(spark, [f"{tree}/Game"], ["cpp"]))
    got = [(r["symbol"], r["header"], r["line"]) for r in load.missing_includes(index, sources).collect()]
    assert got == [("FMath", "Math.h", 2)]  # FBase comes with Pawn.h, FFar is no dependency
    lines = spark.createDataFrame([("a\n#include <x>\n#include \"a.generated.h\"\n",), ("#include <x>\n",), ("",)], "c string")
    assert [r[0] for r in lines.select(load.insert_line(F.col("c"))).collect()] == [2, 2, 1]


def test_update(spark, tree, index):
    changed = spark.createDataFrame([(f"{tree}/Game/Source/Game/Public/Player.h", '#include "New.h"\nclass APlayer : public ANew { void Stop(); };'), (f"{tree}/Game/Source/Game/Public/New.h", "class ANew {};")], "path string, content string")
    deleted = spark.createDataFrame([(f"{tree}/Eng/Core/Public/Base.h",)], "path string")
    now = load.updated(index, changed, deleted)
    assert [r["name"] for r in now.get_recursive_parent_classes("APlayer").collect()] == ["ANew"]
    assert [r["name"] for r in now.get_class_members("APlayer").where("access <> 'impl'").collect()] == ["Stop"]
    assert now.get_enum_values("EKind").isEmpty() and now.find_class_by_name("FBase").isEmpty() and now.files.where("filename = 'Base.h'").isEmpty()
    got = now.get_depend_files(f"{tree}/Game/Source/Game/Private/Player.cpp", recursive=True)
    assert [(r["path"].rpartition("/")[2], r["module_name"]) for r in got.collect()] == [("New.h", "Game"), ("Player.h", "Game")]
    assert now.files.count() == index.files.count() and now.classes.where("name = 'APawn'").count() == 1
    assert now.file_includes.where("base_filename = 'Base.h' and resolved_file_id is null").count() == 1


def test_references(spark):
    text = "class AThing;\nclass X_API AThing { };\n// AThing\nAThing* a = new AThing();\n"
    df = spark.createDataFrame([("a.h", text), ("b.h", "none"), ("c.h", None)], "path string, content string")
    assert sorted(map(tuple, cpp.references(df, "AThing").collect())) == [("a.h", 4, 0, "AThing* a = new AThing();"), ("a.h", 4, 16, "AThing* a = new AThing();")]
    assert {(r["name"], r["line"]) for r in cpp.words(df).where("name = 'a'").collect()} == {("a", 4)}


def test_calls_and_fast_scan(spark, tree, index):
    changed = spark.createDataFrame([(f"{tree}/Game/Source/Game/Public/Player.h", "void F() { Go(1); Go(2); }")], "path string, content string")
    now = load.updated(index, changed)
    assert [(r["path"].rpartition("/")[2], r["line"]) for r in now.get_call_sites("Go").collect()][-2:] == [("Player.h", 1), ("Player.h", 1)]
    df = spark.createDataFrame([("a.h", "class A {};"), ("b.h", '#include "x"'), ("c.cpp", "int x;"), ("d.inl", None), ("e.hpp", "USTRUCT() struct E {};")], "path string, content string")
    assert [r["path"] for r in df.where(cpp.worth_parsing(F.col("path"), F.col("content"))).collect()] == ["b.h", "c.cpp", "e.hpp"]
