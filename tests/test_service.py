"""The query catalogue on a small hand-written index."""

import pytest

from lodestone.plans.service import CodeIndex


@pytest.fixture(scope="module")
def index(spark):
    make = spark.createDataFrame
    return CodeIndex(
        modules=make([(1, "Core", "Runtime", "Engine", "/e/Core", ["Base"]), (2, "Game", "Runtime", "Game", "/g/Game", ["Core"])], "id long, name string, type string, scope string, root_path string, deep_dependencies array<string>"),
        files=make(
            [(1, 0, "/e/Core/Public/A.h", "A.h", "h", 1, 1, True), (2, 0, "/g/Game/B.h", "B.h", "h", 1, 2, True), (3, 0, "/g/Game/B.cpp", "B.cpp", "cpp", 1, 2, False), (4, 0, "/g/Game.Target.cs", "Game.Target.cs", "cs", 1, None, False)],
            "id long, dir_id long, full_path string, filename string, extension string, mtime long, module_id long, is_header boolean",
        ),
        classes=make(
            [(1, "A", None, None, 1, 1, 50, "class"), (2, "B", None, "A", 2, 1, 40, "class"), (3, "C", None, "B", 2, 10, 20, "struct"), (4, "E", None, None, 1, 60, 70, "enum")],
            "id long, name string, namespace string, base_class string, file_id long, line long, end_line long, symbol_type string",
        ),
        members=make(
            [(1, 1, "Run", "function", "", "public", None, "void", False, 5, 1), (2, 2, "Run", "function", "", "impl", None, "void", False, 9, 3), (3, 2, "Run", "function", "", "public", None, "void", False, 4, 2), (4, 1, "X", "property", "", "public", None, "int", False, 6, 1)],
            "id long, class_id long, name string, type string, flags string, access string, detail string, return_type string, is_static boolean, line long, file_id long",
        ),
        enum_values=make([(4, "Two", 62, 1), (4, "One", 61, 1)], "enum_id long, name string, line long, file_id long"),
        inheritance=make([(2, "A", 1), (3, "B", 2), (1, "C", 3)], "child_id long, parent_name string, parent_class_id long"),  # a cycle
        file_includes=make([(2, "A.h", "A.h", 1), (3, "B.h", "B.h", 2)], "file_id long, include_path string, base_filename string, resolved_file_id long"),
        components=make([("Eng", "Engine", "Engine", None, "/e"), ("Bad", None, "Game", None, "/g")], "name string, display_name string, type string, owner string, root_path string"),
    )


def first(df):
    return [r[0] for r in df.collect()]


def test_lookups(index):
    assert first(index.get_structs_only()) == ["C"] and first(index.get_enum_values("NS::E")) == ["One", "Two"]
    assert first(index.get_components()) == ["Eng"] and [tuple(r) for r in index.load_component_data("Eng").collect()] == [("Eng", "Core")]
    assert first(index.search_files_by_path_part("b .H")) == ["B.h"] and first(index.search_files_by_path_part(" ")) == []
    assert [tuple(r)[:2] for r in index.get_build_targets().collect()] == [("Game", "Game")]
    assert [r["name"] for r in index.get_class_methods("A").collect()] == ["Run"]
    assert [(r["path"], [i["name"] for i in r["items"]]) for r in index.get_classes_in_modules(["Game"]).collect()] == [("/g/Game/B.h", ["B", "C"])]
    assert [(r["name"], len(r["members"] or [])) for r in index.get_file_symbols("/x/B.h").collect()] == [("B", 2), ("C", 0)]


def test_hierarchies_with_a_cycle(index):
    assert first(index.find_derived_classes("A")) == ["B"] and first(index.get_recursive_derived_classes("A")) == ["A", "B", "C"]
    assert [(r["name"], r["depth"]) for r in index.get_recursive_parent_classes("C").collect()] == [("A", 2), ("B", 1)]
    assert tuple(index.find_symbol_in_inheritance_chain("C", "Run").first()) == ("Run", 4, "/g/Game/B.h", "B")
    assert first(index.get_class_members_recursive("C")) == ["Run", "X"] and index.is_subclass_of("C", "A")


def test_includes_and_search(index, spark):
    assert first(index.get_depend_files("/g/Game/B.cpp", recursive=True)) == ["/e/Core/Public/A.h", "/g/Game/B.h"]
    assert first(index.find_includers("/e/Core/Public/A.h")) == ["/g/Game/B.cpp", "/g/Game/B.h"]
    assert first(index.get_include_completions("Game", "a")) == ["A.h"]
    assert first(index.search_symbols("run function")) == ["Run"] * 3
    assert index.find_symbol_in_module("Game", "Run").first()["path"] == "/g/Game/B.cpp"
    assert first(index.get_modules_by_scope("game", deep=True)) == ["Core", "Game"]
    probes = spark.createDataFrame([(2, 15), (2, 30), (2, 99)], "file_id long, line long")
    assert sorted(tuple(r) for r in index.enclosing_class(probes).collect()) == [(2, 15, "C"), (2, 30, "B")]


BUFFER = """#pragma once
#include "A.h"
#include "Buf.generated.h"
class UBuf : public A
{
public:
    /** Does it.
     * Twice. */
    UFUNCTION()
    void Do(B* other);
    UPROPERTY(EditAny)
    int Size;
};
void UBuf::Do(B* other)
{
    auto made = Cast<C>(other);
    int local = 1;
    other->Run();
    made->Run(local);
    Run();
    E e;
}
"""


def place(text, nth=0):
    """Line and character of the nth occurrence of a text in BUFFER."""
    at = -1
    for _ in range(nth + 1):
        at = BUFFER.index(text, at + 1)
    return BUFFER[:at].count("\n"), at - BUFFER.rfind("\n", 0, at) - 1


def test_buffer():
    from lodestone.plans import editor

    got = editor.parse_buffer(BUFFER, "b.h", *place("Run"))
    assert [(s["name"], s["kind"], s["base_class"]) for s in got["symbols"]] == [("UBuf", "class", "A")]
    assert got["metadata"]["suggested_insert_line"] == 3 and [i["is_generated"] for i in got["metadata"]["includes"]] == [False, True]
    assert got["cursor_info"] == {"symbol": "Run", "qualifier": "other", "mark": "->", "enclosing": "UBuf"}
    assert editor.variable_type(BUFFER, "other") == "B" and editor.variable_type(BUFFER, "made") == "C" and editor.variable_type(BUFFER, "none") is None
    line, at = place("(EditAny")
    assert editor.open_macro(BUFFER, line, at + 5) == "UPROPERTY" and editor.open_macro(BUFFER, 3, 4) is None
    assert editor.comment_above(BUFFER.split("\n"), 10) == "Does it.\nTwice." and editor.comment_above([], 3) == ""
    assert editor.parse_buffer("#pragma once\n")["metadata"]["suggested_insert_line"] == 2 and editor.cursor("", 0, 0) is None


def test_goto_and_completions(index):
    from lodestone.plans import editor

    go = lambda *at: editor.goto_definition(index, BUFFER, *at, "b.h")
    assert go(*place("local", 1))["line_number"] == 17
    assert go(*place("other->"))["line_number"] == 14
    assert (go(*place("Run"))["class_name"], go(*place("Run", 1))["class_name"]) == ("B", "B")  # made is a C, whose nearest Run is B's
    assert go(*place("E e"))["file_path"] == "/e/Core/Public/A.h" and go(4, 0) is None
    line, at = place("Run(local")
    assert [r["label"] for r in editor.completions(index, BUFFER, line, at + 1).collect()] == ["Run"]
    assert [r["label"] for r in editor.completions(index, "E", 0, 1).collect()] == ["E"]
    assert [tuple(r) for r in editor.completions(index, "UPROPERTY(edita", 0, 15).collect()] == [("EditAnywhere", "EditAnywhere")]
    assert ("Category", 'Category="$1"') in editor.specifiers("UFUNCTION") and ("meta", "meta=($1)") in editor.specifiers("UENUM") and editor.specifiers("X") == []


def test_types_and_usages(index, spark):
    assert index.find_type_definition("B").first()["file_path"] == "/g/Game/B.h" and index.find_member_anywhere("Run").first()["class_name"] == "A"
    assert index.find_member_return_type("C*", "X") == "int" and index.find_member_return_type("TWeakPtr<const A>", "Get") == "A" and index.find_member_return_type("A", "None") is None
    assert index.resolve_typedef("A") == "A"
    assert [(r["label"], r["kind"]) for r in index.fetch_global_symbols("").collect()] == [("A", 7), ("B", 7), ("C", 7), ("E", 13)]
    assert [r["label"] for r in index.fetch_uobject_subclasses("a").collect()] == ["A"]
    sources = spark.createDataFrame([("/e/Core/Public/A.h", "class A { void Run(); };"), ("/g/Game/B.h", "class B : A {};"), ("/g/Game/B.cpp", "A a; a.Run(); A::Run(); Z::Run();"), ("/other.cpp", "A")], "path string, content string")
    assert [(r["path"], r["line"], r["column"]) for r in index.find_symbol_usages(sources, "A").collect()] == [("/g/Game/B.cpp", 1, 0), ("/g/Game/B.cpp", 1, 14), ("/g/Game/B.h", 1, 10)]
    assert [r["column"] for r in index.find_symbol_usages(sources, "A", "/e/Core/Public/A.h", "Run").collect()] == [7, 17]
