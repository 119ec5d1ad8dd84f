from lodestone.sources import cpp

SOURCE = '''#pragma once
#include "Core/Base.h"
#include <vector>
#define LIMIT 3
DECLARE_LOG_CATEGORY_EXTERN(LogThing, Log, All);
DECLARE_DYNAMIC_MULTICAST_DELEGATE_OneParam(FOnDone, int32, Code);
DECLARE_DELEGATE_RetVal(bool, FAsk);
class FForward;
namespace Outer {
enum class EMode : uint8 { One, Two = 2, /* no */ Three };
namespace EOld { enum Type { A, B }; }
UCLASS(BlueprintType)
class GAME_API AThing : public AActor, private TBase<int, float>, public ns::IFace
{
    GENERATED_BODY()
    int Hidden = 3;
public:
    AThing();
    virtual ~AThing();
    UFUNCTION(BlueprintCallable, Category="x")
    static TArray<FString> Names(const FString& In, int N = 2) const;
    UPROPERTY(EditAnywhere)
    UObject* Owner{nullptr};
    using Key = TMap<int, FString>;
protected:
    bool operator==(const AThing& o) const { return Run(o); }
    struct Inner { float X; };
};
}
void Outer::AThing::Go(int a) { if (a) { Fire(a); } }
int Global(int x) { int local = 2; return x; }
static const char* Word = "class X { int y; };";
'''


def by_name(found):
    return {s.name: s for s in found}


def test_symbols_and_members():
    s = by_name(cpp.parse(SOURCE))
    assert {k: v.symbol_type for k, v in s.items()} == {
        "LIMIT": "define", "LogThing": "log_category", "FOnDone": "delegate", "FAsk": "delegate", "EMode": "enum", "Outer::EOld::Type": "enum",
        "AThing": "UCLASS", "Inner": "struct", "Global": "global_function", "Word": "global_var",
    }
    thing = s["AThing"]
    assert thing.namespace == "Outer" and thing.bases == ["AActor", "TBase", "IFace"]
    assert (thing.line, thing.end_line) == (13, 28)
    got = {m["name"]: (m["type"], m["access"], m["flags"], m["return_type"]) for m in thing.members}
    assert got["Hidden"] == ("property", "private", "", "int")
    assert got["AThing"][:2] == ("function", "public") and "~AThing" in got
    assert got["Names"] == ("function", "public", "UFUNCTION static", "TArray<FString>")
    assert got["Owner"] == ("property", "public", "UPROPERTY", "UObject")
    assert got["Key"] == ("type_alias", "public", "", "TMap<int, FString>")
    assert got["operator=="][:2] == ("function", "protected")
    assert got["Go"] == ("function", "impl", "", "void")
    assert [m["name"] for m in s["EMode"].members] == ["One", "Two", "Three"]
    assert [m["name"] for m in s["Inner"].members] == ["X"] and s["Inner"].namespace == "Outer::AThing"


def test_calls_and_odd_inputs():
    names = [n for n, _ in cpp.call_sites(SOURCE)]
    assert "Fire" in names and "Run" in names and "if" not in names
    for text in (None, "", "}}}", "class", "class X {", "((((", '"open', "/* open", "enum {", "operator", ";;;", "template <", "x = {", "[[", "::"):
        cpp.parse(text)
    assert cpp.parse("class X {")[0].name == "X"


def test_tag_namespaces():
    text = 'namespace A::B {\nUE_DEFINE_GAMEPLAY_TAG_COMMENT(One, "x.one", "first");\nnamespace C { extern FNativeGameplayTag Two;\n UE_DECLARE_GAMEPLAY_TAG_EXTERN(Three); }\n}\nnamespace D { int x; }\n'
    found = {s.name: s for s in cpp.parse(text) if s.symbol_type == "namespace"}
    assert {k: (v.namespace, v.line, v.end_line) for k, v in found.items()} == {"B": ("A", 1, 5), "C": ("A::B", 3, 4)}
    assert [(m["name"], m["detail"], m["return_type"], m["flags"]) for m in found["B"].members] == [("One", "x.one — first", "FGameplayTag", "static")]
    assert [(m["name"], m["return_type"]) for m in found["C"].members] == [("Two", "FNativeGameplayTag"), ("Three", "FGameplayTag")]


def test_index_tables(spark):
    files = spark.createDataFrame([("a.h", SOURCE), ("b.h", None), ("c.h", "")], "path string, content string")
    got = cpp.index_tables(files)
    assert sorted(r["include_path"] for r in got["file_includes"].collect()) == ["Core/Base.h", "vector"]
    assert got["file_includes"].where("base_filename = 'Base.h'").count() == 1
    assert {r["base_class"] for r in got["classes"].where("name = 'AThing'").collect()} == {"AActor"}
    assert [r["name"] for r in got["enum_values"].where("enum_name = 'Outer::EOld::Type'").orderBy("line", "name").collect()] == ["A", "B"]
    assert {r["parent_name"] for r in got["inheritance"].collect()} == {"AActor", "TBase", "IFace"}
    assert [r["name"] for r in got["members"].where("is_static").collect()] == ["Names"]
    assert cpp.calls(files).where("name = 'Fire'").count() == 1
