import struct

import pytest
from pyspark.sql import functions as F

from lodestone.sources import assets


def text(s):
    raw = s.encode() + b"\0"
    return struct.pack("<i", len(raw)) + raw


NAMES = ["/Script/Engine", "Actor", "Package", "Class", "Function", "Go", "/Game/Other", "BP_Thing_C", "BP_Thing", "Default__Actor"]


def package(v4=522, v5=1008):
    """A header with a package, its class, a function of it, another package and a default object; one export, the asset's class."""
    imports = [(2, 0, 0), (3, -1, 1), (4, -1, 5), (2, 0, 6), (1, -1, 9)]  # class, outer, name
    body_names = b"".join(text(n) + b"\0" * 4 for n in NAMES)
    body_imports = b"".join(struct.pack("<qqiq", 0, k, o, n) + b"\0" * 8 + (b"\0" * 4 if v5 >= 12 else b"") for k, o, n in imports)
    body_exports = struct.pack("<iiiiqI", -2, -2, 0, 0, 7, 0) + struct.pack("<qq", 0, 0) + b"\0" * 12 + (b"\0" * 4 if v5 >= 6 else b"") + b"\0" * 4 + b"\0" * 8 + (b"\0" * 4 if v5 >= 7 else b"") + b"\0" * 20 + b"\0" * 16
    front = struct.pack("<Iiiiii", assets.TAGS[0], -8, 0, v4, v5, 0) + struct.pack("<ii", 0, 0) + text("/Game/BP_Thing")

    def rest(at):
        names, imps, exps = at, at + len(body_names), at + len(body_names) + len(body_imports)
        return struct.pack("<Iii", 0, len(NAMES), names) + b"\0" * 8 + text("id") + b"\0" * 8 + struct.pack("<iiii", 1, exps, len(imports), imps) + b"\0" * 40

    at = len(front) + len(rest(0))
    return front + rest(at) + body_names + body_imports + body_exports


def test_header():
    head = assets.decode(package())
    assert head.references() == (["/Script/Engine", "/Script/Engine.Actor", "/Game/Other", "/Script/Engine.Actor"], ["/Script/Engine:Go"])
    assert head.name == "BP_Thing" and head.parent_class() == "/Script/Engine.Actor"
    assert head.path(1) == "BP_Thing_C" and head.path(0) == "None" and head.path(-99) == "None"


@pytest.mark.parametrize("cut", [0, 3, 20, 60, -5])
def test_short_headers_are_errors(cut):
    with pytest.raises((ValueError, struct.error)):
        assets.decode(package()[:cut])


def test_table_and_graph(spark):
    files = spark.createDataFrame([("/p/Content/a/BP_Thing.uasset", bytearray(package())), ("/p/Content/bad.umap", bytearray(b"no")), ("/p/x", None)], "path string, content binary")
    table = assets.headers(files).cache()
    assert {r["path"]: r["error"] is None for r in table.collect()} == {"/p/Content/a/BP_Thing.uasset": True, "/p/Content/bad.umap": False, "/p/x": False}
    graph = assets.edges(table)
    assert sorted(map(tuple, assets.usages(graph, "AActor").collect())) == [("derived", "/game/a/bp_thing"), ("references", "/game/a/bp_thing")]
    assert assets.usages(graph, "/Script/Engine.Go").count() == 1 and assets.usages(graph, "Missing").isEmpty()
    assert [r[0] for r in assets.all_assets(graph).collect()] == ["/game/a/bp_thing"]
    assert assets.dependencies(table).where("asset_path = '/Game/a/BP_Thing'").first()["dependencies"] == ["/Game/Other", "/Script/Engine", "/Script/Engine.Actor"]
    assert assets.derived_assets(graph, "Actor", spark.createDataFrame([], "path string")).first()["name"] == "bp_thing"


def test_scan(spark):
    df = spark.createDataFrame([("Content/BP_A.uasset",), ("Content/X.uasset",), ("Content/X.umap",), ("Plugins/P/Content/DA_B.uasset",), ("a/b/c/d/Content/BP_C.uasset",), ("Saved/Content/BP_D.uasset",)], "p string")
    assert [r[0] for r in df.select(assets.essential(F.col("p"))).collect()] == [True, False, True, True, False, False]
    cached = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime long")
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, mtime long")
    todo = assets.to_parse(cached, listing)
    assert sorted(r[0] for r in todo.collect()) == ["b", "d"]
    assert sorted(map(tuple, assets.refreshed(cached, listing, todo).collect())) == [("a", 1), ("b", 2), ("d", 1)]
