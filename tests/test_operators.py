"""Hand-computed cases of the library's operators."""

from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import graph, incremental, overlay, text
from lodestone.sources import build_rules, vcs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_full_paths(spark):
    nodes = spark.createDataFrame([(1, None, "src"), (2, 1, "a"), (3, 2, "b"), (4, None, "lib")], "id long, parent_id long, name string")
    assert rows(graph.full_paths(nodes)) == [(1, "src", 0), (2, "src/a", 1), (3, "src/a/b", 2), (4, "lib", 0)]


def test_reach_on_a_cycle_and_a_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (2, 5), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1)], "origin long, node long")
    assert rows(graph.reach(seeds, edges)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 2)]
    assert rows(graph.reach(seeds, edges, 1)) == [(1, 1, 0), (1, 2, 1), (1, 4, 1)]


def test_unresolved_includes_fan_out_to_headers(spark):
    files = spark.createDataFrame([(1, "a.h", True), (2, "a.h", True), (3, "x.cpp", False)], "id long, filename string, is_header boolean")
    includes = spark.createDataFrame([(3, "a.h", None), (3, "b.h", 1)], "file_id long, base_filename string, resolved_file_id long")
    assert rows(graph.effective_includes(includes, files)) == [(3, 1), (3, 2)]


def test_best_per_key(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 5, "c")], "k string, n int, v string")
    assert rows(graph.best_per(df, ["k"], [F.col("n")])) == [("k", 1, "a"), ("m", 5, "c")]


def test_paths(spark):
    df = spark.createDataFrame([("C:\\\\Work\\Src\\A.h",), ("/a//b/",), ("/",)], "p string")
    assert [r[0] for r in df.select(paths.normalised(F.col("p"))).collect()] == ["c:/Work/Src/A.h", "/a/b", "/"]
    one = spark.createDataFrame([("/m/Public/X/A.gen.h", "/m")], "p string, root string")
    got = one.select(paths.stem(F.col("p")), paths.extension(F.col("p")), paths.parent(F.col("p")), paths.include_path(F.col("p"), F.col("root"))).first()
    assert tuple(got) == ("A.gen", "h", "/m/Public/X", "X/A.h".replace("A.h", "A.gen.h"))


def test_types(spark):
    df = spark.createDataFrame([("const TObjectPtr<UFoo>&",), ("CORE_API  class AActor *",)], "t string")
    assert [r[0] for r in df.select(paths.clean_type(F.col("t"))).collect()] == ["UFoo", "AActor"]
    df = spark.createDataFrame([("TArray<FVector>",), ("TMap<FName, TArray<int>>",), ("int",)], "t string")
    assert [r[0] for r in df.select(paths.element_type(F.col("t"))).collect()] == ["FVector", "TArray<int>", "int"]


def test_longest_prefix(spark):
    files = spark.createDataFrame([("/p/a/x.h",), ("/p/a/b/y.h",), ("/q/z.h",), ("/p/ab/w.h",)], "path string")
    roots = spark.createDataFrame([("/p/a", "A"), ("/p/a/b", "B")], "root string, name string")
    assert rows(paths.longest_prefix(files, roots).select("path", "name")) == [("/p/a/b/y.h", "B"), ("/p/a/x.h", "A"), ("/p/ab/w.h", "_Global"), ("/q/z.h", "_Global")]


def test_match(spark, tmp_path):
    df = spark.createDataFrame([(1, "AMyActor moves", None), (2, "my actor", "void"), (3, None, None)], "id int, name string, type string")
    found = lambda p: [r[0] for r in rows(text.match(df, p, ["name", "type"]).select("id"))]
    assert found("actor") == [2] and found("amy*") == [1] and found('"my actor" void') == [2] and found("") == []
    assert text.token_table(df, "id", ["name"]).count() == 4
    index = text.token_index(df, "id", ["name", "type"], str(tmp_path / "tokens"))
    for p in ("actor", "amy*", '"my actor" void', "", "nothing", '"actor my"', "m* actor"):
        assert [r[0] for r in rows(text.match_index(index, p))] == found(p)


def test_ini_overlay(spark):
    files = spark.createDataFrame(
        [("Win", 1, "base.ini", "; c\nTop=1\n[S]\nA=1\n+L=x\n+L=y\n"), ("Win", 2, "win.ini", "[S]\nA=2\n-L=x\n!M=\n+M=z")], "platform string, stack_rank int, file string, content string"
    )
    lines = overlay.parse_ini(files)
    assert rows(lines.where("file = 'base.ini'").select("section", "key", "op", "value", "line"))[0] == ("Default", "Top", "", "1", 2)
    out = overlay.fold(lines, ["section", "key"], ["stack_rank", "line"], True)
    got = {(r["section"], r["key"]): (r["values"], len(r["history"])) for r in out.collect()}
    assert got == {("Default", "Top"): (["1"], 1), ("S", "A"): (["2"], 2), ("S", "L"): (["y"], 3), ("S", "M"): (["z"], 2)}
    assert {(r["section"], r["key"]): (r["values"], r["steps"]) for r in overlay.fold(lines, ["section", "key"], ["stack_rank", "line"]).collect()} == got
    show = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["x" * 60],)], "v array<string>").select(overlay.shown(F.col("v")))
    assert [r[0] for r in show.collect()] == ["nil", "a", "[Array x2] b", "x" * 47 + "..."]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "path string, mtime long")
    new = spark.createDataFrame([("b", 2), ("c", None), ("d", 1)], "path string, mtime long")
    assert rows(incremental.changes(old, new, "path", "mtime")) == [("a", "deleted"), ("b", "changed"), ("c", "unchanged"), ("d", "added")]
    assert rows(incremental.upserted(old, new.where("path = 'b'"), ["path"]).where("mtime > 0")) == [("a", 1), ("b", 2)]
    kept = incremental.without_stale(spark.createDataFrame([("/g/a",), ("/g/b",), ("/e/c",)], "path string"), spark.createDataFrame([("/g/a",)], "path string"), "path", ["/g"])
    assert rows(kept) == [("/e/c",), ("/g/a",)]


def test_refresh_decisions(spark):
    decide = lambda *p: incremental.refresh_decision(spark.createDataFrame([(x,) for x in p], "path string")).first()[0]
    assert decide("/a/x.cpp") == "incremental" and decide("/a/X.Build.cs") == "full" and decide("/a/x.png") == "none" and decide(*[f"/{i}.h" for i in range(101)]) == "full"


def test_debounce_counts_from_the_last_accepted(spark):
    events = spark.createDataFrame([("p", t) for t in (0, 300, 600, 1000, 1200)], "path string, ts long")
    assert rows(incremental.debounced(events, "path", "ts", 500)) == [("p", 0), ("p", 600), ("p", 1200)]


def test_debounce_stream_agrees(spark, tmp_path):
    from lodestone.streaming.changes import debounced_stream

    spark.createDataFrame([("p", t) for t in (0, 300, 600, 1000, 1200)] + [("q", 5)], "path string, ts long").write.json(str(tmp_path / "in"))
    stream = debounced_stream(spark.readStream.schema("path string, ts long").json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("debounced")) == [("p", 0), ("p", 600), ("p", 1200), ("q", 5)]


def test_chunks(spark):
    got = rows(incremental.chunked(spark.range(10), 4, ["id"]).select("id", "chunk"))
    assert got == [(i, i // 4) for i in range(10)]


def test_over_many_partitions(spark):
    """Chunks, debounce and reachability with 16 partitions that are not put together."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(0, 40_000, 1, 16).select((F.col("id") * 7919 % 40_009).alias("v"))
        want = {v: i // 500 for i, v in enumerate(sorted(i * 7919 % 40_009 for i in range(40_000)))}
        assert {r["v"]: r["chunk"] for r in incremental.chunked(df, 500, ["v"]).collect()} == want
        events = spark.range(0, 30_000, 1, 16).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 30_011).alias("ts")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
        got, want = {}, {}
        for r in incremental.debounced(events, "k", "ts", 100).collect():
            got.setdefault(r["k"], []).append(r["ts"])
        for r in sorted(events.collect(), key=lambda r: r["ts"]):
            kept = want.setdefault(r["k"], [])
            if not kept or r["ts"] >= kept[-1] + 100:
                kept.append(r["ts"])
        assert {None if k != k else k: sorted(v) for k, v in got.items()} == want
        chain = spark.range(0, 10).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        found = graph.reach(spark.createDataFrame([(0, 0)], "origin long, node long"), chain)
        assert rows(found) == [(0, i, i) for i in range(11)]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_vcs_lists(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert rows(vcs.git_diff(lines("M\ta.h", "R100\told\tnew", ""))) == [("M", "a.h"), ("R", "new")]
    assert rows(vcs.git_status(lines(" M a.h", "?? n.h", "R  x -> y"))) == [("??", "n.h"), ("M", "a.h"), ("R", "y")]
    assert rows(vcs.svn_summary(lines("M       a b.h"))) == [("M", "a b.h")]
    assert rows(vcs.p4_fstat(lines("... clientFile /w/a.h\n... headAction move/add"))) == [("A", "/w/a.h")]
    merged = vcs.merged(spark.createDataFrame([(2, "a", "M"), (1, "a", "A")], "provider_rank int, path string, status string"))
    assert rows(merged) == [("a", "A")]


def test_build_rules(spark):
    content = 'public class Foo : ModuleRules {\n PublicDependencyModuleNames.AddRange(new string[] {\n "Core", // "No"\n "Engine" });\n PrivateDependencyModuleNames.Add("Slate"); }'
    got = build_rules.parse(spark.createDataFrame([("/Foo.Build.cs", content)], "path string, content string")).first()
    assert (got["module"], got["public"], got["private"]) == ("Foo", ["Core", "Engine"], ["Slate"])


def test_progress_and_state(spark):
    from lodestone.operators import status

    phases = spark.createDataFrame([("a", 0.2, 5, 10), ("a", 0.8, 10, 5), ("b", 1.0, 1, 0), ("c", 0.0, 1, 1), ("d", 1.0, None, 3)], "k string, weight double, done long, total long")
    assert rows(status.progress(phases, ["k"])) == [("a", 90.0), ("b", 0.0), ("c", 0.0), ("d", 0.0)]
    active = spark.createDataFrame([("a", "querying", 1), ("a", "scanning", 2), ("b", "busy", 0), ("c", None, 1), ("c", "odd", 1)], "k string, state string, n long")
    assert rows(status.state(active, ["k"])) == [("a", "scanning"), ("b", "idle"), ("c", "idle")]
