"""Ignore rules, commit logs and manifest edits."""

import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ignore_rules, paths
from lodestone.sources import manifests, vcs

RULES = "# note\n\n*.log\n!keep.log\nSaved/\n/root.txt\ndocs/*.md\n**/deep/x\na/**/z\nout/**\nf?o[0-9].c\n\\#odd\n trail \n[!a]q\n"
PATHS = ["a.log", "keep.log", "d/b.log", "Saved/x/y", "src/Saved/z", "Saved", "root.txt", "d/root.txt", "docs/a.md", "docs/b/a.md", "x/docs/a.md", "deep/x", "p/q/deep/x", "a/z", "a/b/c/z", "out/f", "out", "foo1.c", "fooo1.c", "#odd", "bq", "aq", "plain", "note.md"]


def test_ignore_rules_like_git(spark, tmp_path):
    rules = ignore_rules.parse(RULES)
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = {r[0] for r in df.where(ignore_rules.ignored(F.col("p"), rules)).collect()}
    want = {"a.log", "d/b.log", "Saved/x/y", "src/Saved/z", "Saved", "root.txt", "docs/a.md", "deep/x", "p/q/deep/x", "a/z", "a/b/c/z", "out/f", "foo1.c", "#odd", "bq"}
    assert got == want
    if shutil.which("git"):
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
        (tmp_path / ".gitignore").write_text(RULES)
        out = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(PATHS), capture_output=True, text=True).stdout.split("\n")
        assert set(out) - {""} == want - {"Saved"}  # a path that is not there counts as a file


def test_logs(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    git = vcs.git_log(one("ab\x1fFix\x1fann\x1f2 days ago", "bad", None))
    assert [r["display"] for r in vcs.shown(git).collect()] == ["ab Fix (2 days ago)"]
    p4 = vcs.p4_log(one("... change 12\n... user bob\n... time 1000\n... desc  Did it ", "... user x"), F.lit(8200))
    assert [tuple(r) for r in p4.collect()] == [("12", "Did it", "bob", "2 hours ago", "p4")]
    xml = '<log><logentry revision="7"><author>cy</author><date>1970-01-01T00:10:00.1Z</date><msg>M</msg></logentry><logentry revision="8"><date>?</date></logentry></log>'
    assert [tuple(r)[:4] for r in vcs.svn_log(one(xml), F.lit(1200)).collect()] == [("r7", "M", "cy", "10 minutes ago"), ("r8", "(no message)", "", "?")]
    assert [r["hash"] for r in vcs.newest(git.unionByName(p4), F.col("hash"), 1, "bob").collect()] == ["12"]
    raw = vcs.commit_files(one(":100644 100644 aa bb M\tsrc/x.c", ":160000 160000 cc dd M\tsub", "", None))
    assert [tuple(r)[:3] for r in raw.collect()] == [("submodule", "sub", "sub"), ("file", "src/x.c", "x.c")]
    inner = spark.createDataFrame([("sub", "d/e.c")], "path string, rel_path string")
    assert [r["full_rel_path"] for r in vcs.submodule_files(raw, inner).collect()] == ["sub/d/e.c"]
    assert vcs.revision(spark.createDataFrame([(1, None), (3, "c"), (2, "b")], "provider_rank int, revision string")).first()[0] == "b"
    build = spark.createDataFrame([(5, 3, None, None)], "MajorVersion int, MinorVersion int, PatchVersion int, BranchName string")
    assert vcs.build_fingerprint(build).first()[0] == "ue:5.3.0+Unknown"


def test_project_edit(tmp_path):
    f = tmp_path / "A.uproject"
    f.write_text('{\n\t"FileVersion": 3\n}\n')
    assert manifests.add_to_project(str(f), "M") and not manifests.add_to_project(str(f), "M") and manifests.add_to_project(str(f), "N", "Editor")
    assert [m["Name"] for m in json.loads(f.read_text())["Modules"]] == ["M", "N"] and (tmp_path / "A.uproject.old").exists()


TARGET = 'public class GameTarget : TargetRules\n{\n\tpublic GameTarget(TargetInfo Target) : base(Target)\n\t{\n\t\tType = TargetType.Game; // }\n\t}\n}\n'


def test_target_edit():
    one = manifests.with_target_module(TARGET, "M")
    assert one.count(f"{manifests.METHOD}();") == 1 and one.count('"M"') == 1 and one.count("{") == one.count("}") - 1  # the comment's brace
    assert manifests.with_target_module(one, "M") == one
    two = manifests.with_target_module(one, "N")
    assert '"M",\n\t\t\t"N"\n\t\t});' in two and manifests.with_target_module(two, "N") == two
    flat = manifests.with_target_module(one.replace('{\n\t\t\t"M"\n\t\t});', '{ "M" });'), "N")
    assert '"M",\n\t\t\t"N"\n\t\t});' in flat
    with pytest.raises(ValueError):
        manifests.with_target_module("class X {}", "M")


def test_names_and_types(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(paths.key(F.lit(x))) for x in ("a\\\\b/", "C:/", "/x//", "/")] == ["a//b", "C:/", "/x/", "/"]
    assert one(paths.cache_name(F.lit("C:\\Work\\Game/"))) == "c__Work_Game"
    import hashlib

    assert one(paths.index_name(F.lit("/w/Game"))) == "Game_" + hashlib.sha256(b"/w/Game").hexdigest()[:16] and one(paths.index_name(F.lit("/"))).startswith("Root_")
    assert [one(paths.pointee(F.lit(x))) for x in ("TObjectPtr<UFoo>", "const AActor*", "FBar&", "TArray<TObjectPtr<const UX*>>")] == ["UFoo", "AActor", "FBar", "UX"]


def test_revisions(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert sorted(tuple(r) for r in vcs.git_unpushed(lines("a.h", '"b c.h"', "a.h", ""), "/w/").collect()) == [("/w/a.h", "Unpushed"), ("/w/b c.h", "Unpushed")]
    assert [r[0] for r in vcs.git_between(lines("a.h", ""), "/w").collect()] == ["/w/a.h"]
    assert spark.range(1).select(vcs.reference(F.lit("git:abc"))).first()[0] == "abc"
    versions = spark.createDataFrame([(5, 3, None, "++main"), (None, None, None, None)], "MajorVersion int, MinorVersion int, PatchVersion int, BranchName string")
    assert [r[0] for r in vcs.build_fingerprint(versions).collect()] == ["ue:5.3.0+++main", "ue:0.0.0+Unknown"]


def test_router(spark):
    from lodestone.streaming.changes import router

    got = {}
    note = lambda kind: lambda df: got.setdefault(kind, sorted(r["path"] for r in df.collect()))
    router(note("config"), note("asset"), note("source"))(spark.createDataFrame([("/a.ini",), ("/b.umap",), ("/c.H",), ("/d.txt",), ("/e.cs",)], "path string"), 0)
    assert got == {"config": ["/a.ini"], "asset": ["/b.umap"], "source": ["/c.H", "/e.cs"]}
