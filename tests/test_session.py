"""The service's state on the driver: cached results, polls, newest requests, projects, scan requests."""

import json

from lodestone.plans import session


def test_result_cache():
    cache = session.ResultCache(3)
    for i in range(3):
        cache.put("A" if i < 2 else "B", f"p{i}", "", [i])
    assert cache.get("A", "p0", "") == [0] and cache.hits("A", "p0", "") == 2
    cache.put("C", "p", "", [9])  # p1 was used least recently
    assert cache.get("A", "p1", "") is None and cache.get("A", "p0", "") == [0]
    assert cache.invalidate("A") == 1 and cache.get("A", "p0", "") is None and cache.invalidate("A") == 0 and cache.get("C", "p", "") == [9]


def test_cached_query(spark):
    cache, asked = session.ResultCache(), []
    query = lambda: asked.append(1) or spark.range(2)
    assert [[r["id"] for r in cache.rows("A", "", "", query)] for _ in range(2)] == [[0, 1]] * 2 and len(asked) == 1


def test_poller(spark):
    at, paths = [0.0], lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    poller = session.Poller("r0", 300, 2, lambda: at[0])
    ask = lambda revision, changed: poller.poll(lambda: revision, lambda old, new: changed)
    assert ask("r1", paths("/a.cpp")) == "incremental" and ask("r2", paths("/a.cpp")) == "none"  # still cooling down
    at[0] = 300
    assert ask("r1", None) == "none"
    at[0] = 600
    assert ask("r2", None) == "full"
    at[0] = 900
    assert ask("r3", paths("/a.cpp", "/b.h", "/c.h")) == "full"
    at[0] = 1200
    assert ask("r4", paths("/a.png")) == "none"


def test_last_request_wins(spark):
    requests = session.LastWins(sleep=lambda s: None)
    first, second = requests.ask("search"), requests.ask("search")
    other = requests.ask("files")
    assert requests.run("search", first, lambda: 1 / 0) is None and requests.run("search", second, lambda: 2) == 2 and requests.run("files", other, lambda: 3) == 3


def test_projects(spark, tmp_path):
    projects = session.Projects(spark, str(tmp_path / "projects"))
    assert projects.all().isEmpty()
    projects.register("/g", "Game", "/e", "/i")
    projects.register("/h", "Other")
    projects.register("/g", "Game2", "/e", "/i")
    projects.delete("/h")
    assert [tuple(r) for r in projects.all().collect()] == [("/g", "Game2", "/e", "/i")]


def test_scan_request(spark, tmp_path):
    (tmp_path / "a.h").write_text('#include "B/b.h"\nclass A : public B { void Go(); };')
    request = json.dumps({"files": [{"path": str(tmp_path / "a.h"), "mtime": 5}, {"path": str(tmp_path / "none.h"), "mtime": 6}]})
    (line,) = [json.loads(r["value"]) for r in session.scanned(spark, request).collect()]
    assert (line["path"], line["status"], line["mtime"]) == (str(tmp_path / "a.h"), "parsed", 5)
    assert [c["name"] for c in line["data"]["classes"]] == ["A"] and line["data"]["includes"] == ["B/b.h"]
    assert session.scanned(spark, "").isEmpty() and session.scanned(spark, "[]").isEmpty()
