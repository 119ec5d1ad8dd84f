"""What a service keeps on the driver beside the index: cached results, the time of its last look at version control, the newest request of a kind, and the list of projects."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import incremental

# Entries of the cache, seconds between two polls, scannable files before a full refresh, seconds a request waits for a newer one.
ENTRIES, COOLDOWN, MOST_CHANGED, WAIT = 50_000, 300, 100, 0.02


class ResultCache:
    """The newest results by (class, prefix, accessor), each with its hits; the least recently used go first. Results are lists of rows that a query has collected."""

    def __init__(self, entries: int = ENTRIES) -> None:
        self.entries = entries
        self.held: OrderedDict[tuple[str, str, str], tuple[list[Row], int]] = OrderedDict()
        self.keys_of: dict[str, set[tuple[str, str, str]]] = {}

    def get(self, class_name: str, prefix: str, accessor: str) -> list[Row] | None:
        key = (class_name, prefix, accessor)
        found = self.held.get(key)
        if found is None:
            return None
        self.held[key] = (found[0], found[1] + 1)
        self.held.move_to_end(key)
        return found[0]

    def put(self, class_name: str, prefix: str, accessor: str, rows: list[Row]) -> None:
        key = (class_name, prefix, accessor)
        self.held[key] = (rows, 1)
        self.held.move_to_end(key)
        self.keys_of.setdefault(class_name, set()).add(key)
        while len(self.held) > self.entries:
            self._forget(next(iter(self.held)))

    def _forget(self, key: tuple[str, str, str]) -> None:
        self.held.pop(key, None)
        own = self.keys_of.get(key[0], set())
        own.discard(key)
        if not own:
            self.keys_of.pop(key[0], None)

    def hits(self, class_name: str, prefix: str, accessor: str) -> int:
        return self.held.get((class_name, prefix, accessor), ([], 0))[1]

    def invalidate(self, class_name: str) -> int:
        """Forgets a class's results and tells how many there were."""
        keys = list(self.keys_of.get(class_name, ()))
        for key in keys:
            self._forget(key)
        return len(keys)

    def rows(self, class_name: str, prefix: str, accessor: str, query: Callable[[], DataFrame]) -> list[Row]:
        """The cached rows, or those of the query, which are cached then. The query bounds its rows."""
        found = self.get(class_name, prefix, accessor)
        if found is None:
            found = query().collect()
            self.put(class_name, prefix, accessor, found)
        return found


class Poller:
    """Looks at version control at most once in a cooldown and says what a change of revision asks for."""

    def __init__(self, revision: str | None = None, cooldown: float = COOLDOWN, limit: int = MOST_CHANGED, now: Callable[[], float] = time.time) -> None:
        self.revision, self.cooldown, self.limit, self.now, self.last = revision, cooldown, limit, now, float("-inf")

    def poll(self, current: Callable[[], str | None], changed: Callable[[str | None, str], DataFrame | None]) -> str:
        """none, full or incremental. current: the revision now; changed: paths (path) between two revisions, None where they cannot be told."""
        if self.now() - self.last < self.cooldown:
            return "none"
        self.last = self.now()
        revision = current()
        if revision is None or revision == self.revision:
            return "none"
        old, self.revision = self.revision, revision
        paths = changed(old, revision)
        return "full" if paths is None else incremental.refresh_decision(paths, self.limit).first()["decision"]


class LastWins:
    """Of requests of a kind that come within the wait, only the last runs."""

    def __init__(self, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> None:
        self.wait, self.sleep, self.newest = wait, sleep, {}

    def ask(self, kind: Hashable) -> int:
        """A ticket of a kind; older tickets of it no longer count."""
        self.newest[kind] = self.newest.get(kind, 0) + 1
        return self.newest[kind]

    def run(self, kind: Hashable, ticket: int, query: Callable[[], DataFrame]) -> DataFrame | None:
        """The query's result after the wait, None if a newer request came."""
        self.sleep(self.wait)
        return query() if self.newest.get(kind) == ticket else None


PROJECT = "root string, name string, engine_root string, index_folder string, gone boolean"


class Projects:
    """The registered projects: a log of entries in a folder, of which the last of a root counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _log(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        schema = PROJECT + ", turn long"
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(schema).json(self.folder) if there else self.spark.createDataFrame([], schema)

    def all(self) -> DataFrame:
        columns = [c.split(" ")[0] for c in PROJECT.split(", ")]
        last = self._log().groupBy("root").agg(F.max_by(F.struct(*columns[1:]), "turn").alias("p")).select("root", "p.*")
        return last.where("not gone").drop("gone").orderBy("root")

    def _add(self, *entry: object) -> None:
        turn = (self._log().agg(F.max("turn")).first()[0] or 0) + 1
        self.spark.createDataFrame([(*entry, turn)], PROJECT + ", turn long").coalesce(1).write.mode("append").json(self.folder)

    def register(self, root: str, name: str, engine_root: str | None = None, index_folder: str | None = None) -> None:
        self._add(root, name, engine_root, index_folder, False)

    def delete(self, root: str) -> None:
        self._add(root, None, None, None, True)


def scanned(spark: SparkSession, request: str) -> DataFrame:
    """(value): a line of JSON for each file of a scan request ({"files": [{"path", "mtime", ...}]} or the list itself), with its symbols and includes; files that cannot
    be read are left out."""
    from lodestone.sources import cpp, files

    asked = json.loads(request) if request.strip() else []
    asked = asked.get("files", []) if isinstance(asked, dict) else asked
    schema = "path string, status string, mtime long, module_id long, data struct<classes:array<string>,includes:array<string>>"
    if not asked:
        return spark.createDataFrame([], schema).select(F.to_json(F.struct("*")).alias("value"))
    wanted = spark.createDataFrame([(a["path"], a.get("mtime"), a.get("module_id")) for a in asked], "path string, mtime long, module_id long")
    raw = spark.read.option("ignoreMissingFiles", "true").format("binaryFile").load([a["path"] for a in asked if _exists(spark, a["path"])] or [])
    texts = files.texts(raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"))
    classes = cpp.symbols(texts).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "symbol_type", "bases", "members"))).alias("classes"))
    includes = cpp.includes(texts).groupBy("path").agg(F.array_sort(F.collect_set("include_path")).alias("includes"))
    rows = texts.select("path").join(wanted, "path").join(classes, "path", "left").join(includes, "path", "left")
    data = F.struct(F.coalesce("classes", F.array()).alias("classes"), F.coalesce("includes", F.array()).alias("includes"))
    return rows.select(F.to_json(F.struct("path", F.lit("parsed").alias("status"), "mtime", "module_id", data.alias("data"))).alias("value"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
