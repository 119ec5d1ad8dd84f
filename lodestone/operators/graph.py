"""Trees and cyclic graphs as DataFrames. Rounds run on the driver, data stays distributed; each round's result is checkpointed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.storage import cut

#: Rounds after which what was seen is written as one table.
COMPACT = 8


def full_paths(nodes: DataFrame, separator: str = "/") -> DataFrame:
    """(id, full_path, depth) of an adjacency list (id, parent_id, name); roots have a null parent. One equi-join a level. Nodes on a cycle or below a missing parent are under no
    root and have no row, so the levels end."""
    level = cut(nodes.where("parent_id is null").select("id", F.col("name").alias("full_path"), F.lit(0).alias("depth")))
    done, rounds = level, 0
    while True:
        above = level.select(F.col("id").alias("parent_id"), F.col("full_path").alias("above"), "depth")
        level = cut(nodes.join(above, "parent_id").select("id", F.concat_ws(separator, "above", "name").alias("full_path"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return done
        rounds += 1
        done = done.unionByName(level)
        if rounds % COMPACT == 0:
            done = cut(done)


def reach(seeds: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(origin, node, depth): what each origin reaches over edges (src, dst), with the least depth; seeds (origin, node) have depth 0.

    Semi-naive: only new (origin, node) pairs go on, so cycles end and diamonds are walked once; without a limit it goes on until there is no new pair. What was seen is
    written as one table every COMPACT rounds, so a round's anti-join reads few files and plans stay short."""
    frontier = cut(seeds.select("origin", "node", F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while limit is None or depth < limit:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").select("origin", "node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:
            seen = cut(seen.repartition("origin", "node"))
    return seen


def effective_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): resolved include edges, and unresolved ones fanned out to every header of that base name."""
    resolved = includes.where("resolved_file_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"))
    headers = files.where("is_header").select(F.col("filename").alias("base_filename"), F.col("id").alias("dst"))
    fanned = includes.where("resolved_file_id is null").join(headers, "base_filename").select(F.col("file_id").alias("src"), "dst")
    return resolved.union(fanned).distinct()


def best_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order, by an aggregate that combines before the shuffle (no window, no sort)."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_best")).select(*keys, "_best.*")
