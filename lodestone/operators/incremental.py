"""Snapshots: diffs, upserts, unique resolution, stale rows, refresh decisions, debounce."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.storage import cut


def changes(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """key and `change` (added, changed, deleted, unchanged) between two snapshots."""
    o, n = old.select(key, F.col(stamp).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(stamp).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, change.alias("change"))


def upserted(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of new's keys replaced by new's: child rows of a file go with the file."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_stale(rows: DataFrame, present: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """rows without those that lie under a walked root but are no longer there."""
    under = F.lit(False)
    for r in roots:
        under = under | F.col(path).startswith(r.rstrip("/") + "/")
    gone = rows.where(under).join(present.select(path), path, "left_anti").select(path)
    return rows.join(gone, path, "left_anti")


def resolve_unique(edges: DataFrame, name: str, targets: DataFrame, target_name: str, target_id: str, resolved: str) -> DataFrame:
    """edges with `resolved`: the target of that name where exactly one exists."""
    single = targets.groupBy(F.col(target_name).alias(name)).agg(F.count(F.lit(1)).alias("_n"), F.min(target_id).alias(resolved)).where("_n = 1").drop("_n")
    return edges.join(single, name, "left")


def resolve_any(edges: DataFrame, name: str, targets: DataFrame, target_name: str, target_id: str, resolved: str) -> DataFrame:
    """edges with `resolved`: the smallest target id of that name."""
    return edges.join(targets.groupBy(F.col(target_name).alias(name)).agg(F.min(target_id).alias(resolved)), name, "left")


STRUCTURAL = r"(?i)(\.build\.cs|\.target\.cs|\.uplugin|\.uproject)$"
SCANNABLE = ("h", "hpp", "inl", "cpp", "cs", "ini")


def refresh_decision(changed: DataFrame, limit: int = 100) -> DataFrame:
    """One row: full where a structural file or more than limit scannable files changed, incremental where some did, else none."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return changed.agg(
        F.when(F.coalesce(F.bool_or(F.col("path").rlike(STRUCTURAL)), F.lit(False)), "full").when(F.count_if(ext.isin(*SCANNABLE)) > limit, "full").when(F.count_if(ext.isin(*SCANNABLE)) > 0, "incremental").otherwise("none").alias("decision")
    )


def debounced(events: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """(key, ts) of the accepted events: each at least gap after the last ACCEPTED one of its key. Events are sorted within partitions and read once, with the key's last
    accepted time as the only state, so a hot key costs a scan and no memory. Events of a null time are left out; a null key is a key."""
    field = events.schema[key]
    rows = events.where(F.col(ts).isNotNull()).select(key, F.col(ts).cast("long").alias("_ts"), F.to_json(F.struct(key)).alias("_key"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for b in batches:
            keys, times, kept = b["_key"].to_numpy(), b["_ts"].to_numpy(), []
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(b) else np.empty(0, dtype=int)
            for start, end in zip(starts, np.r_[starts[1:], len(b)], strict=True):
                if keys[start] != current:
                    current, last = keys[start], None
                at = start
                while at < end:  # from one accepted event to the next
                    at = at if last is None else start + int(np.searchsorted(times[start:end], last + gap))
                    if at < end:
                        last = times[at]
                        kept.append(at)
                        at += 1
            yield pd.DataFrame({key: b[key].to_numpy()[kept], ts: times[kept]})

    schema = T.StructType([field, T.StructField(ts, T.LongType())])
    return rows.repartition("_key").sortWithinPartitions("_key", "_ts").mapInPandas(run, schema)


def chunked(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """df with `chunk`: batches of size rows in a total order. Rows are ranged over partitions and get their place there once, in a checkpoint: a second ranging
    could put its borders elsewhere. The partitions' sizes, a number each, then give every row its number; no task holds all rows."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    total, pairs = 0, []
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(total)]
        total += sizes[p]
    first = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return ranged.withColumn("chunk", F.floor((first + place) / size)).drop("_at")
