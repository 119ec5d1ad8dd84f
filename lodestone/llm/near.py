"""MinHash near-duplicate groups with odd sketches.

Documents are sets of 5-word shingles (64-bit hashes); two are linked where 100 * intersection >= share * union: op9 takes a share of 85, keep_one (the pipeline's stage) of STAGE_SHARE.

1. Equal sets form classes (by a 128-bit digest of the sorted set); all further work is on class representatives, so copies cost nothing.
2. MinHash: samples in bands of ROWS. There are as many bands as it takes for a pair at the share to meet in none with probability MISSED at most
   (26 at 85, 41 at 80).
3. The same samples fold into an odd sketch: a parity bitmap of BITS bits. The population count of two sketches' XOR estimates their
   similarity; what may be SPREAD standard deviations below the share passes (0.69 at 85, 0.65 at 80).
4. Star round: each band bucket proposes (smallest row, member) pairs only, a number linear in the bucket. Survivors of the sketch test are
   confirmed on full shingle sets.
5. Rest round, for buckets whose members are still in several components. A task compares members of different components by odd sketch and by the parities of the
   full sets, an exact bound (each shingle that only one of two sets has flips one bit, so a population count above what a link may differ by rules the pair out), in blocks of
   BLOCK members a side, and gives out the members that are in a pair that passes: rows linear in the members. A pair counts in the first bucket that it shares only.
   These members meet again with their full sets, in blocks of BLOCK members and BLOCK_SHINGLES shingles a side; there each pair that passes is confirmed exactly in the
   task, unless links found before have joined its components, and a link is given out: fewer than the components that the block holds. No pair of different components goes
   untested, so no link between components is lost, and no task gives out the pairs of a crowd.
6. Components by contraction in rounds, each of which is a few shuffles of what edges are left.

Defined cases: null or empty text has an empty set, links with nothing and is its own component; very long texts are read whole; rows are linked as rows, so rows that share a doc_id link by their own texts, and
rows with a null doc_id link too. component_id is the smallest doc_id reachable, null where no row of the component has one. One row of a component is kept: one with that doc_id,
or, where ids are null, any one; rows without words are all kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import KEYS, body, by_keys, kept_rows, keyed, met, small_batches, staged, table
from lodestone.llm.tokens import WordHashes, mixed, shingles, words_of

ROWS, BITS = 6, 512
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Bits of the parities of a full set.
FULL_BITS = 4096
#: Shares in hundredths: of op9, and of a stage without a contract of its own.
SHARE, STAGE_SHARE = 85, 80
MISSED, SPREAD = 5e-6, 5.75


def n_bands(share: int) -> int:
    """Bands for a pair at the share to share none with probability MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log(1 - (share / 100) ** ROWS))


def most_bits(share: int) -> int:
    """SPREAD standard deviations below the share, in XOR population count: differing samples of both sides, folded into BITS parities."""
    k, s = n_bands(share) * ROWS, share / 100
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * k * (1 - s + SPREAD * math.sqrt(s * (1 - s) / k))))) + 1


@cache
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    a = (rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[None, :]
    return a, rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)[None, :]


def minhash(found: np.ndarray, share: int = SHARE) -> np.ndarray:
    """n_bands * ROWS minima of a non-empty shingle set."""
    mul, add = _functions(n_bands(share) * ROWS)
    x, low = (found >> np.uint64(32)).astype(np.uint32)[:, None], None
    for i in range(0, len(x), 1024):
        part = (x[i : i + 1024] * mul + add).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, ROWS).astype(np.uint64)
    key = mixed(np.arange(1, len(rows) + 1, dtype=np.uint64))
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """BITS parities as 64-bit words."""
    at = (np.arange(len(low), dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
    place = mixed(low.astype(np.uint64) | at) % np.uint64(BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def full_parities(found: np.ndarray) -> bytes:
    return np.packbits((np.bincount((found % np.uint64(FULL_BITS)).astype(np.int64), minlength=FULL_BITS) & 1).astype(np.uint8)).tobytes()


def features(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """row (a number), the row's KEYS, doc_id, n, sig, bands, odd, parity; the last four null for empty sets."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in b["text"]:
                found = shingles(hashes.of(words_of(text)))
                if len(found):
                    low = minhash(found, share)
                    rows.append((len(found), xxhash.xxh128_digest(found.tobytes()), bands(low), odd_sketch(low), full_parities(found)))
                else:
                    rows.append((0, None, None, None, None))
            out = pd.DataFrame(rows, columns=["n", "sig", "bands", "odd", "parity"])
            for at, name in enumerate(("row", *KEYS, "doc_id")):
                out.insert(at, name, b[name].astype("Int64").array)
            yield out

    rows = keyed(docs).select(F.monotonically_increasing_id().alias("row"), *KEYS, F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return rows.mapInPandas(run, f"row long, {KEYS[0]} long, {KEYS[1]} long, doc_id long, n long, sig binary, bands array<long>, odd array<long>, parity binary")


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and its shingles (sorted), of reps (rep, KEYS)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out = b[list(KEYS)].copy()
            out["found"] = [shingles(hashes.of(words_of(t))).view(np.int64) for t in b["text"]]
            yield out

    rows = by_keys(keyed(docs), reps, "left_semi").select(*KEYS, body().alias("text"))
    found = rows.mapInPandas(run, f"{KEYS[0]} long, {KEYS[1]} long, found array<long>").dropDuplicates(list(KEYS))
    return reps.select("rep", *KEYS).distinct().join(found, list(KEYS)).select("rep", "found")


def _near(x: str, y: str, share: int):
    """May the sketched rows x and y be linked? By set sizes and odd sketches."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum(F.bit_count(F.col(f"{x}.odd")[i].bitwiseXOR(F.col(f"{y}.odd")[i])) for i in range(BITS // 64))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * share) & (differ <= most_bits(share))


def confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) of representatives whose full shingle sets reach the share."""
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = staged(sets_of(docs, reps.join(ends, "rep", "left_semi")), "sets")
    left, right = sets.select(F.col("rep").alias("a"), F.col("found").alias("fa")), sets.select(F.col("rep").alias("b"), F.col("found").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("fa") + F.size("fb")).alias("sum"))
    return found.where(100 * F.col("both") >= share * (F.col("sum") - F.col("both"))).select("a", "b")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component: the smallest id reachable.

    Each round every node hooks onto its best neighbour (smallest id at first; later by a hash that changes with the round, so chains shrink by a
    constant share), one pointer jump follows, and edges inside a node go."""
    edges = staged(edges.where("a != b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = staged(ends.select("id", F.col("id").alias("at")), "labels")
    for turn in range(limit):
        if edges.isEmpty():
            break
        rank = (lambda c: F.col(c)) if turn < 2 else (lambda c: F.xxhash64(F.col(c), F.lit(turn)))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("up"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("up"))
        hook = staged(best.select(F.col("a").alias("x"), F.least(F.col("m"), own)["up"].alias("up")), "hook")
        above = hook.select(F.col("x").alias("up"), F.col("up").alias("top"))
        jump = staged(hook.join(above, "up").select("x", "top"), "jump")
        labels = staged(labels.join(jump, labels["at"] == jump["x"], "left").select("id", F.coalesce("top", "at").alias("at")), "labels")
        a, b = jump.select(F.col("x").alias("a"), F.col("top").alias("ta")), jump.select(F.col("x").alias("b"), F.col("top").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta != tb")
        edges = staged(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    least = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(least, "at").select("id", "component")


def _groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows equal in keys, of batches sorted by them."""
    parts, current = [], None
    for b in batches:
        if not len(b):
            continue
        values = b[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        for start, end in zip(starts, np.r_[starts[1:], len(b)], strict=True):
            if parts and tuple(values[start]) != current:
                yield pd.concat(parts, ignore_index=True)
                parts = []
            current = tuple(values[start])
            parts.append(b.iloc[start:end])
    if parts:
        yield pd.concat(parts, ignore_index=True)


class Block:
    """Members of a bucket, of one block or of two."""

    def __init__(self, members: pd.DataFrame, share: int) -> None:
        self.share, self.most, self.key = share, most_bits(share), members["key"][0]
        self.rep, self.at, self.n = (members[c].to_numpy(np.int64) for c in ("rep", "at", "n"))
        self.odd = np.array(members["odd"].tolist(), dtype=np.int64).view(np.uint64)
        self.parity = np.frombuffer(b"".join(members["parity"]), dtype=np.uint64).reshape(len(members), -1)
        self.bands = np.array(members["bands"].tolist(), dtype=np.int64)
        self.block, self.sides = members["block"].to_numpy(), (members["bi"][0], members["bj"][0])

    def passing(self) -> Iterator[tuple[int, np.ndarray]]:
        """A member and those with which it is in different components now, may be linked, and shares no earlier bucket."""
        bi, bj = self.sides
        rows = np.flatnonzero(self.block == bi)
        others = rows if bi == bj else np.flatnonzero(self.block == bj)
        for r in rows:
            c = others[others > r] if bi == bj else others
            n = self.n[c]
            c = c[(self.at[c] != self.at[r]) & (np.minimum(n, self.n[r]) * 100 >= np.maximum(n, self.n[r]) * self.share)]
            c = c[np.bitwise_count(self.odd[c] ^ self.odd[r]).sum(axis=1, dtype=np.int64) <= self.most]
            differ = np.bitwise_count(self.parity[c] ^ self.parity[r]).sum(axis=1, dtype=np.int64)
            c = c[differ * (100 + self.share) <= (self.n[c] + self.n[r]) * (100 - self.share)]
            if len(c):
                c = c[self.bands[r][(self.bands[c] == self.bands[r]).argmax(axis=1)] == self.key]
                if len(c):
                    yield r, c


def _crowd(share: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in _groups(batches, ["key", "bi", "bj"]):
            block, hit = Block(members, share), np.zeros(len(members), dtype=bool)
            for r, c in block.passing():
                hit[r] = hit[c] = True
            yield pd.DataFrame({"key": block.key, "rep": block.rep[hit]}).astype({"key": "int64", "rep": "int64"})

    return run


def _links(share: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in _groups(batches, ["key", "bi", "bj"]):
            block, out, found = Block(members, share), [], members["found"].tolist()
            for r, c in block.passing():
                for x in c:
                    if block.at[x] != block.at[r]:
                        both = len(np.intersect1d(found[r], found[x], assume_unique=True))
                        if 100 * both >= share * (len(found[r]) + len(found[x]) - both):
                            out.append((block.rep[r], block.rep[x]))
                            block.at[block.at == block.at[x]] = block.at[r]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """members (key, rep, ...) to tasks: each of a bucket's blocks with each, by key, bi, bj."""
    rows = members.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    rows = rows.withColumns({"bi": F.least("block", "_other"), "bj": F.greatest("block", "_other")}).drop("_other")
    return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")


def _rest(docs: DataFrame, held: DataFrame, reps: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """(a, b): links between components, which join all those that links of a bucket's members join."""
    at = labels.withColumnsRenamed({"id": "rep", "component": "at"})
    crowd = held.where("size > 2").select("key", "rep").join(at, "rep", "left").withColumn("at", F.coalesce("at", "rep"))
    several = crowd.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("key", "size")
    sketched = staged(crowd.join(several, "key").join(reps.select("rep", "n", "odd", "parity", "bands"), "rep"), "crowd")
    schema = "key long, rep long"
    crowded = staged(_dealt(sketched, F.ceil(F.col("size") / BLOCK).cast("int")).mapInPandas(_crowd(share), schema).distinct(), "crowded")
    if crowded.isEmpty():
        return crowded.select(F.col("key").alias("a"), F.col("rep").alias("b"))
    again = sketched.drop("size").join(crowded, ["key", "rep"], "left_semi")
    sizes = again.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sets = staged(sets_of(docs, reps.join(crowded.select("rep").distinct(), "rep", "left_semi")), "sets")
    whole = again.join(sizes, "key").join(sets, "rep")
    return _dealt(whole, F.col("blocks")).mapInPandas(_links(share), "a long, b long")


def near_groups(docs: DataFrame, share: int = SHARE, keys: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; with its KEYS if asked for."""
    found = staged(features(docs, share), "features")
    full = found.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = full.groupBy("sig").agg(F.min("row").alias("rep"), first.alias("first"), F.count(F.lit(1)).alias("size"))
    members = full.select(F.col("row").alias("rep"), *KEYS, "n", "bands", "odd", "parity")
    reps = staged(members.join(classes, "rep"), "reps")

    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    held = staged(banded.join(buckets, "key"), "buckets")
    sketch = lambda name: reps.select(F.col("rep").alias(name), F.struct("n", "odd").alias(f"s{name}"))
    stars = held.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    tested = stars.join(sketch("a"), "a").join(sketch("b"), "b").where(_near("sa", "sb", share)).select("a", "b")
    labels = staged(components(confirmed(docs, reps, staged(tested, "pairs"), share)), "first")

    more = staged(_rest(docs, held, reps, labels, share), "rest")
    if not more.isEmpty():
        at = lambda name: labels.select(F.col("id").alias(name), F.col("component").alias(f"c{name}"))
        joined = more.join(at("a"), "a", "left").join(at("b"), "b", "left")
        second = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        both = labels.select("id", "component").join(second.select(F.col("component").alias("top"), F.col("id").alias("component")), "component", "full")
        labels = staged(both.select(F.coalesce("id", "component").alias("id"), F.coalesce("top", "component").alias("component")), "merged")
    by_class = staged(reps.select("rep", "sig", "first", "size").join(labels, reps["rep"] == labels["id"], "left").select("sig", "first", "size", F.coalesce("component", "rep").alias("component")), "classes")
    tops = by_class.groupBy("component").agg(F.min("first").alias("top"))
    facts = staged(by_class.join(tops, "component").select("sig", "size", F.col("top.doc_id").alias("top_id"), F.col("top.row").alias("top_row")), "tops")
    rows = met(found.where("n > 0").select("row", *KEYS, "doc_id", "n", "sig"), facts, "sig", "size", found.count())
    rows = rows.select(*KEYS, "doc_id", "n", F.col("top_id").alias("component_id"), (F.col("row") == F.col("top_row")).alias("kept"))
    alone = found.where("n = 0").select(*KEYS, "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(alone).select(*(KEYS if keys else ()), "doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, share: int = STAGE_SHARE) -> DataFrame:
    """The rows of docs that stay, all columns: one row of each group."""
    return kept_rows(docs, near_groups(docs, share, True))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), SHARE)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
