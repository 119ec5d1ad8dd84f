"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item where some stretch of its words is within floor(EDITS * n) word edits of the item's n words.

Windows: an item that is cut by k edits into k + 1 runs keeps one run of floor(n / (k + 1)) words whole, so every contaminated stretch shares such a
run with the item (no loss). Only where a run is shared, the item-sized window that aligns it is embedded.
Embedding: the CGK random walk reads the window through a pointer that a random function of step and word moves or holds; windows at a small edit distance
meet the same words at many steps. Walks are each sampled at SAMPLED steps; a window whose samples equal an item's in
any repeat is a candidate for that item. With a share h of differing steps a pair is missed with probability (1 - (1-h)^SAMPLED)^repeats: 0.001 at h = 0.5 and
24 repeats. h grows with the number of edits, so an item has repeats(n) walks for its n words, for a recall of RECALL at all its allowed edits: in simulations
items of 20, 40, 60, 100 and 200 words took 28 to 38, 28, 34, 49 and 85 for it.
Candidates are verified by exact edit distance (the item against any stretch around the window).

The benchmark is broadcast: its size is checked, and beyond MAX_ITEM_WORDS words it is applied in blocks, one pass over the documents for each.

Defined cases: words are lower-cased and free of ASCII punctuation; null or empty texts and items without a word match nothing; very long texts are
read whole; a document that holds an item twice gives its best stretch, the first of equals; repeated document rows give a row each. clean judges each row by its own
text, so of rows that share a doc_id, or have none, just the contaminated ones go. An empty benchmark or table finds nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import KEYS, body, by_keys, keyed, small_batches, staged, table
from lodestone.llm.tokens import WordHashes, mixed, runs

EDITS, SAMPLED, SEED, RECALL = 0.2, 2, 5, 0.999
MAX_ITEM_WORDS, FLUSH = 400_000, 20_000
_PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
_PAD = np.uint64(0)
OUT = f"{KEYS[0]} long, {KEYS[1]} long, doc_id long, item_id long, distance int, start_word long, end_word long"


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_PUNCTUATION).split() if text else []


def edits_allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def repeats(n: int) -> int:
    """Walks of an item of n words: above what RECALL took in simulations, but for one of 60 trials at 20 words (38; 28 in one of 300)."""
    return 24 + math.ceil(0.4 * n)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of text nearest to item by word edits; the first end of equals."""
    n, m = len(item), len(text)
    cost, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    for i in range(1, n + 1):
        same = (text != item[i - 1]).astype(np.int64)
        new, new_start = np.empty(m + 1, dtype=np.int64), np.empty(m + 1, dtype=np.int64)
        new[0], new_start[0] = i, 0
        diag, up = cost[:-1] + same, cost[1:] + 1
        best = np.minimum(diag, up)
        origin = np.where(diag <= up, start[:-1], start[1:])
        for j in range(1, m + 1):
            left = new[j - 1] + 1
            if left < best[j - 1]:
                new[j], new_start[j] = left, new_start[j - 1]
            else:
                new[j], new_start[j] = best[j - 1], origin[j - 1]
        cost, start = new, new_start
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """A block of the benchmark: seed runs, embeddings' samples, and the items' words."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hashes = WordHashes()
        pairs = sorted((i, hashes.of(w)) for i, t in items if i is not None and (w := plain_words(t)))
        self.ids, self.words = [p[0] for p in pairs], [p[1] for p in pairs]
        self.longest = max((len(w) for w in self.words), default=0)
        rng = np.random.default_rng(SEED)
        steps = max(1, 3 * self.longest)
        self.seeds = rng.integers(1, 1 << 63, (repeats(self.longest), steps), dtype=np.int64).astype(np.uint64)
        self.unit = rng.random((repeats(self.longest), SAMPLED))
        by_width: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            width = max(1, len(w) // (edits_allowed(len(w)) + 1))
            for q, h in enumerate(runs(w, width)):
                by_width[width].append((int(h), k, q))
        self.runs = {}
        for width, found in sorted(by_width.items()):
            found.sort()
            keys = np.array([f[0] for f in found], dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[keys >> np.uint64(44)] = True
            self.runs[width] = (keys, np.array([f[1:] for f in found]), seen)
        self.buckets: dict[tuple[int, int], list[int]] = defaultdict(list)
        if self.words:
            for k, row in enumerate(self.samples(self.padded(self.words), np.array([len(w) for w in self.words]))):
                for r, key in enumerate(row[: repeats(len(self.words[k]))]):
                    self.buckets[r, int(key)].append(k)

    def padded(self, windows: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(windows), self.longest + 1), _PAD)
        for row, w in zip(out, windows, strict=True):
            row[: len(w)] = w
        return out

    def samples(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of each padded window, of which the first repeats(size) count. The sampled steps depend on the size, 3n steps being a walk's length."""
        turns = np.array([repeats(int(n)) for n in sizes], dtype=np.int64)
        out = np.zeros((len(windows), int(turns.max(initial=0))), dtype=np.uint64)
        for r in range(out.shape[1]):
            rows = np.flatnonzero(turns > r)
            at = (self.unit[r][None, :] * (2 * sizes[rows])[:, None]).astype(np.int64)
            pointer, key = np.zeros(len(rows), dtype=np.int64), sizes[rows].astype(np.uint64)
            for j in range(int(at.max()) + 1):
                word = windows[rows, pointer]
                hit = (at == j).any(axis=1)
                key[hit] = mixed(key[hit] * np.uint64(31) + word[hit])
                bit = (mixed(word ^ self.seeds[r, j]) & np.uint64(1)).astype(np.int64)
                pointer = np.minimum(pointer + bit, self.longest)
            out[rows, r] = key
        return out

    def windows(self, text: np.ndarray) -> set[tuple[int, int]]:
        """(start, size) of the item-sized windows that share a run with an item of that size."""
        out = set()
        for width, (keys, places, seen) in self.runs.items():
            own = runs(text, width)
            at = np.flatnonzero(seen[own >> np.uint64(44)]) if len(own) else own
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for k, q in places[a:b].tolist():
                    out.add((max(0, p - q), len(self.words[k])))
        return out

    def candidates(self, windows: list[np.ndarray], sizes: list[int]) -> list[set[int]]:
        keys = self.samples(self.padded(windows), np.array(sizes))
        return [{k for r, key in enumerate(row[: repeats(n)]) for k in self.buckets.get((r, key), ())} for row, n in zip(keys.tolist(), sizes, strict=True)]


def _scan(items: Items):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, waiting, held = WordHashes(), [], 0

        def settle() -> pd.DataFrame:
            flat = [(d, s, n) for d, (_, _, spans) in enumerate(waiting) for s, n in sorted(spans)]
            got = items.candidates([waiting[d][1][s : s + n] for d, s, n in flat], [n for *_, n in flat]) if flat else []
            tries: dict[tuple[int, int], set[int]] = defaultdict(set)
            for (d, s, _), ks in zip(flat, got, strict=True):
                for k in ks:
                    tries[d, k].add(s)
            rows = []
            for (d, k), starts in tries.items():
                best, (doc, text, _), item = None, waiting[d], items.words[k]
                slack, done = edits_allowed(len(item)), -1
                for s in sorted(starts):
                    if s <= done:  # the stretch tried before covers it
                        continue
                    a, b = max(0, s - slack), s + 2 * (len(item) + slack)
                    done = s + len(item)
                    cost, x, y = best_stretch(item, text[a:b])
                    if cost <= slack and (best is None or cost < best[0]):
                        best = (cost, a + x, a + y)
                if best:
                    rows.append((*doc, items.ids[k], *best))
            return pd.DataFrame(rows, columns=[*KEYS, "doc_id", "item_id", "distance", "start_word", "end_word"]).astype({"doc_id": "Int64"})

        for b in batches:
            for *doc, text in zip(b[KEYS[0]], b[KEYS[1]], b["doc_id"].astype("Int64"), b["text"], strict=True):
                words = hashes.of(plain_words(text))
                if spans := items.windows(words):
                    waiting.append((doc, words, spans))
                    held += len(spans) + len(words) // 64
                    if held > FLUSH:
                        yield settle()
                        waiting, held = [], 0
        if waiting:
            yield settle()

    return run


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of the benchmark, one at a time on the driver."""
    rows = benchmark.select("item_id", body().alias("text")).where("length(text) > 0")
    sized = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-sized // (6 * MAX_ITEM_WORDS)))
    for i in range(n):
        yield Items([(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()])


def found_in(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of matches, with the KEYS of the document's row."""
    small_batches(docs.sparkSession)
    rows = keyed(docs).select(*KEYS, F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    out = None
    for items in _blocks(benchmark):
        part = staged(rows.mapInPandas(_scan(items), OUT), "matches")  # so that the driver need not hold this block on
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word of each contaminated (document, item)."""
    return found_in(docs, benchmark).drop(*KEYS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns."""
    return by_keys(keyed(docs), found_in(docs, benchmark), "left_anti").drop(*KEYS)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
