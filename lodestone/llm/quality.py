"""Quality classifier: random Fourier features approximate a Gaussian kernel over document statistics.

Ridge regression in that feature space, in which the constant and the standardised statistics themselves stand too (a linear kernel beside the Gaussian one, so a score keeps
its slope far from the training data), is fitted from normal equations: each partition sums its own part,
GROUPS tasks add the partitions' sums, and the driver adds those GROUPS matrices of fixed size. Isotonic regression on another
fold (pooled over at most 4001 score bins) makes the raw scores probabilities.

Only the text is read for a score. Defined cases: null text counts as empty and is scored like any other; very long texts are read whole; repeated rows give a row and a score each, and
count each in training; documents without a label are scored; several labels of one document count as their mean; a null label or a null doc_id is no label; other columns
are ignored, whatever their names; without any label every score is 0.5; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import body, fold_of, small_batches, staged, table

WAVES, RIDGE, GROUPS, SEED, WIDTH = 192, 1.0, 16, 7, 1.3
_MARKS = b"|*!#%&$.,;:-"
N_STATS = 13 + len(_MARKS)


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; logarithms and shares, so texts of any length compare."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * N_STATS
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    low = data.lower().split()
    lines = data.split(b"\n")
    k = max(1, len(words))
    pairs = set(zip(low, low[1:], strict=False))
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / k, hist[65:91].sum() / n, hist[48:58].sum() / n,
        hist[128:].sum() / n, len(set(low)) / k, len(pairs) / k, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        len(zlib.compress(data, 1)) / n, sum(len(w) <= 2 for w in words) / k, hist[10] / k,
        *(min(2.0, hist[c] / k) for c in _MARKS),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "stats": [statistics(t) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInPandas(run, "doc_id long, stats array<float>")


class Waves:
    """Standardises statistics and maps them to cosines whose inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(N_STATS, WAVES)) / (WIDTH * np.sqrt(N_STATS))
        self.b = rng.uniform(0, 2 * np.pi, WAVES)

    def of(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / WAVES) * np.cos(z @ self.w + self.b)])


def _sums(frames: Iterable[pd.DataFrame], waves: Waves) -> np.ndarray:
    d = 1 + N_STATS + WAVES
    total = np.zeros((d, d + 1))
    for b in frames:
        if len(b):
            x = waves.of(np.array(b["stats"].tolist(), dtype=float))
            total += x.T @ np.column_stack([x, b["y"].to_numpy(float)])
    return total


def normal_equations(rows: DataFrame, waves: Waves) -> np.ndarray:
    """Sum of x x' and x y over rows (stats, y): per partition, then in GROUPS tasks, then here."""

    def part(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = _sums(batches, waves)
        if total[0, 0]:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % GROUPS], "sums": [total.tobytes()]})

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for s in b["sums"]:
                x = np.frombuffer(s)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    d = 1 + N_STATS + WAVES
    merged = rows.select("stats", "y").mapInPandas(part, "part int, sums binary").repartition(GROUPS, "part").select("sums").mapInPandas(merge, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in merged.collect()), np.zeros(d * (d + 1))).reshape(d, d + 1)


def pooled(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block centres and values."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


class Model:
    def __init__(self, waves: Waves, beta: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        self.waves, self.beta, self.at, self.value = waves, beta, at, value

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.waves.of(stats) @ self.beta, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def fit(rows: DataFrame) -> Model | None:
    """rows: stats, y, calibrate. None where there is nothing to learn from."""
    base = rows.where("not calibrate")
    cols = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)]
    found = base.agg(F.count(F.lit(1)).alias("n"), *cols).first()
    if not found["n"]:
        return None
    scale = np.array([found[f"s{i}"] for i in range(N_STATS)], float)
    waves = Waves(np.array([found[f"m{i}"] for i in range(N_STATS)], float), np.where(scale > 1e-6, scale, 1.0))
    sums = normal_equations(base, waves)
    penalty = np.full(len(sums), RIDGE)
    penalty[0] = 1e-6
    model = Model(waves, np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def bins(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"bin": np.round(model.raw(np.array(b["stats"].tolist(), dtype=float)) * 1000).astype(int), "y": b["y"].to_numpy(float)})

    binned = rows.where("calibrate").select("stats", "y").mapInPandas(bins, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    if got := sorted((r["bin"] / 1000, r["y"], r["n"]) for r in binned.collect()):
        model.at, model.value = pooled(*np.array(got).T)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = model.score(np.array(b["stats"].tolist(), dtype=float)) if model and len(b) else np.full(len(b), 0.5)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": got})

    return stats.mapInPandas(run, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(document_statistics(table(spark, sf_dir, "documents")), "stats")
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = labels.groupBy("doc_id").agg(F.avg("quality").alias("y"))
    fold = fold_of("doc_id", 5)
    rows = staged(stats.join(marks, "doc_id").where(fold != 0).select("stats", "y", (fold == 4).alias("calibrate")), "train")
    found = score(stats, fit(rows))
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
