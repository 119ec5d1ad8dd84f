"""Soft-membership mixing with DataFrame functions only.

1. A classifier learned from the labelled table (Bernoulli naive Bayes over the VOCABULARY most telling words and a few binned
   text statistics) gives each document a posterior q over domains.
2. Document rates r >= 0 are the minimum of one fixed least-squares objective

       F(r) = 1/2 (s - T)' M (s - T) + RIDGE/2 sum_i w_i (r_i - 1)^2,   s_k = sum_i w_i r_i q_ik,

   w_i: the document's share of all tokens; T: the targets; M: the (pseudo-)inverse of sum_i w_i q_i q_i', computed once, so a gap counts by how hard it is to
   close. It is found by projected gradient from r = y = 1, with the gradient taken by w_i, accelerated by momentum:

       r_i' = max(0, y_i - STEP (q_i' M (s(y) - T) + RIDGE (y_i - 1))),   y_i' = r_i' + b (r_i' - r_i).

   STEP = 1 / (1 + RIDGE) is the inverse of the gradient's Lipschitz constant, as the second moments weighted by M have no eigenvalue above 1; b grows by Nesterov's rule and starts
   anew at 0 when a step goes against the momentum. Each step is one distributed sum over narrow rows (posterior, tokens, r, y); a row's rate follows from its posterior and
   the steps so far, K + 1 numbers a step, so no rate is ever sent.
   The steps end when the projected gradient's norm, sqrt(sum_i w_i ((r_i' - y_i) / STEP)^2), is below CLOSE; after STEPS steps without that, an error is raised.

Defined cases: null text is empty, has no tokens and gets the rate of its posterior; very long texts are read whole; a label row with a null is ignored; several labels of a document count each; a domain
without labelled documents gets posterior 0 and its target is shared out among the others; without any label or token all rates are 1; repeated rows count each; columns named
mix_rate or mix_copies are replaced; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import body, staged, table

DOMAINS = ("plain", "low", "toxic")
TARGETS = {"plain": 0.94, "low": 0.05, "toxic": 0.01}
#: The classifier is fitted on about so many labelled documents at most, chosen by a hash of their id.
LABELLED, VOCABULARY = 20_000, 128
RIDGE, STEPS, CLOSE = 1e-4, 2000, 1e-5
STEP = 1 / (1 + RIDGE)
#: Steps between two writings of the rates.
WRITTEN = 8


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "plain").otherwise("low")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _share(part: Column, whole: Column, name: str, steps: int) -> Column:
    return F.concat(F.lit(f"#{name}"), F.least(F.lit(steps), F.round(part / F.greatest(whole, F.lit(1)) * steps).cast("int")).cast("string"))


def tokenised(docs: DataFrame) -> DataFrame:
    """row (all of the input), doc_id, n_tokens, tokens: the distinct words of the whole text and its binned statistics."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    rows = rows.select("row", "doc_id", "text", _words(F.col("text")).alias("words"))
    rows = rows.select("row", "doc_id", "text", F.size("words").alias("n_tokens"), F.array_distinct("words").alias("seen"))
    length = F.length("text")
    marks = length - F.length(F.regexp_replace("text", r"[*!|%$&#{}]+", ""))
    upper = length - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    extra = F.array(
        _share(marks, F.col("n_tokens"), "marks", 6), _share(upper, length, "upper", 8), _share(F.size("seen"), F.col("n_tokens"), "distinct", 8),
        F.concat(F.lit("#length"), F.least(F.lit(9), F.floor(F.log10(F.col("n_tokens") + F.lit(1.0)) * 2)).cast("string")),
    )
    return rows.select("row", "doc_id", "n_tokens", F.concat("seen", extra).alias("tokens"))


class Classifier:
    """words, and for each domain the log prior with all words absent and the gain of each word present."""

    def __init__(self, words: list[str], start: np.ndarray, gain: np.ndarray) -> None:
        self.words, self.start, self.gain = words, start, gain

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """rows (with tokens) and q_<domain>. Step by step, so that nothing is computed twice."""
        known = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        present = F.transform(F.array_intersect("tokens", known), lambda w: F.array_position(known, w).cast("int"))

        def log_of(start: float, gain: np.ndarray) -> Column:
            gains = F.array(*(F.lit(float(g)) for g in gain))
            return F.aggregate("present", F.lit(float(start)), lambda a, i: a + F.element_at(gains, i)) if len(gain) else F.lit(float(start))

        logs = [f"log_{d}" for d in DOMAINS]
        rows = rows.withColumn("present", present).drop("tokens").withColumns({c: log_of(*x) for c, x in zip(logs, zip(self.start, self.gain, strict=True), strict=True)})
        rows = rows.withColumn("top", F.greatest(*logs)).withColumns({f"mass_{d}": F.exp(F.col(c) - F.col("top")) for c, d in zip(logs, DOMAINS, strict=True)})
        rows = rows.withColumn("mass", reduce(lambda a, b: a + b, (F.col(f"mass_{d}") for d in DOMAINS)))
        return rows.withColumns({f"q_{d}": F.col(f"mass_{d}") / F.col("mass") for d in DOMAINS})


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """From a bounded sample of the labelled documents."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain().alias("domain"))
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30))
    sample = staged(marks.where(draw < int((1 << 30) * min(1.0, LABELLED / max(1, n)))), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # about LABELLED rows at most
    marked = staged(tokenised(rows).join(F.broadcast(sample), "doc_id").select("domain", "tokens"), "marked")
    sizes = {r["domain"]: r["n"] for r in marked.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return None
    counts = marked.select("domain", F.explode("tokens").alias("word")).groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS))
    # telling: the chi-square of presence against domain
    every = sum(F.col(d) for d in DOMAINS)
    chi = reduce(lambda a, b: a + b, (F.pow(F.col(d) - every * (sizes[d] / total), 2) / (every * (sizes[d] / total)) for d in DOMAINS if sizes.get(d)))
    best = counts.where(every >= 5).orderBy(F.desc(F.round(chi, 6)), "word").limit(VOCABULARY).collect()
    words = [r["word"] for r in best]
    share = np.array([[(r[d] + 0.5) / (sizes.get(d, 0) + 1.0) for r in best] for d in DOMAINS]).reshape(len(DOMAINS), len(words))
    share = np.clip(share, 1e-6, 1 - 1e-6)
    prior = np.log([max(sizes.get(d, 0), 1e-300) / total for d in DOMAINS])
    return Classifier(words, prior + np.log(1 - share).sum(axis=1), np.log(share) - np.log(1 - share))


def _folded(steps: list[list[float]], r: Column, y: Column) -> Column:
    """(r, y) of a row with posteriors q_<domain> after steps, each M (s - T) and b."""
    acc = F.struct(r.alias("r"), y.alias("y"))
    if not steps:
        return acc

    def one(at: Column, step: Column) -> Column:
        toward = sum((F.col(f"q_{d}") * step[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))
        new = F.greatest(F.lit(0.0), at["y"] * F.lit(1 - STEP * RIDGE) + F.lit(STEP * RIDGE) - F.lit(STEP) * toward)
        return F.struct(new.alias("r"), (new + step[len(DOMAINS)] * (new - at["r"])).alias("y"))

    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps)), acc, one)


def rate_of(steps: list[list[float]]) -> Column:
    """The rate of a row with posteriors q_<domain> after all steps."""
    return _folded(steps, F.lit(1.0), F.lit(1.0))["r"]


def fitted(rows: DataFrame, targets: dict[str, float]) -> list[list[float]]:
    """All steps to the minimum: M (s - T) and b of each. rows: q_<domain> and w (tokens)."""
    qs = [F.col(f"q_{d}") for d in DOMAINS]
    weigh = lambda c, name: F.coalesce(F.sum(F.col("w") * c), F.lit(0.0)).alias(name)
    pairs = [(i, j) for i in range(len(qs)) for j in range(i, len(qs))]
    moments = rows.agg(weigh(F.lit(1.0), "w"), *(weigh(q, f"m{k}") for k, q in enumerate(qs)), *(weigh(qs[i] * qs[j], f"f{i}{j}") for i, j in pairs)).first()
    total = moments["w"]
    if not total:
        return []
    before = at = np.array([moments[f"m{k}"] for k in range(len(qs))]) / total  # s(r), s(y)
    target = np.where(at > 0, [targets[d] for d in DOMAINS], 0.0)
    target = target / target.sum() if target.sum() else at
    second = np.zeros((len(qs), len(qs)))
    for i, j in pairs:
        second[i, j] = second[j, i] = moments[f"f{i}{j}"] / total
    metric = np.linalg.pinv(second, rcond=1e-12, hermitian=True)
    steps: list[list[float]] = []
    state, written, momentum = rows.select(*qs, "w", F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")).alias("at")), 0, 1.0
    for _ in range(STEPS):
        gradient = (metric @ (at - target)).tolist()
        now = state.withColumn("at", _folded(steps[written:], F.col("at.r"), F.col("at.y"))).withColumn("new", _folded([[*gradient, 0.0]], F.col("at.r"), F.col("at.y"))["r"])
        turn = (F.col("at.y") - F.col("new")) * (F.col("new") - F.col("at.r"))
        got = now.agg(*(weigh(F.col("new") * q, f"s{k}") for k, q in enumerate(qs)), weigh(F.pow((F.col("new") - F.col("at.y")) / F.lit(STEP), 2), "moved"), weigh(turn, "turn")).first()
        new = np.array([got[f"s{k}"] for k in range(len(qs))]) / total
        size = np.sqrt(got["moved"] / total)
        if size < CLOSE:
            return [*steps, [*gradient, 0.0]]
        if got["turn"] > 0:  # against the momentum
            b, momentum = 0.0, 1.0
        else:
            grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            b, momentum = (momentum - 1) / grown, grown
        steps.append([*gradient, float(b)])
        before, at = new, new + b * (new - before)
        if len(steps) - written == WRITTEN:
            state, written = staged(state.withColumn("at", _folded(steps[written:], F.col("at.r"), F.col("at.y"))), "rates"), len(steps)
    raise RuntimeError(f"rates did not settle in {STEPS} steps: the projected gradient is {size:.2g}, the limit {CLOSE:.2g}")


def posteriors(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """row (the whole input row), doc_id, n_tokens, q_<domain>; without a model all mass is in the first domain."""
    rows = tokenised(docs)
    rows = model.posteriors(rows) if model else rows.withColumns({f"q_{d}": F.lit(float(k == 0)) for k, d in enumerate(DOMAINS)})
    return rows.select("row", "doc_id", "n_tokens", *(f"q_{d}" for d in DOMAINS))


def _copies() -> Column:
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("rate") + draw)


def _steps(found: DataFrame, model: Classifier | None, targets: dict[str, float] | None) -> list[list[float]]:
    if not model:
        return []
    return fitted(staged(found.select(*(f"q_{d}" for d in DOMAINS), F.col("n_tokens").cast("double").alias("w")), "narrow"), targets or TARGETS)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, q_<domain>, rate, copies (the rate, rounded up or down by a hash of the id so that it holds on average)."""
    model = fit(docs, labels)
    found = staged(posteriors(docs, model).drop("row"), "posteriors")
    return found.withColumn("rate", rate_of(_steps(found, model, targets))).withColumn("copies", _copies())


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs, all rows and columns, and mix_rate and mix_copies. Rows are written once with their posteriors: texts are neither shuffled nor tokenised again."""
    docs = docs.drop("mix_rate", "mix_copies")
    model = fit(docs, labels)
    found = staged(posteriors(docs, model), "posteriors")
    steps = _steps(found, model, targets)
    return found.withColumn("rate", rate_of(steps)).select("row.*", F.col("rate").alias("mix_rate"), _copies().alias("mix_copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
