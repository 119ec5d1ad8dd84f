"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Three combining steps, each of which groups by the digest AND the full text, so equal digests never
suffice: (1) each map task collapses its own copies (partial aggregation), (2) the survivors meet in
groups salted by their partition, (3) the salt winners meet globally. A text held by a third of all
rows reaches step 2 as one row a map task and step 3 as at most SALTS rows.

Rows then get their group's winner by digest, which moves ids and digests, not texts; the digests of large groups are
broadcast, so no task gets all copies of a text. Should two texts share a digest, the rows of that digest are matched by full text instead.

Defined cases: null text counts as empty; empty texts equal each other; very long texts are compared whole; of rows that share both doc_id and
text all have the same result row, and keep_one keeps one; a doc_id with several texts is a row of each group; a null doc_id never wins against a
number, and of a group with null ids only keep_one keeps one row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import KEYS, body, kept_rows, keyed, met, staged

SALTS = 64


def _hashed(docs: DataFrame) -> DataFrame:
    return keyed(docs).select(*KEYS, F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).select(*KEYS, "doc_id", "body", F.unhex(F.sha2("body", 256)).alias("sha"))


def combined(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(sha, body, keep_id, group_size): one row per distinct text."""
    local = _hashed(docs).withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("sha", "salt", "body").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("sha", "body").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, salts: int = SALTS, keys: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; with its KEYS if asked for."""
    winners = staged(combined(docs, salts).select("sha", "keep_id", "group_size"), "exact")
    rows = _hashed(docs).drop("body")
    total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    shared = winners.groupBy("sha").count().where("count > 1").select("sha")
    if shared.isEmpty():
        found = met(rows, winners, "sha", "group_size", total)
    else:  # different texts of one digest: these few are told apart by their texts
        clear = winners.join(shared, "sha", "left_anti")
        texts = combined(docs, salts).join(shared, "sha", "left_semi")
        found = met(rows.join(shared, "sha", "left_anti"), clear, "sha", "group_size", total).unionByName(_hashed(docs).join(texts, ["sha", "body"]).drop("body"))
    own = (*KEYS, "doc_id") if keys else ("doc_id",)
    return found.select(*own, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, all columns; of rows equal in doc_id and text one stays."""
    return kept_rows(docs, exact_groups(docs, salts, True).where("group_size > 1"))
