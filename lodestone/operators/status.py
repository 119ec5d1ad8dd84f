"""Progress over weighted phases, and the state of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States from the most to the least urgent.
STATES = ["busy", "refreshing", "scanning", "updating", "completing", "querying", "idle"]


def progress(phases: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `percent`: 100 times the sum of weight * done / total over a key's phases (weight, done, total), weights scaled to add to one; done beyond total counts as total.

    A total of zero or null, or a null done, is a phase not begun; weights that add to zero give 0."""
    part = F.when(F.col("total") > 0, F.greatest(F.least(F.coalesce("done", F.lit(0)) / F.col("total"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    whole = F.sum("weight")
    return phases.groupBy(*keys).agg(F.when(whole > 0, F.round(100 * F.sum(F.col("weight") * part) / whole)).otherwise(0.0).alias("percent"))


def state(active: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `state`: the most urgent state that a key has with n > 0, else idle. active: (state, n)."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    best = F.min(F.when((F.col("n") > 0) & (rank > 0), rank))
    return active.groupBy(*keys).agg(F.coalesce(F.element_at(F.array(*map(F.lit, STATES)), best.cast("int")), F.lit("idle")).alias("state"))
