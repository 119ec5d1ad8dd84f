"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder (spark.checkpoint.dir; only in local mode an own one)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="lodestone-rounds-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
