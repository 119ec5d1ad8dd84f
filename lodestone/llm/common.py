"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row keys up to this count (32 MB of longs) may be broadcast in a semi or anti join; beyond it the join shuffles.
BROADCAST_KEYS = 2_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Columns that `keyed` adds.
KEYS = ("_lodestone_key_1", "_lodestone_key_2")
#: At most so many keys are hot enough for a broadcast of their own.
HOT_KEYS = 100_000
#: Rows in one Arrow batch; whole texts can be 100 KB each.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only in local mode, a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    own = getattr(spark.sparkContext, "_lodestone_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, True)
        own = spark.sparkContext._lodestone_dir = f"file://{folder}"
    return own


_written: list = []


def _remove_written() -> None:
    """At the driver's exit, as results read staged tables lazily; what a stopped context or a lost driver leaves stays in the shared folder."""
    for context, path in _written:
        with contextlib.suppress(Py4JError):  # the JVM may have gone first
            if context._jsc is not None:
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors,
    and gives the planner real file sizes for its broadcast decisions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of this write again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark.sparkContext, path))
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker. Plans read the session's settings when they run,
    after the operator has returned, so the lower bounds stay set; they never rise."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def body(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEYS: 128 bits of doc_id and text (null as empty), so rows are told apart where ids repeat or are null. Rows equal in both share them."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), body()]
    return docs.withColumns({k: F.xxhash64(F.lit(k), *parts) for k in KEYS})


def by_keys(docs: DataFrame, keys: DataFrame, how: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """keyed docs left_semi or left_anti the rows of keys. keys is counted first: broadcast up to limit, else a shuffle join."""
    keys = staged(keys.select(*KEYS).distinct(), "keys")
    side = F.broadcast(keys) if keys.count() <= limit else keys
    return docs.join(side, list(KEYS), how)


def kept_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns. verdicts: KEYS and kept, a row for each row of docs; where rows equal in doc_id and text have different
    verdicts, or several of them are kept, one stays."""
    rows = keyed(docs)
    by_key = verdicts.groupBy(*KEYS).agg(F.bool_or("kept").alias("any"), F.bool_or(~F.col("kept")).alias("some_lost"), F.count(F.lit(1)).alias("n"))
    told = staged(by_key.where("some_lost or n > 1"), "verdicts")
    one = told.where("any")
    rest = by_keys(rows, told.where("not any"), "left_anti")
    if one.isEmpty():
        return rest.drop(*KEYS)
    again = by_keys(rest, one, "left_semi").dropDuplicates(list(KEYS))
    return by_keys(rest, one, "left_anti").unionByName(again).drop(*KEYS)


def met(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left join facts (one row a key, with its number of rows in the column size; non-null keys). The keys of more than total / HOT_KEYS
    rows, which are HOT_KEYS at most, are broadcast, so no task gets all rows of a hot key; the others meet in a shuffle."""
    most = max(1000, total // HOT_KEYS)
    hot = F.broadcast(staged(facts.where(F.col(size) > most).withColumn("_hot", F.lit(True)), "hot"))
    values = [c for c in facts.columns if c != key]
    marked = rows.join(hot, key, "left")
    settled = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *values).join(facts.where(F.col(size) <= most), key, "left")
    return settled.unionByName(rest)
