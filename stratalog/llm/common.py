"""Helpers that the operators of this package share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of two numbers that may be broadcast, some 100 bytes each.
MAX_BROADCAST_ROWS = 1_000_000


def fresh(name: str, *taken: DataFrame) -> str:
    """name, or name with more underscores before it, that no frame has as a column."""
    known = {c.lower() for df in taken for c in df.columns}
    while name.lower() in known:
        name = "_" + name
    return name


def join_hot(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined to facts, which has one row for each key, without a task that gets a hot key.

    A key that holds more rows than a task's even share is joined by broadcast, where its rows
    lie; there are fewer such keys than tasks. The others are shuffled. rows is read twice, so
    it should be durable; counts, if known, has (key, n).
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    share = rows.count() // tasks + 1
    found = counts.where((F.col("n") > share) & F.col(key).isNotNull()).select(key).collect()
    if not found:
        return rows.join(facts, key, how)
    hot = F.broadcast(spark.createDataFrame(found, rows.select(key).schema))
    own = rows.join(hot, key, "left_semi").join(F.broadcast(facts.join(hot, key, "left_semi")), key, how)
    return own.unionByName(rows.join(hot, key, "left_anti").join(facts, key, how))


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], names: list[str], how: str = "left_anti") -> DataFrame:
    """docs without the rows whose keys, in this order, stand in gone's columns `names`, nulls
    alike; or with how="left_semi" those rows only. gone is broadcast up to MAX_BROADCAST_ROWS
    rows, so docs stay where they are; beyond it both sides are shuffled."""
    gone = durable(gone)
    small = gone.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    alike = F.lit(True)
    for key, name in zip(keys, names):
        alike = alike & key.eqNullSafe(gone[name])
    return docs.join(F.broadcast(gone) if small else gone, alike, how)


#: Bytes that go to Python at once where the session doesn't set them, so that long texts don't
#: add up; and the setting.
BATCH_BYTES, BATCH_SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def spread(df: DataFrame) -> DataFrame:
    """df for a Python operator, in batches of bounded size, on all cores: rows are dealt anew only if df reads fewer splits than there are
    cores, as a small table of one file does. Other frames stay as they are: a large table,
    and one with a shuffle, whose partitions can't be counted without running it."""
    df.sparkSession.conf.set(BATCH_SETTING, df.sparkSession.conf.get(BATCH_SETTING, BATCH_BYTES))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    nodes = re.findall(r"(?m)^[ :+-]*(?:\*\(\d+\) )?(\w+)", plan)
    if not {"Project", "Filter", "FileScan", "Scan", "BatchScan"}.issuperset(nodes):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII texts take the fast built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
