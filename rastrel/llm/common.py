"""Helpers that the corpus operators share: reading tables, worker imports, reliable checkpoints."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the session has set.

    Only a session on one machine that names none gets a temporary folder; on a cluster that would
    be lost with its machine, so it is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there; its lineage ends, and lost executors cost nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def thin(rows: DataFrame, code: Column, keep: int, spare: int = 16) -> DataFrame:
    """About spare * keep rows of a table, or all if there are fewer, chosen by their hash alone.

    For fitting on a bounded sample: what is then sorted and sent to the driver stays small however
    many tasks read the table. rows should not be filtered yet, so that counting them reads no column.
    """
    step = max(1, rows.count() // (spare * keep))
    return rows.where(F.pmod(code, F.lit(step)) == 0) if step > 1 else rows


#: A key of more than 1 / HOT of all rows is hot; there are fewer than HOT of them.
HOT = 1000


def spread_join(rows: DataFrame, named: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with named, which has one row for each key and in weight how many of the total rows have it.

    Hot keys, fewer than HOT whatever the data, are broadcast, so that their rows stay where they are; the others
    are joined by shuffle, where none fills a task. named should be checkpointed, as it is read three times.
    """
    hot = F.col(weight) * HOT > F.lit(total)
    light, few = named.where(~hot).drop(weight), named.where(hot).drop(weight)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def release() -> None:
    """Give memory that this Python worker no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
