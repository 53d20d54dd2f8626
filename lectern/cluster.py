"""Session helpers that behave alike on a laptop and on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, put to use.  Where that setting is absent, a local session makes a folder of its own; on a cluster, whose
    executors would not share it, that is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        shared = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later stages neither recompute it nor need the executors that made it.

    The result keeps its partitions and their order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a table written below the shared checkpoint folder: compressed, and read by column, but in partitions of the reader's choice.

    The table stays as long as the folder does, which belongs to the session."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(width: int, *cols: str):
    """A bucket in [0, width) that depends on the row's values alone, so it is the same when a lost task runs again."""
    return F.pmod(F.xxhash64(*cols), F.lit(width)).cast("int")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
