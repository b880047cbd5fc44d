"""Session helpers shared by every operator: table access, checkpoints, spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory; nothing is read before an action."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, local runs) a temporary folder is
    made, since a machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tallyweave-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can read and write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cluster when it has fewer splits than there are cores.

    A large table already has many splits and passes unchanged, so no shuffle is
    paid at scale; a table of one small file would keep all but one core idle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def tokenizer_dir() -> str:
    """Folder of the public tokenizers; ``TALLYWEAVE_TOKENIZERS`` overrides it."""
    return os.environ.get("TALLYWEAVE_TOKENIZERS", "/opt/tokenizers")
