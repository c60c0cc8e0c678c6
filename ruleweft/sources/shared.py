"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary folder, which goes
    when Python exits. What is written below it stays until its owner removes it; Spark drops checkpoints that nothing
    refers to if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return str(sc._jsc.sc().getCheckpointDir().get())
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ruleweft-")
        atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{base_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; what reads it sees the same rows even after an executor
    is lost."""
    base_folder(df.sparkSession)
    return df.checkpoint()
