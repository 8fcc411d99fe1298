"""Lineage that ends in the folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as it is dealt and sorted, written once to the folder that ``spark.checkpoint.dir`` names.

    Reading keeps partitions and their order, also where an executor is lost. A session on this machine alone that names no
    folder gets a temporary one; on a cluster that is an error, as executors could not see it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        if not named:
            named = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()
