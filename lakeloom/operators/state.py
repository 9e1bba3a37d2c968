"""Cutting lineage in iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the folder that the cluster names in ``spark.checkpoint.dir``.

    A local master without that setting gets a folder of its own; elsewhere the setting is required.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir")
        if found is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if found is None:
            found = tempfile.mkdtemp(prefix="lakeloom-checkpoint-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return df.checkpoint()
