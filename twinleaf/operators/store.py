"""Intermediate tables in the shared folder, so that what is dear to make is made once and lost executors cost no recomputation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read again.

    Where that is unset a local folder serves, but only if all of Spark runs in this one process.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'twinleaf-checkpoints')}"
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
