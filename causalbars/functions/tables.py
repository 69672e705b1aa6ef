"""Tables written once and read several times."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: ``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``, which outlives lost
    executors; the folder's owner removes it. Only a local session may leave that setting unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="causalbars-tables-")).as_uri()
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/causalbars-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
