"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the session's checkpoint folder and read back: computed once, its lineage cut. A folder of
    the machine is taken only where none is named, and only for a session of one process, whose tasks share the driver's disk."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:/tmp/checkpoints"
    path = f"{folder.rstrip('/')}/veriframe/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
