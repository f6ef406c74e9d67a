"""Results written to the shared folder, so that iterations don't grow their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

LOCAL_SHARED = "file:///tmp/checkpoints/loomset"


def cut(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(shared or LOCAL_SHARED).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
