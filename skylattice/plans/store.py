"""Tables in the shared folder that cut the lineage of iterative plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows, counted first, is broadcast; a larger one is merged.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all work is done on this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skylattice-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, label: str = "side", rows: int | None = None) -> DataFrame:
    """``small``, to be broadcast if it is small and merged otherwise; without ``rows`` it is written and counted first."""
    if rows is None:
        small = stored(small, label)
        rows = small.count()
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")
