"""Folders for tables that outlive a plan, where all executors see them, and how many parts a table is dealt to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that a part of a shuffle gets where AQE can't choose the number of parts.
PART_BYTES = 512 << 20


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of a local master, or for a cluster a folder of the
    warehouse, which is shared. One on the machine's own disk is refused."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="nearfield-")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")):
        raise ValueError(f"Set spark.checkpoint.dir to a folder that all executors see; the warehouse [{warehouse}] is on a machine's own disk")
    return warehouse + "/_nearfield"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/nearfield/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """The parts to deal df's rows to: what the session shuffles to, and more for an input that is large by its files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A plan of unknown size claims more than any input has.
    return max(least, -(-size // part_bytes)) if size < 1 << 60 else least
