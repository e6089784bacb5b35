"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine a temporary folder where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """A small input that comes in fewer splits than there are cores is dealt out over these; a large one stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def bounded_batches(spark: SparkSession) -> None:
    """1024 rows in an Arrow batch at most, from now on in this session: that bounds the texts a worker holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1024:
        spark.conf.set(key, "1024")


def materialized(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/quillmark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
