"""Run a streaming query over what is there now, and read its result as a table."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session names for checkpoints; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="memengine-")
    return f"{base.rstrip('/')}/replay-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def stream_of(*frames: DataFrame) -> DataFrame:
    """Frames as a stream that reads them one after the other, a file a trigger."""
    spark = frames[0].sparkSession
    folder = shared_folder(spark)
    for frame in frames:  # files are read in the order in which they were written
        frame.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def replay(stream: DataFrame) -> DataFrame:
    """Rows that the query appends over all input that is there; state that waits for more is not in it."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
