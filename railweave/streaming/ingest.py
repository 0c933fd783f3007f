"""Incremental document load and helpers to run a stream over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from railweave.sources.tables import append_missing


def read_stream(spark: SparkSession, path: str, schema: StructType, max_bytes: int = 1 << 30, pattern: str | None = None) -> DataFrame:
    """Parquet files as a stream; a micro-batch takes ``max_bytes`` at most, so a
    backlog is worked off in pieces."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def stream_table(spark: SparkSession, path: str, schema: StructType, max_bytes: int = 1 << 30) -> DataFrame:
    """One Parquet table as a stream, whether it is a file or a folder of files.

    A stream reads a folder or what a pattern matches, so the path is made a pattern that only it matches.
    """
    return read_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, max_bytes)


def stream_documents(documents: DataFrame, root: str, checkpoint: str):
    """Appends new documents to the collections. A restarted batch finds its rows
    stored already, so nothing is written twice."""
    def load(batch: DataFrame, _: int) -> None:
        append_missing(batch, root)

    return (documents.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there and stops."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
