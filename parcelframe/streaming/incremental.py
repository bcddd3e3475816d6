"""Grouped operators on a file stream.

The source system has no streaming; nothing here adds operator semantics.
Because the KPI and group-by operators are plain DataFrame code, they run
unchanged on a streaming DataFrame: new shipment files dropped into a
folder update the aggregates incrementally (complete output mode, state in
the checkpoint location).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir


def read_shipment_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream Parquet shipment files from ``path`` with the schema of the files already there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def start_grouped(op: Callable[[DataFrame], DataFrame], stream: DataFrame, name: str,
                  sink: str = "memory", checkpoint: str | None = None) -> StreamingQuery:
    """Start ``op(stream)`` in complete mode; state is kept under the checkpoint location."""
    spark = stream.sparkSession
    loc = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    return (op(stream).writeStream.outputMode("complete").format(sink).queryName(name)
            .option("checkpointLocation", loc).start())
