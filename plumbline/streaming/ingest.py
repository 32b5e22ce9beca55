"""Incremental ingest: files that arrived since the last run, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_new_files(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append what ``source`` has got since the last call to the Parquet folder ``table``, then stop.

    The checkpoint remembers the files that are done, so a run that fails goes on where it broke off.
    """
    rows: DataFrame = spark.readStream.schema(schema).parquet(source)
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    query = (writer.partitionBy(partition) if partition else writer).start()
    query.awaitTermination()
    return query
