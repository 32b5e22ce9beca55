"""Tables laid out by a key in buckets, so that joins and aggregations on it need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import shared_dir

#: Bytes of a bucket that the number of buckets aims at, and rows of a file at most.
BUCKET_BYTES, FILE_ROWS = 256 << 20, 20_000_000


def buckets_for(size: int, least: int = 1) -> int:
    """A power of two, so that tables of other sizes have buckets that fall into each other."""
    return 1 << max(0, (max(least, -(-size // BUCKET_BYTES)) - 1).bit_length())


def bucketed(df: DataFrame, name: str, *keys: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` as the table ``name`` in buckets of ``keys``, sorted by them, each bucket written by one task in files of at most ``FILE_ROWS`` rows.

    The number of buckets follows the estimated size where it isn't given. The table's files lie at ``path``, by default in the shared folder.
    """
    spark = df.sparkSession
    if buckets is None:
        buckets = buckets_for(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()))
    rows = df.repartition(buckets, *keys)
    writer = rows.write.mode("overwrite").format("parquet").option("maxRecordsPerFile", FILE_ROWS).option("path", path or f"{shared_dir(spark)}/{name}")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


class co_partitioned:  # noqa: N801: reads as a phrase
    """While open, joins on more columns than the buckets' own may use the buckets: rows that agree on all columns agree on those."""

    _CONF = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.requireAllClusterKeysForDistribution", "spark.sql.sources.bucketing.autoBucketedScan.enabled")

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = {c: self.spark.conf.get(c) for c in self._CONF}
        for c in self._CONF:
            self.spark.conf.set(c, "false")

    def __exit__(self, *_: object) -> None:
        for c, v in self.before.items():
            self.spark.conf.set(c, v)


def exchanges(df: DataFrame) -> list[str]:
    """The exchanges of the plan that would run, broadcasts aside."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip(" :+-*()0123456789") for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


def file_rows(df: DataFrame) -> DataFrame:
    """Rows of each file of a table."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
