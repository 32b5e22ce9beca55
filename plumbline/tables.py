"""Intermediate tables, which cut a plan's lineage: a lost executor costs its tasks, not what came before."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, one beside the warehouse's tables, or, with a single machine, one of its own.

    On a cluster whose warehouse lies on a local path there is no shared folder to find, and each executor would write to its own disk: that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    single = context.master == "local" or context.master.startswith("local[")
    if single:
        return _own_dir(context.applicationId)
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")):
        raise RuntimeError(f"the warehouse {warehouse} is a local path; set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_intermediate"


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` where nulls equal each other; the left side's keys stay."""
    if not keys:
        return left.join(right, how=how) if how in ("inner", "left") else left.join(right, F.lit(True), how)
    right = right.withColumnsRenamed({k: f"{k} right" for k in keys})
    found = left.join(right, reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k} right")) for k in keys]), how)
    return found if how in ("left_semi", "left_anti") else found.drop(*[f"{k} right" for k in keys])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, name: str, old: DataFrame) -> DataFrame:
    """``df``, written, in place of an earlier table that it was made from, which goes."""
    new = written(df, name)
    for folder in {f.rpartition("/")[0] for f in old.inputFiles()}:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return new
