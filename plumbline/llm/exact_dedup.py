"""Exact duplicates by salted digest groups, comparing whole contents where copies meet.

Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts
the row with the largest id stays. Spark's partial aggregation removes copies inside each task, the
salted groups merge what is left of a hot text in several tasks, and the last groups hold one row
for each salt at most. Both aggregations group by the text itself, not by its digest alone.

What a group found goes back to its salt winners first, then from each to the rows of its salt, so a hot text's rows
stay spread. Rows on that way are told by SHA-256, length and a second hash of 64 bits, since comparing contents
there would ship every text twice more.

Nulls: a null id is smaller than any other; where a group has only null ids, one row stays. Repeated
rows (same id, same text): one of them stays, and the others of that id are dropped. An empty table gives an empty
result. Of other columns ``deduplicated`` keeps all, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sub-groups that a hot text is spread over before its winners meet; at most 31.
SALTS = 16


def normalised(text: str) -> Column:
    return F.coalesce(F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def _identity(body: Column) -> Column:
    """What stands for a whole text on the way back to its rows: digest, length and a second hash."""
    return F.struct(F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("length"), F.xxhash64(body).alias("check"))


def _salt(id_: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(salts)).cast("int")


def winners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: ``identity``, ``keep_id``, ``group_size`` and the bits of its ``salts``."""
    rows = docs.select(F.col(doc_id).alias("id"), normalised(text).alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("salt", _salt(F.col("id"), salts))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"))
    return merged.select(_identity(F.col("body")).alias("identity"), "keep_id", "group_size", "salts")


def membership(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row, dropped ones too: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Repeated rows travel as one with their number, and come apart again at the end.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), _identity(normalised(text)).alias("identity"))
    rows = rows.groupBy("identity", "doc_id").agg(F.count(F.lit(1)).alias("repeats")).withColumn("salt", _salt(F.col("doc_id"), salts))
    each = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit("salts", s) == 1)
    found = winners(docs, doc_id, text, salts).select("identity", "keep_id", "group_size", F.explode(each).alias("salt"))
    joined = rows.join(found, ["identity", "salt"]).withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("identity.digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns whatever those are called.

    Rows move once, by text and id, so that copies of a hot text meet in as many tasks as they have ids; of repeated rows
    each task sends on one.
    """
    key = lambda identity, id_: F.struct(identity.alias("identity"), F.coalesce(id_.cast("string"), F.lit("")).alias("id"), id_.isNull().alias("no_id"))
    rows = docs.select(F.struct("*").alias("row"), key(_identity(normalised(text)), F.col(doc_id)).alias("key"))
    stay = winners(docs, doc_id, text, salts).select(key(F.col("identity"), F.col("keep_id")).alias("key"))
    return rows.groupBy("key").agg(F.first("row").alias("row")).join(stay, "key", "left_semi").select("row.*")
