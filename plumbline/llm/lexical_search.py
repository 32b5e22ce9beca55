"""Ranked lexical search: the best documents for each query by TPUT over term-partitioned postings.

Every list of postings belongs to one term and is ordered by what a posting adds to a score, so lists lie in ranges of (term, contribution) and a frequent
term's list spreads over many files. The three phases run for all queries at once:

1. the heads, the k largest contributions of each list, are added up; the k-th best partial sum of a query is its first lower bound;
2. a query with t lists takes from each of them every posting that adds at least bound / t; the k-th best sum of what was taken is the second bound, and a
   document is out whose sum can't reach that with less than bound / t, and no more than the list's head, from each list it wasn't found in;
3. exact scores of the documents left are looked up in all lists of the query.

A term is a maximal run of ASCII letters, digits and other characters beyond ASCII, with only A-Z lowered. Postings are kept for terms that some query has;
a bitmap of fixed size sifts words while texts are read, and a join on the terms themselves decides. Scores are 64-bit integers throughout.

A null text has no terms, and neither does one of blanks and signs. Query rows that repeat count once; texts of one query id make one query together, and so do
those of a null id. Documents that repeat are each ranked; of equal scores the least id comes first, a null id last. Empty tables give an empty
result. Other columns are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from plumbline.llm.frames import exchange_partitions, joined, sliced, written
from plumbline.llm.words import LOWER, Words, in_word, mixed

#: Documents that each query gets.
BEST = 10
#: Bits of the bitmap of query terms, as a power of two; its size doesn't depend on the queries.
SIEVE_BITS = 23
# Fixed values of the score: saturation and length weight in hundredths, and the scale of a contribution.
_LENGTH, _SCALE = 75, 1_000_000_000
#: The ASCII bytes that end a term.
_ENDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_SLICE = 1 << 22
#: Documents of a block as a power of two, queries that are added up at once, and lists of the queries that go out together.
_BLOCK_BITS, _QUERIES, _LISTS = 13, 256, 1 << 17


def _place(hashes: np.ndarray) -> np.ndarray:
    """Each word's bit of the sieve."""
    return mixed(hashes.copy()) >> np.uint64(64 - SIEVE_BITS)


def _spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The bytes of the words ``at``."""
    size = words.end[at] - words.start[at]
    bound = np.concatenate([[0], np.cumsum(size)])
    data = words.data[np.repeat(words.start[at] - bound[:-1], size) + np.arange(bound[-1])]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(data.tobytes())])


def _counted(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word of each row among ``keep``, and how often it occurs there."""
    row, hashes = words.row()[keep], words.hashes()[keep]
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(row[order]) != 0) | (np.diff(hashes[order]) != 0)
    first = np.flatnonzero(new)
    return keep[order[first]], np.diff(np.append(first, len(order)))


def query_terms(queries: DataFrame, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``term`` and how often the query has it (``q``)."""
    kind = queries.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            words = Words(batch.column("text"), in_word(_ENDS), LOWER)
            at, q = _counted(words, np.arange(len(words)))
            ids = batch.column("item_id").take(pa.array(words.row()[at]))
            yield pa.RecordBatch.from_arrays([ids, _spelled(words, at), pa.array(q)], ["item_id", "term", "q"])

    rows = queries.select(F.col(query_id).alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(run, f"item_id {kind}, term binary, q long").groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def _sieve(terms: DataFrame) -> bytes:
    """The bitmap of all terms, joined from the parts of tasks; never larger than its fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SIEVE_BITS, bool)
        for batch in batches:
            terms = batch.column("term")
            words = Words(terms, np.ones(256, bool))
            bits[_place(words.hashes())] = True
        full = np.packbits(bits, bitorder="little").view(np.uint64)
        at = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(full[at].view(np.int64))], ["at", "bits"])

    found = terms.select("term").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()
    full = np.zeros((1 << SIEVE_BITS) // 64, np.int64)
    full[[r["at"] for r in found]] = [r["bits"] for r in found]
    return full.tobytes()


def _raw(docs: DataFrame, sieve: bytes, doc_id: str, text: str) -> DataFrame:
    """Postings of words that the sieve lets through, with a ``key`` for each row of documents; a row without a term has, for some documents together, how many have terms (``tf``) and how many terms (``n``)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(sieve)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").view(bool)
        begin = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text", _SLICE):
            words = Words(batch.column("text"), in_word(_ENDS), LOWER)
            at, tf = _counted(words, np.flatnonzero(bits[_place(words.hashes())]))
            row = words.row()[at]
            arrays = [_spelled(words, at), pa.array(begin + row), batch.column("doc_id").take(pa.array(row)), pa.array(tf), pa.array(words.count[row])]
            totals = [[None], [None], [None], [int((words.count > 0).sum())], [len(words)]]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, pa.array(t, a.type)]) for a, t in zip(arrays, totals, strict=True)], ["term", "key", "doc_id", "tf", "n"])
            begin += batch.num_rows

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"term binary, key long, doc_id {kind}, tf long, n long")


def postings(raw: DataFrame, terms: DataFrame) -> DataFrame:
    """``term``, ``key`` and ``s``, what the term adds to a score; written in ranges of (term, s)."""
    totals = raw.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = totals["docs"], max(totals["terms"], 1)
    raw = raw.where("term is not null")
    held_by = raw.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    m = F.lit(100 - _LENGTH).cast("long") + F.expr(f"({_LENGTH}L * n * {n_docs}L) div {n_terms}L")
    found = raw.join(written(held_by, "frequencies"), "term").withColumn("m", m)
    found = found.select("term", "key", (weight * F.expr(f"({_SCALE}L * tf) div (1000 * tf + 8 * m)")).alias("s")).where("s > 0")
    return written(found.repartitionByRange(exchange_partitions(raw.sparkSession), "term", F.col("s").desc()).sortWithinPartitions("term", F.col("s").desc()), "postings")


def _kth(sums: DataFrame, best: int) -> DataFrame:
    """The ``best``-th largest ``sum`` of each query, 0 where it has fewer."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("sum").desc()))
    return sums.withColumn("rank", rank).where(F.col("rank") <= best).groupBy("item_id").agg(F.when(F.count(F.lit(1)) >= best, F.min("sum")).otherwise(0).alias("bound"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block as one table; rows come in the order of their blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and part.num_rows and held[-1].column("block")[0] != part.column("block")[0]:
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _fetched(index: DataFrame, wanted: list[Row], item_type: DataType, best: int) -> DataFrame:
    """The candidates (``item_id``, ``key``) of each query of ``wanted``, its lists with their thresholds.

    Postings travel once, not once for each query, to the block of documents that they belong to; there each list's part at or over a query's
    threshold is added up. The best sums of each task give the query's second bound. What is sent on then are documents whose sum reaches that bound together
    with what each list that they weren't found in may hold at most: less than the threshold, and no more than its head.
    """
    spark = index.sparkSession
    items = sorted({r["item_id"] for r in wanted}, key=lambda i: (i is not None, i))
    number = {i: k for k, i in enumerate(items)}
    spelled = sorted({bytes(r["term"]) for r in wanted})
    of_term: list[list[tuple[int, int, int]]] = [[] for _ in spelled]
    at = {t: k for k, t in enumerate(spelled)}
    # Of each query: its lists, its first bound, and the most that all lists may hold below their thresholds; the last times lists, so that nothing is rounded.
    lists, bound, below = (np.zeros(len(items), np.int64) for _ in range(3))
    for r in wanted:
        i = number[r["item_id"]]
        of_term[at[bytes(r["term"])]].append((i, r["q"], r["least"]))
        lists[i], bound[i] = r["lists"], r["bound"]
        below[i] += min(r["bound"], r["q"] * r["head"] * r["lists"])
    least = spark.createDataFrame([(t, min(x[2] for x in of_term[k])) for t, k in at.items()], "term binary, any long")
    held = spark.sparkContext.broadcast((spelled, of_term))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """A query's number, documents, sums and in how many lists they were found, block by block."""
        names, wants = held.value
        values = pa.array(names, pa.binary())
        for block in _whole_blocks(batches):
            term = pc.index_in(block["term"].combine_chunks(), values).to_numpy()
            keys, doc = np.unique(block["key"].to_numpy(), return_inverse=True)
            s = block["s"].to_numpy()
            order = np.lexsort((-s, term))
            term, doc, s = term[order], doc[order], s[order]
            present, begin = np.unique(term, return_index=True)
            slices = list(zip(present.tolist(), begin.tolist(), [*begin[1:].tolist(), len(term)], strict=True))
            for low in range(0, len(lists), _QUERIES):
                high = min(low + _QUERIES, len(lists))
                total, found = np.zeros((high - low, len(keys)), np.int64), np.zeros((high - low, len(keys)), np.int32)
                for t, a, b in slices:
                    for item, q, threshold in wants[t]:
                        if low <= item < high:
                            k = a + int(np.searchsorted(-s[a:b], -threshold, "right"))
                            total[item - low, doc[a:k]] += q * s[a:k]
                            found[item - low, doc[a:k]] += 1
                for i in range(high - low):
                    some = np.flatnonzero(found[i])
                    if len(some):
                        yield low + i, keys[some], total[i, some], found[i, some].astype(np.int64)

    def best_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(lists), best), np.int64)
        for item, _, sums, _ in added(batches):
            top[item] = np.sort(np.concatenate([top[item], sums]))[-best:]
        item, _ = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(top[top > 0])], ["item_id", "sum"])

    taken = index.join(least, "term").where(F.col("s") >= F.col("any")).select("term", "key", "s", F.shiftright("key", _BLOCK_BITS).alias("block"))
    dealt = taken.repartition(exchange_partitions(spark), "block").sortWithinPartitions("block")
    # One number for each query.
    second = np.zeros(len(items), np.int64)
    for r in _kth(dealt.mapInArrow(best_sums, "item_id long, sum long"), best).collect():
        second[r["item_id"]] = r["bound"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, keys, sums, found in added(batches):
            may = keys[sums * lists[item] + below[item] - found * bound[item] >= second[item] * lists[item]]
            if len(may):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(may), item)), pa.array(may)], ["number", "key"])

    schema = StructType([StructField("number", LongType()), StructField("item_id", item_type)])
    names = spark.createDataFrame([(k, i) for i, k in number.items()], schema)
    return dealt.mapInArrow(candidates, "number long, key long").join(names, "number").drop("number")


def search(docs: DataFrame, queries: DataFrame, best: int = BEST, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of the ``best`` documents of each query that score above 0."""
    terms = written(query_terms(queries, query_id, query_text), "query_terms")
    raw = written(_raw(docs, _sieve(terms), doc_id, text), "raw_postings")
    index = postings(raw, terms)

    # 1. Heads. The limit on the rank works in each task before the exchange, so a long list sends few rows.
    at_head = F.row_number().over(Window.partitionBy("term").orderBy(F.col("s").desc(), "key"))
    heads = written(index.withColumn("at", at_head).where(F.col("at") <= best).drop("at"), "heads")
    # A list without postings asks for nothing.
    terms = written(terms.join(heads.groupBy("term").agg(F.max("s").alias("head")), "term"), "lists")
    sums = heads.join(terms, "term").groupBy("item_id", "key").agg(F.sum(F.col("q") * F.col("s")).alias("sum"))
    lists = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("lists"))
    bounded = joined(lists, _kth(sums, best), ["item_id"], "left").select("item_id", "lists", F.coalesce("bound", F.lit(0)).alias("bound"))
    # A posting is taken if q * s * lists reaches the bound, so nothing is rounded.
    wanted = joined(terms, bounded, ["item_id"]).withColumn("least", F.expr("(bound + q * lists - 1) div (q * lists)"))

    # 2. What reaches the thresholds, for blocks of queries.
    blocked = written(wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-terms.count() // _LISTS)))).cast("int")), "wanted")
    left = None
    for block in range(max(1, -(-terms.count() // _LISTS))):
        found = _fetched(index, blocked.where(F.col("block") == block).collect(), blocked.schema["item_id"].dataType, best)
        left = found if left is None else left.unionByName(found)
    left = written(left, "candidates")

    # 3. Exact scores.
    looked = joined(left, terms, ["item_id"]).join(index, ["term", "key"])
    scores = written(looked.groupBy("item_id", "key").agg(F.sum(F.col("q") * F.col("s")).alias("score")), "scores")
    names = raw.where("term is not null").select("key", "doc_id").join(scores.select("key").distinct(), "key", "left_semi").distinct()
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key")
    return scores.join(names, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
