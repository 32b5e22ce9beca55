"""Language-model scores of whole documents.

A-Z are lower-cased; tokens are runs of other than ASCII white space, then one end. Exact counts of all
training tokens are summed over the corpus. The ``VOCABULARY`` most frequent words, the end and one
stand-in for all others are what a gated recurrent network (``gru.py``) predicts; a word behind the
stand-in has the probability of its count among those words, plus one, with one more place for all
unseen ones.

1.  Counts of words are summed in blocks of their 64-bit hashes; those of the most frequent, at most ``SHARED``, go to all tasks.
2.  Texts become rows of slices: their documents' word numbers, and the hashes of words that not all tasks know.
    No text is read again.
3.  The network trains on every training document once, in ``ROUNDS`` rounds. A round's documents are dealt by a
    hash of id and text to blocks of about ``BLOCK`` tokens; each block trains from the mean of all blocks' weights
    after the round before, on its documents in the order of that hash. So the weights don't depend on how rows lie.
4.  A slice asks the blocks of counts for its other words, and scores its documents with the answers.

A null text counts as empty: one end token. Without training documents all counts are 0 and the network stays
as it began; an empty table gives an empty result. Repeated rows are scored alike and train as often as they are
there, in one block; ids may be null. Words of equal count are ordered by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import gru
from plumbline.llm.frames import exchange_partitions, one_blas_thread, sliced, written
from plumbline.llm.words import LOWER, SPACE, Words, in_word, mixed

VOCABULARY = 64 * gru.CLASS - 2
SHARED = 1 << 17
#: Rounds of training, and the tokens of a block.
ROUNDS, BLOCK = 4, 1 << 19
#: Weights that one task averages.
FAN_IN = 32
#: Bytes of a row's texts, rows of a slice, and tokens that train side by side at most.
_SLICE, _ROWS, _GROUP = 8 << 20, 4, 2_000_000
#: Counts in a row of a block.
_ROW = 1 << 20
_WORD_BYTE = in_word(SPACE)
_OTHER, _END = 0, 1
_LOG10 = np.log(10)


def _routed(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the hashes by block, and where each block begins in it."""
    block = mixed(hashes) % np.uint64(blocks)
    order = np.argsort(block.astype(np.int32), kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``block``, ``words`` (hashes, sorted within the block) and ``counts`` of all distinct words; blocks are those of ``_routed``."""
    blocks = exchange_partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, _SLICE):
            word, n = np.unique(Words(batch.column(text), _WORD_BYTE, LOWER).hashes(), return_counts=True)
            order, edge = _routed(word, blocks)
            word, n = word[order], n[order].astype("<i8")
            yield _binaries({"block": np.flatnonzero(np.diff(edge))}, words=(word, edge), counts=(n, edge))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, counts, size, known = None, [], [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, of = np.unique(np.concatenate(words), return_inverse=True)
            n = np.zeros(len(word), np.int64)
            np.add.at(n, of, np.concatenate(counts))
            return word, n

        for batch in batches:
            for b, w, n in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                block = b
                words.append(np.frombuffer(w, "<u8"))
                counts.append(np.frombuffer(n, "<i8"))
                size += len(words[-1])
                if size > 2 * known + _ROW:  # what is held stays in proportion to the distinct words
                    word, n = merged()
                    words, counts, size, known = [word], [n], len(word), len(word)
        if words:
            word, n = merged()
            for i in range(0, len(word), _ROW):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x[i : i + _ROW].tobytes()], pa.binary()) for x in (word, n))], ["block", "words", "counts"])

    schema = "block int, words binary, counts binary"
    return docs.select(text).mapInArrow(count, schema).repartitionById(blocks, "block").mapInArrow(total, schema)


def _binaries(plain: dict[str, np.ndarray], **packed: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """One row for each of the blocks that ``plain["block"]`` numbers: its part of every packed array, between the block's edges."""
    which = plain["block"]
    columns = [pa.array(v.astype(np.int32 if k == "block" else np.int64)) for k, v in plain.items()]
    columns += [pa.array([values[edge[b] : edge[b + 1]].tobytes() for b in which], pa.binary()) for values, edge in packed.values()]
    return pa.RecordBatch.from_arrays(columns, [*plain, *packed])


def _octave(n: np.ndarray) -> np.ndarray:
    """Counts in steps of a 64th of an octave; small ones each have a step of their own."""
    return np.floor(np.log2(n) * 64).astype(np.int32)


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """At most ``SHARED`` of the most frequent words with their counts, in order, the number of all words, and of all distinct ones.

    A histogram of counts, of a few thousand rows at most, tells from which step on all words of a step fit. Of the step that doesn't fit, the words of
    least hash take the places that are left, so equal counts, however many, fill the vocabulary all the same.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                n = np.frombuffer(data, "<i8")
                step, of = np.unique(_octave(n), return_inverse=True)
                words, total = np.bincount(of), np.zeros(len(step), np.int64)
                np.add.at(total, of, n)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(words.astype(np.int64)), pa.array(total)], ["step", "words", "total"])

    found = counts.select("counts").mapInArrow(steps, "step int, words long, total long").groupBy("step").agg(F.sum("words").alias("words"), F.sum("total").alias("total")).collect()
    edge, room, kept, limit = -1, 0, 0, 0  # a step, its places, and the greatest hash that may take one
    for r in sorted(found, key=lambda r: -r["step"]):
        if kept + r["words"] > SHARED:
            edge, room = r["step"], SHARED - kept
            limit = min((1 << 64) - 1, int((1.1 * room + 64) / r["words"] * 2.0**64))
            break
        kept += r["words"]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(*(batch.column(c).to_pylist() for c in ("words", "counts")), strict=True):
                word, n = np.frombuffer(w, "<i8"), np.frombuffer(n, "<i8")
                step = _octave(n)
                some = (step > edge) | ((step == edge) & (word.view(np.uint64) <= np.uint64(limit)))
                yield pa.RecordBatch.from_arrays([pa.array(word[some]), pa.array(n[some])], ["word", "n"])

    total, distinct = (sum(r[c] for r in found) for c in ("total", "words"))
    top = counts.select("words", "counts").mapInArrow(chosen, "word long, n long").toPandas()
    word, n = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    at_edge = np.flatnonzero(_octave(n) == edge) if len(n) else np.zeros(0, np.int64)
    stays = np.ones(len(n), bool)
    stays[at_edge[np.argsort(word[at_edge].view(np.uint64), kind="stable")[room:]]] = False
    word, n = word[stays], n[stays]
    order = np.lexsort((word, -n))
    return word[order].view(np.uint64), n[order], total, distinct


class Known:
    """What all tasks know of words: counts of the most frequent ones, and which of those the network has."""

    def __init__(self, word: np.ndarray, n: np.ndarray, documents: int, total: int, distinct: int):
        """Words with counts, the most frequent first; totals over all words, without ends."""
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        place = np.empty(len(word), np.int64)
        place[order] = np.arange(len(word))
        self.number = np.full(len(word), _OTHER, np.int32)
        top = min(VOCABULARY, len(word))
        self.number[place[:top]] = np.arange(2, 2 + top)
        self.ends, self.tokens, self.distinct = documents, total + documents, distinct + (documents > 0)
        covered = int(n[:top].sum())
        self.counts = np.concatenate([[total - covered, documents], n[:top]])
        self.others = np.log10(max(1, total - covered + distinct - top + 1))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1 if not known here) and the network's numbers."""
        if not len(self.word):
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        known = self.word[at] == hashes
        return np.where(known, self.n[at], -1), np.where(known, self.number[at], _OTHER)


_SLICE_COLUMNS = ("places", "learnt", "lengths", "numbers", "known", "logs", "others", "rare", "rare_counts")


def _slices(source: DataFrame, known, kind: str) -> DataFrame:
    """One row or a few for each slice of documents: ``slice``, ``doc_ids``, and arrays over its documents or their words as binaries."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, task = known.value, TaskContext.get().partitionId()
        for nth, batch in enumerate(sliced(batches, "text", _SLICE)):
            words = Words(batch.column("text"), _WORD_BYTE, LOWER)
            hashes, of = np.unique(words.hashes(), return_inverse=True)
            count, number = know.look_up(hashes)
            log, number, count = np.log10(np.maximum(count, 0) + 1.0)[of], number[of], count[of]
            row, n = words.row(), batch.num_rows
            numbers = np.full(len(words) + n, _END, "<u2")
            numbers[np.arange(len(words)) + row] = number
            other, rare = number == _OTHER, count < 0
            arrays = (
                batch.column("place").to_numpy().astype("<i8"),
                batch.column("learnt").to_numpy(zero_copy_only=False).astype("u1"),
                (words.count + 1).astype("<i8"),
                numbers,
                np.bincount(row, count > 0, n).astype("<i8") + int(know.ends > 0),
                np.bincount(row, log, n) + np.log10(know.ends + 1.0),
                np.bincount(row[other], log[other] - know.others, n),
                hashes[of[rare]],
                np.bincount(row[rare], minlength=n).astype("<i8"),
            )
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | nth // _ROWS], pa.int64()), ids, *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], ["slice", "doc_ids", *_SLICE_COLUMNS])

    return source.mapInArrow(number, f"slice long, doc_ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _SLICE_COLUMNS))


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the members of runs."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _dealt(slices: DataFrame, k: int, blocks: int) -> DataFrame:
    """Rows of ``block``, ``places``, ``lengths`` and ``numbers``: the training documents of a round, each block in a partition of its own."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, learnt, lengths, numbers in zip(*(batch.column(c).to_pylist() for c in _SLICE_COLUMNS[:4]), strict=True):
                place, length = np.frombuffer(places, "<i8"), np.frombuffer(lengths, "<i8")
                spread = mixed(place.view(np.uint64))
                mine = np.flatnonzero((np.frombuffer(learnt, "u1") > 0) & (spread % np.uint64(ROUNDS) == k))
                block = ((spread[mine] >> np.uint64(8)) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                mine, edge = mine[order], np.searchsorted(block[order], np.arange(blocks + 1))
                of_words = np.concatenate([[0], np.cumsum(length[mine])])[edge]
                members = _expand((np.cumsum(length) - length)[mine], length[mine])
                yield _binaries(
                    {"block": np.flatnonzero(np.diff(edge))},
                    places=(place[mine], edge), lengths=(length[mine], edge), numbers=(np.frombuffer(numbers, "<u2")[members], of_words),
                )

    dealt = slices.select(*_SLICE_COLUMNS[:4]).mapInArrow(deal, "block int, places binary, lengths binary, numbers binary")
    return dealt.repartitionById(blocks, "block")


def _averaged(weights: DataFrame, blocks: int) -> tuple[np.ndarray | None, float]:
    """The mean of all blocks' weights by their tokens, in a tree of sums of at most ``FAN_IN`` in the order of blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, block = None, 0.0, None
        for batch in batches:
            for b, w, n in zip(*(batch.column(c).to_pylist() for c in ("block", "weights", "tokens")), strict=True):
                part = np.frombuffer(w, "<f4") * np.float64(n)
                total = part if total is None else total + part
                tokens, block = tokens + n, b
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block // FAN_IN], pa.int32()), pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary()), pa.array([tokens])], ["block", "weights", "tokens"])

    weights = written(weights, "weights")
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        part = weights.repartitionById(blocks, (F.col("block") / FAN_IN).cast("int")).sortWithinPartitions("block")
        weights = written(part.mapInArrow(add, weights.schema), "weights")
    row = weights.first()
    return (np.frombuffer(row["weights"], "<f4"), row["tokens"]) if row else (None, 0.0)


def train(slices: DataFrame, known, tokens: int) -> dict[str, np.ndarray]:
    """Weights of the network after ``ROUNDS`` rounds over the training documents, which have so many tokens."""
    spark, counts = slices.sparkSession, known.value.counts
    w, blocks = gru.initial(counts), max(1, -(-tokens // (ROUNDS * BLOCK)))
    for k in range(ROUNDS):
        begin = spark.sparkContext.broadcast(gru.flat(w))

        def learn(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            one_blas_thread()
            documents, block = [], None
            for batch in batches:
                for b, places, lengths, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "lengths", "numbers")), strict=True):
                    block = b
                    end = 2 * np.cumsum(np.frombuffer(lengths, "<i8"))
                    documents += [(p, numbers[e - n : e]) for p, e, n in zip(np.frombuffer(places, "<i8").tolist(), end.tolist(), np.diff(end, prepend=0).tolist(), strict=True)]
            if not documents:
                return
            documents.sort()
            trainer = gru.Trainer(gru.shaped(begin.value, gru.initial(known.value.counts)))
            size, held, trained = 0, [], 0
            for _, numbers in documents:
                held.append(np.frombuffer(numbers, "<u2"))
                size += len(held[-1])
                if size >= _GROUP:
                    trainer.documents(held, _END)
                    size, held, trained = 0, [], trained + size
            trainer.documents(held, _END)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([gru.flat(trainer.w).astype("<f4").tobytes()], pa.binary()), pa.array([float(trained + size)])], ["block", "weights", "tokens"])

        mean, learnt = _averaged(_dealt(slices, k, blocks).mapInArrow(learn, "block int, weights binary, tokens double"), blocks)
        begin.unpersist()
        if learnt:
            w = gru.shaped(mean, w)
    return w


def _answers(slices: DataFrame, counts: DataFrame) -> DataFrame:
    """For each slice the ``words`` that not all tasks know, and their ``counts``, in several rows."""
    blocks = exchange_partitions(slices.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, rare in zip(batch.column("slice").to_pylist(), batch.column("rare").to_pylist(), strict=True):
                word = np.unique(np.frombuffer(rare, "<u8"))
                order, edge = _routed(word, blocks)
                some = np.flatnonzero(np.diff(edge))
                yield _binaries({"block": some, "slice": np.full(len(some), of)}, words=(word[order], edge))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block's counts come first."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        word = n = None
        for batch in batches:
            out = []
            for of, words, some in zip(*(batch.column(c).to_pylist() for c in ("slice", "words", "counts")), strict=True):
                mine = np.frombuffer(words, "<u8")
                if of is None:
                    parts.append((mine, np.frombuffer(some, "<i8")))
                    continue
                if word is None:
                    word, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, "<u8") for i in (0, 1))
                    order = np.argsort(word, kind="stable")
                    word, n, parts = word[order], n[order].astype(np.int64), []
                count = np.zeros(len(mine), np.int64)
                if len(word):
                    at = np.minimum(np.searchsorted(word, mine), len(word) - 1)
                    count = np.where(word[at] == mine, n[at], 0)
                out.append((of, words, count.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["slice", "words", "counts"])

    asked = slices.select("slice", "rare").mapInArrow(ask, "block int, slice long, words binary").withColumn("counts", F.lit(None).cast("binary"))
    both = counts.select("block", F.lit(None).cast("long").alias("slice"), "words", "counts").union(asked)
    return both.repartitionById(blocks, "block").sortWithinPartitions(F.col("slice").asc_nulls_first()).mapInArrow(answer, "slice long, words binary, counts binary")


def scored(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (base-10 logarithms)."""
    context = docs.sparkSession.sparkContext
    training = docs.where(learn)
    counts = written(word_counts(training, text), "word-counts")
    top, n, words, distinct = _most_frequent(counts)
    known = context.broadcast(Known(top, n, training.count(), words, distinct))
    place = F.xxhash64(doc_id, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learnt"), place.alias("place"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    slices = written(_slices(source, known, kind), "slices")
    train_tokens = known.value.tokens
    weights = context.broadcast(gru.flat(train(slices, known, train_tokens)))
    scale = float(np.log10(train_tokens + known.value.distinct + 1))

    def finish(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        one_blas_thread()

        def column(table: pa.Table, name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        length, times, rare = column(own, "lengths", "<i8"), column(own, "rare_counts", "<i8"), column(own, "rare", "<u8")
        word, count = column(answers, "words", "<u8"), column(answers, "counts", "<i8")
        order, of = np.argsort(word), np.repeat(np.arange(len(times)), times)
        count = count[order][np.searchsorted(word[order], rare)] if len(rare) else count
        logs = np.bincount(of, np.log10(count + 1.0), len(length))
        seen = np.bincount(of, count > 0, len(length)).astype(np.int64)
        w = gru.shaped(weights.value, gru.initial(known.value.counts))
        numbers = np.split(column(own, "numbers", "<u2").astype(np.int32), np.cumsum(length)[:-1]) if len(length) else []
        network = gru.score(w, numbers, _END) / _LOG10
        base = column(own, "logs", "<f8") + logs - length * scale
        columns = [pa.array(length), pa.array(column(own, "known", "<i8") + seen), pa.array(np.full(len(length), train_tokens, np.int64)), pa.array(base), pa.array(network + column(own, "others", "<f8") + logs)]
        return pa.Table.from_arrays([own["doc_ids"].combine_chunks().flatten(), *columns], names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slices.groupBy("slice").cogroup(_answers(slices, counts).groupBy("slice")).applyInArrow(finish, schema)
