"""Near duplicates by an exact Jaccard join of word shingles through a token-group matrix.

A-Z are lower-cased; words are runs of other than ASCII white space. A document's set has its distinct
shingles of ``SHINGLE`` words (with fewer words, the whole sequence; without words, nothing). Two
documents link when 100 * |intersection| >= ``PERCENT`` * |union|; a component is what links connect.

1.  Equal sets are one set from here on, and its documents one component.
2.  A set's prefix are its rarest tokens in one order of all tokens, a tenth of them and ``MORE``. Two sets
    that link share ``MORE`` tokens of their prefixes at least, and one more. Tokens frequent in many
    documents come last in that order.
3.  Similar sets form groups: those of one least hash of a token that isn't frequent, or of one that is
    where most of the set's tokens are (a large group of copies makes its own tokens frequent). The matrix joins each
    prefix token with the groups that hold it in sets of a fit size. Counted over a set's prefix, that
    bounds the overlap with any set of a group: the set may link into those that reach what it needs.
4.  A group's sets go to one block, or to several of about ``MEMBERS``; with each block go the
    sets that may link into it, at most ``QUERIES`` to a copy of it. A block keeps the union
    of its tokens: a set with too few tokens in the union meets no member. Others are compared exactly.
5.  Two rounds: first each block within itself, and every set with the first block of its group and of the
    lowest group that it may link into, which connects most copies; then blocks with those sets only that
    aren't connected with all of it yet.
6.  Links to one connected part of a block give one edge; edges give components.

Hashes have 48 bits for a shingle and 64 for a set. Null texts and texts without words have no shingles,
link with nothing and are their own component. Repeated rows are equal sets. With a null id a row takes
part, and the component's id is the least of the others; if there is none, it is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.frames import exchange_partitions, sliced, written
from plumbline.llm.words import LOWER, SPACE, Words, in_word, mixed, window_hashes

SHINGLE, PERCENT = 3, 90
MEMBERS, QUERIES = 256, 1024
#: Of a set's size: prefix tokens beyond the tenth, which a linked set must share as well.
MORE = 0.06
#: Tokens in at least this share of documents are ordered by their count; at most so many of them.
FREQUENT_SHARE, FREQUENT = 1e-3, 1 << 20
_SLICE = 8 << 20
_WORD_BYTE = in_word(SPACE)
_BITS = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)
#: Lists up to this length are compared pair by pair at once, longer ones class by class.
_SHORT = 12


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and shingles of all sets, sorted by both, and each row's number of shingles. At most 65,536 rows."""
    words = Words(column, _WORD_BYTE, LOWER)
    hashes, at = words.hashes(), words.windows(SHINGLE)
    whole = window_hashes(hashes, at, SHINGLE)
    row = words.row()[at]
    few = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    short = np.array([mixed(np.bitwise_xor.reduce(mixed(hashes[words.first[i] : words.first[i + 1]] + np.arange(words.count[i], dtype=np.uint64)))[None])[0] for i in few], np.uint64)
    key = (np.concatenate([row, few]).astype(np.uint64) << _BITS) | (np.concatenate([whole, short]) & _MASK)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    row = (key >> _BITS).astype(np.int64)
    return row, key & _MASK, np.bincount(row, minlength=words.rows)


def _prints(row: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """64 bits for each row's set."""
    total = np.zeros(rows, np.uint64)
    np.add.at(total, row, mixed(token + np.uint64(1)))
    return mixed(total)


def _prefixes(row: np.ndarray, token: np.ndarray, count: np.ndarray, frequent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the prefixes' members, and which tokens of the sets aren't frequent."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
        heavy = frequent[at] == token
    else:
        at, heavy = np.zeros(len(token), np.int64), np.zeros(len(token), bool)
    light, late = np.flatnonzero(~heavy), np.flatnonzero(heavy)
    late = late[np.lexsort((token[late], weight[at[late]] if len(late) else late, row[late]))]
    n_light = np.bincount(row[light], minlength=len(count))
    place = np.empty(len(row), np.int64)
    place[light] = np.arange(len(light)) - np.repeat(np.cumsum(n_light) - n_light, n_light)
    n_late = count - n_light
    place[late] = np.arange(len(late)) - np.repeat(np.cumsum(n_late) - n_late, n_late) + n_light[row[late]]
    length = count - (PERCENT * count + 99) // 100 + _shared(count)
    return np.flatnonzero(place < length[row]), ~heavy


def _shared(size: np.ndarray) -> np.ndarray:
    """How many tokens the prefixes of two linked sets share if the smaller has this size."""
    return 1 + (MORE * size).astype(np.int64)


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection with which sets of these sizes link."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold, sorted, with estimated counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            token, n = np.unique(_sets(batch.column("text"))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n > 2].astype(np.int64)), pa.array(n[n > 2], pa.int64())], ["token", "n"])

    total = docs.count()
    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_SHARE * total)
    found = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas().sort_values("token")
    return found["token"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)


_POSTING = np.dtype([("token", "<u8"), ("set", "<u8"), ("group", "<u4"), ("size", "<u4")])


def _posting_rows(batch: pa.RecordBatch, blocks: int, frequent: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    row, token, count = _sets(batch.column("text"))
    prints = _prints(row, token, len(count))
    first = np.zeros(len(count), bool)
    first[np.unique(prints, return_index=True)[1]] = True  # one of each set in the slice
    kept, light = _prefixes(row, token, count, frequent, weight)
    kept = kept[first[row[kept]]]
    # The group: the least hash of the set's tokens of that kind, frequent or not, which most of them are.
    mostly_light = 2 * np.bincount(row[light], minlength=len(count)) >= count
    least = np.full(len(count), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row, (mixed(token + np.uint64(7)) >> np.uint64(1)) | (light != mostly_light[row]).astype(np.uint64) << np.uint64(63))
    p = np.zeros(len(kept), _POSTING)
    p["token"], p["set"], p["size"] = token[kept], prints[row[kept]], count[row[kept]]
    p["group"] = (mixed(least[row[kept]]) >> np.uint64(32)).astype(np.uint32)
    block = (mixed(p["token"].copy()) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(block, kind="stable")
    p, bounds = p[order], np.searchsorted(block[order], np.arange(blocks + 1))
    some = np.flatnonzero(np.diff(bounds))
    # Field by field, since equal leading bytes of a column compress well.
    packed = [b"".join(np.ascontiguousarray(p[n][bounds[k] : bounds[k + 1]]).tobytes() for n in _POSTING.names) for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["block", "postings"])


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // _POSTING.itemsize
    out, at = np.empty(n, _POSTING), 0
    for name in _POSTING.names:
        out[name] = np.frombuffer(data, _POSTING[name], n, at)
        at += n * _POSTING[name].itemsize
    return out


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _counted(set_: np.ndarray, into: np.ndarray, n: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` for each distinct pair of set and group, with the other columns of its first row."""
    order = np.lexsort((into, set_))
    set_, into = set_[order], into[order]
    head = np.flatnonzero(np.concatenate([[True], (set_[1:] != set_[:-1]) | (into[1:] != into[:-1])])) if len(set_) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], head) if len(head) else n[:0]
    return set_[head], into[head], total, *(r[order][head] for r in rest)


def _overlaps(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """(set, group, tokens shared with sets of the group, the set's own group, its size) over these token lists."""
    p = p[np.lexsort((p["set"], p["token"]))]
    same = (p["token"][1:] == p["token"][:-1]) & (p["set"][1:] == p["set"][:-1])
    p = p[np.concatenate([[True], ~same])] if len(p) else p
    edge = np.flatnonzero(np.concatenate([[True], p["token"][1:] != p["token"][:-1], [True]])) if len(p) else np.zeros(1, np.int64)
    length = np.diff(edge)
    at, into = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    short = np.flatnonzero(np.repeat((length > 1) & (length <= _SHORT), length))
    for step in range(1, _SHORT):
        a, b = short[:-step], short[step:]
        hit = (p["token"][a] == p["token"][b]) & _fit(p["size"][a], p["size"][b])
        a, b = a[hit], b[hit]
        at += [a, b]
        into += [p["group"][b], p["group"][a]]
    for k in np.flatnonzero(length > _SHORT):
        x = p[edge[k] : edge[k + 1]]
        # Sets of one group and size are one class; its only set doesn't meet itself.
        classes = x[np.lexsort((x["size"], x["group"]))]
        head = np.flatnonzero(np.concatenate([[True], (classes["group"][1:] != classes["group"][:-1]) | (classes["size"][1:] != classes["size"][:-1])]))
        several = np.diff(np.append(head, len(classes))) > 1
        classes = classes[head]
        for begin in range(0, len(x), 512):
            part = x[begin : begin + 512]
            i, j = np.nonzero(_fit(part["size"][:, None], classes["size"][None, :]) & (several | (part["set"][:, None] != classes["set"][None, :])))
            at.append(edge[k] + begin + i)
            into.append(classes["group"][j])
    at, into = np.concatenate(at), np.concatenate(into)
    # A token counts once for a set and a group.
    order = np.lexsort((into, at))
    at, into = at[order], into[order]
    once = np.concatenate([[True], (at[1:] != at[:-1]) | (into[1:] != into[:-1])]) if len(at) else np.zeros(0, bool)
    at, into = at[once], into[once]
    return _counted(p["set"][at], into, np.ones(len(at), np.int64), p["group"][at], p["size"][at])


_OVERLAP = (("set", "<u8"), ("into", "<u4"), ("n", "<i8"), ("group", "<u4"), ("size", "<u4"))


def _may_link(set_: np.ndarray, into: np.ndarray, n: np.ndarray, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (set, group, into): its own group, and lower groups that it may link into."""
    set_, into, n, group, size = _counted(set_, into, n, group, size)
    enough = n >= _shared((PERCENT * size.astype(np.int64) + 99) // 100)
    set_, group, into = set_[enough], group[enough], np.minimum(group, into)[enough]
    set_, into, _, group = _counted(set_, into, np.ones(len(set_), np.int64), group)
    return set_, group, into


def _candidates(docs: DataFrame) -> DataFrame:
    """``set``, its ``group`` and ``into``, the groups (its own or lower ones) whose members it may link with."""
    blocks = exchange_partitions(docs.sparkSession)
    order = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            yield _posting_rows(batch, blocks, *order.value)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(x) for batch in batches for x in batch.column("postings").to_pylist()]
        if parts:
            found = _overlaps(np.concatenate(parts))
            block = (mixed(found[0]) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            edge = np.searchsorted(block[order], np.arange(blocks + 1))
            some = np.flatnonzero(np.diff(edge))
            fields = [c[order].astype(t) for c, (_, t) in zip(found, _OVERLAP, strict=True)]
            packed = [b"".join(f[edge[k] : edge[k + 1]].tobytes() for f in fields) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["block", "overlaps"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = sum(np.dtype(t).itemsize for _, t in _OVERLAP)
        fields: list[list[np.ndarray]] = [[] for _ in _OVERLAP]
        for batch in batches:
            for data in batch.column("overlaps").to_pylist():
                n, at = len(data) // width, 0
                for held, (_, t) in zip(fields, _OVERLAP, strict=True):
                    held.append(np.frombuffer(data, t, n, at))
                    at += n * np.dtype(t).itemsize
        if fields[0]:
            found = _may_link(*map(np.concatenate, fields))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], ["set", "group", "into"])

    lists = docs.select("text").mapInArrow(postings, "block int, postings binary").repartitionById(blocks, "block")
    overlaps = lists.mapInArrow(overlap, "block int, overlaps binary").repartitionById(blocks, "block")
    return overlaps.mapInArrow(decide, "set long, group long, into long")


class _Block:
    """Members of a block: their tokens in one sorted array, which is also the union. Members of one label are linked already."""

    def __init__(self, labels: np.ndarray, sets: list[np.ndarray]):
        self.labels, self.size = labels, np.array([len(s) for s in sets], np.int64)
        token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")
        self.token, self.member = token[order], member[order]
        first, of = np.unique(labels, return_index=True, return_inverse=True)[1:]
        self.part = first[of]
        found = list(self.links(labels, sets)) if len(first) > 1 else []
        while True:  # the least member that links reach, within the block
            before = self.part.copy()
            for i, m in found:
                np.minimum.at(self.part, m, self.part[i])
                np.minimum.at(self.part, i, self.part[m])
            self.part = self.part[self.part]
            if (before == self.part).all():
                break

    def links(self, labels: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query and a member of another label that link."""
        size = np.array([len(s) for s in sets], np.int64)
        at = 0
        while at < len(sets):
            end, total = at, 0
            while end < len(sets) and (end == at or total < 1 << 15):
                total += len(sets[end])
                end += 1
            token, query = np.concatenate(sets[at:end]), np.repeat(np.arange(end - at), size[at:end])
            low, high = np.searchsorted(self.token, token, "left"), np.searchsorted(self.token, token, "right")
            in_union = np.bincount(query[high > low], minlength=end - at)
            opened = (100 * in_union >= PERCENT * size[at:end])[query] & (high > low)
            low, times, query = low[opened], (high - low)[opened], query[opened]
            where = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            shared = np.bincount(np.repeat(query, times) * len(self.size) + self.member[where], minlength=(end - at) * len(self.size))
            shared = shared.reshape(end - at, len(self.size))
            i, m = np.nonzero(shared >= _needed(size[at:end, None], self.size[None, :]))
            other = labels[at + i] != self.labels[m]
            yield at + i[other], m[other]
            at = end

    def edges(self, labels: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        """One edge from each query's label to each connected part of the block that it links with."""
        out = [np.stack([labels[i], self.labels[self.part[m]]], 1) for i, m in self.links(labels, sets)]
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def own(self) -> np.ndarray:
        """Edges that connect the members as their links do."""
        some = self.part != np.arange(len(self.part))
        out = np.stack([self.labels[some], self.labels[self.part[some]]], 1)
        return np.unique(out[out[:, 0] != out[:, 1]], axis=0)


_ROUTE = ("into", "part", "copy", "member")


def _met(docs: DataFrame, reps: DataFrame, members: DataFrame, queries: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``: labels) between the queries and the members of their blocks, and among a block's members.

    Both have ``set``, ``label`` and the block (``into``, ``part``). Members go to every copy of their
    block, which has one for every ``QUERIES`` queries; a query goes to one copy.
    """
    block = ["into", "part"]
    asked = queries.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
    as_member = members.join(asked, block, "left").select("set", "label", *block, F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), F.lit(True).alias("member"))
    as_query = queries.join(asked, block).select("set", "label", *block, F.pmod(F.xxhash64("set", F.lit(1)), F.col("copies")).cast("int").alias("copy"), F.lit(False).alias("member"))
    routes = as_member.union(as_query).groupBy("set", "label").agg(F.collect_list(F.struct(*_ROUTE)).alias("to"))
    routed = routes.join(reps, "set").select(F.col("doc.doc_id").alias("of"), F.col("doc.check").alias("of_check"), "label", "to")
    texts = docs.join(routed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("check") == F.col("of_check"))).select("text", "label", "to")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE // 4):
            _, token, count = _sets(batch.column("text"))
            bounds = np.concatenate([[0], np.cumsum(count)])
            six = np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            for i, (label, to) in enumerate(zip(batch.column("label").to_pylist(), batch.column("to").to_pylist(), strict=True)):
                n, data = len(to), six[bounds[i] : bounds[i + 1]].tobytes()
                columns = [pa.array([t[k] for t in to], kind) for k, kind in zip(_ROUTE, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([label] * n, pa.int64()), pa.array([data] * n, pa.binary())], [*_ROUTE, "label", "tokens"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(block and copy, whether a member, label, tokens); sorted by block, members before queries."""
        for batch in batches:
            for into, part, copy, member, label, tokens in zip(*(batch.column(n).to_pylist() for n in (*_ROUTE, "label", "tokens")), strict=True):
                wide = np.zeros((len(tokens) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
                yield (into, part, copy), member, label, wide.view("<u8").reshape(-1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = lambda e: pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
        of = lambda part: (np.array([r[2] for r in part], np.int64), [r[3] for r in part])
        for key, in_block in groupby(rows(batches), itemgetter(0)):
            block = None
            for member, part in groupby(in_block, itemgetter(1)):
                if member:
                    block = _Block(*of(list(part)))
                    if key[2] == 0:
                        yield edges(block.own())
                elif block is not None:
                    for some in batched(part, QUERIES):
                        yield edges(block.edges(*of(some)))

    shipped = texts.mapInArrow(ship, "into long, part int, copy int, member boolean, label long, tokens binary")
    blocks = shipped.repartition(exchange_partitions(docs.sparkSession), "into", "part", "copy").sortWithinPartitions("into", "part", "copy", F.desc("member"))
    return blocks.mapInArrow(meet, "a long, b long")


def _within_groups(members: DataFrame, asking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First round: all parts of a group by themselves, and its other parts and what may link into no lower group against its first part."""
    parts = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    placed = members.join(parts, "group").select("set", F.col("set").alias("label"), F.col("group").alias("into"), F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"))
    lowest = asking.groupBy("set").agg(F.min("into").alias("into")).select("set", F.col("set").alias("label"), "into")
    queries = placed.where("part > 0").select("set", "label", "into").union(lowest)
    return placed, queries.withColumn("part", F.lit(0))


def _between_labels(members: DataFrame, asking: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Second round: every part of a group against what may link into it and isn't connected with all of it yet.

    Members of a label of more than ``MEMBERS``, or of all the group, have parts of their own, which nothing
    of that label meets; all others share parts by label. Of two parts of a group, the later asks the earlier.
    """
    label = F.coalesce("root", "set").alias("label")
    named = roots.select(F.col("node").alias("set"), "root")
    members, asking = members.join(named, "set", "left").select("set", label, F.col("group").alias("into")), asking.join(named, "set", "left").select("set", label, "into")
    sized = members.groupBy("into", "label").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("n") == F.sum("n").over(Window.partitionBy("into"))
    sized = sized.withColumn("owner", F.when((F.col("n") > MEMBERS) | alone, F.col("label")))
    ahead = Window.partitionBy("into").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    shapes = sized.groupBy("into", "owner").agg(F.ceil(F.sum("n") / MEMBERS).cast("int").alias("parts")).withColumn("first", F.coalesce(F.sum("parts").over(ahead), F.lit(0)).cast("int"))
    shapes = written(shapes, "shapes")
    whole = shapes.groupBy("into").agg(F.sum("parts").cast("int").alias("total"))
    owned = shapes.where("owner IS NOT NULL").select("into", F.col("owner").alias("label"), F.col("first").alias("own_first"), (F.col("first") + F.col("parts")).alias("own_end"))
    shared = shapes.where("owner IS NULL").select("into", "parts", "first")
    by_label = members.join(owned, ["into", "label"], "left").join(shared, "into", "left")
    in_owned = F.col("own_first") + F.pmod(F.xxhash64("set"), F.col("own_end") - F.col("own_first"))
    in_shared = F.col("first") + F.pmod(F.xxhash64("label"), F.col("parts"))
    placed = by_label.select("set", "label", "into", F.coalesce(in_owned, in_shared).cast("int").alias("part"), "own_first", "own_end")
    outside = asking.join(whole, "into").join(owned, ["into", "label"], "left").select("set", "label", "into", F.col("total").alias("before"), "own_first", "own_end")
    asked = placed.select("set", "label", "into", F.col("part").alias("before"), "own_first", "own_end").union(outside).where("before > 0")
    all_before = F.sequence(F.lit(0), F.col("before") - 1)
    others = F.filter(all_before, lambda p: ~F.coalesce((p >= F.col("own_first")) & (p < F.col("own_end")), F.lit(False)))
    queries = asked.select("set", "label", "into", F.explode(others).alias("part"))
    # A part of one label that nothing asks needn't be shipped.
    used = queries.select("into", "part").distinct().withColumn("asked", F.lit(True))
    placed = placed.join(used, ["into", "part"], "left").where("asked OR own_first IS NULL").select("set", "label", "into", "part")
    return placed, queries


def _roots(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """``set`` and ``root`` of all sets that may link: sets that links connect have one root."""
    found = written(_candidates(docs), "may-link")
    members, asking = found.select("set", "group").distinct(), found.where(F.col("into") != F.col("group")).select("set", "into")
    reps = signatures.where("n_shingles > 0").groupBy("set").agg(F.min(F.struct("doc_id", "check")).alias("doc"))
    near = written(components(_met(docs, reps, *_within_groups(members, asking))), "roots")
    far = components(_met(docs, reps, *_between_labels(members, asking, near)))
    named = members.select("set").join(near.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("root", "set").alias("near"))
    return named.join(far, F.col("near") == F.col("node"), "left").select("set", F.coalesce("root", "near").alias("root"))


def _signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``check`` (the text's crc32), ``n_shingles`` and the ``set`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            row, token, count = _sets(batch.column("text"))
            prints = _prints(row, token, len(count)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), pa.array(count, pa.int64()), pa.array(prints)], ["doc_id", "check", "n_shingles", "set"])

    return docs.mapInArrow(sign, f"doc_id {kind}, check long, n_shingles long, set long")


def _clusters(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("check"), F.col(text).alias("text"))
    signatures = written(_signatures(docs), "signatures")
    roots = _roots(docs, signatures)
    some = signatures.where("n_shingles > 0")
    by_set = some.groupBy("set").agg(F.min("doc_id").alias("least")).join(roots, "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    by_root = by_set.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_set.join(by_root, "root").select("set", "component_id")
    linked = some.join(named, "set").select("doc_id", "check", "n_shingles", "component_id")
    return linked.union(signatures.where("n_shingles = 0").select("doc_id", "check", "n_shingles", F.col("doc_id").alias("component_id")))


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the least id that links reach."""
    return _clusters(docs, doc_id, text).drop("check")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's, with their own columns whatever those are called.

    Repeated rows stay together, and so do the rows of a component without any id.
    """
    stay = _clusters(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "check")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("of_check"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of_check") == F.col("check")), "left_semi").select("row.*")
