"""Repair of damaged conversations: the cheapest edits that give each one the grammar ``(s?(ua)+)?`` of role initials.

A forward Viterbi pass goes over a conversation's rows in order. Its four states are the grammar's: nothing yet, after the system's turn, after the
user's, after the assistant's. A state carries the least (cost, audit string), where the audit string has one letter for each edit: Delete, Insert,
Keep, Rerole. After each row a layer is closed by insertions, two at most, since a third comes back to where it began. Two audits of equal cost that
lead from one state to another over the same rows are never one the beginning of the other, for letters fix the cost; so the least of them stays the
least whatever follows, and ties go to the ASCII-least audit.

A conversation of any length is split: rows are dealt by ranges of (conversation, turn, role, digest), each task cuts its rows into segments of bounded
size, and a segment's pass gives the least (cost, audit) from each state to each, which compose like matrices. Rows travel without their texts until the
edits are known. A whole conversation meets in one task only as a stream: to put its segments together, and to digest its repaired text, which no other way gives.

Order: by turn, nulls first; turns that repeat go by role, then by the SHA-256 of the text. A null role or text is one space, and so is a null id or turn
where the damage is drawn. Rows that repeat wholly travel as one with their number; all but the first are duplicates. A role without an initial, or with
another than s, u and a, can't be kept. A conversation without rows has no faults, no cost and no text; an empty table gives no rows. Other columns
are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import exchange_partitions, joined, written

# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Distinct rows of a segment at most.
SEGMENT = 2048
_BLANKS = r"\x20\x09-\x0D"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where an initial leads from each state.
_MOVE = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_NAME = {"u": "user", "a": "assistant"}
_KEY = ["conv_id", "turn", "role", "digest"]

State = list[tuple[int, str] | None]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` of the rows after damage, drawn by the CRC of ``conv_id:turn``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Each distinct row once, with its ``copies`` and whether its text is ``blank`` or ``cut`` short."""
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.groupBy(*_KEY).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    last = F.regexp_extract("text", rf"([^{_BLANKS}])[{_BLANKS}]*\z", 1)
    return rows.withColumns({"blank": last == "", "cut": ~last.isin(".", "!", "?")})


def _faults(rows: DataFrame) -> DataFrame:
    """The distinct rows without their texts; ``seen`` where an earlier turn of the conversation has the same role and text."""
    by = ["conv_id", "role", "digest"]
    null_turn = F.bool_or(F.col("turn").isNull())
    again = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("turns"), F.when(~null_turn, F.min("turn")).alias("first")).where("turns > 1")
    again = again.select(*by, "first", F.lit(True).alias("several"))
    light = rows.select(*_KEY, F.left("role", F.lit(1)).alias("initial"), "copies", "blank", "cut")
    found = joined(light, again, by, "left")
    return found.select(*light.columns, (F.coalesce("several", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))).alias("seen"))


def _least(state: State, at: int, found: tuple[int, str]) -> None:
    if state[at] is None or found < state[at]:
        state[at] = found


def _closed(state: State) -> State:
    for _ in range(2):
        before = list(state)
        for at, held in enumerate(before):
            if held is not None:
                _least(state, _ASSISTANT if at == _USER else _USER, (held[0] + INSERT, held[1] + "I"))
    return state


def _row(state: State, initial: str, fault: str, copies: int) -> State:
    """The layer after one distinct row and its ``copies``; ``fault`` is one of blank, duplicate, truncated and none, of its first copy."""
    new: State = [None] * 4
    gone = fault in ("blank", "duplicate")
    kept = TRUNCATED if fault == "truncated" else 0
    for at, held in enumerate(state):
        if held is None:
            continue
        cost, audit = held
        _least(new, at, (cost + DELETE, audit + "D"))
        if gone:
            continue
        if (to := _MOVE.get(initial, {}).get(at)) is not None:
            _least(new, to, (cost + kept, audit + "K"))
        for move in (_MOVE["u"], _MOVE["a"]):
            if (to := move.get(at)) is not None:
                _least(new, to, (cost + kept + REROLE, audit + "R"))
    new = _closed(new)
    if copies > 1:
        new = _closed([held and (held[0] + DELETE * (copies - 1), held[1] + "D" * (copies - 1)) for held in new])
    return new


def _fault(blank: bool, seen: bool, cut: bool) -> str:
    return "blank" if blank else "duplicate" if seen else "truncated" if cut else "none"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Segment:
    """The pass over rows of one conversation, from each of ``starts``."""

    def __init__(self, key: tuple, starts: tuple[int, ...]):
        self.key, self.rows, self.distinct = key, 0, 0
        self.passes = {s: _closed([(0, "") if k == s else None for k in range(4)]) if s == _START else [(0, "") if k == s else None for k in range(4)] for s in starts}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = ""

    def add(self, initial: str, copies: int, blank: bool, cut: bool, seen: bool) -> None:
        fault = _fault(blank, seen, cut)
        if self.distinct:
            self.counts["illegal"] += not _legal(self.last, initial)
        else:
            self.first = initial
        self.counts["illegal"] += copies - 1
        whole = fault in ("blank", "duplicate")
        if fault != "none":
            self.counts[fault] += copies if whole else 1
        if not whole:
            self.counts["duplicate"] += copies - 1
        self.last, self.rows, self.distinct = initial, self.rows + copies, self.distinct + 1
        self.passes = {s: _row(state, initial, fault, copies) for s, state in self.passes.items()}


_SEGMENTS = "turn long, role string, digest string, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, starts array<int>, costs array<long>, audits array<string>"


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """One row per segment, with the least cost and audit from each of ``starts`` (in fours, by the state that they end in)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, open_ = None, [], None

        def close(s: _Segment) -> dict:
            flat = [x for state in s.passes.values() for x in state]
            ends = {"starts": list(s.passes), "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat]}
            return dict(zip(_KEY, s.key, strict=True)) | {"rows": s.rows, **s.counts, "first": s.first, "last": s.last} | ends

        def out() -> pa.RecordBatch:
            columns = {c: [h[c] for h in held] for c in held[0]}
            types = {c: schema.field(c).type for c in _KEY} | {c: pa.int64() for c in ("rows", "blank", "duplicate", "truncated", "illegal")}
            types |= {"first": pa.string(), "last": pa.string(), "starts": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in columns.items()], list(columns))

        for batch in batches:
            schema = batch.schema
            names = [*_KEY, "initial", "copies", "blank", "cut", "seen"]
            for *key, initial, copies, blank, cut, seen in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                other = open_ is None or open_.key[0] != key[0]
                if other or open_.distinct >= size:
                    # What a task meets first may go on from a segment of another task, and so may the next segment of one conversation.
                    starts = (_START,) if other and open_ is not None else tuple(range(4))
                    if open_ is not None:
                        held.append(close(open_))
                    open_ = _Segment(tuple(key), starts)
                open_.add(initial, copies, blank, cut, seen)
            if sum(len(h["costs"]) * h["rows"] for h in held) > 1 << 22 or len(held) > 4096:
                yield out()
        if open_ is not None:
            held.append(close(open_))
        if held:
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, " + _SEGMENTS.replace("turn long", f"turn {turn}"))


def _composed(segments: DataFrame) -> DataFrame:
    """Segments put together in order: for each its slice of the audit, and for the last of a conversation what the whole is."""
    kind, turn = (segments.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    whole = "whole struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string>"

    def slices(audit: str, sizes: list[int]) -> list[str]:
        """The audit cut behind as many of its letters as a segment has rows; insertions at a cut belong to what comes before it."""
        out, at = [], 0
        for n in sizes:
            begin = at
            while n:
                n -= audit[at] != "I"
                at += 1
            while at < len(audit) and audit[at] == "I":
                at += 1
            out.append(audit[begin:at])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, keys, sizes, out = None, None, [], [], []
        state: State = []
        counts: dict[str, int] = {}
        last = ""

        def close() -> None:
            cost, audit = min(x for x in (state[_START], state[_ASSISTANT]) if x is not None)
            for i, (k, part) in enumerate(zip(keys, slices(audit, sizes), strict=True)):
                end = counts | {"cost": cost, "audit": audit} if i == len(keys) - 1 else None
                out.append((*k, part, end))

        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                if key is None or r["conv_id"] != key[0]:
                    if key is not None:
                        close()
                    key, keys, sizes, last = (r["conv_id"],), [], [], None
                    state = [(0, ""), None, None, None]
                    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                for c in counts:
                    counts[c] += r[c]
                counts["illegal"] += last is not None and not _legal(last, r["first"])
                last = r["last"]
                new: State = [None] * 4
                for i, start in enumerate(r["starts"]):
                    if state[start] is not None:
                        for end in range(4):
                            if (cost := r["costs"][4 * i + end]) is not None:
                                _least(new, end, (state[start][0] + cost, state[start][1] + r["audits"][4 * i + end]))
                state = new
                keys.append(tuple(r[c] for c in _KEY))
                sizes.append(r["rows"])
            if len(out) > 4096:
                yield batch_of(schema, out)
        if key is not None:
            close()
        if out:
            yield batch_of(schema, out)

    def batch_of(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
        counts = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
        types = [schema.field(c).type for c in _KEY] + [pa.string(), pa.struct(counts)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*_KEY, "edits", "whole"])
        out.clear()
        return batch

    dealt = segments.repartition(exchange_partitions(segments.sparkSession), "conv_id").sortWithinPartitions(*_order())
    return dealt.mapInArrow(run, f"conv_id {kind}, turn {turn}, role string, digest string, edits string, {whole}")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _turns(rows: DataFrame, composed: DataFrame, digests: bool) -> DataFrame:
    """The repaired turns (``conv_id``, ``position``, ``role``, ``text``), or with ``digests`` the ``repaired_sha256`` of each conversation.

    A segment's edits lie just before its first row, so that a task meets both in one sorted stream.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    edits = composed.select(*_KEY, F.lit(0).alias("kind"), "edits", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    texts = rows.select(*_KEY, F.lit(1).alias("kind"), F.lit("").alias("edits"), "text", "copies")
    dealt = edits.unionByName(texts).repartition(exchange_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*_order(), "kind")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Schema, object, int, str, str]]:
        part, at, place, system, conv, begun = "", 0, 0, False, None, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "kind", "edits", "text", "copies"))
            for conv_id, role, row_kind, letters, text, copies in zip(*columns, strict=True):
                if not begun or conv_id != conv:
                    conv, begun, place, system = conv_id, True, 0, False
                    yield batch.schema, conv, -1, "", ""
                if row_kind == 0:
                    part, at = letters, 0
                    continue

                def expected() -> str:
                    return "ua"[(place - system) % 2]

                while copies:
                    letter, at = part[at], at + 1
                    if letter == "I":
                        yield batch.schema, conv, place, _NAME[expected()], ""
                    else:
                        copies -= 1
                        if letter == "K":
                            system = system or (place == 0 and role[:1] == "s")
                            yield batch.schema, conv, place, role, text
                        elif letter == "R":
                            yield batch.schema, conv, place, _NAME[expected()], text
                    place += letter != "D"
                while at < len(part) and part[at] == "I":
                    yield batch.schema, conv, place, _NAME[expected()], ""
                    at, place = at + 1, place + 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, sha, now = None, [], None, None
        for schema, conv, place, role, text in turns(batches):  # noqa: B007
            if place < 0:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                sha, now = hashlib.sha256(), conv
                if len(out) > 4096:
                    yield batch_of(schema, out, ["conv_id", "repaired_sha256"])
            else:
                sha.update(("\n" * (place > 0) + f"{role}:{text}").encode())
        if sha is not None:
            out.append((now, sha.hexdigest()))
            yield batch_of(schema, out, ["conv_id", "repaired_sha256"])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, size = None, [], 0
        for schema, *turn in turns(batches):  # noqa: B007
            if turn[1] >= 0:
                out.append(tuple(turn))
                size += len(turn[3]) + 64
            if size > 1 << 22:
                yield batch_of(schema, out, ["conv_id", "position", "role", "text"])
                size = 0
        if out:
            yield batch_of(schema, out, ["conv_id", "position", "role", "text"])

    def batch_of(schema: pa.Schema, out: list[tuple], names: list[str]) -> pa.RecordBatch:
        types = {"conv_id": schema.field("conv_id").type, "position": pa.int64()}
        batch = pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)
        out.clear()
        return batch

    if digests:
        return dealt.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")
    return dealt.mapInArrow(repaired, f"conv_id {kind}, position long, role string, text string")


def _solved(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """The distinct rows, and the segments put together; both written."""
    distinct = written(_distinct(rows), "distinct")
    faults = written(_faults(distinct), "faults")
    dealt = faults.repartitionByRange(exchange_partitions(rows.sparkSession), *_order()).sortWithinPartitions(*_order())
    return distinct, written(_composed(_segments(dealt, segment)), "composed")


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The turns of each conversation after repair, with their ``position`` from 0; ``rows`` have ``conv_id``, ``turn``, ``role`` and ``text``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return _turns(*_solved(rows.select("conv_id", "turn", text_of("role"), text_of("text"), F.lit(1).cast("long").alias("copies")), segment), digests=False)


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """What damage does to each conversation and what its repair costs, one row for each ``conv_id`` before the damage."""
    distinct, composed = _solved(damaged(conversations), segment)
    turns = distinct.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    found = composed.where("whole is not null").select("conv_id", "whole.*")
    ids = conversations.select("conv_id").distinct()
    for part in (turns, found, _turns(distinct, composed, digests=True)):
        ids = joined(ids, part, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
