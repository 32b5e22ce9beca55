"""Packing, conversation repair and ranked search, against brute force on small tables with every odd case."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import lexical_search, packing, repair
from plumbline.llm.queries import WORDS

PATH = public_tokenizers.path(WORDS)
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [
    None, "", " \t\n", "one", "don't 'start x's I'LL", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "É é İx Ñandú ÷ × ª º   x́", "日本 語 ﬁ ΑΣ Σ. 🙂🙂 — “q” 12,345.6 ½", "\x00a\x1fb\x7f\x85c", "Straße ŉ Ǆ ǅ z", "x\x0by\x0cz\r\n",
    "a" * 30_000, "word, " * 9000,
]


# Packing


def pieces_of(found):
    docs, sequences = {}, {}
    for r in found:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    return docs, sequences


def gapless(spans):
    end = 0
    for start, length in sorted(spans):
        assert start == end and length > 0
        end += length
    return end


def padding(size, window):
    return 0 if size & (size - 1) == 0 else window - size


@pytest.mark.parametrize("partitions", [1, 5])
def test_packing_keeps_each_id_once_and_pads_nothing(spark, partitions):
    rng = random.Random(3)
    texts = ODD + [" ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(rng.choice([1, 5, 80, 700, 5000]))) for _ in range(60)]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(partitions), PATH, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    docs, sequences = pieces_of(found)
    assert set(docs) == {r[0] for r in rows}
    for i, t, *_ in rows:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted(docs[i], key=lambda r: r["start"])
        assert gapless((r["start"], r["length"]) for r in mine) == len(want) == mine[0]["doc_tokens"]
        assert [x for r in mine for x in r["ids"]] == want
        assert all(r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4")) for r in mine)
    assert all(gapless(s) <= packing.WINDOW and padding(gapless(s), packing.WINDOW) == 0 for s in sequences.values())


def test_packing_of_repeated_rows_and_of_nothing(spark):
    schema = "doc_id long, text string"
    rows = [(7, "a b c")] * 50 + [(None, "a b c")] * 3 + [(None, None)] * 5
    found = packing.packed(spark.createDataFrame(rows, schema).repartition(4), PATH, window=16).collect()
    _, sequences = pieces_of(found)
    assert sum(r["length"] for r in found) == 53 * 4 + 5 and all(gapless(s) <= 16 and padding(gapless(s), 16) == 0 for s in sequences.values())
    assert packing.packed(spark.createDataFrame([], schema), PATH).count() == 0


def test_packing_hashes_counts_and_sorts_no_ids(spark):
    """Sorts of all ids beside workers that held on to freed memory took an executor's 3 GB."""
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(50)], "doc_id long, text string")
    plan = packing.packed(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


@pytest.mark.parametrize("seed", range(30))
def test_fill_comes_as_near_as_any_choice(seed):
    rng = random.Random(seed)
    counts, room = {rng.randint(1, 12): rng.randint(0, 3) for _ in range(5)}, rng.randint(0, 40)
    taken = packing.fill(counts, room)
    best = max(t for t in (sum(n * c for n, c in zip(counts, x)) for x in product(*(range(c + 1) for c in counts.values()))) if t <= room)
    assert sum(n * c for n, c in taken.items()) == best and all(c <= counts[n] for n, c in taken.items())


@pytest.mark.parametrize("counts", [{3000: 1000}, {3000: 7}, {1: 1}, {4095: 3}, {7: 10**11}, {5: 3, 4000: 2, 1: 9}, {}])
def test_plan_places_every_rank_once(counts):
    plan = packing.Plan.of(counts)
    for length, runs in plan.runs.items():
        assert [r[0] for r in runs] == [sum(x[1] for x in runs[:i]) for i in range(len(runs))]
    if sum(counts.values()) < 2000:
        held = {}
        for length, c in counts.items():
            for rank in range(c):
                mine = list(plan.pieces(length, rank))
                assert sum(take for take, *_ in mine) == length
                for take, sequence, offset in mine:
                    held.setdefault(sequence, []).append((offset, take))
        assert set(held) == set(range(plan.sequences)) and all(padding(gapless(s), packing.WINDOW) == 0 for s in held.values())


def test_encoder_forgets_without_a_change(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "_KNOWN", 5)
    encoder, whole = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for texts in (["a b c", "d e f"], ["a c x y z w v u"], ["", None], ["a b"]):
        ids, bound = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:])] == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


# Conversation repair


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Every sequence of edits with at most two insertions in a place, the least (cost, audit) of those that the grammar takes."""
    grammar, best = re.compile(r"(s?(ua)+)?"), None
    inserts = [(5 * len(x), "I" * len(x), [(n, "") for n in x]) for k in range(3) for x in product(("user", "assistant"), repeat=k)]

    def options(row, kind):
        keep, late = row[2], 5 if kind == "truncated" else 0
        yield 2, "D", []
        if kind not in ("blank", "duplicate"):
            if keep[:1] in ("s", "u", "a") and keep:
                yield late, "K", [(keep, row[3])]
            for n in ("user", "assistant"):
                yield late + 1, "R", [(n, row[3])]

    held = {"": min(x for x in inserts if not x[0])}
    states = {}
    for cost, audit, turns in inserts:
        states.setdefault("".join(t[0][0] for t in turns), []).append((cost, audit, turns))
    held = {k: min(v) for k, v in states.items()}
    for row, kind in zip(rows, kinds):
        new = {}
        for letters, (cost, audit, turns) in held.items():
            for (c1, a1, t1), (c2, a2, t2) in product(options(row, kind), inserts):
                found = (cost + c1 + c2, audit + a1 + a2, turns + t1 + t2)
                key = letters + "".join(t[0][0] for t in t1 + t2)
                if re.fullmatch(r"(s?(ua)*u?)?", key) and (key not in new or found < new[key]):
                    new[key] = found
        held = new
    for letters, found in held.items():
        if grammar.fullmatch(letters) and (best is None or found < best):
            best = found
    return best


def conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "Umpire", "", None]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([1, 1, 2, 4, 6])):
            text = rng.choice(["Yes.", "no", "What?", None, "", " \t", "Long! " * 3, "a\x0bb. \n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 1]), rng.choice(roles), text, "x"))
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage(r for r in rows if r[0] == conv)
        kinds = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, repaired = cheapest(mine, kinds) if mine else (0, "", [])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [repair.SEGMENT, 1, 2])
def test_repair_by_brute_force(spark, segment):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string").repartition(3)
    assert {r[0]: tuple(r)[1:] for r in repair.report(df, segment).collect()} == expected(rows)


@pytest.mark.parametrize("seed", range(8))
def test_segments_compose_to_the_whole_pass(spark, seed):
    """One conversation that takes many segments in several tasks equals the pass in one."""
    rng = random.Random(seed)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"t{i}", "Hm?"])) for i in range(120)] + [(2, 1, "user", "Hi.")] * 40
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    one, many = (sorted(map(tuple, repair.report(df, s).collect())) for s in (1000, 3))
    assert one == many and len(one) == 2


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "user", "Hi?"), (1, 2, "user", ""), (1, 3, "assistant", "Yes."), (1, 4, "user", "And?")]
    found = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in found.orderBy("position").collect()] == [(1, 0, "system", "Be."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes.")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(empty).count() == repair.repaired(empty).count() == 0


# Ranked search


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, best):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(d, Counter(terms(t)), t) for d, t, *_ in docs]
    df = Counter(w for _, b, _ in bags for w in b)
    n_docs, total = sum(bool(b) for _, b, _ in bags), sum(b.total() for _, b, _ in bags)
    weight = {w: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * c + 1))) for w, c in df.items()}
    queries, out = {}, []
    for item, text in dict.fromkeys((i, t) for i, t, *_ in items):
        queries.setdefault(item, Counter()).update(terms(text))
    for item, query in queries.items():
        found = []
        for d, bag, _ in bags:
            m = 25 + 75 * bag.total() * n_docs // max(total, 1)
            score = sum(q * weight[w] * (1_000_000_000 * bag[w] // (1000 * bag[w] + 8 * m)) for w, q in query.items() if bag[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Straße", "É", "x", "日本"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 90])).title(), "c", 1) for i in range(150)] + [(i, t, "c", 1) for i, t in enumerate([None, "", "... --", text(20000), "x " * 3000], 150)]
    docs += [(200, "w1 w2 w3 É", "c", 1)] * 15 + [(None, "w1 w2", "c", 1), (None, "w1 w3", "c", 1), (5, "w2 w1 w7", "c", 1)]
    items = [(i, text(rng.choice([1, 2, 8, 40])), "s") for i in range(25)] + [(25, None, "s"), (26, "", "s"), (27, "nothing has this", "s"), (None, "w1 w2", "s"), (3, "w1 w1", "s"), (4, "w9", "s"), (4, "w9", "s")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string, term string, s long").repartition(4), spark.createDataFrame(items, "item_id long, text string, q string"))
    assert sorted(map(tuple, found.collect()), key=repr) == ranked(docs, items, 10)


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(one, items).count() == 0
    assert lexical_search.search(docs, one.toDF("item_id", "text")).count() == 0
