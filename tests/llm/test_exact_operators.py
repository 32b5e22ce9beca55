"""Operators whose results are exact, against brute force on small tables with every odd case."""

import base64
import hashlib
import re
import string
import zlib
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import byte_bpe, decontamination, exact_dedup, jaccard_join, sharding, substring_dedup
from plumbline.llm.queries import VOCABULARY

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile("[^\x20\x09-\x0d]+")
BENCH = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(n, seed, vocabulary=40):
    return " ".join(f"w{(i * i * 7 + i * seed * 13 + seed) % vocabulary}" for i in range(n))


PASSAGE = words(30, 5, 400)
BASE = words(120, 3, 1000)
TEXTS = [
    None, "", " \t\n", "one", "one two", "One TWO", "a b c", "A B C", "a b c", "É é", PASSAGE, f"x y {PASSAGE} z", f"{PASSAGE} {PASSAGE}", words(25, 5, 400),
    BASE, BASE.upper(), BASE.replace("w9 ", "v9 "), BASE + " tail", BASE + " other tail of five", words(3000, 11, 9000), "no break \x1f unit", "don't  stop\r\nhere", "日本 語 テスト " * 15, "🙂 " * 30, "\x00 nul \x7f",
]
ROWS = [(i, t, "n", i) for i, t in enumerate(TEXTS)] + [(10, PASSAGE, "n", 1), (10, PASSAGE, "n", 1), (None, BASE, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names the operators use themselves.
    return spark.createDataFrame(ROWS, "doc_id long, text string, key string, `row` long").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string, `row` long")


def same(found, want):
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in found.collect()) == order(want)


def test_exact_dedup(docs, empty):
    groups = {}
    for d, t, *_ in ROWS:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    keep = {b: max((d for d in ids if d is not None), default=None) for b, ids in groups.items()}
    found = exact_dedup.membership(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == sorted(
        (d is None, d or 0, keep[b], len(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for d, t, *_ in ROWS for b in [(t or "").translate(LOWER)]
    )
    assert sum(r["kept"] for r in found) == len(groups)
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted(keep.values())
    assert exact_dedup.membership(empty).count() == exact_dedup.deduplicated(empty).count() == 0


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def component_ids(rows):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = [y if r == x else r for r in root]
    ids = {}
    for r, (d, *_) in zip(root, rows, strict=True):
        ids.setdefault(r, []).append(d)
    return [(d, len(s), min((i for i in ids[r] if i is not None), default=None)) for (d, *_), s, r in zip(rows, sets, root, strict=True)]


def test_jaccard_join(docs, empty):
    same(jaccard_join.clusters(docs), component_ids(ROWS))
    assert jaccard_join.representatives(docs).columns == docs.columns
    assert jaccard_join.clusters(empty).count() == 0


def test_jaccard_join_splits_a_large_group(spark, monkeypatch):
    """Hundreds of near copies in small blocks, some of which only link through others."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 8)
    monkeypatch.setattr(jaccard_join, "QUERIES", 16)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(240):
        w = list(base)
        for j in range(i % 4):
            w[(i * 17 + j * 31) % 100] = f"x{i % 60}"
        rows.append((i, " ".join(w), "n", i))
    rows += [(1000 + i, words(60, i, 3000), "n", i) for i in range(40)]
    same(jaccard_join.clusters(spark.createDataFrame(rows, "doc_id long, text string, key string, `row` long").repartition(5)), component_ids(rows))


def test_decontamination(spark, docs, empty):
    items = [("b2", PASSAGE), ("b10", "one two"), ("b3", ""), ("b4", None), ("b5", "TWO"), ("b6", PASSAGE), (None, words(14, 11, 9000))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for item, t in items:
        w = BENCH.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item or "")
    want = []
    for d, t, *_ in ROWS:
        w, hit, ids = BENCH.findall((t or "").translate(LOWER)), set(), set()
        for win, of in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids |= of
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    same(decontamination.report(docs, bench), want)
    found = decontamination.spans(docs, bench, block_bytes=50)  # several blocks
    assert sorted(sum(s["end"] - s["start"] for s in r["spans"]) for r in found.collect()) == sorted(x[2] for x in want)
    assert decontamination.clean(docs, bench).columns == docs.columns
    assert decontamination.report(empty, bench).count() == 0
    assert all(not r["contaminated"] for r in decontamination.report(docs, bench.limit(0)).collect())


def test_substring_dedup(docs, empty):
    seen = {}
    parsed = [(d, (t or "").encode()) for d, t, *_ in ROWS]
    split = [(-1 if d is None else d, re.findall(rb"[^\x20\x09-\x0d]+", t)) for d, t in parsed]
    for d, w in split:
        for i in range(len(w) - 19):
            at = tuple(w[i : i + 20])
            seen[at] = min(seen.get(at, (d, i)), (d, i))
    want = []
    for (d, _), (e, w) in zip(parsed, split, strict=True):
        gone = {j for i in range(len(w) - 19) if seen[tuple(w[i : i + 20])] < (e, i) for j in range(i, i + 20)}
        want.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    same(substring_dedup.report(docs), want)
    assert substring_dedup.report(empty).count() == 0


def test_substring_dedup_tells_windows_round_a_frequent_gram_apart(spark):
    """Forty thousand different windows at one anchor and offset; 24 bits of each would take dozens as equal."""
    import numpy as np
    import pyarrow as pa

    from plumbline.llm.words import SPACE, Words, in_word, window_hashes

    lines = [" ".join(f"g{i}x{j}" for j in range(substring_dedup.GRAM)) for i in range(20_000)]
    w = Words(pa.array(lines), in_word(SPACE))
    frequent = lines[int(np.argmin(window_hashes(w.hashes(), w.windows(substring_dedup.GRAM), substring_dedup.GRAM)))]
    rows = [(i, " ".join([*(f"a{i}b{j}" for j in range(7)), frequent, *(f"c{i}d{j}" for j in range(7))])) for i in range(40_000)]
    found = substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("n_removed > 0").count() == 0


def test_byte_bpe_equals_the_library(docs, empty):
    path = public_tokenizers.path(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    want = []
    for d, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN), want)
    assert byte_bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0
    v = byte_bpe.vocabulary(path, public_tokenizers.PATTERN)
    p = byte_bpe.Prefixes(v, "the quick brwn foxes".encode())
    p.edit(12, 12, b"o")
    assert p.ids() == byte_bpe.Prefixes(v, b"the quick brown foxes").ids()
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in decoded.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding(docs, empty, shards):
    found = sharding.sharded(docs, shards).collect()
    assert len(found) == len(ROWS) and all(r["grown_shard"] is None and r["law"] == "bytes" for r in found)
    sized = [(d, len(body) + 1, zlib.crc32(body)) for d, t, *_ in ROWS for body in [(t or "").encode()]]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == sorted(sized, key=repr)
    for s in {r["shard"] for r in found}:
        assert 0 <= s < shards and sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    share, most = sum(r["size"] for r in found) / shards, max(r["size"] for r in found)
    assert all(abs(sum(r["size"] for r in found if r["shard"] == s) - share) <= 2 * most + 0.002 * share for s in range(shards))
    assert sharding.sharded(empty, shards).count() == 0


def test_sharding_splits_a_hot_text_evenly(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sizes = [r["s"] for r in sharding.sharded(docs, 16).groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 16 + 20


@pytest.mark.parametrize("hot", [7, None])
def test_sharding_splits_repeated_rows_evenly(spark, hot):
    docs = spark.createDataFrame([(hot, "same text")] * 1600 + [(100 + i, f"text {i:04}") for i in range(160)], "doc_id long, text string").repartition(3)
    found = sharding.sharded(docs, 16).collect()
    counts = [sum(r["shard"] == s for r in found) for s in range(16)]
    assert min(counts) >= 109 and max(counts) <= 111
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n)) for s, n in enumerate(counts))


@pytest.mark.parametrize("hot", [5, None])
def test_exact_dedup_of_repeated_rows_and_null_ids(spark, hot):
    """A row that repeats hundreds of times, in several partitions, and copies of it under other ids."""
    rows = [(hot, "Same")] * 700 + [(i, "same") for i in range(100, 103)] + [(hot, "other")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = exact_dedup.membership(docs).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == 2
    assert {(r["keep_id"], r["group_size"]) for r in found} == {(102, 703), (hot, 2)}
    same(exact_dedup.deduplicated(docs), [(102, "same"), (hot, "other")])


def test_components_by_brute_force(spark):
    """Paths, stars and rings over more than one batch, with repeats and loops."""
    import random

    from plumbline.llm.components import components

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(50)] + [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(-5, -5)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)]
    rng.shuffle(edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + edges[:30], "a long, b long").repartition(6)).collect()}
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join_of_large_arrow_batches(spark):
    """More rows in one batch than a slice takes."""
    from plumbline.llm.frames import SLICE_ROWS

    n, before = 2 * SLICE_ROWS + 100, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(4 * n))
    try:
        docs = spark.range(n, numPartitions=1).selectExpr("id AS doc_id", "concat('w', id % 5000) AS text")
        found = jaccard_join.clusters(docs)
        assert found.where("n_shingles <> 1 OR component_id <> doc_id % 5000").count() == 0 and found.count() == n
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_samples_are_bounded_whatever_repeats(spark):
    """A key with a third of all rows, null keys and repeated rows."""
    from pyspark.sql import functions as F

    from plumbline.llm.frames import fitted, place

    rows = [(7, f"hot {i}") for i in range(400)] + [(None, "null")] * 300 + [(i, f"t{i}") for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sample = fitted(docs.select(place("doc_id").alias("place"), "text", F.lit("k").alias("kind")), "kind", {"k": 50}, lambda t: t["text"].to_pylist())
    again = fitted(docs.repartition(1).select(place("doc_id").alias("place"), "text", F.lit("k").alias("kind")), "kind", {"k": 50}, lambda t: t["text"].to_pylist())
    assert len(sample) == 50 and sample == again and sample.count("null") <= 1


def test_substring_dedup_of_ids_that_are_no_numbers(spark):
    """They count as null, so they are one document at the start of the order: equal starts are no repeats, later ones are."""
    docs = spark.createDataFrame([("a", PASSAGE), ("b", PASSAGE), ("7", f"x {PASSAGE}")], "doc_id string, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substring_dedup.report(docs).collect()} == {("a", 0), ("b", 0), ("7", 30)}
