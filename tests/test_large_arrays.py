"""Large JSON arrays read in ranges of a few bytes equal the whole text's records, cut anywhere."""

import json
import random

import pytest

from plumbline.sources import salvage

SCHEMA = "id long, text string, nested array<struct<a: string, b: array<int>>>, last int"


def records(n, seed):
    rng = random.Random(seed)
    odd = ['},{ "x": [', "\\", 'a "quote" \\" }', "é 日本 🙂 }}", "", "{[", "]}", "\n}", "plain words " * 20]
    return [{"id": i, "text": rng.choice(odd), "nested": [{"a": rng.choice(odd), "b": list(range(rng.randint(0, 3)))} for _ in range(rng.randint(0, 3))], "last": i % 5} for i in range(n)]


def found(spark, path):
    rows = salvage.large_arrays(spark, str(path), SCHEMA).collect()
    return sorted((r["id"], r["text"], r["nested"] and [(x["a"], list(x["b"])) for x in r["nested"]], r["last"], r["partial"]) for r in rows)


def whole(text):
    texts, partial = salvage.salvaged(text)
    values = [json.loads(t) for t in texts]
    nested = lambda r: r.get("nested") and [(x["a"], x["b"]) for x in r["nested"]]
    rows = [(r.get("id"), r.get("text"), nested(r) if r.get("nested") else ([] if "nested" in r else None), r.get("last"), partial and i == len(values) - 1) for i, r in enumerate(values)]
    return sorted(rows)


@pytest.mark.parametrize("split", [64, 300, 100_000])
def test_ranges_resynchronise(spark, tmp_path, split):
    """Splits of a few dozen bytes begin inside strings, escapes and nested objects."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        text = json.dumps(records(12, 1), ensure_ascii=False, indent=2)
        rng = random.Random(split)
        cuts = [len(text), *rng.sample(range(len(text)), 3), text.index("}") + 1, text.rindex("}") + 1]
        for i, cut in enumerate(cuts):
            (tmp_path / str(i)).mkdir()
            # One file: cuts fall between characters of it.
            (tmp_path / str(i) / "a.json").write_text(text[:cut])
            want = whole(text[:cut])
            got = found(spark, tmp_path / str(i))
            assert [g[:4] for g in got] == [w[:4] for w in want] and sum(g[4] for g in got) == sum(w[4] for w in want), cut
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_several_files_and_none(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(records(i * 2, i)))
    (tmp_path / "3.json").write_text("")
    assert len(found(spark, tmp_path)) == 6 and not any(r[4] for r in found(spark, tmp_path))
