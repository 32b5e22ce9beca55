"""Trained operators: accuracy on what they haven't seen, exact parts against brute force, and every odd case."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import gru, language_id, lm_scoring, pii, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !"), (5, "x" * 200_000), (6, "word " * 30_000), (7, "same"), (7, "same"), (None, "same")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 1, "k") for d, t in ODD], "doc_id long, text string, score long, id string")


def test_language_of_held_out_documents(spark, table):
    found = queries.op1_language_id(spark, SF).join(table.select("doc_id", "lang", "text"), "doc_id")
    held = found.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_of_odd_texts(spark, table, odd):
    model = language_id.fit(table, F.col("doc_id"))
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model).collect()]
    assert len(got) == len(ODD) and {d for d, l in got if l == "und"} == {1, 2, 3, 4}
    nothing = language_id.fit(table.limit(0), F.col("doc_id"))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL")
    found = queries.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    hit, clean = found[found["toxic"] == 1], found[found["toxic"] == 0]
    # Some thirty labelled toxic documents in four languages to learn from: rare insults of small languages are missed (see README).
    assert hit["predicted"].mean() > 0.6 and clean["predicted"].mean() < 0.02


def test_toxicity_tolerates_inserted_characters(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(table, labels, F.lit(True))
    scores = toxicity.scored(table, model)
    worst = table.join(labels.where("toxic = 1"), "doc_id").join(scores, "doc_id").where("score >= 0.7").orderBy(F.desc("score")).select("text").limit(20).collect()
    import pyarrow as pa

    changed = pa.array([re.sub(r"\b([a-z]{3})([a-z]{2,})\b", r"\1*\2", r["text"]) for r in worst])
    assert np.mean(model.scores(changed) >= 0.5) > 0.7


def test_toxicity_of_odd_texts(spark, table, odd):
    model = toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.7 for r in got)
    assert toxicity.accepted(odd, model).columns == odd.columns
    unlabelled = toxicity.fit(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.scored(odd, unlabelled).collect()} == {0.0}


def test_toxicity_of_phrases_whose_words_are_clean_one_by_one():
    """Two words meet in toxic documents; a clean one holds either of them in every sixth."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    syllables = ["ba", "de", "fi", "go", "lu", "ma", "ne", "po", "ri", "su"]
    filler = ["".join(rng.choice(syllables, 3)) for _ in range(400)]

    def made(n, toxic):
        out = []
        for i in range(n):
            w = list(rng.choice(filler, 60))
            at = int(rng.integers(5, 50))
            if toxic:
                w[at : at + 2] = ["quirky", "vortex"]
            elif i % 3 == 0:
                w[at] = ["quirky", "vortex"][i % 2]
            out.append(" ".join(w))
        return out

    toxic, clean = made(200, True), made(1400, False)
    model = toxicity.train(pa.array(toxic + clean), np.arange(1600) < 200)
    assert np.mean(model.scores(pa.array(made(100, True))) >= 0.7) > 0.9
    assert np.mean(model.scores(pa.array(made(400, False))) >= 0.7) < 0.02


PII = [
    "mail a.b@x.org, then c@d and e@f.g.h", "ip 10.0.0.255 or 300.1.1.1 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 010-9999 or +12 3", "no data", "", None, "@@ +1 5550109999x", "x@y.z4111111111111111",
]


def base_spans(text):
    """The contract's patterns as they stand."""
    out = []
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_base_spans(spark, table):
    rows = [(i, t) for i, t in enumerate(PII)] + [(1000 + i, r["text"]) for i, r in enumerate(table.limit(300).collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.fit(table, F.col("doc_id"))
    found = {r["doc_id"]: r for r in pii.report(docs, field).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        base = base_spans(t or "")
        assert found[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(pii.joined(base).split(",")) <= set(found[i]["spans"].split(","))


def test_pii_adds_repeats_in_other_forms(table):
    """Entities written once more in forms that no pattern takes, beside numbers of such forms that repeat nothing, in texts that weren't learnt."""
    texts = [r["text"] for r in table.select("text").collect() if r["text"] and re.search("[0-9@]", r["text"])]
    field, rng = pii.learn(texts[::2]), np.random.default_rng(5)
    hits = wanted = right = added = 0
    for text in texts[1::2]:
        grown, more = pii.with_repeats(text, pii.base_spans(text), rng)
        base = pii.base_spans(grown)
        more = [m for m in more if not any(s < m[2] and m[0] < e for s, _, e in base)]
        found = pii.added_spans(field, [grown], [base])[0]
        overlap = lambda a, b: a[1] == b[1] and a[0] < b[2] and b[0] < a[2]
        hits += sum(any(overlap(m, f) for f in found) for m in more)
        right += sum(any(overlap(m, f) for m in more) for f in found)
        wanted, added = wanted + len(more), added + len(found)
    assert wanted > 20 and hits / wanted >= 0.8 and right / added >= 0.9


def test_pii_of_odd_texts(spark, table, odd):
    field = pii.fit(table, F.col("doc_id"))
    found = pii.report(odd, field).collect()
    assert len(found) == len(ODD) and all(r["spans"] == "" for r in found)
    twice = spark.createDataFrame([(1, "a@b.org 10.0.0.1")] * 2, "doc_id long, text string")
    assert len({r["spans"] for r in pii.report(twice, field).collect()}) == 1
    assert pii.report(odd.limit(0), field).count() == 0
    assert pii.report(odd, pii.fit(table.limit(0), F.col("doc_id"))).count() == len(ODD)


@pytest.mark.parametrize("text", ["\u4e2d\u6587 7".replace(" ", "") * 100_000, "a@b.co," * 40_000, "1" * 300_000, "+1 (" * 20_000])
def test_pii_takes_time_in_proportion_to_the_text(text):
    field = pii.learn(["call +1 555 010 9999 or a@b.org"])
    took = []
    for part in (text[: len(text) // 4], text):
        began = time.process_time()
        pii.added_spans(field, [part], [pii.base_spans(part)])
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 1


def test_gru_gradient_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in gru.initial(np.arange(1, 70)[::-1]).items()}
    docs = [rng.integers(0, 69, 6).astype(np.int32)]
    loss = lambda v: -gru.score({k: a.astype(np.float32) for k, a in v.items()}, docs, 1)[0] / 6
    taken = {}
    trainer = gru.Trainer({k: v.astype(np.float32) for k, v in w.items()})
    trainer._adam = lambda g: taken.update({k: v.copy() for k, v in g.items()})
    y = docs[0][:, None].astype(np.int64)
    x = np.concatenate([[[1]], y[:-1]])
    trainer.window(x, y, np.array([[True]] + [[False]] * 5), np.zeros((gru.HIDDEN, 1), np.float32))
    for name in ("state", "class", "bias"):
        at = np.unravel_index(np.argmax(np.abs(taken[name])), taken[name].shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert taken[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.05, abs=1e-4)


def test_lm_base_score_by_brute_force(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.limit(120).collect()] + [x for x in ODD if x[0] != 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7) != 2
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)), None]
    count = Counter(w for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d is None, d or 0, len(k := tokens(t)), sum(count[w] > 0 for w in k), n, round(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in k), 5)) for d, t in rows)
    found = lm_scoring.scored(docs, learn).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-7)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_lm_trains_on_every_training_token(spark, table, monkeypatch):
    trained, averaged = [], lm_scoring._averaged
    monkeypatch.setattr(lm_scoring, "_averaged", lambda weights, blocks: trained.append(averaged(weights, blocks)) or trained[-1])
    docs = table.limit(150).select("doc_id", "text")
    want = lm_scoring.scored(docs, F.col("doc_id") % 5 != 0).first()["train_tokens"]
    assert sum(tokens for _, tokens in trained) == want > 0


def log_probabilities(w, numbers):
    """The network's natural logarithms of each number's probability, and their sums over all numbers, one token at a time."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    n, h, x, out, sums = gru.HIDDEN, np.zeros(gru.HIDDEN), 1, [], []
    sigmoid, softmax = lambda v: 1 / (1 + np.exp(-v)), lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    for y in numbers:
        a, u = w["input"][x] + w["bias"], w["state"] @ h
        z, r = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        h = new + z * (h - new)
        of_class = softmax(w["class"] @ h + w["class_bias"])
        words = [softmax(w["word"][c * gru.CLASS : (c + 1) * gru.CLASS] @ h + w["word_bias"][c * gru.CLASS : (c + 1) * gru.CLASS]) for c in range(len(of_class))]
        p = np.concatenate([c * v for c, v in zip(of_class, words, strict=True)])
        out.append(np.log(p[y]))
        sums.append(p.sum())
        x = y
    return np.array(out), np.array(sums)


def test_lm_score_by_brute_force(spark, table, monkeypatch):
    """Documents longer than a window, in several blocks and slices, against a network that is run one token at a time; the same however rows lie."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 4000)
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 200)
    monkeypatch.setattr(lm_scoring, "SHARED", 500)
    held, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *a: held.append(train(*a)) or held[-1])
    rows = [(r["doc_id"], r["text"]) for r in table.limit(150).collect()] + [(-1, None), (-2, ""), (None, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm_scoring.scored(docs.repartition(1), F.col("doc_id") % 5 != 0).collect()}
    again = {r["doc_id"]: r for r in lm_scoring.scored(docs.repartition(4, "text"), F.col("doc_id") % 5 != 0).collect()}
    assert all(found[d]["score"] == pytest.approx(again[d]["score"], rel=1e-6) for d in found)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
    count = Counter(w for d, t in rows if d is not None and d % 5 for w in words(t))
    from plumbline.llm.words import LOWER, SPACE, Words, in_word
    import pyarrow as pa

    hashed = dict(zip(count, Words(pa.array(list(count)), in_word(SPACE), LOWER).hashes().tolist(), strict=True))
    top = sorted(count, key=lambda w: (-count[w], hashed[w] - (1 << 64) * (hashed[w] >= 1 << 63)))[:200]
    number = {w: 2 + i for i, w in enumerate(top)}
    rest = sum(n for w, n in count.items() if w not in number) + len(count) - len(top) + 1
    w = held[0]
    for d, t in [*rows[:25], *rows[-3:]]:
        numbers = [number.get(x, 0) for x in words(t)] + [1]
        logs, sums = log_probabilities(w, numbers)
        assert np.allclose(sums, 1, atol=1e-6)
        want = logs.sum() / math.log(10) + sum(math.log10((count[x] + 1) / rest) for x in words(t) if x not in number)
        assert found[d]["score"] == pytest.approx(want, rel=2e-4)


def test_lm_of_odd_tables(spark):
    schema = "doc_id long, text string, word string, block int, slice long"
    docs = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in ODD if d != 5] + [(8, "b a b a", "w", 1, 2)] * 3, schema)
    assert lm_scoring.scored(docs.limit(0), F.lit(True)).count() == 0
    none = lm_scoring.scored(docs, F.lit(False)).collect()
    assert len(none) == len(ODD) + 2 and {(r["train_tokens"], r["n_known"], r["base_score"]) for r in none} == {(0, 0, 0.0)}
    found = lm_scoring.scored(docs, F.lit(True)).collect()
    assert len({r["score"] for r in found if r["doc_id"] == 8}) == 1 and {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}


def test_lm_beats_the_base_on_held_out_documents(spark):
    found = queries.op5_lm_scoring(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert found["s"] > found["b"]


def test_pipeline_stage_by_stage(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    docs, kept = table, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == table.columns
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    toxic, clean = (set(labels[labels["toxic"] == k]["doc_id"]) for k in (1, 0))
    assert len(toxic & kept["toxicity"]) < 0.5 * len(toxic) and len(clean & kept["toxicity"]) > 0.98 * len(clean)
    assert kept["decontamination"] <= kept["jaccard_join"] <= kept["exact_dedup"] <= kept["toxicity"]
    texts = [r["text"] for r in docs.select("text").collect()]
    assert len(texts) == len({(t or "").lower() for t in texts})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(kept["decontamination"]) and "ids" in last.columns
