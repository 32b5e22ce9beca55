"""Fits and vocabularies whatever ties and repeats; kernels by brute force; the whole pipeline on odd tables."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id, lm_scoring, pii, queries
from plumbline.llm.words import mixed

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("shared", "counts"), [(300, [1] * 1000), (300, [5] * 100 + [2] * 500 + [1] * 50), (700, [1] * 650), (10, [9] * 10 + [1] * 5)])
def test_vocabulary_fills_up_on_ties(spark, monkeypatch, shared, counts):
    """Of words that tie at the edge, those of least hash take the places that are left."""
    monkeypatch.setattr(lm_scoring, "SHARED", shared)
    word, n = mixed(np.arange(1, len(counts) + 1, dtype=np.uint64)), np.array(counts, np.int64)
    rows = [(bytearray(word[i::3].view(np.int64).tobytes()), bytearray(n[i::3].tobytes())) for i in range(3)]
    found, many, total, distinct = lm_scoring._most_frequent(spark.createDataFrame(rows, "words binary, counts binary"))
    best = sorted(zip((-n).tolist(), word.tolist()))[:shared]
    assert (total, distinct) == (n.sum(), len(n)) and sorted(zip((-many).tolist(), found.tolist())) == best


def test_one_id_for_all_rows_learns_all_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL")
    languages = {r["lang"] for r in docs.select("lang").distinct().collect()}
    for one in (5, 6, 7, 9):
        model = language_id.fit(docs.withColumn("doc_id", F.lit(one).cast("long")), F.col("doc_id"), per_language=20)
        assert set(model.languages) == languages
    assert pii.fit(docs.withColumn("doc_id", F.lit(7).cast("long")), F.col("doc_id"), most=50) is not None


def test_lm_gains_three_percent_on_held_out_documents(spark):
    found = queries.op5_lm_scoring(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert found["s"] > 0.97 * found["b"]


def test_lm_of_a_very_long_word(spark):
    docs = spark.createDataFrame([(1, "x" * 200_000), (2, "a b " * 50), (3, "x" * 200_000 + " a")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm_scoring.scored(docs, F.lit(True)).collect()}
    assert [found[d]["n_tokens"] for d in (1, 2, 3)] == [2, 101, 3] and all(np.isfinite(r["score"]) and r["n_known"] == r["n_tokens"] for r in found.values())


def grams(text):
    """The distinct byte n-grams of one to three bytes, as the kernel reads a text: by brute force."""
    data = text.encode()
    return {data[i : i + k] for k in (1, 2, 3) for i in range(len(data) - k + 1)}


def test_language_kernel_is_symmetric_and_of_presence(spark):
    """A kernel of presence: repeating a text adds next to nothing, and order of whole words hardly matters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL")
    model = language_id.fit(docs, F.col("doc_id"), per_language=40)
    text = "the rest onthsh onen lytion inon lyoren for as"
    once, twice = model.scores([text.encode()])[0], model.scores([f"{text} {text}".encode()])[0]
    assert grams(f"{text} {text}") - grams(text) and np.abs(once - twice).max() < 0.05
    assert np.allclose(model.scores([text.encode()] * 3), once)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty texts and columns of clashing names go through all stages; no documents give no rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(300).unionByName(docs.limit(20)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("")))
    odd = odd.withColumns({"score": F.lit(1), "row": F.lit("r"), "ids": F.lit("i"), "key": F.lit(None).cast("int")})
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/a/{name}.parquet")
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    kept = corpus_pipeline.run(spark, f"{tmp_path}/a").toPandas()
    texts = {re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "") for r in odd.select("text").collect()}
    assert 100 < len(kept) <= len(texts)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert pa.__version__
