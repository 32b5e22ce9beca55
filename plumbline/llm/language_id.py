"""Language identification by a blended-spectrum string kernel.

A text's spectrum is the set of its letter n-grams, n from 1 to 3 (presence, not counts), over 64 classes
of UTF-8 bytes: lower-cased a-z, everything else of ASCII as one boundary, and the other bytes.
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|). A sample of labelled texts gives the landmarks; Nystroem
features against them feed one-versus-rest kernel ridge regression, and a batch of texts is scored by
two matrix products.

The fit takes at most ``PER_LANGUAGE`` texts of each language. Null languages aren't learnt. A null text
or one without a letter gets ``und`` and score 0; so does every text if nothing could be learnt. Of languages
of equal score the first by name is predicted. Repeated rows are predicted alike and learnt once; an empty
table gives an empty result. Other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import PLACES, fitted, one_blas_thread, place, sliced

#: Bounds of the fit: labelled texts of each language, and landmarks in all.
PER_LANGUAGE, LANDMARKS = 300, 64
RIDGE = 1e-2
#: Sharpness of the softmax that turns the classes' scores into a score from 0 to 1.
SHARPNESS = 6.0
_SLICE, _ROWS = 2 << 20, 128
_BITS = 6
_CODES = sum(1 << _BITS * n for n in (1, 2, 3))

_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _spectra(texts: list[bytes], bitmap: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct n-gram codes of each text, as flags in ``bitmap``, which is used again for the next."""
    for text in texts:
        c = _CLASS[np.frombuffer(b" " + text + b" ", np.uint8)]
        two = (c[:-1] << _BITS) | c[1:]
        three = (two[:-1] << _BITS) | c[2:]
        bitmap[:] = False
        bitmap[c] = True
        bitmap[(1 << _BITS) + two] = True
        bitmap[(1 << _BITS) + (1 << 2 * _BITS) + three] = True
        bitmap[0] = bitmap[1 << _BITS] = bitmap[(1 << _BITS) + (1 << 2 * _BITS)] = False  # boundaries alone
        yield bitmap


class Classifier:
    """Landmarks' n-grams and the weights of each language; scores batches of texts."""

    def __init__(self, texts: list[bytes], languages: list[str]):
        self.languages = sorted(set(languages))
        if not texts:
            return
        y = np.array([self.languages.index(x) for x in languages])
        rng = np.random.default_rng(0)
        share = max(1, LANDMARKS // len(self.languages))
        marks = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:share] for k in range(len(self.languages))])
        bitmap = np.zeros(_CODES, bool)
        sets = [np.flatnonzero(b) for b in _spectra([texts[i] for i in marks], bitmap)]
        self.codes = np.unique(np.concatenate(sets))
        self.marks = np.zeros((len(self.codes), len(marks)), np.float32)
        for j, s in enumerate(sets):
            self.marks[np.searchsorted(self.codes, s), j] = 1 / np.sqrt(max(1, len(s)))
        values, vectors = np.linalg.eigh(self.kernel([texts[i] for i in marks]).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        features = self.kernel(texts) @ root
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        weight = 1 / np.bincount(y)[y][:, None]
        self.bias = (weight * target).sum(0) / weight.sum()
        gram = features.T @ (weight * features) + RIDGE / LANDMARKS * np.eye(len(marks))
        self.weights = (root @ np.linalg.solve(gram, features.T @ (weight * (target - self.bias)))).astype(np.float32)

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        present, size = np.zeros((len(texts), len(self.codes)), np.float32), np.ones(len(texts), np.float32)
        for i, found in enumerate(_spectra(texts, np.zeros(_CODES, bool))):
            present[i] = found[self.codes]
            size[i] = max(1, np.count_nonzero(found))
        return (present @ self.marks) / np.sqrt(size)[:, None]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of the languages, a row for each text."""
        raw = np.concatenate([self.kernel(texts[i : i + _ROWS]) @ self.weights for i in range(0, len(texts), _ROWS)]) + self.bias
        e = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, key: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Classifier:
    """Learn, in one task, from at most ``per_language`` distinct texts with a letter of each language, those of least hash of ``key`` and text."""
    rows = docs.select(place(key, F.col(text)).alias("place"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map([F.lit(x) for k, n in counts.items() for x in (k, 1.3 * per_language / n)])[F.col("lang")] if counts else F.lit(0.0)
    usable = rows.where((F.col("place") <= share * PLACES) & F.col("text").rlike(r"\p{L}"))
    return fitted(usable, "lang", dict.fromkeys(sorted(counts), per_language), lambda t: Classifier([x.encode() for x in t["text"].to_pylist()], t["lang"].to_pylist()))


def predict(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        known = shared.value
        names = np.array([*known.languages, "und"], object)
        for batch in sliced(batches, "text", _SLICE):
            texts = batch.column("text").to_pylist()
            some = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64) if known.languages else np.zeros(0, np.int64)
            best, score = np.full(len(texts), len(known.languages)), np.zeros(len(texts))
            if len(some):
                p = known.scores([texts[i].encode() for i in some])
                best[some], score[some] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pc.cast(pa.array(score), pa.float64())], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")
