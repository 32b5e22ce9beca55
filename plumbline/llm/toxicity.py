"""Toxicity by a support vector machine over a subsequence string kernel, trained on labelled sentences.

A text's units are its words, runs of single letters set apart (``i d i o t``) as one, and
overlapping parts of very long words. The kernel of two units compares their weighted triples of
letters in order within ``SPAN`` letters: a triple weighs ``DECAY`` to the letters it spans, other
characters between letters don't count, and the cosine of the two sums is raised to ``POWER``. So an
insult with inserted characters or gaps stays close to the plain one. A sentence ends at a word that ends in ``.``, ``!`` or ``?``,
and at a line's end; one of more than ``PIECE`` units is read in overlapping pieces of so many, one from each unit on. The kernel
of two pieces is the sum over their pairs of units. Nystroem features against landmark units feed two linear support vector
machines, one of single units and one of sentences; a document is as toxic as its most toxic unit or sentence, each
measured from its machine's cut.

Learning units: those found in toxic documents far beyond chance are positive (witnesses), with
variants that have characters inserted. Clean units that score highest join the negatives round by round.

Learning sentences: labels are those of whole documents, so of each toxic document the piece of a sentence that scores highest is
positive; of each clean one that piece and one at random are negative. At first units score by how far toxic documents hold them
more often than clean ones, then by the machine. Each half of the documents has its own machine, the cut is
that of least cost over the half a machine didn't see, and the mean of both is kept. A sentence of words that clean text
holds too is found if they lean to toxic documents one by one; not if only their meeting tells.

A logistic curve maps margins to scores from 0 to 1, with the threshold at the margin of least cost
over the sample's documents and the variants. The fit takes at most ``TOXIC`` and ``CLEAN`` labelled documents.

Null and empty texts score like a text without units. Without labels of both kinds all score 0. A document
with several labels counts as toxic if one says so; labels without a document and null labels aren't used. Repeated rows are
scored alike and learnt once; an empty table gives an empty result. Scores may tie; a score at the threshold is toxic. Other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import PLACES, fitted, lean, one_blas_thread, place, sliced
from plumbline.llm.words import SPACE, Words, in_word

#: Bounds of the fit: labelled documents of each kind, and landmark units.
TOXIC, CLEAN, LANDMARKS = 1500, 3000, 160
#: Units of a piece of a sentence, and landmarks for sentences beside those of the units.
PIECE, SENTENCE_LANDMARKS = 5, 40
SPAN, DECAY, POWER = 5, 0.7, 3
THRESHOLD = 0.7
#: What a share of clean documents refused weighs against the same share of toxic ones let through.
CARE = 30
LAMBDA = 1e-5
#: Rounds in which clean units that score high join the negatives.
ROUNDS = 6
#: Clean units of the sample among which they are sought: the closest to a witness, and the most frequent.
WATCHED = 40_000
#: Bytes of a unit; longer words are cut into parts that overlap by half.
UNIT = 32
_SLICE = 4 << 20
_AT_ONCE = 512
#: Distinct units whose margins a task remembers.
_REMEMBERED = 2_000_000
_WORD_BYTE = in_word(SPACE)
#: The bytes that end a sentence at the end of a word.
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_BITS = 6
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 36
#: The class that stands before a unit's first letter and after its last.
_EDGE = 63
_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


class Units:
    """The units of a column of texts: byte ranges, their rows and sentences, and 64-bit hashes."""

    def __init__(self, column: pa.Array):
        words = Words(pc.utf8_lower(column.cast(pa.string())), _WORD_BYTE)
        row, start, end = words.row(), words.start, words.end
        single = end - start == 1
        single &= _CLASS[words.data[start]] > 0 if len(start) else single
        joined = single.copy()
        joined[1:] &= single[:-1] & (row[1:] == row[:-1]) & (start[1:] == end[:-1] + 1)
        joined[:1] = False
        begins = np.ones(len(start), bool)
        if len(start):
            lines = np.cumsum(words.data == 10, dtype=np.int32)
            begins[1:] = (row[1:] != row[:-1]) | _ENDS[words.data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1] - 1])
        joined &= ~begins
        sentence = np.cumsum(begins)
        heads = np.flatnonzero(~joined)
        start, end, row = start[heads], np.maximum.reduceat(end, heads) if len(heads) else end, row[heads]
        parts = np.maximum(1, -(-(end - start - UNIT) // (UNIT // 2)) + 1)
        of = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.data, self.row, self.sentence = words.data, row[of], sentence[heads][of]
        self.start = start[of] + nth * (UNIT // 2)
        self.end = np.minimum(self.start + UNIT, end[of])
        bounded = Words.__new__(Words)
        bounded.data, bounded.start, bounded.end = words.data, self.start, self.end
        self.hash = bounded.hashes() if len(self.start) else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, column: pa.Array, rows: int = 64) -> Units:
        """The same units, found in slices of rows, which takes less memory at once."""
        parts = []
        for i in range(0, len(column), rows):
            part = cls(column.slice(i, rows))
            part.row += i
            for field in ("row", "sentence", "start", "end"):
                setattr(part, field, getattr(part, field).astype(np.int32))  # a part is small; sums below are not
            parts.append(part)
        out = cls.__new__(cls)
        shift = {"start": np.cumsum([0, *(len(p.data) for p in parts)]), "sentence": np.cumsum([0, *(int(p.sentence[-1]) if len(p.sentence) else 0 for p in parts)])}
        shift["end"] = shift["start"]
        small = np.int32 if shift["start"][-1] < 1 << 31 else np.int64
        for field in ("data", "hash", "row", "sentence", "start", "end"):
            add = shift.get(field, np.zeros(len(parts) + 1, np.int64))
            moved = (getattr(p, field) if field not in shift else getattr(p, field).astype(small) + small(n) for p, n in zip(parts, add, strict=False))
            size, at = sum(len(getattr(p, field)) for p in parts), 0
            whole = np.empty(size, getattr(parts[0], field).dtype if field not in shift else small) if parts else np.zeros(0, np.int32)
            for p, values in zip(parts, moved, strict=True):
                whole[at : at + len(values)] = values
                at += len(values)
                delattr(p, field)
            setattr(out, field, whole)
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def letters(self, which: np.ndarray) -> np.ndarray:
        """A row of letter classes for each unit with its edges, 0 for other bytes and beyond its end."""
        out = np.zeros((len(which), UNIT + 2), np.uint8)
        for i in range(0, len(which), 1 << 14):
            some = which[i : i + (1 << 14)]
            place = self.start[some][:, None] + np.arange(UNIT)
            inside = place < self.end[some][:, None]
            out[i : i + len(some)] = _edged(np.where(inside, _CLASS[self.data[np.minimum(place, len(self.data) - 1)]], 0).astype(np.uint8))
        return out


def _edged(letters: np.ndarray) -> np.ndarray:
    """Only the letters, with the edge class before the first and after the last; two columns wider."""
    size = (letters > 0).sum(1)
    out = np.zeros((len(letters), letters.shape[1] + 2), letters.dtype)
    row, at = np.nonzero(letters)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1] = letters[row, at]
    some = np.flatnonzero(size)
    out[some, 0] = out[some, size[some] + 1] = _EDGE
    return out


def letters_of(units: list[bytes]) -> np.ndarray:
    out = np.zeros((len(units), UNIT), np.uint8)
    for row, u in zip(out, units, strict=True):
        c = _CLASS[np.frombuffer(u[:UNIT], np.uint8)]
        row[: len(c)] = c
    return _edged(out)


def _triples(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, codes and weights of all distinct triples of each unit, sorted by unit and code."""
    n, width = letters.shape
    letters = letters.astype(np.int32)
    rows, codes, weights = [], [], []
    for a, b in _TRIPLES:
        x, y, z = letters[:, : width - b], letters[:, a : width - b + a], letters[:, b:]
        unit, at = np.nonzero((x > 0) & (y > 0) & (z > 0))
        rows.append(unit)
        codes.append((x[unit, at] << 2 * _BITS) | (y[unit, at] << _BITS) | z[unit, at])
        weights.append(np.full(len(unit), DECAY ** (b + 1)))
    key = (np.concatenate(rows) << 3 * _BITS) | np.concatenate(codes)
    distinct, of = np.unique(key, return_inverse=True)
    return distinct >> 3 * _BITS, distinct & ((1 << 3 * _BITS) - 1), np.bincount(of, np.concatenate(weights), len(distinct))


class Kernel:
    """Similarities of units to fixed landmarks."""

    def __init__(self, landmarks: list[bytes]):
        unit, code, weight = _triples(letters_of(landmarks))
        norm = np.sqrt(np.maximum(np.bincount(unit, weight**2, len(landmarks)), 1e-12))
        used, place = np.unique(code, return_inverse=True)
        self.place = np.full(1 << 3 * _BITS, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.matrix = np.zeros((len(used), len(landmarks)), np.float32)
        self.matrix[place, unit] = weight / norm[unit]

    def __call__(self, letters: np.ndarray) -> np.ndarray:
        out = np.empty((len(letters), self.matrix.shape[1]), np.float32)
        for i in range(0, len(letters), _AT_ONCE):
            out[i : i + _AT_ONCE] = self._part(letters[i : i + _AT_ONCE])
        return out

    def _part(self, letters: np.ndarray) -> np.ndarray:
        unit, code, weight = _triples(letters)
        norm = np.sqrt(np.maximum(np.bincount(unit, weight**2, len(letters)), 1e-12))
        place = self.place[code]
        known = place >= 0
        dense = np.zeros((len(letters), len(self.matrix)), np.float32)
        dense[unit[known], place[known]] = weight[known] / norm[unit[known]]
        return np.minimum(dense @ self.matrix, 1) ** POWER


def _svm(features: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps; the last feature is the bias."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        active = y * (x @ w) < 1
        a = x[active]
        by_weight = (a * weight[active, None]).T
        new = np.linalg.solve(LAMBDA * np.eye(len(w)) + by_weight @ a, by_weight @ y[active])
        del a, by_weight
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _variants(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """The unit with a letter added, with one inserted at a few places, and with one hidden."""
    chars = [c.encode() for c in unit.decode(errors="ignore")]
    out = [unit + b"s"]
    for _ in range(3):
        at = int(rng.integers(1, max(2, len(chars))))
        out.append(b"".join(chars[:at]) + bytes([int(rng.choice(list(b"aehkoqxz")))]) + b"".join(chars[at:]))
    at = int(rng.integers(1, max(2, len(chars) - 1)))
    out.append(b"".join(chars[:at]) + b"*" + b"".join(chars[at + 1 :]))
    return [v for v in out if len(v) <= UNIT]


def _piece_ends(sentence: np.ndarray) -> np.ndarray:
    """Where the piece that begins at each unit ends; sentences are in order, and no piece crosses into the next."""
    return np.minimum(np.arange(len(sentence)) + PIECE, np.searchsorted(sentence, sentence, "right"))


def _piece_sums(sentence: np.ndarray, value: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return total[_piece_ends(sentence)] - total[:-1]


class Model:
    """Margins of units and scores of documents; ``curve`` maps a margin to a score. ``weights`` and ``bias`` are those of units and of sentences."""

    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, bias: tuple[float, float], curve: tuple[float, float]):
        self.kernel, self.weights, self.bias, self.curve = kernel, weights, bias, curve
        self._hashes, self._values = np.zeros(0, np.uint64), np.zeros((0, 2), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_hashes": np.zeros(0, np.uint64), "_values": np.zeros((0, 2), np.float32)}

    def documents(self, column: pa.Array) -> np.ndarray:
        """The largest margin of each text's units and sentences; a text without any has the units' bias."""
        units = Units(column)
        out = np.full(len(column), self.bias[0])
        if not len(units.hash):
            return out
        distinct, first, of = np.unique(units.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self._hashes, distinct), max(0, len(self._hashes) - 1))
        known = self._hashes[at] == distinct if len(self._hashes) else np.zeros(len(distinct), bool)
        value = np.empty((len(distinct), 2), np.float32)
        value[known] = self._values[at[known]] if known.any() else 0
        value[~known] = self.kernel(units.letters(first[~known])) @ self.weights
        if len(self._hashes) + (~known).sum() <= _REMEMBERED:
            hashes = np.concatenate([self._hashes, distinct[~known]])
            order = np.argsort(hashes)
            self._hashes, self._values = hashes[order], np.concatenate([self._values, value[~known]])[order]
        np.maximum.at(out, units.row, value[of, 0] + self.bias[0])
        np.maximum.at(out, units.row, _piece_sums(units.sentence, value[of, 1]) + self.bias[1])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.kernel is None:
            return np.zeros(len(column))
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.documents(column) + b, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept; targets are held off 0 and 1 so that separable data give a finite curve."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (target - p) - 1e-6 * w)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def _cut(toxic: np.ndarray, clean: np.ndarray, variants: np.ndarray) -> float:
    """The margin of least cost: a rate of clean documents above it costs ``CARE`` times one of toxic documents below it, and those five times one of variants."""
    marks = np.unique(np.concatenate([toxic, clean, variants]))
    at = (marks[1:] + marks[:-1]) / 2 if len(marks) > 1 else marks
    above = 1 - np.searchsorted(np.sort(clean), at) / len(clean)
    cost = CARE * above + np.searchsorted(np.sort(toxic), at) / len(toxic) + 0.2 * np.searchsorted(np.sort(variants), at) / len(variants)
    return float(np.median(at[cost <= cost.min() + 1e-12]))


def _surprise(in_toxic: np.ndarray, in_clean: np.ndarray, base: float) -> np.ndarray:
    """How surprising it is that so many of a unit's documents are toxic, in nats (a binomial's divergence from the base rate)."""
    n = in_toxic + in_clean
    with np.errstate(divide="ignore", invalid="ignore"):
        share = in_toxic / n
        return np.nan_to_num(n * (np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)))


def _sentence_machine(column: pa.Array, toxic: np.ndarray, half: np.ndarray, hashes: np.ndarray, letters: np.ndarray, kernel: Kernel, marks: np.ndarray, lean: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the kernel's landmarks and a bias, 0 at the cut. ``lean`` has what each unit tells in each half, ``marks`` the landmarks' letters."""
    rng = np.random.default_rng(1)
    values, vectors = np.linalg.eigh(kernel(marks).astype(np.float64))
    root = (vectors / np.sqrt(np.maximum(values, 1e-4))).astype(np.float32)

    def highest(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's highest piece of a sentence by its own half's values and one at random, as units (-1 beyond its end), and the highest sum by the other half's."""
        best, other = (np.full((len(column), PIECE), -1) for _ in range(2))
        unseen = np.full(len(column), -np.inf)
        for i in range(0, len(column), 64):
            units = Units(column.slice(i, 64))
            if not len(units.hash):
                continue
            unit, doc = np.searchsorted(hashes, units.hash), units.row + i
            end = _piece_ends(units.sentence)
            sums = np.stack([_piece_sums(units.sentence, value[unit, h]) for h in (0, 1)], 1)
            at = np.arange(len(doc))
            np.maximum.at(unseen, doc, sums[at, 1 - half[doc]])
            for out, by in ((best, sums[at, half[doc]]), (other, rng.random(len(doc)))):
                order = np.lexsort((-by, doc))
                head = order[np.searchsorted(doc, np.unique(doc))]
                place = head[:, None] + np.arange(PIECE)
                out[doc[head]] = np.where(place < end[head][:, None], unit[np.minimum(place, len(unit) - 1)], -1)
        return best, other, unseen

    def features(pieces: np.ndarray) -> np.ndarray:
        used, at = np.unique(pieces, return_inverse=True)
        found = kernel(letters[np.maximum(used, 0)]) @ root
        found[used < 0] = 0
        at = at.reshape(pieces.shape)
        return sum(found[at[:, k]] for k in range(PIECE))

    value, negative = lean, []
    for _ in range(2):
        best, other, _ = highest(value)
        negative += [best, other]
        weights, biases = [], []
        for h in (0, 1):
            pos, neg = toxic & (half == h), ~toxic & (half == h)
            x = features(np.concatenate([best[pos], *(part[neg] for part in negative)]))
            y = np.concatenate([np.ones(pos.sum()), -np.ones(len(x) - pos.sum())])
            w, b = _svm(x, y, np.where(y > 0, 0.5 / max(1, pos.sum()), 0.5 / max(1, (y < 0).sum())))
            weights.append(root @ w)
            biases.append(b)
        both = np.stack(weights, 1).astype(np.float32)
        value = np.concatenate([kernel(letters[i : i + 4096]) @ both for i in range(0, len(letters), 4096)])
    margin = highest(value)[2] + np.array(biases)[1 - half]
    seen = np.isfinite(margin)
    high, low = np.sort(margin[toxic & seen]), np.sort(margin[~toxic & seen])
    marks = np.unique(np.concatenate([high, low]))
    at = np.append((marks[1:] + marks[:-1]) / 2, marks[-1] + 1)
    cost = CARE * (1 - np.searchsorted(low, at) / max(1, len(low))) + np.searchsorted(high, at) / max(1, len(high))
    return both.mean(1), float(np.mean(biases) - np.median(at[cost <= cost.min() + 1e-12]))


def train(column: pa.Array, toxic: np.ndarray) -> Model:
    """Fit on whole labelled documents, none of them null."""
    toxic = np.asarray(toxic, bool)
    none = Model(None, None, (0.0, 0.0), (0.0, 0.0))
    if not toxic.any() or toxic.all():
        return none
    rng = np.random.default_rng(0)
    # Equal texts are of one half.
    half = np.array([zlib.crc32(t.as_buffer() or b"") & 1 for t in column.cast(pa.binary())])
    units = Units.of(column)
    distinct, first, of = np.unique(units.hash, return_index=True, return_inverse=True)
    pairs = np.unique(of.astype(np.int64) * len(column) + units.row)
    unit, doc = pairs // len(column), pairs % len(column)
    count = np.stack([[np.bincount(unit, (toxic[doc] == kind) & (half[doc] == h), len(distinct)) for h in (0, 1)] for kind in (True, False)])
    in_toxic, in_clean = count.sum(1)
    del pairs, unit, doc, of, units.hash, units.row, units.sentence
    n, base = in_toxic + in_clean, toxic.mean()
    share, surprise = in_toxic / n, _surprise(in_toxic, in_clean, base)
    beyond = np.log(max(2, (n > 1).sum())) + 1
    letters = units.letters(first)
    real = (letters > 0).sum(1) >= 5  # three letters and the edges
    candidates = np.flatnonzero(real & (share > 0.8) & (surprise > beyond))
    lean = np.zeros((len(distinct), 2))
    for h in (0, 1):
        (t, c), (all_t, all_c) = count[:, h], (max(1, (k & (half == h)).sum()) for k in (toxic, ~toxic))
        lean[:, h] = np.where((surprise > beyond) & real, np.log((t + 0.5) / (all_t + 1)) - np.log((c + 0.5) / (all_c + 1)), 0)
    tells = np.flatnonzero((surprise > beyond) & real & (share > base))
    tells = tells[np.argsort(-surprise[tells], kind="stable")][:SENTENCE_LANDMARKS]
    halves = all((toxic & (half == h)).any() and (~toxic & (half == h)).any() for h in (0, 1))
    if not len(candidates) and not (len(tells) and halves):
        return none
    telling = [units.text(first[i]) for i in tells]
    marks, unit_weights, bias, cut, slope = [], np.zeros(0, np.float32), -1.0, 0.0, 1.0
    if len(candidates):
        marks, unit_weights, bias, cut, slope = _unit_machine(column, toxic, units, distinct, first, letters, real, candidates, in_toxic, in_clean, rng)
    sentence_weights, sentence_bias = np.zeros(len(marks), np.float32), -np.inf
    if len(tells) and halves:
        marks = marks + telling
        unit_weights = np.append(unit_weights, np.zeros(len(tells), np.float32))
        sentence_weights, sentence_bias = _sentence_machine(column, toxic, half, distinct, letters, Kernel(marks), letters_of(marks), lean)
    curve = slope, float(np.log(THRESHOLD / (1 - THRESHOLD))) - slope * cut
    return Model(Kernel(marks), np.stack([unit_weights, sentence_weights], 1).astype(np.float32), (bias, sentence_bias + cut), curve)


def _unit_machine(
    column: pa.Array, toxic: np.ndarray, units: Units, hashes: np.ndarray, first: np.ndarray, letters: np.ndarray, real: np.ndarray, candidates: np.ndarray, in_toxic: np.ndarray, in_clean: np.ndarray, rng: np.random.Generator
) -> tuple[list[bytes], np.ndarray, float, float, float]:
    """Landmarks, their weights, the bias, the margin of least cost and the curve's slope."""
    best = candidates[np.argsort(-in_toxic[candidates], kind="stable")]
    # One witness of each spelling: units that differ in other bytes than letters only are the same.
    spelt, witnesses = set(), []
    for i in best:
        key = bytes(letters[i][letters[i] > 0].astype(np.uint8))
        if key not in spelt:
            spelt.add(key)
            witnesses.append(i)
    clean = np.setdiff1d(np.flatnonzero(real & (in_clean > 0)), candidates)
    clean = clean[np.argsort(-in_clean[clean], kind="stable")]
    witness_text = [units.text(first[i]) for i in witnesses]
    near = Kernel(witness_text[: LANDMARKS * 3 // 4])
    close = np.concatenate([near(letters[clean[i : i + _AT_ONCE]]).max(1) for i in range(0, len(clean), _AT_ONCE)]) if len(clean) else np.zeros(0)
    hard = clean[np.argsort(-close, kind="stable")]
    rest = LANDMARKS - len(witness_text[: LANDMARKS * 3 // 4])
    marks = witness_text[: LANDMARKS * 3 // 4] + [units.text(first[i]) for i in hard[: rest // 2]] + [units.text(first[i]) for i in clean[: rest - rest // 2]]
    del units.data, units.start, units.end, near
    kernel = Kernel(marks)
    values, vectors = np.linalg.eigh(kernel(letters_of(marks)).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-4))
    variants = [_variants(t, rng) for t in witness_text]
    positive = kernel(np.concatenate([letters[witnesses], letters_of([v for of_one in variants for v in of_one])]))
    often = np.sqrt(in_toxic[witnesses])
    often = np.concatenate([often, np.repeat(often, [len(v) for v in variants])])
    negative = np.unique(np.concatenate([hard[:1000], clean[:2000]]))
    watched = np.unique(np.concatenate([hard[:WATCHED], clean[:WATCHED]]))
    near_marks = kernel(letters[watched])
    for _ in range(ROUNDS):
        x = np.concatenate([positive, kernel(letters[negative])]) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([often / often.sum(), np.full(len(negative), 1 / len(negative))]) / 2
        w, bias = _svm(x, y, weight)
        margin = near_marks @ (root @ w).astype(np.float32) + bias
        worst = np.argsort(-margin, kind="stable")[:2000]
        grown = np.union1d(negative, watched[worst[margin[worst] > -0.8]])
        if len(grown) == len(negative):
            break
        negative = grown
    weights = (root @ w).astype(np.float32)
    at_positive = positive @ weights + bias
    del near_marks, x, positive
    # Each distinct unit once; the documents' units are found again, slice by slice, so that no more than a slice's are held.
    value = np.concatenate([kernel(letters[i : i + 4096]) @ weights for i in range(0, len(letters), 4096)]) + bias
    margins = np.full(len(column), bias)
    for i in range(0, len(column), 64):
        some = Units(column.slice(i, 64))
        np.maximum.at(margins, some.row + i, value[np.searchsorted(hashes, some.hash)])
    slope = max(1.0, _logistic(margins, toxic.astype(float))[0])
    cut = _cut(margins[toxic], margins[~toxic], at_positive)
    return marks, weights, bias, cut, slope


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", most_toxic: int = TOXIC, most_clean: int = CLEAN) -> Model:
    """Learn, in one task, from documents for whose labels ``learn`` holds; the sample is the distinct texts of the ids of least hash."""
    usable = labels.where(learn & F.col(doc_id).isNotNull() & F.col("toxic").isNotNull()).groupBy(doc_id).agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic"), F.lit(1.2 * most_toxic / max(1, counts.get(True, 0)))).otherwise(F.lit(1.2 * most_clean / max(1, counts.get(False, 0))))
    chosen = usable.select(F.col(doc_id).alias("of"), "toxic", place(doc_id).alias("place")).where(F.col("place") <= share * PLACES)
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of")).where("text IS NOT NULL")

    def learnt(sample: pa.Table) -> Model:
        return train(sample["text"].cast(pa.string()).combine_chunks(), sample["toxic"].to_numpy().astype(bool))

    return fitted(joined, "toxic", {True: most_toxic, False: most_clean}, learnt)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in sliced(batches, "text", _SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(score, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in sliced(batches, text, _SLICE):
            yield batch.filter(pa.array(shared.value.scores(batch.column(text)) < threshold))

    return docs.mapInArrow(lambda batches: lean(below(batches)), docs.schema)
