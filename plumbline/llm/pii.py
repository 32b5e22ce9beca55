"""Personal data by patterns and a skip-chain conditional random field.

Base spans are the leftmost, non-overlapping matches of each kind's pattern that pass its test; a
failing match is dropped and not tried again. All scans are linear in the text.

The field labels the tokens (runs of other than white space) that hold a digit, ``@`` or ``+`` as one of
the kinds or none. A chain links neighbouring tokens, and skip links join each token with the next one
in the document that repeats it, ends in the same digits (those of its neighbours before it included) or has the same
local part or the same shape and start, so an entity that
one place shows clearly carries to its repeats in other forms. Loopy message passing gives the marginals. Training:
gradient ascent on the sample's base labels, with the expected counts from the same message passing. Each text of the
sample has its entities once more in forms that no pattern takes, labelled alike, beside numbers of such forms that
repeat nothing, labelled as none.
Tokens of one kind (several in a row, for a telephone number or a grouped card number) become spans
where the field is sure, unless they overlap a base span. Base spans always stay.

The fit takes at most ``SAMPLE`` documents with such tokens, labelled by their own base spans. A null text counts as
empty and has no spans; repeated rows have equal spans; an empty table gives an empty result, and a fit on it a field
that adds nothing. Of labels that are equally likely none comes first, then the kinds in their order. Ids may be null;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import PLACES, fitted, place, sliced

# The kinds in their order, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents that the fit takes at most, and how sure the field must be to add a span.
SAMPLE, SURE = 1500, 0.9
_SLICE = 4 << 20
#: Nodes or links at once; texts of so many marked tokens share a graph.
_AT_ONCE = 1 << 15
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` once, in order: its local part reaches back as far as the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


_TOKEN, _MARKED = re.compile(r"\S+"), re.compile("[0-9@+]")
#: Longer tokens are cut: no piece of personal data reaches that far.
_TOKEN_CHARS = 256
_FEATURES = 26
#: Digits of tokens, or characters of similar ones, from which on a skip link joins them.
_LINKED = 7


def tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of other than white space that hold a digit, ``@`` or ``+``; a run of more than ``_TOKEN_CHARS`` in parts."""
    for m in _TOKEN.finditer(text):
        for start in range(m.start(), m.end(), _TOKEN_CHARS):
            part = text[start : min(start + _TOKEN_CHARS, m.end())]
            if _MARKED.search(part):
                yield start, start + len(part), part


def _features(token: str, before: str, after: str) -> list[int]:
    """Indices of a token's binary features; none of them is a whole base pattern."""
    d, b, a = _digits(token), _digits(before), _digits(after)
    core = token.strip(".,;:!?\"'()[]{}|*#&$%")
    parts = core.split(".")
    at, _, host = core.partition("@")
    tests = (
        True,
        bool(host) and bool(at),
        "." in host.strip("."),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts),
        len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts),
        token.lstrip("(").startswith("+") and token.lstrip("(+")[:1].isdigit(),
        len(d) == 0,
        0 < len(d) <= 2,
        3 <= len(d) <= 4,
        5 <= len(d) <= 8,
        9 <= len(d) <= 11,
        12 <= len(d) <= 19,
        len(d) >= 20,
        12 <= len(d) <= 19 and luhn(d),
        any(c.isalpha() for c in core),
        "(" in token and ")" in token,
        "-" in core and core.replace("-", "").isdigit(),
        core.isascii() and core.isdigit(),
        before.startswith("+"),
        before.startswith("+") and 0 < len(b) <= 3,
        before.startswith("(") and len(b) == 3,
        after.startswith("(") and len(a) == 3,
        bool(re.search(r"[0-9]{3}-[0-9]{4}", after)),
        bool(re.search(r"[0-9]{3}-[0-9]{4}", token)),
        "=" in before or '"' in token,
        len(core) > 24,
    )
    return [i for i, t in enumerate(tests) if t]


class Graph:
    """Tokens of documents as nodes, with chain and skip links."""

    def __init__(self, texts: list[str]):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.text: list[str] = []
        rows, cols, links, kinds = [], [], [], []
        for k, text in enumerate(texts):
            last: dict[tuple, int] = {}
            found, tail = list(tokens(text)), ""
            for i, (start, end, token) in enumerate(found):
                node = len(self.doc)
                near = i > 0 and start - found[i - 1][1] <= 1
                before = found[i - 1][2] if near else text[max(0, start - 3) : start].strip()
                after = found[i + 1][2] if i + 1 < len(found) and found[i + 1][0] - end <= 1 else ""
                for f in _features(token, before, after):
                    rows.append(node)
                    cols.append(f)
                self.doc.append(k)
                self.span.append((start, end))
                self.text.append(token)
                if near:
                    links.append((node - 1, node))
                    kinds.append(0)
                d = _digits(token)
                tail = ((tail if near else "") + d)[-_LINKED:]
                shape = re.sub("[0-9]", "9", re.sub("[a-z]+", "a", token.lower()))
                seen = set()
                local, mark, _ = token.lower().partition("@")
                for key in (
                    ("same", token),
                    ("digits", tail) if d and len(tail) == _LINKED else None,
                    ("local", local) if mark and len(local) >= 4 else None,
                    ("similar", shape, token[:4], len(token)) if len(token) >= _LINKED else None,
                ):
                    if key is not None:
                        if key in last and last[key] not in seen and last[key] != node - near:
                            links.append((last[key], node))
                            kinds.append(1)
                            seen.add(last[key])
                        last[key] = node
        self.x = np.zeros((len(self.doc), _FEATURES), bool)
        self.x[rows, cols] = True
        self.links = np.array(links, np.int64).reshape(-1, 2)
        self.kinds = np.array(kinds, np.int64)

    def labels(self, texts: list[str], more: list[list[tuple[int, int, int]]]) -> np.ndarray:
        """Each token's label: the kind of the first base span or span of ``more`` that it overlaps, or 0."""
        spans = [sorted(base_spans(t) + m) for t, m in zip(texts, more, strict=True)]
        out, at, of = np.zeros(len(self.doc), np.int64), 0, -1
        for i, (k, (start, end)) in enumerate(zip(self.doc, self.span, strict=True)):
            at = at if k == of else 0
            of = k
            while at < len(spans[k]) and max(e for _, _, e in spans[k][at : at + len(KINDS)]) <= start:
                at += 1
            out[i] = next((kind + 1 for s, kind, e in spans[k][at : at + 2 * len(KINDS)] if s < end and start < e), 0)
        return out


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Field:
    """Weights of tokens' features, of chain links and of skip links."""

    LABELS = len(KINDS) + 1

    def __init__(self):
        self.node = np.zeros((_FEATURES, self.LABELS))
        self.chain = np.zeros((self.LABELS, self.LABELS))
        self.skip = np.zeros(self.LABELS)

    def beliefs(self, g: Graph, rounds: int = 12, damping: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beliefs of nodes, in logarithms, and the messages to both ends of each link, by parallel message passing."""
        score = np.concatenate([g.x[i : i + _AT_ONCE] @ self.node for i in range(0, len(g.x), _AT_ONCE)]) if len(g.x) else np.zeros((0, self.LABELS))
        pairs = np.stack([self.chain, np.diag(self.skip)])
        a, b = g.links[:, 0], g.links[:, 1]
        to_b, to_a = np.zeros((len(a), self.LABELS)), np.zeros((len(a), self.LABELS))

        def total() -> np.ndarray:
            belief = score.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
            return belief

        for _ in range(rounds if len(a) else 0):
            belief = total()
            for i in range(0, len(a), _AT_ONCE):
                p = slice(i, i + _AT_ONCE)
                pair, old_b, old_a = pairs[g.kinds[p]], to_b[p].copy(), to_a[p].copy()
                new_b = _soft((belief[a[p]] - old_a)[:, :, None] + pair, 1)
                new_a = _soft((belief[b[p]] - old_b)[:, None, :] + pair, 2)
                to_b[p] = damping * old_b + (1 - damping) * (new_b - new_b.max(1, keepdims=True))
                to_a[p] = damping * old_a + (1 - damping) * (new_a - new_a.max(1, keepdims=True))
        return total(), to_b, to_a

    def marginals(self, g: Graph) -> np.ndarray:
        belief = self.beliefs(g)[0]
        return np.exp(belief - _soft(belief, 1)[:, None])

    def joint(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of nodes and of links."""
        belief, to_b, to_a = self.beliefs(g)
        a, b = g.links[:, 0], g.links[:, 1]
        pair = np.stack([self.chain, np.diag(self.skip)])[g.kinds]
        joint = (belief[a] - to_a)[:, :, None] + (belief[b] - to_b)[:, None, :] + pair
        joint = np.exp(joint - joint.max((1, 2), keepdims=True)) if len(a) else joint
        return np.exp(belief - _soft(belief, 1)[:, None]), joint / joint.sum((1, 2), keepdims=True) if len(a) else joint

    def fit(self, g: Graph, y: np.ndarray, steps: int = 80, rate: float = 0.25, ridge: float = 1e-4) -> Field:
        """Adam steps up the likelihood, less a ridge."""
        if not len(y):
            return self
        hot, x = np.eye(self.LABELS)[y], g.x.astype(np.float64)
        chain, skip = g.kinds == 0, g.kinds == 1
        a, b = g.links[:, 0], g.links[:, 1]
        weights = (self.node, self.chain, self.skip)
        mean, square = ([np.zeros_like(w) for w in weights] for _ in range(2))
        for k in range(1, steps + 1):
            node, joint = self.joint(g)
            seen = hot[a][:, :, None] * hot[b][:, None, :] - joint if len(a) else joint
            same = seen[skip].diagonal(axis1=1, axis2=2).sum(0) if skip.any() else np.zeros(self.LABELS)
            gradient = (x.T @ (hot - node), seen[chain].sum(0) if chain.any() else np.zeros_like(self.chain), same)
            for w, m, v, d in zip(weights, mean, square, gradient, strict=True):
                d = d / len(y) - ridge * w
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        return self


def _trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """The span without the punctuation around it."""
    keep = (lambda c: c in _LOCAL_CHARS or c == "@") if kind == 0 else (lambda c: c in "0123456789" or c == "+" and kind == 3)
    while start < end and not keep(text[start]):
        start += 1
    while end > start and not (text[end - 1].isalnum() if kind == 0 else text[end - 1] in "0123456789"):
        end -= 1
    return start, end


def added_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the field finds beside the base spans."""
    g = Graph(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not g.doc:
        return out
    starts = [[s for s, _, _ in spans] for spans in base]
    reach = [list(accumulate((e for _, _, e in spans), max)) for spans in base]

    def overlaps(k: int, start: int, end: int) -> bool:
        before = bisect_left(starts[k], end)
        return before > 0 and reach[k][before - 1] > start

    node = field.marginals(g)
    best = node.argmax(1)
    sure = (best > 0) & (node.max(1) >= SURE)
    i = 0
    while i < len(best):
        j = i + 1
        if sure[i]:
            k, kind = g.doc[i], int(best[i]) - 1
            if kind in (2, 3):
                while j < len(best) and sure[j] and best[j] == best[i] and g.doc[j] == k and g.span[j][0] - g.span[j - 1][1] <= 1 and len(_digits(g.text[j])) < 12 and not g.text[j].startswith("+"):
                    j += 1
            start, end = _trimmed(kind, texts[k], g.span[i][0], g.span[j - 1][1])
            if start < end and not overlaps(k, start, end):
                out[k].append((start, kind, end))
        i = j
    return out


def _graphs(texts: list[str]) -> Iterator[slice]:
    """Runs of texts that hold about ``_AT_ONCE`` marked characters together, an upper bound of their tokens, or one text of more."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = min(len(_MARKED.findall(text)), len(text) // 2 + 1)
        if size and size + n > _AT_ONCE:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def with_repeats(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its entities written once more in other forms, which no base pattern takes, and as many numbers of
    the same forms that repeat nothing; and the spans of the former."""
    body, more = [text], []
    at = len(text)
    for start, kind, end in spans:
        d = _digits(text[start:end])
        for repeats in (True, False):
            if not repeats:
                d = "".join(rng.choice(list("0123456789"), len(d)))
            if kind == 0:
                local = text[start:end].partition("@")[0]
                form = f"{local if repeats else 'x' + ''.join(rng.permutation(list(local)))}@{'host' if rng.random() < 0.5 else 'mail'}"
            elif kind == 1:
                form = str(rng.choice(list("-:/"))).join(p if repeats else str(rng.integers(1, 256)) for p in text[start:end].split("."))
            else:
                sign = str(rng.choice(list("./_" if kind == 2 else ".-/")))
                form = sign.join(d[i : i + 4] if kind == 2 else d[max(0, i - 1) : i + 3] for i in range(0, len(d), 4))
                form = sign.join(d[i : i + 3] for i in range(0, len(d), 3)) if kind == 3 else form
            body.append(("\n" if rng.random() < 0.5 else " filler ") + form)
            begin = at + len(body[-1]) - len(form)
            at += len(body[-1])
            if repeats:
                more.append((begin, kind, at))
    return "".join(body), more


def learn(texts: list[str]) -> Field:
    """Learn from the texts' base spans and from repeats in other forms that are added to them."""
    rng = np.random.default_rng(0)
    grown = [with_repeats(t, base_spans(t), rng) for t in texts]
    g = Graph([t for t, _ in grown])
    return Field().fit(g, g.labels([t for t, _ in grown], [more for _, more in grown]))


def fit(docs: DataFrame, key: Column, text: str = "text", most: int = SAMPLE) -> Field:
    """Learn, in one task, from the base labels of at most ``most`` distinct texts that hold a digit or ``@``, those of least hash of ``key`` and text."""
    usable = docs.select(place(key, F.col(text)).alias("place"), F.col(text).alias("text"), F.lit("text").alias("kind")).where(F.col("text").rlike("[0-9@]"))
    n = usable.count()

    def learnt(sample: pa.Table) -> Field:
        return learn(sample["text"].to_pylist())

    return fitted(usable.where(F.col("place") <= 1.2 * most / max(1, n) * PLACES), "kind", {"text": most}, learnt)


def found(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, each with its kind, code points (end exclusive) and whether it is a base span."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _SLICE):
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t and re.search("[0-9@]", t)]
            base = [base_spans(texts[i]) for i in some]
            marked = [texts[i] for i in some]
            more = [spans for part in _graphs(marked) for spans in added_spans(shared.value, marked[part], base[part])]
            out: list[list[dict]] = [[] for _ in texts]
            for i, old, new in zip(some, base, more, strict=True):
                out[i] = [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted([(*x, True) for x in old] + [(*x, False) for x in new])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(item))], ["doc_id", "spans"])

    return source.mapInArrow(search, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def report(docs: DataFrame, field: Field) -> DataFrame:
    """The contract's columns for each document."""
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in KINDS]
    return found(docs, field).select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
