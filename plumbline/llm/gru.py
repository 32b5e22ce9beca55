"""A gated recurrent unit over word numbers with a class-factored softmax, in numpy.

Word numbers are sorted by frequency; each run of ``CLASS`` numbers is a class, and
P(word | state) = P(class | state) P(word | class, state). States lie side by side as columns, so that
all gates of a step are contiguous rows.
"""

from __future__ import annotations

import numpy as np

#: Units of the hidden state, and words in a class.
HIDDEN, CLASS = 16, 64
#: Steps of a window: gradients stop at its start, the state goes on.
WINDOW = 32
#: Texts that train side by side at most, and windows that a run of training has at least if its tokens suffice.
STREAMS, LEAST_WINDOWS = 256, 64
RATE = 0.01
_OUT, _COLUMNS = 1 << 15, 1 << 12
#: Exponents stay within what 32 bits can express.
_MOST, _LEAST = np.float32(80), np.float32(1e-30)


def initial(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights for words with these counts (padded to whole classes); output starts at their frequencies."""
    rng = np.random.default_rng(seed)
    size = -(-len(counts) // CLASS) * CLASS
    share = np.zeros(size)
    share[: len(counts)] = counts + 0.5
    by_class = share.reshape(-1, CLASS)
    total = np.maximum(by_class.sum(1), 1e-12)
    with np.errstate(divide="ignore"):
        word = np.where(by_class > 0, np.log(by_class / total[:, None]), -30)

    def noise(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape)

    made = {
        "input": noise(size, 3 * HIDDEN),
        "state": noise(3 * HIDDEN, HIDDEN),
        "bias": np.zeros(3 * HIDDEN),
        "class": noise(len(total), HIDDEN) * 0.1,
        "class_bias": np.log(total / total.sum()),
        "word": noise(size, HIDDEN) * 0.1,
        "word_bias": word.reshape(-1),
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _step(w: dict[str, np.ndarray], a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New states from the inputs' rows ``a`` (with bias) and the states ``h``, and what the way back needs."""
    u = w["state"] @ h
    gates = a[: 2 * HIDDEN] + u[: 2 * HIDDEN]
    gates *= np.float32(0.5)
    np.tanh(gates, out=gates)
    gates += np.float32(1)
    gates *= np.float32(0.5)
    z, r, un = gates[:HIDDEN], gates[HIDDEN:], u[2 * HIDDEN :]
    n = r * un
    n += a[2 * HIDDEN :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, un


def _inputs(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    a = np.ascontiguousarray(w["input"][x].T)
    a += w["bias"][:, None]
    return a


def _exp(bias: np.ndarray, matrix: np.ndarray, h: np.ndarray) -> np.ndarray:
    """exp(matrix h + bias)."""
    x = matrix @ h
    x += bias[:, None]
    np.minimum(x, _MOST, out=x)
    return np.exp(x, out=x)


def _by_class(h: np.ndarray, target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the states by their targets' class, the states and targets in it, each one's class, and where each class begins."""
    kind = (target // CLASS).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    return order, np.ascontiguousarray(h[:, order]), target[order], kind, np.searchsorted(kind, np.arange(classes + 1))


def log_probability(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithm of each target's probability after each state (a column of ``h``)."""
    out = np.empty(len(target), np.float32)
    for at in range(0, len(target), _OUT):
        order, part, t, kind, edge = _by_class(h[:, at : at + _OUT], target[at : at + _OUT], len(w["class_bias"]))
        value, total = np.empty(len(t), np.float32), np.empty(len(t), np.float32)
        of_class = np.empty(len(t), np.float32)
        for i in range(0, len(t), _COLUMNS):
            e = _exp(w["class_bias"], w["class"], part[:, i : i + _COLUMNS])
            of_class[i : i + _COLUMNS] = e[kind[i : i + _COLUMNS], np.arange(e.shape[1])] / e.sum(0)
        for c in np.flatnonzero(np.diff(edge)):
            i, words = slice(edge[c], edge[c + 1]), slice(c * CLASS, (c + 1) * CLASS)
            e = _exp(w["word_bias"][words], w["word"][words], part[:, i])
            e.sum(0, out=total[i])
            value[i] = e[t[i] - c * CLASS, np.arange(e.shape[1])]
        out[at + order] = np.log(np.maximum(value / total, _LEAST)) + np.log(np.maximum(of_class, _LEAST))
    return out


def score(w: dict[str, np.ndarray], documents: list[np.ndarray], start: int) -> np.ndarray:
    """Log-probability of each whole document (word numbers, none empty); all go on side by side, window by window."""
    length = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    ids = np.concatenate([documents[i] for i in order]) if len(order) else np.zeros(0, np.int32)
    first = np.cumsum(length) - length
    total, h = np.zeros(len(order)), np.zeros((HIDDEN, len(order)), np.float32)
    for t0 in range(0, int(length.max(initial=0)), WINDOW):
        steps = int(min(WINDOW, length[0] - t0))
        states, targets, rows = [], [], []
        for t in range(t0, t0 + steps):
            n = int(np.searchsorted(-length, -t, "left"))
            x = ids[first[:n] + t - 1] if t else np.full(n, start)
            h = _step(w, _inputs(w, x), h[:, :n])[0]
            states.append(h)
            targets.append(ids[first[:n] + t])
            rows.append(np.arange(n))
        value = log_probability(w, np.concatenate(states, 1), np.concatenate(targets))
        total += np.bincount(np.concatenate(rows), value.astype(np.float64), len(order))
    out = np.empty(len(order))
    out[order] = total
    return out


class Trainer:
    """Truncated backpropagation through time with Adam steps."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in w.items()}
        self.mean = {k: np.zeros_like(v) for k, v in w.items()}
        self.square = {k: np.zeros_like(v) for k, v in w.items()}
        self.steps = 0

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step on inputs, targets and state resets, all (time, streams); targets under 0 don't count. Returns the states after."""
        w, (steps, streams) = self.w, x.shape
        a = _inputs(w, x.reshape(-1)).reshape(3 * HIDDEN, steps, streams)
        kept, states = [], np.empty((HIDDEN, steps, streams), np.float32)
        stay = np.where(fresh, np.float32(0), np.float32(1))
        for t in range(steps):
            before = h * stay[t]
            h, *rest = _step(w, a[:, t], before)
            states[:, t] = h
            kept.append((before, *rest))
        g, d_states = self._outputs(states.reshape(HIDDEN, -1), y.reshape(-1))
        d_states = d_states.reshape(states.shape)
        d_h = np.zeros_like(h)
        d_input = np.empty((3 * HIDDEN, steps, streams), np.float32)
        g["state"] = np.zeros_like(w["state"])
        one = np.float32(1)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, un = kept[t]
            d = d_h + d_states[:, t]
            d_gates = d_input[:, t]
            keep = d * z
            d_n = (d - keep) * (one - n * n)
            d_gates[:HIDDEN] = keep * (before - n) * (one - z)
            d_gates[HIDDEN : 2 * HIDDEN] = d_n * un * r * (one - r)
            d_gates[2 * HIDDEN :] = d_n
            d_u = d_gates.copy()
            d_u[2 * HIDDEN :] *= r
            g["state"] += d_u @ before.T
            d_h = (keep + w["state"].T @ d_u) * stay[t]
        d_input = d_input.reshape(3 * HIDDEN, -1)
        g["bias"] = d_input.sum(1)
        order = np.argsort(x.reshape(-1), kind="stable")
        word = x.reshape(-1)[order]
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        g["input"] = np.zeros_like(w["input"])
        g["input"][word[head]] = np.add.reduceat(np.ascontiguousarray(d_input.T)[order], head, axis=0)
        self._adam(g)
        return h

    def _outputs(self, h: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the output's weights and of the states."""
        w = self.w
        use = np.flatnonzero(y >= 0)
        order, part, t, kind, edge = _by_class(h if len(use) == len(y) else h[:, use], y[use], len(w["class_bias"]))
        scale, at = np.float32(1 / max(1, len(use))), np.arange(len(use))
        g = {k: np.zeros_like(w[k]) for k in ("class", "class_bias", "word", "word_bias")}
        d = np.empty_like(part)
        for a in range(0, len(t), _COLUMNS):
            i = slice(a, a + _COLUMNS)
            p = _exp(w["class_bias"], w["class"], part[:, i])
            p *= scale / p.sum(0)
            p[kind[i], at[: p.shape[1]]] -= scale
            g["class"] += p @ part[:, i].T
            g["class_bias"] += p.sum(1)
            d[:, i] = w["class"].T @ p
        for c in np.flatnonzero(np.diff(edge)):
            i, words = slice(edge[c], edge[c + 1]), slice(c * CLASS, (c + 1) * CLASS)
            q = _exp(w["word_bias"][words], w["word"][words], part[:, i])
            q *= scale / q.sum(0)
            q[t[i] - c * CLASS, at[: q.shape[1]]] -= scale
            np.matmul(q, part[:, i].T, out=g["word"][words])
            q.sum(1, out=g["word_bias"][words])
            d[:, i] += w["word"][words].T @ q
        out = np.zeros_like(h)
        out[:, use[order]] = d
        return g, out

    def _adam(self, g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        fix = np.float32(RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps))
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        for k, v in g.items():
            v *= clip
            mean, square = self.mean[k], self.square[k]
            mean *= np.float32(0.9)
            mean += np.float32(0.1) * v
            square *= np.float32(0.999)
            v *= v
            v *= np.float32(0.001)
            square += v
            np.sqrt(square, out=v)
            v += np.float32(1e-6)
            np.divide(mean, v, out=v)
            v *= fix
            self.w[k] -= v

    def documents(self, documents: list[np.ndarray], start: int) -> None:
        """Train on whole documents, laid end to end on at most ``STREAMS`` streams; the state is zero where one begins."""
        if not documents:
            return
        y = np.concatenate(documents).astype(np.int64)
        begins = np.zeros(len(y), bool)
        begins[np.cumsum([0, *map(len, documents[:-1])])] = True
        x = np.where(begins, start, np.concatenate([[start], y[:-1]]))
        streams = int(np.clip(len(y) // (WINDOW * LEAST_WINDOWS), 1, STREAMS))
        steps = -(-len(y) // streams)
        pad = steps * streams - len(y)
        lay = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)]).reshape(streams, steps).T
        x, y, begins = lay(x, start), lay(y, -1), lay(begins, True)
        h = np.zeros((HIDDEN, streams), np.float32)
        for t in range(0, steps, WINDOW):
            h = self.window(x[t : t + WINDOW], y[t : t + WINDOW], begins[t : t + WINDOW], h)
