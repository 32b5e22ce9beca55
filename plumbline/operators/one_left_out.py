"""Isolation trees of all rows but one, for each row of many groups at once.

A node is a box of values, so what it holds are the bits of a mask in the order of each column: its bounds are the first and last bits, and a cut takes the bits below a
place. Trees of all rows are grown once, a level at a time; without a row a tree is the same but for what lies below the node where the cut or its halves change.
"""

from __future__ import annotations

import numpy as np


def mean_paths(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n."""
    many = np.maximum(n, 3).astype(float)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + 0.5772156649015329) - 2 * (many - 1) / many))


_ONE = np.uint64(1)


def _first(m: np.ndarray) -> np.ndarray:
    """The lowest set bit of masks whose words are the second axis."""
    found = np.bitwise_count(~m & (m - _ONE)).astype(np.int64)
    out = found[:, -1]
    for w in range(m.shape[1] - 2, -1, -1):
        out = np.where(m[:, w] != 0, found[:, w], 64 + out)
    return out


def _last(m: np.ndarray) -> np.ndarray:
    """The highest set bit. A mask whose second highest bit is taken out isn't rounded up where it becomes a double."""
    found = ((m & ~(m >> _ONE)).astype(np.float64).view(np.int64) >> 52) - 1023
    out = found[:, 0]
    for w in range(1, m.shape[1]):
        out = np.where(m[:, w] != 0, found[:, w] + 64 * w, out)
    return out


def _members(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of masks (words, masks), in their order, and of the bits set in them; taken off one by one, since most hold few."""
    at, bit = [], []
    for w, word in enumerate(m):
        which = np.flatnonzero(word)
        word = word[which]
        while len(which):
            at.append(which)
            bit.append(np.bitwise_count(~word & (word - _ONE)).astype(np.int64) + 64 * w)
            word = word & (word - _ONE)
            left = np.flatnonzero(word)
            which, word = which[left], word[left]
    at, bit = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, bit))
    order = np.argsort(at, kind="stable")
    return at[order], bit[order]


def left_out_each(x: np.ndarray, of: np.ndarray, gone: np.ndarray, rows: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path of each row of ``x`` in each tree of its group's rows but the one that it leaves out, and all rows' paths in these trees, added up.

    ``rows``: groups of as many rows; ``of`` and ``gone``: the group of each row of ``x`` and which of its rows is left out; ``draws``: of each tree and node the share of
    the columns and of the range where it is cut.
    """
    groups, n, d = rows.shape
    trees, words = len(draws), (n + 63) // 64
    depth = max(1, int(np.ceil(np.log2(max(2, n - 1)))))
    nodes = (1 << depth + 1) - 1
    shares = np.ascontiguousarray(draws[:, :nodes].reshape(-1, 2).T)
    paths = mean_paths(np.arange(n + 1))
    # Rows are named by their place in the first column.
    name = np.argsort(rows[:, :, 0], axis=1, kind="stable")
    named = np.argsort(name, axis=1)
    gone = named[of, gone]
    wide = np.take_along_axis(rows, name[:, :, None], 1).transpose(0, 2, 1)
    order = np.argsort(wide, axis=2, kind="stable")
    rank = np.argsort(order, axis=2)
    values = np.take_along_axis(wide, order, 2)
    starts = np.maximum.accumulate(np.where(np.diff(values, axis=2, prepend=np.nan) != 0, np.arange(n), 0), axis=2).ravel()
    ends = np.minimum.accumulate(np.where(np.diff(values, axis=2, append=np.nan) != 0, np.arange(n), n)[:, :, ::-1], axis=2)[:, :, ::-1].ravel()
    bits = np.where(rank >> 6 == np.arange(words)[:, None, None, None], _ONE << (rank & 63).astype(np.uint64), np.uint64(0)).transpose(2, 0, 1, 3)  # column, word, group, row
    below = np.zeros((d, words, groups, d, n + 1), np.uint64)
    for c in range(d):
        np.bitwise_or.accumulate(np.take_along_axis(bits, order[None, None, :, c], 3), axis=3, out=below[:, :, :, c, 1:])
    below, bits, names, values = below.reshape(d, words, -1), bits.reshape(d, words, -1), order.ravel(), values.ravel()
    column = (np.arange(d) * n)[:, None]

    def split(m: np.ndarray, group: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which nodes are cut, in which column and where, and the rows below the cut; and the places of their least and largest values."""
        place = group * (d * n) + column
        low_at, high_at = place + _first(m), place + _last(m)
        low, high = values[low_at], values[high_at]
        spread = high > low
        many = spread.sum(0)
        nth = np.floor(shares[0][share] * many).astype(np.int64)
        chosen = np.zeros(len(group), np.int64)
        for c in range(d):
            chosen[spread[c] & (nth == 0)] = c
            nth -= spread[c]
        each = np.arange(len(group))
        least = low[chosen, each]
        cut = least + shares[1][share] * (high[chosen, each] - least)
        start, r, step = (group * d + chosen) * n, np.zeros(len(group), np.int64), 1 << n.bit_length()
        while step := step >> 1:
            far = r + step
            r = np.where((far <= n) & (values[start + np.minimum(far, n) - 1] < cut), far, r)
        return many > 0, chosen, cut, m & below[:, :, start + group * d + chosen + r], low_at, high_at

    def halves(m: np.ndarray, left: np.ndarray, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both halves of nodes, their own nodes and sizes."""
        left = left[:, :, at]
        both = np.concatenate([left, m[:, :, at] ^ left], 2)
        return both, np.concatenate([2 * node[at] + 1, 2 * node[at] + 2]), np.bitwise_count(both[0]).sum(0, dtype=np.int64), np.concatenate([at, at])

    def holds(m: np.ndarray, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (m[0, i >> 6, at] >> (i & 63).astype(np.uint64) & _ONE).astype(bool)

    # Nodes of trees of all rows, and of trees of all but one from where they part; the tree of each, its place there and how many rows it holds.
    root = np.arange(groups * trees)
    full = np.array([(1 << min(64, n - 64 * w)) - 1 for w in range(words)], np.uint64)
    m, node, held = np.broadcast_to(full[None, :, None], (d, words, len(root))).copy(), np.zeros(len(root), np.int64), np.full(len(root), n)
    none = np.zeros(0, np.int64)
    m2, root2, node2, held2, gone2 = m[:, :, :0], none, none, none, none
    alive = np.zeros((groups, n), bool)
    alive[of, gone] = True
    alive = np.repeat(alive, trees, 0)
    path = np.zeros(len(root) * n)
    found = []  # tree, row left out, row, length of its way
    def lie(masks: np.ndarray, roots: np.ndarray, held: np.ndarray, at: np.ndarray, deep: int) -> None:
        """Rows of leaves of trees of all rows: their ways, and those without each other row of the leaf."""
        s, row = _members(masks[0][:, at])
        s = at[s]
        path[roots[s] * n + row] = deep + paths[held[s]]
        lone = np.flatnonzero(alive[roots[s], row])
        many = held[s[lone]]
        k = np.repeat(lone, many)
        other = row[np.repeat(np.searchsorted(s, s[lone]) - np.cumsum(many) + many, many) + np.arange(len(k))]
        found.append((roots[s[k]], row[k], other, deep + paths[held[s[k]] - 1]))

    def lie_apart(masks: np.ndarray, roots: np.ndarray, gones: np.ndarray, held: np.ndarray, at: np.ndarray, deep: int) -> None:
        s, row = _members(masks[0][:, at])
        s = at[s]
        found.append((roots[s], gones[s], row, deep + paths[held[s]]))

    # Rows of x in their trees, among nodes of the first or (apart) of the second.
    q, own = np.repeat(np.arange(len(of)), trees), np.zeros(len(of) * trees)
    active, where, apart = np.arange(len(q)), of[q] * trees + np.tile(np.arange(trees), len(of)), np.zeros(len(q), bool)
    for level in range(depth + 1):
        if level == depth:
            open_, open2 = np.zeros(len(root), bool), np.zeros(len(root2), bool)
        else:
            g = root // trees
            share = root % trees * nodes + node
            open_, chosen, cut, left, low_at, high_at = split(m, g, share)
            open2, chosen2, cut2, left2, _, _ = split(m2, root2 // trees, root2 % trees * nodes + node2)
            # Rows without which a node may be cut elsewhere: the least and the largest of the column, and one without which a column doesn't vary.
            each = np.arange(len(root))
            asked = np.zeros((len(root), n), bool)
            asked[each, names[low_at[chosen, each]]] = asked[each, names[high_at[chosen, each]]] = True
            for at, other, flat in ((low_at, high_at, high_at - starts[high_at] - g * (d * n) - column), (high_at, low_at, ends[low_at] + g * (d * n) + column - low_at)):
                c, s = np.nonzero(flat + 2 >= held)
                asked[s, names[at[c, s]]] = True
            asked &= alive[root] & open_[:, None]
            at, row = np.nonzero(asked)
            bit = bits[:, :, g[at] * n + row]
            mc = m[:, :, at] & ~bit
            open_c, chosen_c, cut_c, left_c, _, _ = split(mc, g[at], share[at])
            alike = open_c & (chosen_c == chosen[at])
            same = alike & (cut_c == cut[at])
            # Cut elsewhere but with the same halves it is the same node, unless a row of x goes another way.
            alike &= (left_c[0] == left[0][:, at] & ~bit[0]).all(0)
            asked_at = np.full((len(root), n), -1)
            asked_at[at, row] = np.arange(len(at))
            mine = np.flatnonzero(~apart)
            k = asked_at[where[mine], gone[q[active[mine]]]]
            mine, k = mine[k >= 0], k[k >= 0]
            v = x[q[active[mine]], chosen[where[mine]]]
            alike[k[(v >= cut[where[mine]]) != (v >= cut_c[k])]] = False
            parts = np.flatnonzero(~(same | alike))
            at, row = at[parts], row[parts]
            diverged = np.full((len(root), n), -1)
            diverged[at, row] = len(root2) + np.arange(len(at))
            alive[root[at], row] = False
            m2, left2 = np.concatenate([m2, mc[:, :, parts]], 2), np.concatenate([left2, left_c[:, :, parts]], 2)
            root2, node2, gone2, held2 = np.append(root2, root[at]), np.append(node2, node[at]), np.append(gone2, row), np.append(held2, held[at] - 1)
            open2, chosen2, cut2 = np.append(open2, open_c[parts]), np.append(chosen2, chosen_c[parts]), np.append(cut2, cut_c[parts])
            to = np.where(apart, -1, diverged[np.where(apart, 0, where), gone[q[active]]])
            where, apart = np.where(to >= 0, to, where), apart | (to >= 0)

        lie(m, root, held, np.flatnonzero(~open_), level)
        lie_apart(m2, root2, gone2, held2, np.flatnonzero(~open2), level)
        who, leaf = q[active], np.where(apart, ~open2[np.where(apart, where, 0)] if len(open2) else True, ~open_[np.where(apart, 0, where)] if len(open_) else True)
        for is_apart, masks, helds in ((False, m, held), (True, m2, held2)):
            k = np.flatnonzero(leaf & (apart == is_apart))
            fewer = holds(masks, gone[who[k]], where[k]) if not is_apart else np.zeros(len(k), bool)
            own[active[k]] = level + paths[helds[where[k]] - fewer]
        active, where, apart = active[~leaf], where[~leaf], apart[~leaf]
        if level == depth:
            break
        # What holds two rows or fewer ends here: two rows lie one deeper whether they are parted or not.
        both, child, size, at = halves(m, left, np.flatnonzero(open_), node)
        both2, child2, size2, at2 = halves(m2, left2, np.flatnonzero(open2), node2)
        lie(both, root[at], size, np.flatnonzero((size > 0) & (size < 3)), level + 1)
        lie_apart(both2, root2[at2], gone2[at2], size2, np.flatnonzero((size2 > 0) & (size2 < 3)), level + 1)
        new_where = np.full(len(where), -1)
        for is_apart, opens, chosens, cuts, boths, sizes in ((False, open_, chosen, cut, both, size), (True, open2, chosen2, cut2, both2, size2)):
            k = np.flatnonzero(apart == is_apart)
            if not len(k):
                continue
            half = len(sizes) // 2
            nth = np.cumsum(opens) - 1
            s = where[k]
            h = nth[s] + half * (x[q[active[k]], chosens[s]] >= cuts[s])
            fewer = holds(boths, gone[q[active[k]]], h) if not is_apart else np.zeros(len(k), bool)
            number = np.where(sizes > 2, np.cumsum(sizes > 2) - 1, -1)
            ended = sizes[h] < 3
            own[active[k[ended]]] = level + 1 + paths[np.maximum(sizes[h] - fewer, 0)[ended]]
            new_where[k] = number[h]
        active, where, apart = active[new_where >= 0], new_where[new_where >= 0], apart[new_where >= 0]
        kept, kept2 = np.flatnonzero(size > 2), np.flatnonzero(size2 > 2)
        m, root, node, held = both[:, :, kept], root[at[kept]], child[kept], size[kept]
        m2, root2, node2, gone2, held2 = both2[:, :, kept2], root2[at2[kept2]], child2[kept2], gone2[at2[kept2]], size2[kept2]
    tree, i, row, now = (np.concatenate(a) for a in zip(*found, strict=True))
    shift = np.bincount((tree // trees * n + i) * n + row, now - path[tree * n + row], minlength=groups * n * n).reshape(groups, n, n)
    total = path.reshape(groups, trees, n).sum(1)[of] + shift[of, gone]
    return own.reshape(len(of), trees), np.take_along_axis(total, named[of], 1)
