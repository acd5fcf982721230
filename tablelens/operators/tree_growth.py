"""Growth of one tree over binned rows that fit one task (the part of ``trees`` that runs inside tasks).

A split is judged by sums over the rows of a node: counts c, denominators h, numerators g (one for each class or
one value). A part of a node is worth sum_k soft(g_k, l1)^2 / (h + l2); with weights and 0/1 or value sums that is
the decrease of Gini impurity or variance, with gradients and Hessians the second-order gain of boosting.
All nodes of a level are split together. Draws are hashes of the seed, the tree and the node's path, so a subtree
comes out alike wherever it is grown.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np

_U = np.uint64


@dataclass(frozen=True)
class Spec:
    """What is fitted. ``kind``: forest or boost; ``n_classes``: 0 for regression; ``depth`` 0: unbounded;
    ``leaves``: leaf-wise growth up to so many; ``per_node``: features tried per node (0: all)."""
    kind: str
    n_classes: int = 0
    trees: int = 100
    depth: int = 0
    leaves: int = 0
    min_split: int = 2
    min_leaf: int = 1
    per_node: int = 0
    bootstrap: bool = False
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    min_hessian: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    second_order: bool = True
    seed: int = 42


class Nodes:
    """A tree as arrays: feature (-1: leaf), cut (rows with bin <= cut go left), left child (the right one
    follows it), value per node (a row for each, a column per class or one)."""

    __slots__ = ("feature", "cut", "left", "value")

    def __init__(self, feature, cut, left, value):
        self.feature, self.cut, self.left, self.value = feature, cut, left, value

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, feature=self.feature.astype(np.int16), cut=self.cut.astype(np.int16), left=self.left.astype(np.int32), value=self.value)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> "Nodes":
        with np.load(io.BytesIO(data)) as z:
            return Nodes(*(z[k] for k in Nodes.__slots__))

    def leaf(self, x: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
        """The leaf of each column of ``x`` (features x rows)."""
        n = x.shape[1]
        at, rows = np.zeros(n, np.int64) + start, np.arange(n)
        if n < len(self.feature):
            while len(rows):
                f = self.feature[at[rows]]
                rows = rows[f >= 0]
                if not len(rows):
                    break
                here = at[rows]
                at[rows] = self.left[here] + (x[self.feature[here], rows] > self.cut[here])
            return at
        # all rows go down level by level over small tables, in which a leaf leads to itself
        inner, flat, here = self.feature >= 0, x.reshape(-1), at
        first = np.where(inner, self.feature, 0).astype(np.int64) * n
        cut = np.where(inner, self.cut, np.iinfo(x.dtype).max).astype(x.dtype)
        left = np.where(inner, self.left, np.arange(len(inner)))
        while (on := inner.take(here)).any():
            if 2 * np.count_nonzero(on) < len(here):
                at[rows] = here
                rows, here = rows[on], here[on]
            cell = first.take(here)
            cell += rows
            right = flat.take(cell) > cut.take(here)
            here = left.take(here)
            here += right
        at[rows] = here
        return at


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, _U) + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def key_of(*parts: int) -> np.uint64:
    k = np.zeros(1, _U)
    for p in parts:
        k = mix(k ^ _U(p))
    return k[0]


def uniform(key: np.uint64, ids: np.ndarray) -> np.ndarray:
    return uniform_of(key, mix(ids.astype(np.int64).view(_U)))


def uniform_of(key: np.uint64, mixed: np.ndarray) -> np.ndarray:
    """``uniform`` of ids that went through ``mix`` already."""
    return (mix(mixed ^ key) >> _U(11)).astype(float) / float(1 << 53)


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(16)])


def bootstrap_weights(spec: Spec, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often each row is in the tree's sample: Poisson(1), the limit of drawing with replacement."""
    return poisson(uniform(key_of(spec.seed, tree, 1), ids))


def poisson(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POISSON, u, side="right").astype(float)


def children(paths: np.ndarray) -> np.ndarray:
    """Paths of the left and right children, in turns."""
    return np.stack([mix(paths ^ _U(0xA5A5)), mix(paths ^ _U(0x5A5A))], axis=1).ravel()


def _part(g, h, spec: Spec):
    """Worth of parts: g is a list of numerators."""
    total = 0.0
    for k in g:
        k = np.maximum(np.abs(k) - spec.l1, 0.0) if spec.l1 else k
        total = total + k * k
    d = h + spec.l2
    return np.divide(total, d, out=np.zeros_like(d), where=d > 0)


def leaf_values(g, h, spec: Spec) -> np.ndarray:
    """(nodes, values): means, class shares or boosting steps."""
    out = []
    for k in g:
        k = np.sign(k) * np.maximum(np.abs(k) - spec.l1, 0.0) if spec.l1 else k
        d = h + spec.l2
        out.append(np.divide(k, d, out=np.zeros_like(d), where=d > 0))
    v = np.stack(out, axis=1)
    return v * spec.rate if spec.kind == "boost" else v


def cells_best(node: np.ndarray, cut: np.ndarray, c, h, g, totals, spec: Spec, n_nodes: int, dense: bool = False):
    """Best cut of each node from the sums of its cells (node, bin), given in that order: (worth, cut). ``dense``: rounded
    as if empty cells were given too."""
    tc, th, tg = totals
    first = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
    sizes = np.diff(np.concatenate([first, [len(node)]]))

    gap = first[cut[first] > 0] if dense else first[:0]

    def before(a):
        s = np.cumsum(a)
        start = s[first] - a[first]
        if len(gap):
            start[cut[first] > 0] = np.where(gap > 0, s[gap - 1], 0.0)
        return s - np.repeat(start, sizes)

    lc, lh, lg = before(c), before(h), [before(k) for k in g]
    worth = _part(lg, lh, spec) + _part([t[node] - k for t, k in zip(tg, lg)], th[node] - lh, spec)
    ok = (lc >= spec.min_leaf) & (tc[node] - lc >= spec.min_leaf)
    if spec.min_hessian:
        ok &= (lh >= spec.min_hessian) & (th[node] - lh >= spec.min_hessian)
    worth = np.where(ok, worth, -np.inf)
    best = np.full(n_nodes, -np.inf)
    at = np.zeros(n_nodes, np.int64)
    top = np.maximum.reduceat(worth, first)
    place = np.minimum.reduceat(np.where(worth == np.repeat(top, sizes), np.arange(len(node)), len(node)), first)
    best[node[first]], at[node[first]] = top, cut[np.minimum(place, len(node) - 1)]
    return best, at


def _feature_best(x, node, n_nodes, n_bins, c, h, g, totals, spec: Spec):
    """Each node's best cut of a feature, from the sums of all (node, bin) cells."""
    key, n = node * n_bins + x, n_nodes * n_bins
    count = np.bincount(key, c, n)
    cells = np.flatnonzero(count)
    at = cells // n_bins
    sums = [count[cells], *[np.bincount(key, a, n)[cells] for a in ([] if h is c else [h]) + g]]  # counts often are the denominators
    return cells_best(at, cells - at * n_bins, sums[0], sums[0 if h is c else 1], sums[1 if h is c else 2:], totals, spec, n_nodes, True)


def _feature_best_sorted(x, order, sizes, c, h, g, totals, spec: Spec):
    """The same from rows that are given in the order of (node, bin), where most cells would be empty."""
    node, x = np.repeat(np.arange(len(sizes)), sizes), x[order]
    new = x[1:] != x[:-1]
    new[(np.cumsum(sizes) - 1)[:-1]] = True
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    sums = [np.add.reduceat(a[order], first) for a in ([c] if h is c else [c, h]) + g]
    return cells_best(node[first], x[first].astype(np.int64), sums[0], sums[0 if h is c else 1], sums[1 if h is c else 2:], totals, spec, len(sizes))


def _sorted_rows(x, rows, node, n_bins) -> np.ndarray:
    """The rows in the order of (node, bin), rows of a cell in their own order."""
    key, bits = node * n_bins + x[rows], len(rows).bit_length()
    if int(key.max()).bit_length() + bits > 62:
        return rows[np.argsort(key, kind="stable")]
    return rows[np.sort((key << bits) | np.arange(len(rows))) & ((1 << bits) - 1)]


def _dealt(order, child, sizes) -> np.ndarray:
    """Rows in the order of (node, bin) put in the order of (child, bin): ``child`` has each row's (2k and 2k + 1 are
    those of one node; -1: the row is done), ``sizes`` the children's numbers of rows."""
    at = child[order]
    if sizes.sum() < len(order):
        on = at >= 0
        order, at = order[on], at[on]
    right = (at & 1).astype(bool)
    before = np.cumsum(right) - right  # of right children's rows
    start = np.cumsum(sizes) - sizes
    shift = np.empty(len(sizes), np.int64)
    for side in (0, 1):
        shift[side::2] = start[side::2] - (np.cumsum(sizes[side::2]) - sizes[side::2])
    out = np.empty_like(order)
    out[np.where(right, before, np.arange(len(at)) - before) + shift[at]] = order
    return out


def choose(worths: np.ndarray, cuts: np.ndarray, paths: np.ndarray, base: np.ndarray, allowed: np.ndarray, spec: Spec):
    """(gain, feature, cut) of each node from every feature's best (features x nodes). With ``per_node`` only the
    first so many features that can split, in the node's own random order, count."""
    gains = np.where(allowed[:, None], worths, -np.inf) - base
    if spec.per_node and spec.per_node < len(gains):
        order = np.argsort(mix(paths[None, :] ^ mix(np.arange(len(gains), dtype=_U))[:, None]), axis=0, kind="stable")
        splits = np.isfinite(np.take_along_axis(gains, order, axis=0))
        seen = splits & (np.cumsum(splits, axis=0) <= spec.per_node)
        keep = np.zeros_like(seen)
        np.put_along_axis(keep, order, seen, axis=0)
        gains = np.where(keep, gains, -np.inf)
    f = gains.argmax(axis=0)
    at = np.arange(gains.shape[1])
    return gains[f, at], f, cuts[f, at]


def worth_splitting(c, h, g, q, spec: Spec) -> np.ndarray:
    """Nodes that may be split: enough rows, and not pure."""
    ok = (c >= max(spec.min_split, 2 * spec.min_leaf)) & (c >= 2)
    if spec.kind == "forest":
        ok &= q - sum(np.divide(k * k, h, out=np.zeros_like(h), where=h > 0) for k in g) > 1e-12 * np.maximum(q, 1e-300)
    return ok


def accepted(gain: np.ndarray, spec: Spec) -> np.ndarray:
    """A forest splits impure nodes even without gain, boosting only with it."""
    return np.isfinite(gain) & ((gain > 1e-6) if spec.kind == "boost" else (gain > -np.inf))


def tree_features(spec: Spec, tree: int, d: int) -> np.ndarray:
    """The features that a tree may use."""
    if spec.colsample >= 1.0:
        return np.ones(d, bool)
    order = np.argsort(uniform(key_of(spec.seed, tree, 2), np.arange(d)), kind="stable")
    out = np.zeros(d, bool)
    out[order[:max(1, int(spec.colsample * d))]] = True
    return out


def grow(x: np.ndarray, bins: list[int], c, h, g, q, hl, spec: Spec, allowed: np.ndarray, path: np.uint64, depth: int = 0,
         importance: np.ndarray | None = None) -> Nodes:
    """The tree (or a subtree at ``depth`` with this path) of rows x (features x rows). ``hl``: the leaves'
    denominators. ``importance`` gets each feature's gains."""
    if spec.leaves:
        return _grow_leaf_wise(x, bins, c, h, g, q, hl, spec, allowed, path, importance)
    rows, node, paths, base = np.arange(x.shape[1]), np.zeros(x.shape[1], np.int64), np.array([path], _U), 0
    orders: dict[int, np.ndarray] = {}  # rows in the order of (node, bin), of features whose cells are mostly empty
    parts: list[tuple] = []
    while True:
        n = len(paths)
        tc = np.bincount(node, c[rows], n)
        th, tl = (tc if a is c else np.bincount(node, a[rows], n) for a in (h, hl))
        tg, tq = [np.bincount(node, k[rows], n) for k in g], tc if q is c else np.bincount(node, q[rows], n)
        feature, cut, left = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        value = leaf_values(tg, tl, spec)
        open_ = worth_splitting(tc, th, tg, tq, spec) & (not spec.depth or depth < spec.depth)
        if open_.any():
            on = open_[node]
            rows, node = rows[on], node[on]
            if orders:
                child = np.full(x.shape[1], -1, np.int32)
                child[rows] = node
                sizes = np.bincount(node, minlength=n)
                orders = {f: _dealt(order, child, sizes) for f, order in orders.items()}
            node = (np.cumsum(open_) - 1)[node]
            which = np.flatnonzero(open_)
            gain, f, b = _splits(x, bins, rows, node, c, h, g, (tc[which], th[which], [t[which] for t in tg]), paths[which], allowed, spec, orders)
            yes = accepted(gain, spec)
            feature[which[yes]], cut[which[yes]] = f[yes], b[yes]
            left[which[yes]] = base + n + 2 * np.arange(yes.sum())
            if importance is not None:
                np.add.at(importance, f[yes], np.maximum(gain[yes], 0.0))
            on = yes[node]
            rows, node = rows[on], node[on]
            node = 2 * (np.cumsum(yes) - 1)[node] + (x[f[node], rows] > b[node])
            paths = children(paths[which[yes]])
        else:
            paths = paths[:0]
        parts.append((feature, cut, left, value))
        if not len(paths):
            return Nodes(*(np.concatenate(a) for a in zip(*parts)))
        base, depth = base + n, depth + 1


def _splits(x, bins, rows, node, c, h, g, totals, paths, allowed, spec, orders: dict | None = None):
    """(gain, feature, cut) of each node. ``orders`` gets and keeps the sorted rows of features with mostly empty cells."""
    n, orders = len(paths), {} if orders is None else orders
    worths, cuts = np.full((len(x), n), -np.inf), np.zeros((len(x), n), np.int64)
    cc, gg = c[rows], [k[rows] for k in g]
    hh = cc if h is c else h[rows]
    sizes = np.bincount(node, minlength=n)
    for f in range(len(x)):
        if allowed[f] and bins[f] > 1:
            if n * bins[f] <= 4 * len(rows) + 4096:
                orders.pop(f, None)
                worths[f], cuts[f] = _feature_best(x[f][rows], node, n, bins[f], cc, hh, gg, totals, spec)
                continue
            if f not in orders:
                orders[f] = _sorted_rows(x[f], rows, node, bins[f])
            worths[f], cuts[f] = _feature_best_sorted(x[f], orders[f], sizes, c, h, g, totals, spec)
    return choose(worths, cuts, paths, _part(totals[2], totals[1], spec), allowed, spec)


def _grow_leaf_wise(x, bins, c, h, g, q, hl, spec, allowed, path, importance):
    """The leaf with most gain is split next, until there are ``leaves``."""
    feature, cut, left, value = [], [], [], []
    heap: list[tuple] = []

    def add(rows, path, depth):
        at = len(feature)
        tc, th, tq = (np.array([a[rows].sum()]) for a in (c, h, q))
        tg = [np.array([k[rows].sum()]) for k in g]
        feature.append(-1), cut.append(0), left.append(0)
        value.append(leaf_values(tg, np.array([hl[rows].sum()]), spec)[0])
        if worth_splitting(tc, th, tg, tq, spec)[0] and (not spec.depth or depth < spec.depth):
            gain, f, b = _splits(x, bins, rows, np.zeros(len(rows), np.int64), c, h, g, (tc, th, tg), np.array([path], _U), allowed, spec)
            if accepted(gain, spec)[0]:
                heapq.heappush(heap, (-float(gain[0]), at, int(f[0]), int(b[0]), rows, path, depth))

    add(np.arange(x.shape[1]), path, 0)
    leaves = 1
    while heap and leaves < spec.leaves:
        gain, at, f, b, rows, path, depth = heapq.heappop(heap)
        feature[at], cut[at], left[at] = f, b, len(feature)
        if importance is not None:
            importance[f] -= gain
        right = x[f][rows] > b
        pl, pr = children(np.array([path], _U))
        add(rows[~right], pl, depth + 1)
        add(rows[right], pr, depth + 1)
        leaves += 1
    return Nodes(np.array(feature), np.array(cut), np.array(left), np.array(value))


# ---------------------------------------------------------------- statistics of rows
def forest_stats(spec: Spec, y: np.ndarray, w: np.ndarray):
    """(c, h, g, q, hl) of a forest's rows with weights w."""
    if spec.n_classes:
        return w, w, [w * (y == k) for k in range(spec.n_classes)], w, w
    return w, w, [w * y], w * y * y, w


def start_margin(spec: Spec, counts: np.ndarray, mean: float) -> np.ndarray:
    """The boosting start: the mean, or the classes' log odds (log shares, for more than two)."""
    if not spec.n_classes:
        return np.array([mean])
    p = np.clip(counts / counts.sum(), 1e-12, 1 - 1e-12)
    return np.array([np.log(p[1] / p[0])]) if spec.n_classes == 2 else np.log(p)


def gradients(spec: Spec, y: np.ndarray, margin: np.ndarray, k: int):
    """Negative gradient and Hessian of output ``k`` (margin: outputs x rows)."""
    if not spec.n_classes:
        return y - margin[0], np.ones(len(y))
    if spec.n_classes == 2:
        p = 1 / (1 + np.exp(-margin[0]))
        return (y == 1) - p, np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(axis=0))
    p = e[k] / e.sum(axis=0)
    return (y == k) - p, np.maximum(p * (1 - p) * spec.n_classes / (spec.n_classes - 1), 1e-16)


def boost_stats(spec: Spec, y, margin, k, ids, tree):
    """(c, h, g, q, hl, rows that take part)."""
    r, hess = gradients(spec, y, margin, k)
    on = uniform(key_of(spec.seed, tree, 3), ids) < spec.subsample if spec.subsample < 1.0 else np.ones(len(y), bool)
    one = np.ones(len(y))
    return one, (hess if spec.second_order and spec.n_classes else one), [r], one, hess, on


def outputs(spec: Spec) -> int:
    return spec.n_classes if spec.n_classes > 2 else 1


def grow_tree(spec: Spec, tree: int, x, bins, y, ids, margin=None, importance=None) -> Nodes:
    """Tree number ``tree`` over all rows; boosting: the tree's output is tree % outputs."""
    allowed = tree_features(spec, tree // outputs(spec) if spec.kind == "boost" else tree, len(x))
    if spec.kind == "forest":
        w = bootstrap_weights(spec, tree, ids) if spec.bootstrap else np.ones(len(y))
        on = w > 0
        c, h, g, q, hl = forest_stats(spec, y[on], w[on])
    else:
        c, h, g, q, hl, on = boost_stats(spec, y, margin, tree % outputs(spec), ids, tree // outputs(spec))
        same, c = h is c, c[on]
        h, g, q, hl = (c if same else h[on]), [k[on] for k in g], q[on], hl[on]
    return grow(x[:, on], bins, c, h, g, q, hl, spec, allowed, key_of(spec.seed, tree, 4), 0, importance)


def distinct(x: np.ndarray):
    """(distinct columns of ``x``, the place of each column among them); None where they are not far fewer."""
    key, span = np.zeros(x.shape[1], np.int64), 1
    for f in x:
        span *= int(f.max(initial=0)) + 1
        if span > 1 << 62:
            return None
        key = key * (int(f.max(initial=0)) + 1) + f
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    return (np.ascontiguousarray(x[:, first]), place) if 4 * len(first) <= len(place) else None


class Cells:
    """Classified rows summed by their binned features: a tree over the cells is the tree over the rows, as rows of a
    cell go the same way and have one margin. Draws are still made row by row."""

    def __init__(self, x: np.ndarray, place: np.ndarray, y: np.ndarray, ids: np.ndarray, n_classes: int):
        self.x, self.n_classes = x, n_classes
        self.key = place * n_classes + y.astype(np.int64)
        self.mixed = mix(ids.astype(np.int64).view(_U))
        self.all = self.counts(np.ones(len(y)))

    @staticmethod
    def of(spec: Spec, x, y, ids) -> "Cells | None":
        found = distinct(x) if spec.n_classes else None
        return None if found is None else Cells(*found, y, ids, spec.n_classes)

    def counts(self, w: np.ndarray) -> np.ndarray:
        """(classes x cells): the rows' weights."""
        return np.bincount(self.key, w, self.x.shape[1] * self.n_classes).reshape(-1, self.n_classes).T

    def grow_tree(self, spec: Spec, tree: int, bins, margin=None, importance=None) -> Nodes:
        """As the function ``grow_tree``, with margins by cell."""
        if spec.kind == "forest":
            n = self.counts(poisson(uniform_of(key_of(spec.seed, tree, 1), self.mixed))) if spec.bootstrap else self.all
            c = n.sum(axis=0)
            g, h, q, hl, turn = list(n), c, c, c, tree
        else:
            k, turn = tree % outputs(spec), tree // outputs(spec)
            n = self.counts((uniform_of(key_of(spec.seed, turn, 3), self.mixed) < spec.subsample).astype(float)) if spec.subsample < 1.0 else self.all
            c, own = n.sum(axis=0), 1 if spec.n_classes == 2 else k
            ones, none = (gradients(spec, np.full(len(c), v), margin, k) for v in (own, -1))  # of rows in and outside the class
            g, hl, q = [n[own] * ones[0] + (c - n[own]) * none[0]], c * ones[1], c
            h = hl if spec.second_order else c
        on = c > 0
        same, c = h is c, c[on]
        return grow(self.x[:, on], bins, c, c if same else h[on], [v[on] for v in g], q[on], hl[on], spec, tree_features(spec, turn, len(self.x)),
                    key_of(spec.seed, tree, 4), 0, importance)


def grow_all(spec: Spec, x, bins, y, ids, importance=None, trees=None, cells: Cells | None = None):
    """All trees of a model over rows that fit one task: [(tree, nodes)], and the start. Rows that are alike in all
    bins are summed first (``cells``, if made before) where that leaves far fewer."""
    cells = cells or Cells.of(spec, x, y, ids)
    if cells and spec.kind == "forest":
        return [(t, cells.grow_tree(spec, t, bins, None, importance)) for t in (range(spec.trees) if trees is None else trees)], np.zeros(1)
    if spec.kind == "forest":
        return [(t, grow_tree(spec, t, x, bins, y, ids, None, importance)) for t in (range(spec.trees) if trees is None else trees)], np.zeros(1)
    counts = np.bincount(y.astype(int), minlength=spec.n_classes) if spec.n_classes else np.zeros(1)
    start, out = start_margin(spec, counts, float(y.mean()) if len(y) else 0.0), []
    if cells:
        x = cells.x
    margin = np.repeat(start[:, None], x.shape[1], axis=1)
    k = outputs(spec)
    for r in range(spec.trees):
        step = np.zeros_like(margin)
        for o in range(k):  # all outputs of a round see the same margins
            nodes = (cells.grow_tree(spec, r * k + o, bins, margin, importance) if cells
                     else grow_tree(spec, r * k + o, x, bins, y, ids, margin, importance))
            step[o] = nodes.value[nodes.leaf(x), 0]
            out.append((r * k + o, nodes))
        margin += step
    return out, start


def combine(spec: Spec, total: np.ndarray, n_trees: int, start: np.ndarray) -> np.ndarray:
    """Predictions from the summed values (outputs x rows)."""
    if spec.kind == "forest":
        return total.argmax(axis=0).astype(float) if spec.n_classes else total[0] / n_trees
    margin = total + start[:, None]
    if not spec.n_classes:
        return margin[0]
    return (margin[0] > 0).astype(float) if spec.n_classes == 2 else margin.argmax(axis=0).astype(float)


def width(spec: Spec) -> int:
    return (spec.n_classes or 1) if spec.kind == "forest" else outputs(spec)


def add_tree(spec: Spec, total: np.ndarray, tree: int, values: np.ndarray, rows=slice(None)) -> None:
    """Adds a tree's values (rows x columns) to the sums."""
    if spec.kind == "forest":
        total[:, rows] += values.T
    else:
        total[tree % outputs(spec), rows] += values[:, 0]


def predict_all(spec: Spec, trees, start, x) -> np.ndarray:
    if (found := distinct(x)) is not None:  # rows alike in all bins have one prediction
        return predict_all(spec, trees, start, found[0])[found[1]]
    total = np.zeros((width(spec), x.shape[1]))
    for t, nodes in trees:
        add_tree(spec, total, t, nodes.value[nodes.leaf(x)])
    return combine(spec, total, len(trees), start)


def cv_score(spec: Spec, predicted: np.ndarray, y: np.ndarray) -> float:
    """Accuracy, or R^2."""
    if spec.n_classes:
        return float((predicted == y).mean())
    spread = float(((y - y.mean()) ** 2).sum())
    return 1.0 - float(((y - predicted) ** 2).sum()) / spread if spread else 0.0
