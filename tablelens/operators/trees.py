"""Forests and boosting over Spark (M13, M14, M16): histogram trees with hand-over of small nodes.

Rows are binned once (at most 256 bins a feature: exact where it has no more distinct values, quantiles else) and
written. A tree's nodes then grow in one of two ways, with the same sums, draws and splits:

* while a node's rows don't fit one task (``task_bytes``), all such nodes of a level are split by one aggregate: each
  task sums its rows into cells (tree, node, feature, bin), the cells are summed by key, and every node's best split is
  found where its cells meet. Only the splits reach the driver, where the tops of the trees are kept;
* when they fit, rows are routed by (tree, node) and the subtree is finished in the task that gets them, to any depth.
  Where the whole table fits, that is at the root: a forest's trees, or a search's trials and folds, are then tasks of
  one job over a broadcast of the bounded table.

Boosting adds second-order sums: one tree per output and round, level by level (or the leaf with most gain first),
margins moved with the next round's first aggregate. Multi-class boosting has one tree a class and round on common margins.

Prediction broadcasts the trees where they are small, else it routes rows by (tree, subtree) and joins them there.
"""

import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.operators import tree_growth as G
from tablelens.operators.tree_growth import Nodes, Spec
from tablelens.session import scratch_path

MAX_BINS = 256
TASK_BYTES = 64 << 20       # binned rows that one task may hold
BROADCAST_BYTES = 64 << 20  # trees that may be sent to every task
_ROUNDS = 8                 # boosting rounds between two checkpoints of the margins
_CELLS = 1 << 24            # sums that a task holds before it sends them
_BLOCK_ROWS = 1 << 17       # rows of a block
_KEPT_ROWS = 1 << 16        # rows of a block that boosting keeps: a task holds one at a time
_PACK_ROWS = 1 << 16        # rows whose parts of one node travel as one row
GATHER_BYTES = 16 << 20     # sums of all tasks that may meet on the driver
NODE_BYTES = 16 << 20       # binned rows of a node that is finished in a task: growth holds about ten times that


def _write(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(column, dtype) -> np.ndarray:
    """Equal-length binary values as a (features x rows) matrix."""
    parts = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    if not parts:
        return np.zeros((0, 0), dtype)
    flat = []
    for c in parts:  # the values lie one after the other: no Python object per row
        ends = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset:c.offset + len(c) + 1]
        flat.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(dtype).reshape(len(c), -1))
    return np.ascontiguousarray(np.concatenate(flat).T)


# ---------------------------------------------------------------- bins
def bin_edges(df: DataFrame, d: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins (the last bin is open), from the column ``x`` (array<double>)."""
    def few(batches):
        seen = [set() for _ in range(d)]
        for batch in batches:
            m = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, d))
            for f in range(d):
                if len(seen[f]) <= MAX_BINS:
                    seen[f].update(np.unique(m[:, f][~np.isnan(m[:, f])])[:MAX_BINS + 1].tolist())
        rows = [(f, v) for f in range(d) for v in sorted(seen[f])[:MAX_BINS + 1]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.float64())], names=["f", "v"])

    values = _write(df.select("x").mapInArrow(few, "f int, v double").distinct(), "bin-values")
    counts = values.groupBy("f").agg(F.count("*").alias("n"))
    exact: dict[int, list[float]] = {}
    for r in values.join(counts.where(F.col("n") <= MAX_BINS), "f").select("f", "v").collect():  # at most 256 a feature
        exact.setdefault(r["f"], []).append(r["v"])
    many = [r["f"] for r in counts.where(F.col("n") > MAX_BINS).select("f").collect()]
    probs = [k / MAX_BINS for k in range(1, MAX_BINS)]
    quantiles = {}
    for k in range(0, len(many), 100):
        row = df.agg(*[F.percentile_approx(F.col("x")[f], probs, 10_000).alias(f"q{f}") for f in many[k:k + 100]]).first()
        quantiles |= {f: row[f"q{f}"] for f in many[k:k + 100]}
    out = []
    for f in range(d):
        if f in quantiles:
            out.append(np.unique(np.array(quantiles[f])))
        else:
            v = np.array(sorted(exact.get(f, [0.0])))
            out.append((v[1:] + v[:-1]) / 2)
    return out


def to_bins(m: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(features x rows) bin numbers of a (rows x features) matrix."""
    return np.stack([np.searchsorted(e, m[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)


@dataclass
class Binned:
    """Binned rows (rid, x, y, other columns), written; their number, edges and numbers of bins."""
    df: DataFrame
    edges: list
    n: int

    @property
    def bins(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]

    def fits(self, task_bytes: int) -> bool:
        return self.n * (len(self.edges) + 24) <= task_bytes


def binned(df: DataFrame, features: str = "features", label: str = "label", others: tuple[str, ...] = ()) -> Binned:
    raw = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), *others)
    first = raw.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    edges = bin_edges(raw, first["d"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.ascontiguousarray(to_bins(m, edges).T)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([r.tobytes() for r in x], pa.binary()), *[batch.column(c) for c in ("y", *others)]],
                                                 names=["rid", "x", "y", *others])

    kinds = ", ".join(f"{c} {raw.schema[c].dataType.simpleString()}" for c in others)
    out = _write(raw.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, f"rid long, x binary, y double{', ' * bool(kinds)}{kinds}"), "binned")
    return Binned(out, edges, out.count())


def _rows_at_hand(data: Binned, *others: str):
    """The bounded table (``fits`` was checked): x, y, rid and further columns as arrays, in the order of rid."""
    t = data.df.select("rid", "x", "y", *others).toArrow().sort_by("rid")
    return (_matrix(t.column("x"), np.uint8), t.column("y").to_numpy(), t.column("rid").to_numpy(), *[t.column(c).to_numpy() for c in others])


# ---------------------------------------------------------------- nodes too large for a task
class Top:
    """A tree's top while it grows: nodes with path, depth and sums."""

    def __init__(self, spec: Spec, path, sums=None):
        self.spec = spec
        self.feature, self.cut, self.left, self.path, self.depth, self.sums = [-1], [0], [0], [path], [0], [sums]

    def split(self, at: int, feature: int, cut: int, left_sums, right_sums) -> list[int]:
        """The new children's numbers."""
        k = len(self.feature)
        self.feature[at], self.cut[at], self.left[at] = feature, cut, k
        for path, sums in zip(G.children(np.array([self.path[at]], np.uint64)), (left_sums, right_sums)):
            self.feature.append(-1), self.cut.append(0), self.left.append(0)
            self.path.append(path), self.depth.append(self.depth[at] + 1), self.sums.append(sums)
        return [k, k + 1]

    def nodes(self) -> Nodes:
        w = 1 if self.spec.kind == "boost" else G.width(self.spec)
        s = np.array([np.zeros(4 + w) if x is None else x for x in self.sums])
        value = G.leaf_values([s[:, 4 + k] for k in range(w)], s[:, 3], self.spec)
        return Nodes(np.array(self.feature), np.array(self.cut), np.array(self.left), value)


def _alike(spec: Spec) -> tuple[list[int], list[int]]:
    """(which of the sums c, h, q, hl, g ... differ, each one's place among them): most are the rows' weights again."""
    if spec.kind == "forest":
        return ([0, *range(4, 4 + spec.n_classes)], [0, 0, 0, 0, *range(1, 1 + spec.n_classes)]) if spec.n_classes else ([0, 2, 4], [0, 0, 1, 0, 2])
    if not spec.n_classes:
        return [0, 4], [0, 0, 0, 0, 1]
    return ([0, 1, 4], [0, 1, 0, 1, 2]) if spec.second_order else ([0, 3, 4], [0, 0, 0, 1, 2])


def _row_stats(spec: Spec, tree: int, own, y, rid, mixed, margin):
    """(rows of the tree's sample in its open nodes or None for all, those of the sums' columns c, h, q, hl, g ... of them
    that differ; None for ones); ``own``: the open node of each row, or -1; ``mixed``: the ids through ``mix``, for a forest."""
    pick = _alike(spec)[0]
    if spec.kind == "forest":  # draws are made for the rows that are left only
        rows = np.flatnonzero(own >= 0)
        w = G.poisson(G.uniform_of(G.key_of(spec.seed, tree, 1), mixed[rows])) if spec.bootstrap else np.ones(len(rows))
        on = w > 0
        rows, w = (rows, w) if on.all() else (rows[on], w[on])
        c, h, g, q, hl = G.forest_stats(spec, y[rows], w)
        return rows, [(c, h, q, hl, *g)[k] for k in pick]
    k = G.outputs(spec)
    c, h, g, q, hl, on = G.boost_stats(spec, y, margin, tree % k, rid, tree // k)
    on &= own >= 0
    rows = None if on.all() else np.flatnonzero(on)
    return rows, [None if k == 0 else (c, h, q, hl, *g)[k] if rows is None else (c, h, q, hl, *g)[k][rows] for k in pick]


def _level_sums(spec: Spec, bins: list[int], grown: dict, blocks):
    """(tree, node, feature, sums by bin as bytes) over blocks of rows (x, y, rid, margin). ``grown``: of each tree its
    nodes and which of them are open."""
    held: dict[tuple[int, int], np.ndarray] = {}  # (tree, feature) -> sums of its (node, bin) cells
    seen: dict[int, np.ndarray] = {}

    def sent():
        for (t, f), sums in held.items():
            for r in np.flatnonzero(seen[t]).tolist():
                yield t, int(grown[t][1][r]), f, np.ascontiguousarray(sums[:, r]).tobytes()

    for x, y, rid, margin in blocks:
        mixed = G.mix(rid.astype(np.int64).view(np.uint64)) if spec.kind == "forest" else None
        for t, (nodes, open_) in grown.items():
            rank = np.full(len(nodes.feature), -1)
            rank[open_] = np.arange(len(open_))
            own = rank.take(nodes.leaf(x))
            rows, stats = _row_stats(spec, t, own, y, rid, mixed, margin)
            if rows is not None and not len(rows):
                continue
            own, part = (own, x) if rows is None else (own.take(rows), x[:, rows])
            seen[t] = seen.get(t, 0) + np.bincount(own, minlength=len(open_))
            for f in np.flatnonzero(G.tree_features(spec, t // G.outputs(spec) if spec.kind == "boost" else t, len(bins))).tolist():
                key, n = own * bins[f], len(open_) * bins[f]
                key += part[f]
                one = np.stack([np.bincount(key, a, n) for a in stats]).reshape(len(stats), -1, bins[f])
                held[t, f] = held[t, f] + one if (t, f) in held else one
        if sum(a.size for a in held.values()) > _CELLS:
            yield from sent()
            held, seen = {}, {}
    yield from sent()


def _feature_split(spec: Spec, n_bins: int, sums: list[bytes]):
    """(worth, cut, the node's sums, its left part's) by one feature, from all tasks' sums of a node."""
    s = sum(np.frombuffer(v, float) for v in sorted(sums)).reshape(-1, n_bins)[_alike(spec)[1]]
    b = np.flatnonzero(s[0] > 0)
    s, total = s[:, b], s.sum(axis=1)
    worth, cut = -np.inf, 0
    if n_bins > 1:
        found, cuts = G.cells_best(np.zeros(len(b), np.int64), b, s[0], s[1], list(s[4:]), (total[[0]], total[[1]], [total[[k]] for k in range(4, len(s))]), spec, 1)
        worth, cut = float(found[0]), int(cuts[0])
    return worth, cut, total.tolist(), s[:, b <= cut].sum(axis=1).tolist()


def _split_level(data, spec: Spec, bins: list[int], tops: dict[int, Top], active: dict[int, list[int]]) -> dict:
    """{(tree, node): (gain, feature, cut, its sums, the left part's sums)} of all active nodes: one aggregate. Each
    task sums its rows into one row of sums per (tree, node, feature); where they meet, the feature's best cut is found;
    one small row per open node and feature reaches the driver. ``data``: a frame, or boosting's ``_Kept`` blocks."""
    d, m = len(bins), 4 + (1 if spec.kind == "boost" else G.width(spec))
    grown = {t: (tops[t].nodes(), np.array(active[t])) for t in active}
    widths = np.array(bins)
    names = ["tree", "node", "f", "worth", "cut", "total", "side"]

    def cells(batches):
        def some(rows):
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["tree", "node", "f", "sums"])

        sums = _level_sums(spec, bins, grown, ((*b, None) for b in _gathered(batches, _BLOCK_ROWS, "y", "rid")))
        while rows := list(islice(sums, 1000)):
            yield some(rows)

    def best(t: pa.Table) -> pa.Table:
        at = [t.column(c)[0].as_py() for c in ("tree", "node", "f")]
        found = _feature_split(spec, bins[at[2]], t.column("sums").to_pylist())
        return pa.table({c: [v] for c, v in zip(names, (*at, *found))},
                        schema=pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("f", pa.int32()), ("worth", pa.float64()), ("cut", pa.int32()),
                                          ("total", pa.list_(pa.float64())), ("side", pa.list_(pa.float64()))]))

    def meet(pairs):
        by: dict[tuple[int, int, int], list[bytes]] = {}
        for key, sums in pairs:
            by.setdefault(key, []).append(sums)
        for key, sums in by.items():
            yield dict(zip(names, (*key, *_feature_split(spec, bins[key[2]], sums))))

    if isinstance(data, DataFrame):
        rows = data.mapInArrow(cells, "tree int, node int, f int, sums binary").groupBy("tree", "node", "f").applyInArrow(
            best, "tree int, node int, f int, worth double, cut int, total array<double>, side array<double>").collect()  # a row per open node and feature
    else:
        n = sum(len(a) for a in active.values())
        rows = data.met(lambda blocks: (((t, a, f), s) for t, a, f, s in _level_sums(spec, bins, grown, blocks)), meet, n * d, n * sum(bins) * 8 * len(_alike(spec)[0]))  # a row per open node and feature
    by: dict[tuple[int, int], list] = {}
    for r in rows:
        by.setdefault((r["tree"], r["node"]), []).append(r)
    out = {}
    for (t, a), rows in by.items():
        rows.sort(key=lambda r: r["f"])
        worths, cuts = np.full((d, 1), -np.inf), np.zeros((d, 1), np.int64)
        for r in rows:
            worths[r["f"]], cuts[r["f"]] = r["worth"], r["cut"]
        total = np.array(rows[0]["total"])
        g = [total[[k]] for k in range(4, m)]
        allowed = np.isin(np.arange(d), [r["f"] for r in rows]) & (widths > 1)
        gain, feature, cut = G.choose(worths, cuts, np.array([tops[t].path[a]], np.uint64), G._part(g, total[[1]], spec), allowed, spec)
        may = G.worth_splitting(total[[0]], total[[1]], g, total[[2]], spec) & G.accepted(gain, spec)
        side = next((r["side"] for r in rows if r["f"] == feature[0]), rows[0]["side"])
        out[t, a] = (float(gain[0]) if may[0] else None, int(feature[0]), int(cut[0]), total, np.array(side))
    return out


def _grow_tops(data: Binned, spec: Spec, trees: list[int], task_rows: int, importance: dict) -> dict[int, Top]:
    """Tops of forest trees, split until every open node's rows fit one task."""
    tops = {t: Top(spec, G.key_of(spec.seed, t, 4)) for t in trees}
    active = {t: [0] for t in trees}
    while active:
        found = _split_level(data.df, spec, data.bins, tops, active)
        nxt: dict[int, list[int]] = {}
        for (t, a), (gain, f, cut, total, side) in found.items():
            top = tops[t]
            top.sums[a] = total
            if gain is None or (spec.depth and top.depth[a] >= spec.depth):
                continue
            importance[t][f] += max(gain, 0.0)
            for child in top.split(a, f, cut, side, total - side):
                if top.sums[child][0] > task_rows:
                    nxt.setdefault(t, []).append(child)
        active = nxt
    return tops


def _finish(data: Binned, spec: Spec, tops: dict[int, Top], task_rows: int) -> DataFrame:
    """(tree, root, nodes, importance): the subtrees of handed-over nodes, each grown in the task its rows go to."""
    ready, bins = {}, data.bins
    for t, top in tops.items():
        open_ = [a for a in range(len(top.feature)) if top.feature[a] < 0 and top.sums[a][0] <= task_rows]
        ready[t] = (top.nodes(), np.isin(np.arange(len(top.feature)), open_), np.array(top.path, np.uint64), np.array(top.depth))

    def route(batches):
        for x, y, rid in _gathered(batches, _PACK_ROWS, "y", "rid"):
            mixed = G.mix(rid.astype(np.int64).view(np.uint64))
            for t, (nodes, open_, _, _) in ready.items():
                at = nodes.leaf(x)
                w = G.poisson(G.uniform_of(G.key_of(spec.seed, t, 1), mixed)) if spec.bootstrap else np.ones(len(rid))
                rows, firsts, roots = _by_root(at, (w > 0) & open_[at])
                if len(roots):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(roots), t, np.int32)), pa.array(roots), *[
                        pa.array([np.ascontiguousarray(a[..., rows[i:j]]).tobytes() for i, j in zip(firsts[:-1], firsts[1:])], pa.binary()) for a in (rid, x, y, w.astype(np.uint8))]],
                        names=["tree", "root", "rid", "x", "y", "w"])

    def finish(t: pa.Table) -> pa.Table:
        tree, root = t.column("tree")[0].as_py(), t.column("root")[0].as_py()
        _, _, paths, depths = ready[tree]
        rid, y, w = (np.concatenate([np.frombuffer(v.as_buffer(), k) for v in t.column(c)]) for c, k in (("rid", np.int64), ("y", float), ("w", np.uint8)))
        x = np.concatenate([np.frombuffer(v.as_buffer(), np.uint8).reshape(len(bins), -1) for v in t.column("x")], axis=1)
        order = np.argsort(rid, kind="stable")
        x = np.ascontiguousarray(x[:, order])
        c, h, g, q, hl = G.forest_stats(spec, y[order], w[order].astype(float))
        gains = np.zeros(len(x))
        nodes = G.grow(x, bins, c, h, g, q, hl, spec, G.tree_features(spec, tree, len(x)), paths[root], int(depths[root]), gains)
        return _tree_table([(tree, root, nodes, gains)])

    return data.df.mapInArrow(route, "tree int, root long, rid binary, x binary, y binary, w binary").groupBy("tree", "root").applyInArrow(finish, _TREES)


def _gathered(batches, most: int, *columns: str):
    """(x, columns ...) of about ``most`` rows at a time."""
    held: list[tuple] = []
    for batch in batches:
        if batch.num_rows:
            held.append((_matrix(batch.column("x"), np.uint8), *[batch.column(c).to_numpy() for c in columns]))
        if sum(len(h[-1]) for h in held) >= most:
            yield tuple(np.concatenate(a, axis=-1) for a in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(a, axis=-1) for a in zip(*held))


def _by_root(at: np.ndarray, on: np.ndarray):
    """(rows that are ``on`` in the order of their node, where each node's begin, the nodes)."""
    rows = np.flatnonzero(on)
    rows = rows[np.argsort(at[rows], kind="stable")]
    roots, first = np.unique(at[rows], return_index=True)
    return rows, [*first.tolist(), len(rows)], roots.astype(np.int64)


_TREES = "tree int, root long, nodes binary, importance array<double>"


def _tree_table(rows) -> pa.Table:
    return pa.table({"tree": pa.array([t for t, *_ in rows], pa.int32()), "root": pa.array([r for _, r, *_ in rows], pa.int64()),
                     "nodes": pa.array([n.pack() for *_, n, _ in rows], pa.binary()), "importance": pa.array([i.tolist() for *_, i in rows], pa.list_(pa.float64()))})


# ---------------------------------------------------------------- fits
def _fit_at_hand(spark: SparkSession, data: Binned, spec: Spec) -> tuple[DataFrame, np.ndarray]:
    """Handed over at the root: the table is bounded, trees of a forest are tasks of one job."""
    sent, bins = spark.sparkContext.broadcast(_rows_at_hand(data)), data.bins
    tasks = min(spec.trees, max(1, 4 * spark.sparkContext.defaultParallelism)) if spec.kind == "forest" else 1

    def run(batches):
        x, y, rid = sent.value
        cells = G.Cells.of(spec, x, y, rid)
        for batch in batches:
            wanted = batch.column("id").to_pylist()
            for trees in ([[t] for t in wanted] if spec.kind == "forest" else [None] * len(wanted)):
                gains = np.zeros(len(bins))
                grown, start = G.grow_all(spec, x, bins, y, rid, gains, trees, cells)
                yield from _tree_table([(t, 0, nodes, gains if k == 0 else gains * 0) for k, (t, nodes) in enumerate(grown)]).to_batches()
                if spec.kind == "boost":
                    yield from _tree_table([(-1, 0, Nodes(np.zeros(0), np.zeros(0), np.zeros(0), start), gains * 0)]).to_batches()

    out = _write(spark.range(0, spec.trees if spec.kind == "forest" else 1, 1, tasks).mapInArrow(run, _TREES), "trees")
    if spec.kind == "forest":
        return out, np.zeros(1)
    return out.where("tree >= 0"), Nodes.unpack(out.where("tree = -1").first()["nodes"]).value


def _fit_forest(data: Binned, spec: Spec, task_rows: int, path: str, at_once: int = 34) -> None:
    """Writes the trees under ``path``."""
    for k in range(0, spec.trees, at_once):  # tops and cells of so many trees at a time
        trees = list(range(k, min(k + at_once, spec.trees)))
        gains = {t: np.zeros(len(data.edges)) for t in trees}
        tops = _grow_tops(data, spec, trees, task_rows, gains)
        spark = data.df.sparkSession
        heads = spark.createDataFrame([(t, -1, top.nodes().pack(), gains[t].tolist()) for t, top in tops.items()], _TREES)
        heads.union(_finish(data, spec, tops, task_rows)).write.mode("append").parquet(path)


def _fit_apart(data: Binned, spec: Spec, task_bytes: int, path: str) -> np.ndarray:
    """A table too large for a task: the trees are written under ``path``; returns the start."""
    if spec.kind == "forest":
        _fit_forest(data, spec, max(1, min(task_bytes, NODE_BYTES) // (len(data.edges) + 24)), path)
        return np.zeros(1)
    trees, start = _fit_boost(data, spec)
    trees.write.parquet(path)
    return start


def _fit_boost(data: Binned, spec: Spec) -> tuple[DataFrame, np.ndarray]:
    """Round by round, every level one aggregate over blocks of rows; their margins are kept up to date."""
    spark, k = data.df.sparkSession, G.outputs(spec)
    if spec.n_classes:
        got = {int(r["y"]): r["count"] for r in data.df.groupBy("y").count().collect()}  # a row per class
        start = G.start_margin(spec, np.array([got.get(c, 0) for c in range(spec.n_classes)], float), 0.0)
    else:
        start = G.start_margin(spec, np.zeros(1), data.df.agg(F.avg("y")).first()[0])
    blocks, bins = _kept_blocks(data.df, spec, start), data.bins
    kept = _Kept(blocks, spec)
    try:
        rows = _rounds(kept, bins, spec)  # a row a round and output
    finally:
        kept.close()
    return spark.createDataFrame(rows, _TREES), start


def _rounds(kept, bins: list[int], spec: Spec) -> list[tuple]:
    """(tree, 0, nodes, importance) of all rounds."""
    rows, k = [], G.outputs(spec)
    for r in range(spec.trees):
        gains = np.zeros(len(bins))
        tops = {r * k + o: Top(spec, G.key_of(spec.seed, r * k + o, 4)) for o in range(k)}
        (_leaf_wise if spec.leaves else _level_wise)(kept, bins, spec, tops, gains)
        done = [(t, top.nodes()) for t, top in tops.items()]
        rows += [(t, 0, n.pack(), (gains if i == 0 else gains * 0).tolist()) for i, (t, n) in enumerate(done)]
        if r + 1 < spec.trees:
            kept.add(done)
    return rows


class _Kept:
    """Blocks of rows in a persisted set, of which every few rounds' is checkpointed; an aggregate is a job."""

    def __init__(self, blocks: RDD, spec: Spec):
        self.blocks, self.old, self.spec, self.rounds = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, spec, 0
        self.parts = blocks.getNumPartitions()

    def met(self, sums, meet, keys: int, size: int) -> list[dict]:
        """The sums of all tasks (``size`` bytes of each for ``keys``) met: at once where they are few, else by key in tasks."""
        found = self.blocks.mapPartitions(sums)
        if self.parts * size <= GATHER_BYTES:
            found = list(meet(found.collect()))  # its size was checked
        else:
            found = found.partitionBy(max(1, min(self.blocks.context.defaultParallelism, keys)), lambda key: hash(key)).mapPartitions(meet).collect()
        if self.old is not None:  # the new margins have been computed with this aggregate
            self.old.unpersist()
            self.old = None
        return found

    def add(self, done) -> None:
        spec, self.rounds = self.spec, self.rounds + 1
        self.old, self.blocks = self.blocks, self.blocks.map(lambda b: _moved(spec, b, done)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % _ROUNDS == 0:
            self.blocks.checkpoint()

    def close(self) -> None:
        for one in (self.blocks, self.old):
            if one is not None:
                one.unpersist()


def _kept_blocks(df: DataFrame, spec: Spec, start: np.ndarray) -> RDD:
    """The rows as blocks: binned features (features x rows), labels, ids (where draws need them) and margins (outputs x
    rows). Python reads and writes one block at a time."""
    def run(batches):
        for x, y, rid in _gathered(batches, _KEPT_ROWS, "y", "rid"):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (rid.astype(np.int64), x, y.astype(float))], names=["rid", "x", "y"])

    def arrays(row):
        rid, y = np.frombuffer(row[0], np.int64), np.frombuffer(row[2], float)
        margin = np.repeat(np.asarray(start, float)[:, None], len(y), axis=1)
        return np.frombuffer(row[1], np.uint8).reshape(-1, len(y)), y, (rid if spec.subsample < 1.0 else None), margin

    return _write(df.select("rid", "x", "y").mapInArrow(run, "rid binary, x binary, y binary"), "blocks").rdd.map(arrays)


def _moved(spec: Spec, block, done):
    """The block with the new trees' steps."""
    x, y, rid, margin = block
    margin = margin.copy()
    for tree, nodes in done:
        margin[tree % G.outputs(spec)] += nodes.value[:, 0].take(nodes.leaf(x))
    return x, y, rid, margin


def _level_wise(kept, bins, spec, tops, gains) -> None:
    active = {t: [0] for t in tops}
    while active:
        found, nxt = _split_level(kept, spec, bins, tops, active), {}
        for (t, a), (gain, f, cut, total, side) in sorted(found.items()):
            top = tops[t]
            top.sums[a] = total
            if gain is not None and not (spec.depth and top.depth[a] >= spec.depth):
                gains[f] += max(gain, 0.0)
                new = top.split(a, f, cut, side, total - side)
                if not spec.depth or top.depth[new[0]] < spec.depth:
                    nxt.setdefault(t, []).extend(new)
        active = nxt


def _leaf_wise(kept, bins, spec, tops, gains) -> None:
    """Per tree the open leaf with most gain is split, until there are enough leaves; trees of a round in step.

    Which leaf is next depends only on the leaves' best splits, so those of all children that may come next are found
    in one aggregate; ``wide`` holds them, and the tree is replayed from it as far as they are known."""
    wide = {t: Top(spec, tops[t].path[0]) for t in tops}
    found, kids, active = {}, {}, {t: [0] for t in tops}
    done: dict[int, np.ndarray] = {}
    while active:
        for (t, a), (gain, f, cut, total, side) in _split_level(kept, spec, bins, wide, active).items():
            wide[t].sums[a] = total
            found[t, a] = (None if spec.depth and wide[t].depth[a] >= spec.depth else gain, f, cut, total, side)
        active = {}
        for t in tops:
            if t in done:
                continue
            top, own, ready, leaves, wait = Top(spec, wide[t].path[0]), {0: 0}, {}, 1, False
            gained = np.zeros(len(bins))

            def known(a):
                if (t, own[a]) not in found:
                    return
                top.sums[a] = found[t, own[a]][3]
                if found[t, own[a]][0] is not None:
                    ready[a] = found[t, own[a]]

            known(0)
            while ready and leaves < spec.leaves:
                a = max(ready, key=lambda a: (ready[a][0], -a))
                if (t, own[a]) not in kids:
                    if leaves + 1 < spec.leaves:
                        wait = True
                        break
                    kids[t, own[a]] = wide[t].split(own[a], ready[a][1], ready[a][2], ready[a][4], ready[a][3] - ready[a][4])  # the last: its children stay leaves
                gain, f, cut, total, side = ready.pop(a)
                gained[f] += gain
                for new, at in zip(top.split(a, f, cut, side, total - side), kids[t, own[a]]):
                    own[new] = at
                    known(new)
                leaves += 1
            if wait:
                for a in sorted(ready, key=lambda a: (-ready[a][0], a))[:spec.leaves - leaves]:
                    if (t, own[a]) not in kids:
                        gain, f, cut, total, side = ready[a]
                        kids[t, own[a]] = wide[t].split(own[a], f, cut, side, total - side)
                        active.setdefault(t, []).extend(kids[t, own[a]])
            else:
                done[t], tops[t] = gained, top
    for gained in done.values():
        gains += gained


class Trees(Estimator):
    """Fits ``spec`` on the columns ``features`` (vector) and ``label``."""

    def __init__(self, spec: Spec, features: str = "features", label: str = "label", task_bytes: int = TASK_BYTES):
        super().__init__()
        self.spec, self.features, self.label, self.task_bytes = spec, features, label, task_bytes

    def getNumTrees(self) -> int:
        return self.spec.trees

    def getMaxDepth(self) -> int:
        return self.spec.depth

    def copy(self, extra=None):
        return Trees(self.spec, self.features, self.label, self.task_bytes)

    def _fit(self, dataset: DataFrame) -> "TreesModel":
        data = binned(dataset, self.features, self.label)
        path = scratch_path(dataset.sparkSession, "tree-model")
        if data.fits(self.task_bytes):
            trees, start = _fit_at_hand(dataset.sparkSession, data, self.spec)
            trees.write.parquet(path)
        else:
            start = _fit_apart(data, self.spec, self.task_bytes, path)
        return TreesModel(self.spec, [e.tolist() for e in data.edges], start.tolist(), path, self.features)


# ---------------------------------------------------------------- models
class TreesModel(Model, MLWritable, MLReadable):
    """Fitted trees: (tree, root, nodes) rows under ``path``; root -1: a tree's top, else a subtree of that node."""

    def __init__(self, spec: Spec, edges, start, path: str, features: str = "features", broadcast_bytes: int = BROADCAST_BYTES):
        super().__init__()
        self.spec, self.edges, self.start, self.path, self.features, self.broadcast_bytes = spec, edges, start, path, features, broadcast_bytes

    def copy(self, extra=None):
        return TreesModel(self.spec, self.edges, self.start, self.path, self.features, self.broadcast_bytes)

    @property
    def n_trees(self) -> int:
        return self.spec.trees * (G.outputs(self.spec) if self.spec.kind == "boost" else 1)

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the gains: of each tree (forest) or of all trees (boosting)."""
        t = SparkSession.getActiveSession().read.parquet(self.path).select("tree", F.posexplode("importance").alias("f", "gain"))
        t = t.groupBy("tree", "f").agg(F.sum("gain").alias("gain")).toPandas()  # trees x features
        total = np.zeros(len(self.edges))
        for _, one in t.groupby("tree"):
            g = np.zeros(len(self.edges))
            g[one["f"]] = one["gain"]
            total += g / g.sum() if self.spec.kind == "forest" and g.sum() > 0 else g
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = dataset.sparkSession.read.parquet(self.path).select("tree", "root", "nodes")
        size = trees.agg(F.sum(F.octet_length("nodes"))).first()[0] or 0
        return self._by_broadcast(dataset, trees) if size <= self.broadcast_bytes else self._by_join(dataset, trees)

    def _by_broadcast(self, dataset: DataFrame, trees: DataFrame) -> DataFrame:
        held = [(r["tree"], r["root"], bytes(r["nodes"])) for r in trees.orderBy("tree", "root").collect()]  # its size was checked
        sent = dataset.sparkSession.sparkContext.broadcast(held)
        spec, edges, start, n_trees = self.spec, [np.array(e) for e in self.edges], np.array(self.start), self.n_trees

        @F.pandas_udf("double")
        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            by: dict[int, dict[int, Nodes]] = {}
            for t, root, data in sent.value:
                by.setdefault(t, {})[root] = Nodes.unpack(data)
            for s in parts:
                if not len(s):
                    yield pd.Series([], dtype=float)
                    continue
                x = to_bins(np.stack(s.to_list()), edges)
                total = np.zeros((G.width(spec), x.shape[1]))
                for t, subs in by.items():
                    top = subs.get(-1)
                    at = top.leaf(x) if top else np.zeros(x.shape[1], np.int64)
                    if top:
                        G.add_tree(spec, total, t, np.where(np.isin(at, [r for r in subs if r >= 0])[:, None], 0.0, top.value[at]))
                    for root, nodes in subs.items():
                        if root >= 0 and len(rows := np.flatnonzero(at == root)):
                            G.add_tree(spec, total, t, nodes.value[nodes.leaf(x[:, rows])], rows)
                yield pd.Series(G.combine(spec, total, n_trees, start))

        return dataset.withColumn("prediction", predict(vector_to_array(self.features)))

    def _by_join(self, dataset: DataFrame, trees: DataFrame) -> DataFrame:
        """Rows go to the subtree that they reach in each tree, a block's rows of one subtree together."""
        spark = dataset.sparkSession
        spec, edges, start, n_trees, w = self.spec, [np.array(e) for e in self.edges], np.array(self.start), self.n_trees, G.width(self.spec)
        rows = _write(dataset.withColumn("__rid", F.monotonically_increasing_id()), "scored")
        heads = {r["tree"]: bytes(r["nodes"]) for r in trees.where("root = -1").collect()}  # tops: nodes larger than a task
        roots = {t: [] for t in range(n_trees)}
        for r in trees.where("root >= 0").select("tree", "root").collect():
            roots[r["tree"]].append(r["root"])
        sent = spark.sparkContext.broadcast((heads, roots))
        most = max(1 << 10, min(1 << 14, TASK_BYTES // (n_trees * (4 + 8 * w))))  # rows of a block: all its trees' values meet in a task

        def binned_batches(batches):
            for batch in batches:
                if batch.num_rows:
                    x = to_bins(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), edges)
                    yield pa.RecordBatch.from_arrays([batch.column("__rid"), pa.array([r.tobytes() for r in np.ascontiguousarray(x.T)], pa.binary())], names=["__rid", "x"])

        def route(batches):
            heads, roots = sent.value
            tops = {t: Nodes.unpack(d) for t, d in heads.items()}
            names = ["tree", "root", "block", "n", "rows", "x", "sums"]
            for x, rid in _gathered(binned_batches(batches), most, "__rid"):
                total, block = np.zeros((w, len(rid))), int(rid[0])
                for t, subs in roots.items():
                    at = tops[t].leaf(x) if t in tops else np.zeros(len(rid), np.int64)
                    below = np.isin(at, subs)
                    if t in tops:
                        G.add_tree(spec, total, t, np.where(below[:, None], 0.0, tops[t].value[at]))
                    on, firsts, found = _by_root(at, below)
                    if len(found):
                        parts, k = [on[i:j] for i, j in zip(firsts[:-1], firsts[1:])], len(found)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, t, np.int32)), pa.array(found), pa.array(np.full(k, block)), pa.array([len(p) for p in parts], pa.int64()),
                                                          pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary()),
                                                          pa.array([np.ascontiguousarray(x[:, p]).tobytes() for p in parts], pa.binary()), pa.nulls(k, pa.binary())], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([block], pa.int64()), pa.array([len(rid)], pa.int64()),
                                                  pa.array([rid.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            sums = []
            if left.num_rows:
                nodes, tree = Nodes.unpack(right.column("nodes")[0].as_py()), left.column("tree")[0].as_py()
                for v in left.column("x"):
                    x = np.frombuffer(v.as_buffer(), np.uint8).reshape(len(edges), -1)
                    total = np.zeros((w, x.shape[1]))
                    G.add_tree(spec, total, tree, nodes.value[nodes.leaf(x)])
                    sums.append(total.tobytes())
            return pa.table({**{c: left.column(c) for c in ("tree", "root", "block", "rows")}, "sums": pa.array(sums, pa.binary())})

        routed = _write(rows.select("__rid", vector_to_array(self.features).alias("x"))
                        .mapInArrow(route, "tree int, root long, block long, n long, rows binary, x binary, sums binary"), "routed")
        below = routed.where("tree IS NOT NULL").drop("sums")
        # rows that reach one subtree are dealt over as many tasks as they need
        salts = below.groupBy("tree", "root").agg(F.ceil(F.sum("n") / 200_000).cast("long").alias("salts"))
        salted = below.join(F.broadcast(salts), ["tree", "root"]).withColumn("salt", F.pmod(F.xxhash64("block"), "salts")).select("tree", "root", "salt", "block", "rows", "x")
        subs = (trees.where("root >= 0").join(F.broadcast(salts), ["tree", "root"])
                .select("tree", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "nodes"))
        key = ["tree", "root", "salt"]
        scored = (salted.groupBy(*key).cogroup(subs.groupBy(*key)).applyInArrow(score, "tree int, root long, block long, rows binary, sums binary")
                  .union(routed.where("tree IS NULL").select("tree", "root", "block", "rows", "sums")))

        def finish(t: pa.Table) -> pa.Table:
            t = t.sort_by([("tree", "ascending"), ("root", "ascending")])  # the block's own row last
            *parts, whole = zip(t.column("rows"), t.column("sums"))
            rid, total = np.frombuffer(whole[0].as_buffer(), np.int64), np.frombuffer(whole[1].as_buffer(), float).reshape(w, -1).copy()
            for at, v in parts:
                total[:, np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(v.as_buffer(), float).reshape(w, -1)
            return pa.table({"__rid": pa.array(rid, pa.int64()), "prediction": pa.array(G.combine(spec, total, n_trees, start), pa.float64())})

        sums = scored.groupBy("block").applyInArrow(finish, "__rid long, prediction double")
        return rows.join(sums, "__rid").drop("__rid")

    def write(self) -> "TreesWriter":
        return TreesWriter(self)

    @classmethod
    def read(cls) -> "TreesReader":
        return TreesReader()


class TreesWriter(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        spark.read.parquet(m.path).write.parquet(f"{path}/trees")
        kept = {"spec": asdict(m.spec), "edges": m.edges, "start": m.start, "features": m.features}
        spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.text(f"{path}/values")
        meta = {"class": "tablelens.operators.trees.TreesModel", "uid": m.uid, "timestamp": 0, "sparkVersion": spark.version, "paramMap": {}, "defaultParamMap": {}}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")


class TreesReader(MLReader):
    def load(self, path: str) -> TreesModel:
        kept = json.loads(self.sparkSession.read.text(f"{path}/values").first()["value"])
        return TreesModel(Spec(**kept["spec"]), kept["edges"], kept["start"], f"{path}/trees", kept["features"])


# ---------------------------------------------------------------- search
def fit_and_score(data: Binned, spec: Spec, fold: int, task_bytes: int = TASK_BYTES) -> float:
    """The score on one fold of the distributed fit on the others."""
    own = Binned(data.df.where(F.col("fold") != fold).select("rid", "x", "y"), data.edges, data.df.where(F.col("fold") != fold).count())
    path = scratch_path(data.df.sparkSession, "tree-model")
    start = _fit_apart(own, spec, task_bytes, path)
    whole = [[b + 0.5 for b in range(n - 1)] for n in own.bins]  # bins are their own values
    model = TreesModel(spec, whole, start.tolist(), path, "features")

    def vectors(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), np.uint8).T.astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["a", "label"])

    held = data.df.where(F.col("fold") == fold).select("x", "y").mapInArrow(vectors, "a array<double>, label double")
    p = model.transform(held.select(array_to_vector("a").alias("features"), "label"))
    if spec.n_classes:
        return float(p.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    n, s, r = p.agg(F.count("*"), F.var_pop("label"), F.avg((F.col("label") - F.col("prediction")) ** 2)).first()
    return 1.0 - r / s if n and s else 0.0


def search_at_hand(data: Binned, specs: list[Spec], folds: int, deadline: float | None = None) -> list[tuple[list[float], str | None]]:
    """([score per fold done], error) of each spec. The table (with the column ``fold``) is bounded: every trial and
    fold is a task of one job; those that start after ``deadline`` (seconds since the epoch) are left out."""
    spark = data.df.sparkSession
    sent, bins = spark.sparkContext.broadcast(_rows_at_hand(data, "fold")), data.bins

    def run(batches):
        x, y, rid, fold = sent.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                spec, f, score, error = specs[k // folds], k % folds, None, None
                if deadline is None or time.time() < deadline:
                    try:
                        own, held = fold != f, fold == f
                        trees, start = G.grow_all(spec, x[:, own], bins, y[own], rid[own])
                        score = G.cv_score(spec, G.predict_all(spec, trees, start, x[:, held]), y[held])
                    except Exception as e:  # noqa: BLE001 -- a failed trial scores 0, as in the reference, and is reported
                        score, error = 0.0, f"{type(e).__name__}: {str(e)[:200]}"
                yield pa.RecordBatch.from_arrays([pa.array([k // folds], pa.int32()), pa.array([score], pa.float64()), pa.array([error], pa.string())],
                                                 names=["trial", "score", "error"])

    n = len(specs) * folds
    got = spark.range(0, n, 1, n).mapInArrow(run, "trial int, score double, error string").collect()  # a row per trial and fold
    out: list[tuple[list[float], str | None]] = [([], None) for _ in specs]
    for r in got:
        scores, error = out[r["trial"]]
        out[r["trial"]] = (scores + ([r["score"]] if r["score"] is not None else []), error or r["error"])
    return out
