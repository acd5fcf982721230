"""Exact k-nearest-neighbour join without emitting all pairs.

Equal vectors are searched once: of the points that share a vector only the smallest ids can be among the k nearest
(ties go to the smaller id), and queries that share a vector share their answer. So a table whose vectors repeat
costs what its distinct vectors cost.

Distinct vectors are dealt to cells of about ``chunk`` by a k-d tree; its cuts come from a bounded sample of the
points, which decides only how even the cells are. A query vector is compared, cell against chunk of queries inside
one task (blocks of a distance matrix, top-k kept), with its own cell; the k-th distance found, ``r``, then bounds the
search: a second round compares it with exactly the cells whose bounding box meets the ball of radius ``r``, and keeps
what lies within it. The result is exact; only k rows per query vector and compared cell leave a task. Where distances
concentrate (many dimensions) a ball meets every cell: the work is quadratic then, and what moves is
n * n * (1 / chunk + 1 / (2 * chunk)) vectors.

With ``group`` every query is compared with the points of its own group only, all groups in one plan; groups of up to
``chunk`` distinct vectors are one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 16_384       # points of a cell
CHUNK_LOW = 4_096    # the same up to _LOW dimensions, where small cells exclude more
_LOW = 16
_BLOCK = 1 << 21     # distances that a task holds at a time
_PER_CELL = 64       # sampled points per cell
_FOUND = "vid long, dist double, nid long, n int"


# ---------------------------------------------------------------- cells
class Cells:
    """A k-d tree over sampled vectors: ``dim`` (-1: leaf), ``cut`` (values up to it go left), ``left`` child (the
    right one follows it); a leaf's number is its cell. Boxes are those of the points, once they are known."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.cut, self.left, self.lo, self.hi = [], [], [], None, None
        parts, open_ = [sample], [(0, cells)]
        self._add()
        while open_:
            nxt = []
            for at, wanted in open_:
                x = parts[at]
                if wanted < 2 or len(x) < 2:
                    continue
                spread = x.max(axis=0) - x.min(axis=0)
                d = int(spread.argmax())
                if spread[d] <= 0:
                    continue
                v = np.sort(x[:, d])
                cut = v[(len(v) - 1) // 2]
                if cut == v[-1]:  # the upper half are ties: cut below them
                    cut = v[np.searchsorted(v, cut) - 1]
                self.dim[at], self.cut[at], self.left[at] = d, float(cut), len(self.dim)
                low = x[:, d] <= cut
                for part in (x[low], x[~low]):
                    nxt.append((self._add(), wanted / 2))
                    parts.append(part)
                parts[at] = None
            open_ = nxt
        self.dim, self.cut, self.left = np.array(self.dim), np.array(self.cut), np.array(self.left)

    def _add(self) -> int:
        self.dim.append(-1), self.cut.append(0.0), self.left.append(0)
        return len(self.dim) - 1

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[self.dim[at[rows]] >= 0]
            here = at[rows]
            at[rows] = self.left[here] + (x[rows, self.dim[here]] > self.cut[here])
        return at

    def bound(self, boxes: dict[int, tuple]) -> None:
        """Boxes of the cells, and of the nodes above them; a cell without points meets nothing."""
        d = len(next(iter(boxes.values()))[0])
        self.lo, self.hi = np.full((len(self.dim), d), np.inf), np.full((len(self.dim), d), -np.inf)
        for at, (lo, hi) in boxes.items():
            self.lo[at], self.hi[at] = lo, hi
        for at in range(len(self.dim) - 1, -1, -1):  # children follow their parents
            if self.dim[at] >= 0:
                a = self.left[at]
                self.lo[at], self.hi[at] = np.minimum(self.lo[a], self.lo[a + 1]), np.maximum(self.hi[a], self.hi[a + 1])

    def meeting(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, cell) for all cells whose box meets the ball of radius r around the row."""
        q, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        out: list[tuple] = []
        reach = r * r * (1 + 1e-9)
        while len(q):
            d2 = np.zeros(len(q))
            for k in range(x.shape[1]):
                v = x[q, k]
                gap = np.maximum(np.maximum(self.lo[at, k] - v, v - self.hi[at, k]), 0.0)
                d2 += gap * gap
            near = (d2 <= reach[q]) & (self.lo[at, 0] <= self.hi[at, 0])
            q, at = q[near], at[near]
            leaf = self.dim[at] < 0
            out.append((q[leaf], at[leaf]))
            q, at = q[~leaf], self.left[at[~leaf]]
            q, at = np.concatenate([q, q]), np.concatenate([at, at + 1])
        return tuple(np.concatenate(a) for a in zip(*out)) if out else (q, at)


def _vectors(column) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)) if len(col) else np.zeros((0, 0))


def _by_group(batch):
    """(group, its rows) of a batch."""
    codes = batch.column("g").dictionary_encode()
    at = codes.indices.to_numpy()
    for i, g in enumerate(codes.dictionary.to_pylist()):
        yield g, np.flatnonzero(at == i)


def _in_cells(df: DataFrame, vec: str, trees) -> DataFrame:
    """``df`` with the ``cell`` of each vector: 0 in groups without a tree."""
    def run(batches):
        held = trees.value
        for batch in batches:
            if batch.num_rows:
                cell = np.zeros(batch.num_rows, np.int64)
                if held:
                    x = _vectors(batch.column(vec))
                    for g, rows in _by_group(batch):
                        if g in held:
                            cell[rows] = held[g].cell(x[rows])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, cell long")


def _meeting(df: DataFrame, trees) -> DataFrame:
    """(g, vid, qv, r, cell) for the cells other than its own that each query's ball meets."""
    def run(batches):
        held = trees.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                x, r, home = _vectors(batch.column("qv")), batch.column("r").to_numpy(), batch.column("cell").to_numpy()
                for g, rows in _by_group(batch):
                    if g in held:
                        q, cell = held[g].meeting(x[rows], r[rows])
                        other = cell != home[rows][q]
                        take, cell = rows[q[other]], cell[other]
                        for s in range(0, len(take), 8192):
                            part = pa.array(take[s:s + 8192])
                            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(part) for c in ("g", "vid", "qv", "r")], pa.array(cell[s:s + 8192])],
                                                             names=["g", "vid", "qv", "r", "cell"])

    return df.select("g", "vid", "qv", "r", "cell").mapInArrow(run, "g string, vid long, qv array<double>, r double, cell long")


# ---------------------------------------------------------------- comparison
def _nearest(keep: int):
    """The ``keep`` nearest ids of each query vector among a cell's points, none beyond the query's radius."""
    def fn(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and t.num_rows:
            qv, tv = _vectors(q.column("qv")), _vectors(t.column("pv"))
            vid, reach = q.column("vid").to_numpy(), q.column("r").to_numpy() ** 2
            ids = t.column("ids").combine_chunks()
            first = ids.offsets.to_numpy().astype(np.int64)
            size = np.diff(first)
            pid = ids.values.field("pid").to_numpy(zero_copy_only=False)
            last = ids.values.field("last").to_numpy(zero_copy_only=False).astype(bool)
            n = ids.values.field("n").to_numpy()
            centre = tv.mean(axis=0)
            tc = tv - centre
            tt = (tc * tc).sum(1)
            step, kk = max(1, _BLOCK // len(tv)), min(keep, len(tv))
            for k in range(0, len(qv), step):
                own = qv[k:k + step]
                qc = own - centre
                qq = (qc * qc).sum(1)
                d2 = qq[:, None] + tt[None, :] - 2.0 * qc @ tc.T
                # the product form may be off by rounding: keep all that may be among the nearest, then measure them directly
                slack = 1e-12 * (qq + tt.max() + 1e-300)
                most = reach[k:k + step]
                far = ~np.isfinite(most)
                if far.any():
                    most = most.copy()
                    most[far] = np.partition(d2[far], kk - 1, axis=1)[:, kk - 1]
                i, j = np.nonzero(d2 <= (most + slack)[:, None])
                exact = np.sqrt(((own[i] - tv[j]) ** 2).sum(axis=1))
                at = np.repeat(first[j] - (np.cumsum(size[j]) - size[j]), size[j]) + np.arange(size[j].sum())  # the ids of each pair
                i, exact = np.repeat(i, size[j]), np.repeat(exact, size[j])
                order = np.lexsort((pid[at], last[at], exact, i))  # ties go to the smaller id, whatever the order of the input
                i, at, exact = i[order], at[order], exact[order]
                on = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
                out.append((vid[k + i[on]], exact[on], pid[at[on]], last[at[on]], n[at[on]]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 5
        return pa.table({"vid": pa.array(cols[0], pa.int64()), "dist": pa.array(cols[1], pa.float64()),
                         "nid": pa.array(cols[2].astype(np.int64), mask=cols[3].astype(bool)), "n": pa.array(cols[4].astype(np.int32))})
    return fn


def _usable(vec: str):
    """No null, and no component that is null or not finite."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def knn(points: DataFrame, k: int, id_col: str, vec_col: str, queries: DataFrame | None = None,
        query_id: str | None = None, query_vec: str | None = None, chunk: int | None = None, group: str | None = None) -> DataFrame:
    """(qid, nid, dist, rank) for the k nearest points of every query (self excluded in a self-join), within its
    ``group`` (a column of both sides) if there is one; rows without a group take no part then.

    Ids must be integral and unique on each side; vectors are arrays of numbers of equal length. Vectors that are null
    or hold null or non-finite components take no part.
    """
    spark, self_join = points.sparkSession, queries is None
    of = F.col(f"`{group}`").cast("string").alias("g") if group else F.lit("").alias("g")
    P = points.select(of, F.col(id_col).cast("long").alias("pid"), F.col(vec_col).cast("array<double>").alias("pv")).where(F.col("g").isNotNull() & _usable("pv"))
    if self_join:
        Q = P.select("g", F.col("pid").alias("qid"), F.col("pv").alias("qv"))
    else:
        Q = queries.select(of, F.col(query_id or id_col).cast("long").alias("qid"),
                           F.col(query_vec or vec_col).cast("array<double>").alias("qv")).where(F.col("g").isNotNull() & _usable("qv"))
    keep = k + 1 if self_join else k  # a query's own id may be among the nearest

    # a row per distinct vector of a group, with its smallest ids (null last) and how many rows have them
    ids = P.groupBy("g", "pv", "pid").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    ids = ids.withColumn("rn", F.row_number().over(Window.partitionBy("g", "pv").orderBy(F.col("pid").asc_nulls_last()))).where(F.col("rn") <= keep)
    entry = F.struct("rn", F.coalesce("pid", F.lit(0)).alias("pid"), F.col("pid").isNull().alias("last"), "n")
    U = _materialize(ids.groupBy("g", "pv").agg(F.sort_array(F.collect_list(entry)).alias("ids")))
    first = U.select(F.size("pv").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "qid long, nid long, dist double, rank int")
    d = first["d"]
    chunk = chunk or (CHUNK_LOW if d <= _LOW else CHUNK)

    big = {r["g"]: r["count"] for r in U.groupBy("g").count().where(F.col("count") > chunk).collect()}  # at most a row per ``chunk`` points
    trees = {}
    if big:
        share = spark.createDataFrame([(g, min(1.0, _PER_CELL * 1.2 / chunk)) for g in big], "g string, share double")
        even = F.pmod(F.xxhash64("pv"), F.lit(1 << 30)) < F.col("share") * float(1 << 30)
        sample: dict[str, list] = {}
        for r in U.join(F.broadcast(share), "g").where(even).select("g", "pv").toLocalIterator():  # _PER_CELL a cell
            sample.setdefault(r["g"], []).append(r["pv"])
        trees = {g: Cells(np.array(sample[g]), -(-big[g] // chunk)) for g in big if g in sample}
    cut = spark.sparkContext.broadcast(trees)
    U = _in_cells(U, "pv", cut)
    if trees:
        U = _materialize(U)
        box = [F.min(F.col("pv")[i]).alias(f"lo{i}") for i in range(d)] + [F.max(F.col("pv")[i]).alias(f"hi{i}") for i in range(d)]
        boxes: dict[str, dict] = {}
        for r in U.where(F.col("g").isin(list(trees))).groupBy("g", "cell").agg(*box).collect():  # a row per cell
            boxes.setdefault(r["g"], {})[r["cell"]] = (np.array(r[2:2 + d]), np.array(r[2 + d:]))
        for g, tree in trees.items():
            tree.bound(boxes[g])
        cut = spark.sparkContext.broadcast(trees)
    asked = Q.select("g", "qv").distinct().withColumn("vid", F.monotonically_increasing_id())
    asked = _in_cells(_materialize(asked), "qv", cut)

    def compare(qs: DataFrame) -> DataFrame:
        """qs: (g, vid, qv, r, cell) -- each query vector against its ``cell``, chunks of queries apart."""
        parts = qs.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * chunk)).cast("int").alias("parts"))
        key = ["g", "cell", "part"]
        qx = qs.join(parts, ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).select(*key, "vid", "qv", "r")
        tx = U.join(parts, ["g", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "pv", "ids")
        return qx.groupBy(*key).cogroup(tx.groupBy(*key)).applyInArrow(_nearest(keep), _FOUND)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("vid").orderBy("dist", F.col("nid").asc_nulls_last())
        return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)

    found = compare(asked.withColumn("r", F.lit(float("inf"))))
    if trees:
        # the radius is infinite where fewer were seen than wanted
        found = _materialize(found)
        seen = found.groupBy("vid").agg(F.when(F.count(F.lit(1)) >= keep, F.max("dist")).alias("r"))
        others = _meeting(asked.join(seen, "vid", "left").withColumn("r", F.coalesce("r", F.lit(float("inf")))), cut)  # dealt twice, never written
        found = best(found.unionByName(compare(others))).drop("rn")
    lists = found.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("dist", F.col("nid").isNull().alias("last"), "nid", "n"))).alias("near"))
    answers = asked.select("g", "qv", "vid").join(lists, "vid").select("g", "qv", "near")
    # its own id leaves a query's list; an id of several rows counts as often
    pairs = Q.join(answers, ["g", "qv"])
    if self_join:
        pairs = pairs.withColumn("near", F.expr("filter(near, x -> NOT coalesce(x.nid = qid, false))"))
    pairs = pairs.select("qid", F.explode(F.slice("near", 1, k)).alias("x")).select(
        "qid", "x.nid", "x.dist", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("_copy"))
    w = Window.partitionBy("qid").orderBy("dist", F.col("nid").asc_nulls_last())
    return pairs.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("qid", "nid", "dist", "rank")


def _materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of what is read more than once.

    Written to the shared checkpoint folder (reliable checkpoint), so a lost
    executor does not force the pair comparisons to run again.
    """
    spark = df.sparkSession
    from tablelens.session import scratch_dir
    scratch_dir(spark)
    return df.checkpoint(eager=True)
