"""Nearest neighbours by low-dimensional stable projections.

Largest inner product is made nearest distance by one more component: x' = (x, sqrt(M^2 - |x|^2)) with M the
largest norm, q' = (q, 0); then |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. Every x' is projected by ``m`` Gaussian
(2-stable) directions. The projected squared distance over the true one is chi-square with m degrees of
freedom, so a vector nearer than the k-th best found so far lies, with probability ``confidence``, within
projected distance sqrt(chi2 quantile) times that best. A query therefore goes through its projected
neighbours from near to far, verifies each on the whole vector, and stops when the next one's projected
distance fails this test.

The projections are indexed by a kd-tree in two parts. The upper splits are medians of a bounded sample; its
cells are dealt over the cluster in blocks of bounded size, so that every row is indexed. A query starts with
its k best of the sample, verified on whole vectors, and is sent to the cells whose box passes the test. Each block holds the lower
part of the tree, and searches leaf by leaf in the order of the box distances. A block meets queries in chunks
of bounded size; results of blocks are merged by rank.

Equal vectors are indexed once with their k + 1 least ids, so copies of any number cost no more. Ids that are
repeated with the same vector count once.

Defined results: vectors null, zero, or holding null or non-finite components take no part, as queries or
candidates; a query with fewer candidates than k returns them all; only vectors of the query's length are
candidates; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import written
from tablelens.llm.vectors import matrix, packed, unpacked, usable

SEED = 3
LEAF = 64


def chi2_quantile(m: int, p: float) -> float:
    """x with P(chi-square with m (even) degrees of freedom <= x) = p."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, m]).standard_normal((dim + 1, m))


def lifted(vec: np.ndarray, most2: float) -> np.ndarray:
    return np.concatenate([vec, np.sqrt(np.maximum(0, most2 - (vec * vec).sum(axis=1)))[:, None]], axis=1)


def splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits of the widest axis, breadth first: node i has children 2i + 1 and 2i + 2."""
    parts, out = [points], []
    for _ in range(depth):
        nxt = []
        for p in parts:
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
            cut = float(np.median(p[:, axis])) if len(p) else 0.0
            out.append((axis, cut))
            nxt += [p[p[:, axis] < cut], p[p[:, axis] >= cut]]
        parts = nxt
    return out


def cell_of(points: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axis, cut = np.array([a for a, _ in tree], np.int64), np.array([c for _, c in tree])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= cut[at])
    return at - ((1 << depth) - 1)


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree over a block's points."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        p = points[rows]
        spread = p.max(axis=0) - p.min(axis=0)
        axis = int(np.argmax(spread))
        if len(rows) <= LEAF or spread[axis] == 0:
            out.append(rows)
        else:
            order = np.argpartition(p[:, axis], len(rows) // 2)
            todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, (points, boxes)."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        x = q[:, j:j + 1]
        gap = np.maximum(0, np.maximum(low[None, :, j] - x, x - high[None, :, j]))
        out += gap * gap
    return out


def search(vec, proj, only, first_id, q_vec, q_proj, q_id, q_base, q_best, k, limit):
    """The k best rows of a block for each query, as (query, row, score). ``q_base`` is |q|^2 + M^2, ``q_best`` the
    k-th best squared distance known before, ``limit`` the chi-square quantile; ``only``: the id of a row that
    stands for one id only, which a query of this id skips.

    Every query goes through the leaves in the order of their boxes' distances, in rounds of growing length;
    a round takes one leaf after the other for all queries that have it next. A query ends when its next
    projected neighbour fails the test; rows that can't be among its k best are not kept."""
    groups = leaves(proj)
    low, high = np.array([proj[g].min(axis=0) for g in groups]), np.array([proj[g].max(axis=0) for g in groups])
    flat = np.concatenate(groups)
    end = np.cumsum([len(g) for g in groups])
    begin = end - [len(g) for g in groups]
    vec, proj, only, first = vec[flat], proj[flat], only[flat], first_id[flat]
    p2, q2, best = (proj * proj).sum(axis=1), (q_proj * q_proj).sum(axis=1), q_best.copy()
    lower = box_distance2(q_proj, low, high)
    order = np.argsort(lower, axis=1, kind="stable")
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    at, step = 0, 4
    while at < len(groups):
        nxt = order[:, at:at + step]
        go = np.take_along_axis(lower, nxt, axis=1) <= limit * best[:, None]
        if not go.any():  # farther leaves fail as well
            break
        i, c = np.nonzero(go)
        leaf = nxt[i, c]
        by = np.argsort(leaf, kind="stable")
        i, leaf = i[by], leaf[by]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        new = [top]
        for qs, g in zip(np.split(i, cuts), leaf[np.concatenate([[0], cuts])]):
            a, b = begin[g], end[g]
            score = q_vec[qs] @ vec[a:b].T
            d = q2[qs, None] + p2[None, a:b] - 2 * q_proj[qs] @ proj[a:b].T
            ok = (d <= limit * best[qs, None] + 1e-9) & (score >= (q_base[qs] - best[qs])[:, None] / 2 - 1e-9) & (only[None, a:b] != q_id[qs, None])
            x, y = np.nonzero(ok)
            new.append((qs[x], a + y, score[x, y]))
        query, row, score = (np.concatenate(z) for z in zip(*new))
        o = np.lexsort((first[row], -score, query))
        query, row, score = query[o], row[o], score[o]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = query[rank < k], row[rank < k], score[rank < k]
        kth = rank == k - 1
        best[query[kth]] = np.minimum(best[query[kth]], np.maximum(0.0, q_base[query[kth]] - 2 * score[kth]))
        at, step = at + step, 2 * step
    return top[0], flat[top[1]], top[2]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", m: int = 8,
            confidence: float = 0.99, block_rows: int = 8192, chunk_rows: int = 4096, sample_rows: int = 4096, most_cells: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner product found for each
    row of ``queries`` (same columns), rows with the query's id left out."""
    rows = usable(vectors, id_col, vec_col).withColumn("mark", F.xxhash64("vec")).select("dim", "mark", "vec", "id").distinct()
    place = F.row_number().over(Window.partitionBy("dim", "mark", "vec").orderBy("id"))
    index = written(rows.withColumn("k", place).where(F.col("k") <= k + 1)
                    .groupBy("dim", "mark", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "index")
    asked = written(usable(queries, id_col, vec_col).select("dim", "id", "vec").distinct(), "queries")
    found = None
    sizes = {r["dim"]: (r["n"], r["most2"]) for r in index.groupBy("dim").agg(
        F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most2")).collect()}  # few lengths
    counts = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    for dim in sorted(set(sizes) & set(counts)):
        part = _search_all(index.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), dim, *sizes[dim], counts[dim], k, m,
                           confidence, block_rows, chunk_rows, sample_rows, most_cells)
        found = part if found is None else found.union(part)
    if found is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    hits = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors: its best
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search_all(index, asked, dim, n, most2, n_queries, k, m, confidence, block_rows, chunk_rows, sample_rows, most_cells) -> DataFrame:
    """(query_id, ids, score) found in the blocks, for vectors of one length."""
    to, limit = directions(dim, m), chi2_quantile(m, confidence)
    most2 *= 1 + 1e-12
    sample = index.select("mark", "vec", "ids").orderBy("mark").limit(sample_rows).toArrow()  # the bounded sample
    s_vec, s_ids = matrix(sample.column("vec")), sample.column("ids").to_pylist()
    s_only = np.array([x[0] if len(x) == 1 else -(1 << 62) for x in s_ids], np.int64)
    depth = min(int(math.log2(most_cells)), max(0, math.ceil(math.log2(max(1, n / block_rows)))))
    tree = splits(lifted(s_vec, most2) @ to, depth)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                vec = matrix(batch.column("vec"))
                proj = lifted(vec, most2) @ to
                cols = [batch.column("ids"), batch.column("mark"), packed(vec), packed(proj), pa.array(cell_of(proj, tree, depth)), *[pa.array(proj[:, j]) for j in range(m)]]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "mark", "vec", "proj", "cell", *[f"p{j}" for j in range(m)]])

    axes = ", ".join(f"p{j} double" for j in range(m))
    dealt = written(index.select("ids", "mark", "vec").mapInArrow(deal, f"ids array<long>, mark long, vec binary, proj binary, cell long, {axes}"), "dealt")
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(f"p{j}").alias(f"a{j}") for j in range(m)], *[F.max(f"p{j}").alias(f"b{j}") for j in range(m)]).toPandas()
    cells = boxes["cell"].to_numpy()  # at most most_cells rows
    low, high = boxes[[f"a{j}" for j in range(m)]].to_numpy(), boxes[[f"b{j}" for j in range(m)]].to_numpy()
    blocks = np.zeros(1 << depth, np.int64)
    blocks[cells] = -(-boxes["n"].to_numpy() // block_rows)
    chunks = -(-n_queries // chunk_rows)

    def start(batches):
        """Each query with its k best of the sample, and the k-th best squared distance."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, ids = matrix(batch.column("vec")), batch.column("id").to_numpy()
            base, best, near, scores = (vec * vec).sum(axis=1) + most2, np.full(len(vec), np.inf), [], []
            for s in range(0, len(vec), 1024):
                score = vec[s:s + 1024] @ s_vec.T
                score[ids[s:s + 1024, None] == s_only[None, :]] = -np.inf
                for r, row in enumerate(score):
                    top = np.argsort(-row, kind="stable")[:k] if len(row) <= 4 * k else np.argpartition(-row, k)[:k]
                    top = top[np.isfinite(row[top])]
                    if len(top) == k:
                        best[s + r] = max(0.0, base[s + r] - 2 * row[top].min()) + 1e-9
                    near.append([s_ids[t] for t in top])
                    scores.append(row[top])
            yield pa.RecordBatch.from_arrays([pa.array(ids), packed(vec), pa.array(base), pa.array(best), pa.array(near, pa.list_(pa.list_(pa.int64()))), pa.array(scores, pa.list_(pa.float64()))],
                                             names=["id", "vec", "base", "best", "near", "scores"])

    def visit(batches):
        """Each query once for every block that it must search."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, ids = unpacked(batch.column("vec"), dim), batch.column("id").to_numpy()
            base, best = batch.column("base").to_numpy(), batch.column("best").to_numpy()
            proj = np.concatenate([vec, np.zeros((len(vec), 1))], axis=1) @ to
            i, c = np.nonzero(box_distance2(proj, low, high) <= limit * best[:, None])
            each = blocks[cells[c]]
            i, c = np.repeat(i, each), np.repeat(cells[c], each)
            sub = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            chunk = (ids * 0x9E3779B1 % 0x7FFFFFFF % chunks)[i]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(sub), pa.array(chunk), pa.array([[x] for x in ids[i].tolist()], pa.list_(pa.int64())),
                                              packed(vec[i]), packed(proj[i]), pa.array(base[i]), pa.array(best[i])], names=["cell", "sub", "chunk", "ids", "vec", "proj", "base", "best"])

    keys = ["cell", "sub", "chunk"]
    started = written(asked.select("id", "vec").mapInArrow(start, "id long, vec binary, base double, best double, near array<array<long>>, scores array<double>"), "started")
    begun = started.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("n")).select("query_id", F.col("n.near").alias("ids"), F.col("n.scores").alias("score"))
    visits = written(started.select("id", "vec", "base", "best").mapInArrow(visit, "cell long, sub long, chunk long, ids array<long>, vec binary, proj binary, base double, best double"), "visits")
    per_cell = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), (F.col("cell") + 1).cast("int"))
    stored = (dealt.withColumn("sub", F.pmod(F.col("mark"), per_cell.cast("long"))).join(visits.select(*keys).distinct(), ["cell", "sub"])
              .select(*keys, "ids", "vec", "proj", F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("best")))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t.column("base").is_valid()
        q, c = t.filter(asks), t.filter(pa.compute.invert(asks))
        i = j = np.zeros(0, np.int64)
        score = np.zeros(0)
        ids = c.column("ids").to_pylist()
        q_id = np.array([x[0] for x in q.column("ids").to_pylist()], np.int64)
        if len(ids) and len(q_id):
            only = np.array([x[0] if len(x) == 1 else -(1 << 62) for x in ids], np.int64)
            i, j, score = search(unpacked(c.column("vec"), dim), unpacked(c.column("proj"), m), only, np.array([x[0] for x in ids], np.int64),
                                 unpacked(q.column("vec"), dim), unpacked(q.column("proj"), m), q_id, q.column("base").to_numpy(), q.column("best").to_numpy(), k, limit)
        return pa.table({"query_id": pa.array(q_id[i], pa.int64()), "ids": pa.array([ids[x] for x in j.tolist()], pa.list_(pa.int64())), "score": pa.array(score, pa.float64())})

    return begun.union(visits.union(stored).groupBy(*keys).applyInArrow(run, "query_id long, ids array<long>, score double"))
