"""Embedding near-duplicates by randomised-rotation binary codes.

Every unit vector is turned by one random rotation and stored as its sign bits o' (scaled to length 1) with
the correction factor a = <o, o'>. For a vector q, <q, o'> / a is an unbiased estimate of <q, o> over random
rotations. The parts of q and o outside
o' have lengths sqrt(1 - <q,o'>^2) and sqrt(1 - a^2), and a random rotation turns the second part in a random
direction, so the estimate's error has the deviation

    sqrt((1 - a^2) (1 - <q,o'>^2) / (d - 1)) / a

and never exceeds that without the root of d - 1. Which pairs need exact recomputation is decided in two steps, in
double precision:

* the estimate and its confidence bound (``CONFIDENCE`` deviations) pick the likely pairs, which are recomputed
  first, best estimates first;
* the bound that holds with certainty, a <q,o'> +- sqrt((1 - a^2)(1 - <q,o'>^2)), is the guard. Pairs outside the
  confidence bound whose certain upper bound reaches the threshold are recomputed too; a pair whose certain upper
  bound stays below it can't link and is not looked at again. So no link is lost by a rare error of the estimate,
  and a link is only ever told from the vectors themselves.

Vectors are dealt to cells around pivots (a bounded sample of the vectors), cells to blocks. A vector meets another
block only if the triangle inequality on the sphere leaves room for a partner: its angle to the other pivot is
within that cell's radius and the threshold's angle, and it is near enough to the bisector of the two pivots. Where
the data have no structure the inequality can't exclude blocks, and any exact method must estimate most pairs; the
estimate then is one product of a code block and a vector block. A block holds some ``64 sqrt(n)`` vectors, within
bounds set by a task's memory (``block_rows`` sets it), so vectors are dealt about sqrt(n) / 64 times until blocks
are full (a million vectors), and from there on in proportion to n / 65,536.

Equal vectors are one vector with a count, so copies make no pairs. Tasks return numbers of links and a
spanning set of them, never pairs, so a dense group of near copies stays linear outside its block products; that is
why whole vectors are dealt rather than codes: recomputing pairs elsewhere would send every pair of such a group.

Defined results: vectors null, zero, or holding null or non-finite components, and rows with a null id, link with
nothing and are their own component (``component_id`` is their id, ``kept`` is true); vectors of different lengths
don't link; rows with one id are rows of their own, each with the links and the component of its own vector, and
``kept`` where that component's smallest id is theirs; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import salted_join, written
from tablelens.llm.components import components
from tablelens.llm.vectors import matrix, packed, unpacked, unusable, usable

SEED = 11
_SLACK = 1e-9  # more than double rounding can move an angle
#: More than double rounding can move the certain bound: where 1 - b^2 is rounded by some 1e-15, its root may be
#: off by the root of that.
_CERTAIN = 1e-6
#: Deviations of the estimate within which a pair is likely.
CONFIDENCE = 4.0


def rotation(dim: int) -> np.ndarray:
    """The random rotation for vectors of this length."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    bits = np.unpackbits(codes, axis=1, count=dim).astype(float)
    return (2 * bits - 1) / np.sqrt(dim)


def estimates(turned: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, deviation, certain upper bound) of the cosines of rotated unit vectors and coded ones."""
    dim = turned.shape[1]
    b = turned @ code.T
    # squares may exceed 1 by rounding; what they miss of the true loss is within the slack below
    loss = np.sqrt(np.maximum(0, 1 - factor * factor)[None, :] * np.maximum(0, 1 - b * b))
    return b / factor, loss / (factor * np.sqrt(max(1, dim - 1))), factor * b + loss


def near_pairs(left: np.ndarray, right: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float):
    """Pairs (i, j) with cosine >= threshold. ``left``, ``right``: vectors; ``codes``, ``factor``: of right."""
    dim = left.shape[1]
    norm_l, norm_r = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    turned = (left / norm_l[:, None]) @ rotation(dim)
    code = signs(codes, dim)
    out = []

    def recompute(i, j):
        for s in range(0, len(i), 1 << 17):
            x, y = i[s:s + (1 << 17)], j[s:s + (1 << 17)]
            cos = np.einsum("ij,ij->i", left[x], right[y]) / (norm_l[x] * norm_r[y])
            on = cos >= threshold
            out.append((x[on], y[on]))

    for k in range(0, len(left), 256):
        estimate, deviation, upper = estimates(turned[k:k + 256], code, factor)
        possible = upper >= threshold - _CERTAIN
        likely = possible & (estimate + CONFIDENCE * deviation >= threshold)
        i, j = np.nonzero(likely)
        best = np.argsort(-estimate[i, j], kind="stable")
        recompute(i[best] + k, j[best])
        i, j = np.nonzero(possible & ~likely)  # the guard's pairs
        recompute(i + k, j)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A forest over 0..n-1 with the same components as the links."""
    root = np.arange(n)
    while len(a):  # hook the larger root to the least it meets, then flatten
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        on = low != high
        if not on.any():
            break
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while (root != root[root]).any():
            root = root[root]
    return [(int(root[i]), i) for i in np.flatnonzero(root != np.arange(n))]


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding",
                         block_rows: int | None = None, most_pivots: int = 256) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per input row."""
    rows = written(usable(vectors, id_col, vec_col).withColumn("mark", F.xxhash64("vec")), "vectors")
    same = ["dim", "mark", "vec"]
    distinct = rows.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")  # numbered once, as written
    reps = None
    for dim, n in sorted((r["dim"], r["count"]) for r in distinct.groupBy("dim").count().collect()):  # few lengths
        block = block_rows or int(min(1 << 16, max(4096, 64 * n ** 0.5)))
        found = _links(distinct.where(F.col("dim") == dim), dim, n, threshold, block, most_pivots)
        reps = found if reps is None else reps.union(found)
    if reps is None:
        return vectors.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                              F.col(f"`{id_col}`").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    reps = written(reps, "links")
    partners = reps.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(reps.where("kind = 1").select("a", "b"))
    classes = written(distinct.select(*same, "rep", "least", "copies").join(partners, "rep", "left")
                      .join(roots, F.col("rep") == F.col("node"), "left")
                      .select(*same, "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "classes")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(smallest, "root").select(*same, "copies", "n_links", "component_id"), "classes")
    linked = salted_join(rows.select("id", *same), classes, same, "copies").select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = unusable(vectors, id_col, vec_col).select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)


def _links(distinct: DataFrame, dim: int, n: int, threshold: float, block_rows: int, most_pivots: int) -> DataFrame:
    """(kind, a, b, n) of vectors of one length: kind 0: n rows link to a; kind 1: a spanning link a - b."""
    count = int(min(most_pivots, max(1, n // block_rows)))
    sample = distinct.select("mark", "rep", "vec").orderBy("mark", "rep").limit(count).toArrow()  # the bounded sample
    pivots = matrix(sample.column("vec"))
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    angle = float(np.arccos(min(1.0, threshold)))

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = matrix(batch.column("vec"))
            unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
            codes, factor = encode(unit)
            cos = np.clip(unit @ pivots.T, -1, 1)
            cell = cos.argmax(axis=1)
            far = np.arccos(cos[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("mark"), packed(vec), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(factor), pa.array(cell.astype(np.int32)), pa.array(far)], names=["rep", "copies", "mark", "vec", "code", "factor", "cell", "far"])

    dealt = written(distinct.select("rep", "copies", "mark", "vec")
                    .mapInArrow(deal, "rep long, copies long, mark long, vec binary, code binary, factor double, cell int, far double"), "dealt")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()  # at most most_pivots rows
    blocks, radius = np.zeros(count, np.int64), np.zeros(count)
    blocks[cells["cell"]] = -(-cells["n"].to_numpy() // block_rows)
    radius[cells["cell"]] = cells["far"].to_numpy()
    start = np.concatenate([[0], np.cumsum(blocks)])
    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def meet(batches):
        """Each vector once for every pair of blocks that it takes part in."""
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = unpacked(batch.column("vec"), dim)
            unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
            cell = batch.column("cell").to_numpy()
            home = start[cell] + (batch.column("mark").to_numpy().view(np.uint64) % blocks[cell].astype(np.uint64)).astype(np.int64)
            cos = np.clip(unit @ pivots.T, -1, 1)
            near = np.arccos(cos) <= radius + angle + _SLACK
            # |x-p'|^2 - |x-p|^2 <= 2 |p-p'| |x-y| for any y at least as near to p' as to p
            slack = 2 * np.sin(angle / 2) * 2 * gap[cell] + _SLACK
            near &= 2 * (cos[np.arange(len(cell)), cell][:, None] - cos) <= slack
            near[np.arange(len(cell)), cell] = True
            near &= (blocks > 0)[None, :]
            i, c = np.nonzero(near)
            each = blocks[c]
            i, other = np.repeat(i, each), np.repeat(start[c] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            low, high = np.minimum(home[i], other), np.maximum(home[i], other)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(home[i])] + [batch.column(k).take(pa.array(i)) for k in ("rep", "copies", "vec", "code", "factor")],
                                             names=["low", "high", "home", "rep", "copies", "vec", "code", "factor"])

    def link(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        home = t.column("home").to_numpy()
        left = np.flatnonzero(home == low)
        right = left if low == high else np.flatnonzero(home == high)
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            vec = unpacked(t.column("vec"), dim)
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
            x, y = near_pairs(vec[left], vec[right], codes[right], t.column("factor").to_numpy()[right], threshold)
            a, b = left[x], right[y]
            if low == high:
                a, b = a[a < b], b[a < b]
        n = np.bincount(a, weights=copies[b], minlength=len(rep)) + np.bincount(b, weights=copies[a], minlength=len(rep))
        has = np.flatnonzero(n)
        tree = spanning(a, b, len(rep))
        kinds = [0] * len(has) + [1] * len(tree)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array([*rep[has].tolist(), *(rep[x] for x, _ in tree)], pa.int64()),
                         "b": pa.array([None] * len(has) + [rep[y] for _, y in tree], pa.int64()),
                         "n": pa.array([*n[has].astype(np.int64).tolist(), *[0] * len(tree)], pa.int64())})

    met = dealt.mapInArrow(meet, "low long, high long, home long, rep long, copies long, vec binary, code binary, factor double")
    return met.groupBy("low", "high").applyInArrow(link, "kind int, a long, b long, n long")
