"""Exact duplicates by Patricia-trie owners.

1. Every task inserts the full byte strings of its rows into a compressed radix trie. The terminal node of a
   string is its owner: it stores the identifier that stays (the smallest or the largest) and the number of
   rows. Copies inside a task thus become one owner before anything is shuffled, however many there are. When
   a trie holds more than ``trie_bytes``, its largest subtrees are spilled: their owners leave the task as rows,
   and a string met again later gets a further owner.
2. Owners are partitioned by length and content hash. An owner alone with its length and hash has no equal
   elsewhere; the others go, with their strings, to the task of their partition, sorted by length and hash, and
   are inserted into a trie again, so equality is always decided on whole strings, never on hashes. Subtrees of
   lengths and hashes that are done are spilled to the output when the trie is full.
3. A string that many tasks hold has one owner per task (or spill). Such owners are merged by a tree: ``fan`` of
   them at a time, in as many rounds as that takes.

Rows learn the owner of their group by joining on the token of the owner that their own task gave them: such a
token belongs to one task's rows, so a group of any size is spread over tasks.

Defined results: a null text is empty; a null identifier loses to any other, and a group without any has the
null one; of rows that share the identifier that stays exactly one is ``kept`` (they are alike in all that is
returned); an empty table gives no rows; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.common import by_bytes, written

_NODE_BYTES = 500  # what a node and its owner cost besides the edge


class Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner = edge, {}, None


def agreement(a: bytes, b: bytes) -> int:
    """Leading bytes that two strings of one length share."""
    differ = int.from_bytes(a) ^ int.from_bytes(b)
    return len(a) - (differ.bit_length() + 7) // 8


class Trie:
    """A compressed radix trie of byte strings; ``owner`` of a terminal node is the caller's."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, key: bytes) -> Node:
        """The terminal node of ``key``, made where it is new (its owner is None then)."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.edge) + _NODE_BYTES
                return child
            edge = child.edge
            if not key.startswith(edge, at):  # the edge is cut where the two part, or where the key ends
                rest = key[at:at + len(edge)]
                k = agreement(edge[:len(rest)], rest)
                fork = node.children[key[at]] = Node(edge[:k])
                child.edge = edge[k:]
                fork.children[child.edge[0]] = child
                self.bytes += _NODE_BYTES
                child, edge = fork, fork.edge
            node, at = child, at + len(edge)
        return node

    def owners(self, top: Node | None = None, lead: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(string, owner) of all terminal nodes at and under ``top``."""
        todo = [(top or self.root, lead)]
        while todo:
            node, lead = todo.pop()
            own = lead + node.edge
            if node.owner is not None:
                yield own, node.owner
            todo += [(c, own) for c in node.children.values()]

    def _sizes(self) -> dict[int, int]:
        sizes, todo = {}, [(self.root, False)]
        while todo:
            node, seen = todo.pop()
            if seen:
                sizes[id(node)] = len(node.edge) + _NODE_BYTES + sum(sizes[id(c)] for c in node.children.values())
            else:
                todo.append((node, True))
                todo += [(c, False) for c in node.children.values()]
        return sizes

    def spill(self, most: int) -> Iterator[tuple[bytes, object]]:
        """Take out the largest subtrees until at most ``most`` bytes are left; their strings and owners."""
        sizes = self._sizes()
        while self.bytes > most and self.root.children:
            path, lead, need = [self.root], b"", self.bytes - most
            best = max(self.root.children.values(), key=lambda c: sizes[id(c)])
            while True:  # no more than needed: go down while one child alone is enough
                down = max(best.children.values(), key=lambda c: sizes[id(c)], default=None)
                if down is None or sizes[id(down)] < need:
                    break
                path.append(best)
                lead, best = lead + best.edge, down
            del path[-1].children[best.edge[0]]
            for p in path:
                sizes[id(p)] -= sizes[id(best)]
            self.bytes -= sizes[id(best)]
            yield from self.owners(best, lead)


def _better(a, b, largest: bool) -> bool:
    """Whether (id, row) ``a`` stays rather than ``b``: nulls lose, ties go to the earlier row."""
    if a[0] is None or b[0] is None:
        return b[0] is None and (a[0] is not None or a[1] < b[1])
    if a[0] == b[0]:
        return a[1] < b[1]
    return (a[0] > b[0]) == largest


class _Owner:
    __slots__ = ("token", "best", "n", "size", "hash", "sha", "big")

    def __init__(self, token, best, n, size, digest, sha, big=1):
        self.token, self.best, self.n, self.size, self.hash, self.sha, self.big = token, best, n, size, digest, sha, big


def _owner_columns(found: list[tuple[bytes, _Owner]], id_type: pa.DataType) -> dict[str, pa.Array]:
    o = [w for _, w in found]
    return {"token": pa.array([w.token for w in o], pa.int64()), "size": pa.array([w.size for w in o], pa.int64()),
            "hash": pa.array([w.hash for w in o], pa.int64()), "sha": pa.array([w.sha for w in o], pa.string()),
            "best": pa.array([w.best[0] for w in o], id_type), "best_row": pa.array([w.best[1] for w in o], pa.int64()),
            "n": pa.array([w.n for w in o], pa.int64()), "big": pa.array([w.big for w in o], pa.int64()), "text": pa.array([t for t, _ in found], pa.binary())}


def _batch(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)


def _in_parts(found: Iterator, id_type: pa.DataType, schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for text, owner in found:
        part.append((text, owner))
        size += len(text) + 100
        if size > limit:
            yield _batch(_owner_columns(part, id_type), schema)
            part, size = [], 0
    if part:
        yield _batch(_owner_columns(part, id_type), schema)


def _local_owners(docs: DataFrame, id_type: T.DataType, largest: bool, trie_bytes: int) -> DataFrame:
    """Rows (id, token, row) and owners (token, size, hash, sha, best, best_row, n, text) of every task."""
    names = [("id", id_type), ("token", T.LongType()), ("row", T.LongType()), ("size", T.LongType()), ("hash", T.LongType()),
             ("sha", T.StringType()), ("best", id_type), ("best_row", T.LongType()), ("n", T.LongType()), ("text", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names])
    fields = [(n, t.simpleString()) for n, t in names[1:]]

    def run(batches):
        trie, count, base, arrow, id_arrow = Trie(), 0, TaskContext.get().partitionId() << 36, None, None
        for batch in batches:
            if arrow is None:
                id_arrow = batch.schema.field("id").type
                of = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                arrow = pa.schema([("id", id_arrow)] + [(n, id_arrow if n == "best" else of[t]) for n, t in fields])
            for part in by_bytes([batch], "text", 4 << 20):
                tokens, first = [], base + count
                for i, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    node, own = trie.insert(text), (i, base + count)
                    count += 1
                    if node.owner is None:
                        node.owner = _Owner(own[1], own, 1, len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63), hashlib.sha256(text).hexdigest())
                    else:
                        node.owner.n += 1
                        if _better(own, node.owner.best, largest):
                            node.owner.best = own
                    tokens.append(node.owner.token)
                yield _batch({"id": part.column("id"), "token": pa.array(tokens, pa.int64()), "row": pa.array(range(first, base + count), pa.int64())}, arrow)
                if trie.bytes > trie_bytes:
                    yield from _in_parts(trie.spill(trie_bytes // 2), id_arrow, arrow)
        if arrow is not None:
            yield from _in_parts(trie.owners(), id_arrow, arrow)

    return docs.mapInArrow(run, schema)


def _merge(owners: DataFrame, largest: bool, trie_bytes: int) -> DataFrame:
    """Equal owners of a (size, hash, salt) become one: links (token, to), and the merged owners."""
    id_type = owners.schema["best"].dataType
    schema = T.StructType([T.StructField("to", T.LongType()), *[owners.schema[c] for c in
                                                               ("token", "size", "hash", "sha", "best", "best_row", "n", "big", "text")]])

    def run(batches):
        trie, arrow, id_arrow, before = Trie(), None, None, None
        for batch in batches:
            if arrow is None:
                id_arrow = batch.schema.field("best").type
                arrow = pa.schema([("to", pa.int64()), *[batch.schema.field(f.name) for f in schema.fields[1:]]])
            to = []
            for r in batch.to_pylist():
                lead = r["size"].to_bytes(8) + (r["hash"] + (1 << 63)).to_bytes(8) + r["salt"].to_bytes(8)
                if lead != before and trie.bytes > trie_bytes:  # sorted: no string of an earlier lead comes again
                    yield from _in_parts(((t[24:], o) for t, o in trie.owners()), id_arrow, arrow)
                    trie = Trie()
                before, node, own = lead, trie.insert(lead + r["text"]), (r["best"], r["best_row"])
                if node.owner is None:
                    node.owner = _Owner(r["token"], own, r["n"], r["size"], r["hash"], r["sha"], r["big"])
                else:
                    node.owner.n += r["n"]
                    if _better(own, node.owner.best, largest):
                        node.owner.best = own
                to.append(node.owner.token)
            yield _batch({"token": batch.column("token"), "to": pa.array(to, pa.int64())}, arrow)
        if arrow is not None:
            yield from _in_parts(((t[24:], o) for t, o in trie.owners()), id_arrow, arrow)

    return (owners.repartition("size", "hash", "salt").sortWithinPartitions("size", "hash", "salt").mapInArrow(run, schema))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "smallest",
                     normalise: Callable[[Column], Column] | None = None, trie_bytes: int = 24 << 20, fan: int = 64) -> DataFrame:
    """(id_col, keep_id, group_size, kept, sha), one row per input row: of rows with equal texts (after
    ``normalise``) the one with the ``smallest`` or ``largest`` identifier stays. ``sha``: SHA-256 of the
    normalised text."""
    if stays not in ("smallest", "largest"):
        raise ValueError("stays: smallest or largest")
    largest = stays == "largest"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("").cast(docs.schema[text_col].dataType))
    text = F.coalesce(normalise(text) if normalise else text, F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    local = written(_local_owners(rows, docs.schema[id_col].dataType, largest, trie_bytes), "owners")
    owners = local.where("text IS NOT NULL")
    shared = written(owners.groupBy("size", "hash").agg(F.count("*").alias("big")).where("big > 1"), "shared")
    most = shared.agg(F.max("big")).first()[0] or 0
    state = ["sha", "best", "best_row", "n"]
    final = owners.select("token", *state)
    if most:
        level = owners.drop("id", "row").join(shared, ["size", "hash"])
        links = done = None
        while True:  # one round, or as many as a tree of this fan needs for the string with most owners
            salted = level.withColumn("salt", F.expr(f"pmod(xxhash64(token), (big + {fan - 1}) div {fan})").cast("long"))
            out = written(_merge(salted, largest, trie_bytes), "merged")
            step, tops = out.where("to IS NOT NULL").select("token", "to"), out.where("to IS NULL")
            links = step if links is None else links.join(step.select(F.col("token").alias("to"), F.col("to").alias("next")), "to", "left").select(
                "token", F.coalesce("next", "to").alias("to"))
            ready = tops.where(F.col("big") <= fan).select(F.col("token").alias("to"), *[F.col(c).alias(f"m_{c}") for c in state[1:]])
            done = ready if done is None else done.union(ready)
            if most <= fan:
                break
            most = -(-most // fan)
            level = tops.where(F.col("big") > fan).drop("to").withColumn("big", F.expr(f"(big + {fan - 1}) div {fan}"))
        merged = links.join(done, "to").drop("to")
        final = final.join(merged, "token", "left").select("token", "sha", *[
            F.when(F.col("m_n").isNotNull(), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in state[1:]])
    return (local.where("text IS NULL").select("id", "token", "row").join(final, "token")
            .select(F.col("id").alias(id_col), F.col("best").alias("keep_id"), F.col("n").alias("group_size"),
                    (F.col("row") == F.col("best_row")).alias("kept"), "sha"))
