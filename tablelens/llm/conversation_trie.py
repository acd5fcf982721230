"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has the fingerprint sum of letter_i * B^(n - i) modulo 2^61 - 1 (two bases, so 122 bits); a
letter is the digest of a turn's role and text. Fingerprints form a monoid: that of "s then t" is F(s) * B^|t| +
F(t), so a piece cut off in front is subtracted the same way. A rebuilt conversation, the head of its base then
its own turns after the head, is never put together: with the prefix fingerprints F of the stored conversations,
its prefix that ends at own turn i > h has the fingerprint

    F_own(i) + (F_base(h') - F_own(h)) * B^(i - h)

so one pair of numbers per conversation turns stored prefixes into rebuilt ones.

1. Stored turns are sorted by conversation and turn over range slices; each slice multiplies up its prefixes, and
   the products of the slices before it (one row per slice) are carried in. A conversation of any length is spread
   over slices.
2. Prefix groups (depth, fingerprint) are the nodes. Equality is verified, not trusted: all turns with one pair of
   letters must have one role and text (grouped by the strings themselves), and all members of a prefix group must
   refer to stored turns of one letter and have one parent group; from the root down that makes the sequences
   equal. Should it fail, all is done again with other letters.
3. Sums over subtrees need no walk: a node's figures are put on its smallest member's path, summed along that path
   from its end (again over slices), and a subtree's sum is the sum over the members of its top.
4. Digests of member lists: range slices write the lists in pieces, and one stream per node hashes its pieces.

Hot nodes (the root, a common first turn) are pre-aggregated in every step; children look up parents that have
very many of them in a broadcast list of at most ``_WIDE`` nodes, others by a hash join.

Defined results: a null role or text is empty; rows without conversation id take no part; turns of one number are
ordered by the first 64 characters of role and text, then by digest, and repeated rows are turns of their own;
``c - c % 5`` and ``%`` keep the sign as in SQL; an empty table has no nodes, not even a root; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.ranking import running_sum
from tablelens.llm.common import written

PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0E6546B64F1BBCDD % PRIME)
_WIDE = 10_000  # most nodes in the broadcast list of parents
_SALT = 4096    # turns of one conversation that meet its row in one task
_PIECE = 1 << 20

KEY = ["depth", "k1", "k2"]


class Powers(dict):
    """Powers of one base; the table is small, others are computed."""

    def __init__(self, base: int):
        super().__init__()
        self.base = base

    def __missing__(self, n: int) -> int:
        v = pow(self.base, n, PRIME)
        if len(self) < 1 << 16:
            self[n] = v
        return v


def _stored_turns(conversations: DataFrame, attempt: int, names: dict[str, str]) -> DataFrame:
    """(conv, turn, role, text, l1, l2, nbytes): letters are two 64-bit digests of role and text."""
    t = conversations.select(F.col(f"`{names['conv']}`").cast("long").alias("conv"), F.col(f"`{names['turn']}`").alias("turn"),
                             *[F.coalesce(F.col(f"`{names[c]}`"), F.lit("")).alias(c) for c in ("role", "text")])
    letters = [F.xxhash64(F.lit(2 * attempt + k), "role", "text").alias(f"l{k + 1}") for k in range(2)]
    return t.where("conv IS NOT NULL").select("*", *letters, F.octet_length("text").cast("long").alias("nbytes"))


def _letters_differ(turns: DataFrame) -> bool:
    """Whether two turns that differ share their letters."""
    return not (turns.groupBy("l1", "l2", "role", "text").count().groupBy("l1", "l2").count().where("count > 1").isEmpty())


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, l1, l2, nbytes, f1, f2, g1, g2): 1-based places, fingerprints with and without the turn."""
    head = lambda c: F.substring(c, 1, 64).alias(f"{c}_64")
    rows = turns.select("conv", "turn", head("role"), head("text"), "l1", "l2", "nbytes", F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *[F.col(c) for c in ("role_64", "text_64", "l1", "l2", "row")]]
    columns = ["conv", "pos", "l1", "l2", "nbytes", "f1", "f2", "g1", "g2"]

    def multiply(batches):
        b1, b2 = BASES
        at, pos, f1, f2 = None, 0, 0, 0
        slice_id = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for conv, l1, l2 in zip(*(batch.column(c).to_pylist() for c in ("conv", "l1", "l2"))):
                if conv != at:
                    at, pos, f1, f2 = conv, 0, 0, 0
                g1, g2 = f1, f2
                pos, f1, f2 = pos + 1, (f1 * b1 + l1) % PRIME, (f2 * b2 + l2) % PRIME
                out.append((pos, f1, f2, g1, g2))
            if out:
                pos_, *prints = (pa.array(c, pa.int64()) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("conv"), pos_, batch.column("l1"), batch.column("l2"), batch.column("nbytes"),
                                                  *prints, pa.array([slice_id] * len(out), pa.int64())], names=[*columns, "slice"])

    schema = ", ".join(f"{c} long" for c in [*columns, "slice"])
    slices = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(multiply, schema), "turns")
    ends = (slices.groupBy("slice").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos", "f1", "f2")).alias("last"))
            .orderBy("slice").collect())  # one row per slice
    carry, before = {}, None  # what the slices before hold of a slice's first conversation
    for r in ends:
        conv, pos, f1, f2 = r["last"]
        if before and before[0] == r["first"]:
            carry[r["slice"]] = before
            if conv == r["first"]:
                b = [pow(x, pos, PRIME) for x in BASES]
                pos, f1, f2 = pos + before[1], (f1 + before[2] * b[0]) % PRIME, (f2 + before[3] * b[1]) % PRIME
        before = (conv, pos, f1, f2)
    if not carry:
        return slices.drop("slice")

    def carried(batches):
        p1, p2 = Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            got = [batch.column(c).to_pylist() for c in [*columns, "slice"]]
            out = []
            for conv, pos, l1, l2, nbytes, f1, f2, g1, g2, s in zip(*got):
                c = carry.get(s)
                if c and c[0] == conv:
                    f1, f2 = (f1 + c[2] * p1[pos]) % PRIME, (f2 + c[3] * p2[pos]) % PRIME
                    g1, g2 = (g1 + c[2] * p1[pos - 1]) % PRIME, (g2 + c[3] * p2[pos - 1]) % PRIME
                    pos += c[1]
                out.append((conv, pos, l1, l2, nbytes, f1, f2, g1, g2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=columns)

    return written(slices.mapInArrow(carried, ", ".join(f"{c} long" for c in columns)), "prefixes")


def _rebuilt(prefixes: DataFrame, base, head, most_head: int) -> DataFrame:
    """(conv, n, base, h, hb, d1, d2): for every conversation its number of stored turns, its base, the head's
    length asked for and had, and the difference of fingerprints that turns its own prefixes into rebuilt ones."""
    convs = prefixes.groupBy("conv").agg(F.max("pos").alias("n"))
    convs = convs.select("conv", "n", base(F.col("conv")).alias("base"), head(F.col("conv")).cast("long").alias("h"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(sizes, "base", "left").withColumn("hb", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    heads = prefixes.where(F.col("pos") <= most_head)
    of = lambda c, p, n: heads.select(F.col("conv").alias(c), F.col("pos").alias(p), F.col("f1").alias(f"{n}1"), F.col("f2").alias(f"{n}2"))
    both = convs.join(of("base", "hb", "b"), ["base", "hb"], "left").join(of("conv", "h", "o"), ["conv", "h"], "left")
    delta = [F.expr(f"pmod(coalesce(b{k}, 0) - coalesce(o{k}, 0), {PRIME})").alias(f"d{k}") for k in (1, 2)]
    return written(both.select("conv", "n", "base", "h", "hb", *delta), "convs")


def _members(prefixes: DataFrame, convs: DataFrame, most_head: int) -> DataFrame:
    """A row for each rebuilt conversation and prefix of it: the prefix group, its parent group, the letters and
    size of its last turn, where that turn is stored, and whether the conversation ends there."""
    columns = ["conv", *KEY, "g1", "g2", "l1", "l2", "nbytes", "turn_conv", "turn_pos", "ends"]
    total = F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    salted = convs.withColumn("salt", F.explode(F.expr(f"sequence(0L, n div {_SALT})")))
    own = prefixes.withColumn("salt", F.expr(f"pos div {_SALT}")).join(salted, ["conv", "salt"]).where("pos > h")

    def compose(batches):
        p1, p2 = Powers(BASES[0]), Powers(BASES[1])
        names = ["conv", "pos", "h", "hb", "d1", "d2", "f1", "f2", "g1", "g2", "n"]
        for batch in batches:
            out = []
            for conv, pos, h, hb, d1, d2, f1, f2, g1, g2, n in zip(*(batch.column(c).to_pylist() for c in names)):
                e = pos - h
                out.append((conv, hb + e, (f1 + d1 * p1[e]) % PRIME, (f2 + d2 * p2[e]) % PRIME,
                            (g1 + d1 * p1[e - 1]) % PRIME, (g2 + d2 * p2[e - 1]) % PRIME, int(pos == n)))
            if out:
                conv, depth, k1, k2, g1, g2, ends = (pa.array(c, pa.int64()) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([conv, depth, k1, k2, g1, g2, batch.column("l1"), batch.column("l2"), batch.column("nbytes"),
                                                  conv, batch.column("pos"), ends], names=columns)

    own = own.select("conv", "pos", "h", "hb", "d1", "d2", "f1", "f2", "g1", "g2", "n", "l1", "l2", "nbytes").mapInArrow(
        compose, ", ".join(f"{c} long" for c in columns))
    heads = prefixes.where(F.col("pos") <= most_head).withColumnRenamed("conv", "base")
    shared = convs.join(heads, "base").where("pos <= hb").select(
        "conv", F.col("pos").alias("depth"), F.col("f1").alias("k1"), F.col("f2").alias("k2"), "g1", "g2", "l1", "l2", "nbytes",
        F.col("base").alias("turn_conv"), F.col("pos").alias("turn_pos"), (F.col("pos") == total).cast("long").alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv", *[zero.alias(c) for c in [*KEY, "g1", "g2", "l1", "l2", "nbytes"]], none.alias("turn_conv"), none.alias("turn_pos"),
                         (total == 0).cast("long").alias("ends"))
    return written(own.union(shared).union(roots), "members")


def _list_digests(members: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of the nodes where conversations end."""
    order = [*KEY, "conv"]

    def pieces(batches):
        at, first, part, size = None, None, [], 0
        schema = pa.schema([*[(c, pa.int64()) for c in order], ("piece", pa.string())])

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in (*at, first)], pa.array([",".join(part)])], schema=schema)

        for batch in batches:
            done = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in order)):
                if key != at or size > _PIECE:
                    if part:
                        done.append(row())
                    at, first, part, size = key, conv, [], 0
                part.append(str(conv))
                size += len(part[-1]) + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if part:
            yield row()

    cut = written(members.where("ends = 1").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                  .mapInArrow(pieces, "depth long, k1 long, k2 long, conv long, piece string"), "pieces")

    def digest(batches):
        at, h, done = None, None, []
        for batch in batches:
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in [*KEY, "piece"])):
                if key != at:
                    if at:
                        done.append((*at, h.hexdigest()))
                    at, h = key, hashlib.sha256(piece.encode())
                else:
                    h.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
                done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, h.hexdigest())], names=[*KEY, "ends_sha256"])

    return cut.repartition(*KEY).sortWithinPartitions(*order).select(*KEY, "piece").mapInArrow(
        digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _parents(nodes: DataFrame, kids: DataFrame, n_nodes: int) -> DataFrame:
    """(KEY, parent_conv_id) of all nodes but the root."""
    wide = max(64, n_nodes // _WIDE)  # so at most _WIDE nodes have more children
    up = [(F.col("depth") - 1).alias("depth"), F.col("g1").alias("k1"), F.col("g2").alias("k2")]
    child = nodes.where("depth > 0").select(*up, F.struct(*KEY).alias("child"))
    parent = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    hot = F.broadcast(parent.join(kids.where(F.col("n_children") > wide).select(*KEY), KEY))
    both = child.join(hot, KEY, "left")
    direct = both.where("parent_conv_id IS NOT NULL").select("child", "parent_conv_id")
    rest = both.where("parent_conv_id IS NULL").drop("parent_conv_id").join(parent, KEY).select("child", "parent_conv_id")
    return direct.union(rest).select("child.*", "parent_conv_id")


def crc_head(conv, modulus: int = 9):
    """The head's length: the decimal id's CRC-32 modulo 9."""
    return F.crc32(conv.cast("string").cast("binary")) % modulus


def fifth(conv):
    """The base conversation: the id rounded to a multiple of five."""
    return conv - conv % 5


def prefix_trie(conversations: DataFrame, base=fifth, head=crc_head, most_head: int = 8, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv,
    turn_pos). ``turn_conv``, ``turn_pos``: where the node's last turn is stored (null at the root). ``base`` and
    ``head`` give the base's id and the head's length (0 to ``most_head``) from the column of ids."""
    names = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    for attempt in range(8):
        turns = _stored_turns(conversations, attempt, names)
        if _letters_differ(turns):
            continue
        prefixes = _prefixes(turns)
        members = _members(prefixes, _rebuilt(prefixes, base, head, most_head), most_head)
        ref, up, last = F.struct("turn_conv", "turn_pos"), F.struct("g1", "g2"), F.struct("l1", "l2")
        nodes = written(members.groupBy(*KEY).agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("nbytes").alias("nbytes"), F.min(ref).alias("ref"),
            F.min("g1").alias("g1"), F.min("g2").alias("g2"),
            ((F.min(up) == F.max(up)) & (F.min(last) == F.max(last))).alias("one")), "nodes")
        if nodes.where("NOT one").isEmpty():
            break
    else:
        raise ArithmeticError("fingerprints collide whatever the letters")
    kids = written(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("k1"), F.col("g2").alias("k2"))
                   .agg(F.count(F.lit(1)).alias("n_children")), "kids")
    own = nodes.join(kids, KEY, "left").select(
        F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("nbytes")).alias("saved"), F.col("n_children").isNull().cast("long").alias("leaf"))
    paths = members.select("conv", *KEY).join(own, ["conv", "depth"], "left").withColumn("up", -F.col("depth"))
    sums = running_sum(paths, ["conv"], ["up"], ["saved", "leaf"]).groupBy(*KEY).agg(
        F.sum("cum_saved").alias("saved_tokens"), F.sum("cum_leaf").alias("n_leaves"))

    facts = {"parent_conv_id": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string",
             "conv_id": "long", "n_convs": "long", "ref": nodes.schema["ref"].dataType.simpleString()}

    def rows(df, *own):
        return df.select(*KEY, *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in facts.items()])

    parts = [rows(nodes, "conv_id", "n_convs", "ref"), rows(kids, "n_children"), rows(sums, "saved_tokens", "n_leaves"),
             rows(_parents(nodes, kids, nodes.count()), "parent_conv_id"), rows(_list_digests(members), "ends_sha256")]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    one = every.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in facts])  # one fact of each kind per node
    return one.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "ref.turn_conv", "ref.turn_pos")
