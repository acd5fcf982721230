"""Exact duplicates, whitening and the conversation trie against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


# ------------------------------------------------------------------ exact duplicates
def texts(seed=3):
    rnd = random.Random(seed)
    some = ["", "a", "ab", "abc", "abcd", "b", "ab" * 50, "ab" * 50 + "c", "z" * 70_000, "z" * 70_000 + "y", "été", "\U0001f600"]
    some += ["".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(60)]
    rows = [(i, rnd.choice(some)) for i in range(400)]
    rows += [(1000 + i, "the hot text") for i in range(300)] + [(5, "repeated"), (5, "repeated"), (5, "other"), (None, "no id"), (None, "no id"),
                                                              (None, "repeated"), (2000, None), (2001, None), (2002, "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("stays,trie_bytes,fan", [("smallest", 48 << 20, 64), ("largest", 48 << 20, 2), ("largest", 3000, 3), ("smallest", 1, 2)])
def test_exact_duplicates(spark, stays, trie_bytes, fan):
    from tablelens.llm.exact_dedup import exact_duplicates
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "token", "row", "size", "hash", "best", "n", "big", "sha", "salt")})
    got = exact_duplicates(df.repartition(7), stays=stays, trie_bytes=trie_bytes, fan=fan).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    have = defaultdict(list)
    for r in got:
        have[r.sha].append(r)
    assert have.keys() == groups.keys()
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if stays == "largest" else min)(known) if known else None
        assert sorted((r.doc_id for r in have[sha]), key=str) == sorted(ids, key=str)
        assert {(r.keep_id, r.group_size) for r in have[sha]} == {(keep, len(ids))}
        assert [r.doc_id for r in have[sha] if r.kept] == [keep]


def test_exact_duplicates_other_inputs(spark):
    from tablelens.llm.exact_dedup import exact_duplicates
    df = spark.createDataFrame([("x", "A b"), ("y", "a B"), (None, "c")], "doc_id string, text string")
    assert exact_duplicates(df.limit(0)).count() == 0
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df, normalise=F.lower).collect()}
    assert got == {"x": ("x", 2, True), "y": ("x", 2, False), None: (None, 1, True)}


def test_trie_keeps_all_strings_when_it_spills():
    from tablelens.llm.exact_dedup import Trie
    rnd = random.Random(8)
    keys = {bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(30))) for _ in range(500)} | {b"", b"\x00", b"\x00\x00"}
    trie = Trie()
    for k in keys:
        node = trie.insert(k)
        assert node.owner is None
        node.owner = k
    assert all(trie.insert(k).owner == k for k in keys)
    assert sorted(trie.owners()) == sorted((k, k) for k in keys)
    half = trie.bytes // 2
    out = list(trie.spill(half))
    assert out and trie.bytes <= half
    assert sorted(out + list(trie.owners())) == sorted((k, k) for k in keys)


# ------------------------------------------------------------------ whitening
def test_singular_vectors_of_small_matrices():
    from tablelens.llm.bidiagonal import right_vectors
    g = np.random.default_rng(0)
    for trial in range(60):
        n = int(g.integers(1, 40))
        x = g.standard_normal((n + 20, n))
        if trial % 5 == 1:
            x *= np.logspace(0, -8, n)
        if trial % 5 == 2:
            x[:, -1] = x[:, 0]
        if trial % 5 == 3:
            x = np.linalg.qr(x)[0]  # all values equal
        if trial % 5 == 4 and n > 6:
            x = np.linalg.qr(x)[0] * np.r_[[5.0] * 3, [2.0] * (n - 3)]
        r = np.linalg.qr(x, mode="r")
        values, v = right_vectors(r, 4)
        want = np.linalg.svd(r, compute_uv=False)
        assert np.abs(values - want).max() <= 1e-13 * want[0]
        assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
        assert np.abs(r.T @ (r @ v) - v * values[:v.shape[1]] ** 2).max() < 1e-11 * want[0] ** 2
    assert right_vectors(np.zeros((3, 3)), 4)[1].shape == (3, 0)


def test_small_singular_values_keep_their_digits():
    from tablelens.llm.bidiagonal import singular_values
    d, f = np.array([1.0, 1e-4, 1e-8, 1e-12]), np.array([1e-3, 1e-6, 1e-10])
    product = float(np.prod(d))  # the determinant
    assert abs(float(np.prod(singular_values(d, f))) / product - 1) < 1e-12


def plain_whitening(rows, dim):
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows
            if v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=float)
    n = len(fit)
    s = [sum(int(a) for a in c) for c in fit.T]
    centred = fit - np.array(s) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return good, n, s, e[::-1], u[:, ::-1]


def test_whitening(spark):
    from tablelens.llm.whitening import whiten
    g = np.random.default_rng(2)
    vs = (g.standard_normal((300, 7)) * [3, 2, 1.5, 1, 0.7, 0.5, 0.2]).tolist()
    rows = list(enumerate(vs)) + [(500 + i, vs[0]) for i in range(100)] + [(5, vs[9]), (None, vs[4]), (700, [0.0] * 7), (701, None), (702, []),
                                                                        (703, [float("nan")] * 7), (704, [None] + [1.0] * 6), (705, [float("inf")] * 7),
                                                                        (706, [1.0, 2.0]), (707, [3.0, 1.0]), (708, [2.0, 8.0]), (709, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "x", "dim", "n", "component")})
    got = whiten(df.repartition(5), fan=2).collect()
    for dim in (7, 2):
        good, n, s, e, u = plain_whitening(rows, dim)
        k = min(4, dim)
        mine = [r for r in got if r.n == n]
        assert len(mine) == len(good) * k
        by = defaultdict(list)
        for r in mine:
            by[r.vec_id].append(r)
        sign = {}
        for i, x in good:
            want = (np.array(x) - np.array(s) / n) @ u[:, :k] / np.sqrt(e[:k])
            for r in by[i]:
                if i is not None and len(by[i]) == k:
                    c = r.component - 1
                    sign.setdefault(c, np.sign(want[c] * r.whitened) or 1)
                    assert abs(sign[c] * want[c] - r.whitened) < 1e-9
                    assert int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(x, s))
                    assert abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-9
    assert {r.vec_id for r in got} == {i for i, v in rows if i not in (701, 702, 703, 704, 705, 709)}
    assert whiten(df.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whiten(flat).count() == 0


def test_deviations_beyond_64_bits():
    from tablelens.llm.whitening import deviations
    x = np.array([[1 << 30, -5], [3, 4]])
    n, s = 1 << 30, [7, -9]
    assert [int(v) for v in deviations(x, n, s).to_pylist()] == [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert deviations(x << 10, n, s).to_pylist()[0] is None


# ------------------------------------------------------------------ conversations
def plain_trie(rows):
    stored = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        if c is not None:
            stored[c].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in stored.items()}
    rebuilt = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        rebuilt[c] = stored.get(base, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    out = {}
    for key, members in nodes.items():
        under = [k for k in nodes if k[:len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) for k in under)
        leaves = sum(1 for k in under if not any(len(o) == len(k) + 1 and o[:len(k)] == k for o in under))
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(key))))
        out[min(members), len(key)] = (min(nodes[key[:-1]]) if key else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(60), -7, -12, 1_000_000_007, 9_000_000_000_000_000_001]:
        for turn in range(rnd.choice([0, 1, 2, 5, 8, 12])):
            rows.append((c, turn, rnd.choice(["user", "assistant"][:1 + turn % 2]), rnd.choice(["hi", "yes", "no é"][:1 + (turn > 2) * 2])))
    rows += [(200, t, "user", "long") for t in range(150)]                               # one long conversation
    rows += [(300 + i, t, "user", "same") for i in range(40) for t in range(9)]          # many equal ones
    rows += [(400, None, "user", "first"), (400, 1, None, "x"), (400, 2, "user", None), (400, 2, "user", None), (None, 0, "user", "gone")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_trie(spark, seed, monkeypatch):
    from tablelens.llm import conversation_trie as M
    if seed == 2:  # the long conversation meets its row in parts, lists of ids come in pieces, wide nodes go the broadcast way
        monkeypatch.setattr(M, "_SALT", 16)
        monkeypatch.setattr(M, "_PIECE", 20)
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit(1) for c in ("conv", "pos", "depth", "k1", "n", "h", "base", "salt", "up")})
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in M.prefix_trie(df.repartition(6)).collect()}
    want = plain_trie(rows)
    assert got == want
    if seed == 1:
        assert M.prefix_trie(df.limit(0)).count() == 0


def test_conversation_trie_stays_right_when_letters_collide(spark, monkeypatch):
    from tablelens.llm import conversation_trie as M
    stored, tries = M._stored_turns, []

    def poor(conversations, attempt, names):
        tries.append(attempt)
        t = stored(conversations, attempt, names)
        return t.withColumns({"l1": F.lit(1).cast("long"), "l2": F.lit(1).cast("long")}) if attempt < 2 else t

    monkeypatch.setattr(M, "_stored_turns", poor)
    rows = [(1, 0, "u", "a"), (2, 0, "u", "b"), (10, 0, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r.n_convs for r in M.prefix_trie(df).collect()}
    assert got == {k: v[1] for k, v in plain_trie(rows).items()} and tries == [0, 1, 2]


def test_wide_parents_are_found_both_ways(spark, monkeypatch):
    from tablelens.llm import conversation_trie as M
    rows = [(5 * c, 0, "u", f"t{c}") for c in range(150)] + [(5 * c, 1, "u", f"s{c % 3}") for c in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r.parent_conv_id for r in M.prefix_trie(df).collect()}
    assert got == {k: v[0] for k, v in plain_trie(rows).items()}  # the root has over 64 children, the others few


def test_probes_of_fingerprints_are_not_broadcast(spark):
    """Each fingerprint asks with dozens of probes; Spark sizes them like the fingerprints themselves."""
    from tablelens.llm.common import dealt
    from tablelens.llm.simhash import classes, links
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(300).selectExpr("xxhash64(id) fp")
    assert "SortMergeJoin [part" in plan(links(df))
    assert "SortMergeJoin [root" in plan(classes(spark.range(50).selectExpr("id doc_id", "concat('some words ', xxhash64(id)) text"))[1])
    assert "SortMergeJoin" in plan(df.join(dealt(df, 100_001), "fp")) and "BroadcastHashJoin" in plan(df.join(dealt(df, 100_000), "fp"))
