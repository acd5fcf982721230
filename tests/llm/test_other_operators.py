"""Vectors, URLs, toxicity and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def cloud(n, dim, seed, groups=6, noise=0.12):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((groups, dim))
    out = [(centres[g.integers(groups)] + noise * g.standard_normal(dim) * g.choice([0.3, 1, 4])) * g.choice([0.5, 1, 3]) for _ in range(n)]
    return [[float(x) for x in v] for v in out]


BAD = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, []]


def vectors(spark, seed=1):
    vs = cloud(240, 8, seed)
    rows = list(enumerate(vs)) + [(300 + k, vs[3]) for k in range(30)] + [(400 + k, b) for k, b in enumerate(BAD)]
    rows += [(500 + k, v) for k, v in enumerate(cloud(9, 5, seed))] + [(600, [2 * x for x in vs[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return rows, df.withColumns({c: F.lit(1) for c in ("id", "vec", "mark", "dim", "cell", "rank", "score", "n")}).repartition(3)


def fine(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_nearest(spark):
    from tablelens.llm.ann_projections import nearest
    rows, df = vectors(spark)
    got = nearest(df, df.where("vec_id % 5 = 0"), k=6, block_rows=40, chunk_rows=16, sample_rows=20, confidence=0.999999)
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    good = [(i, v) for i, v in rows if fine(v)]
    for i, v in good:
        if i % 5 == 0:
            best = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:6]
            assert have.pop(i) == [(j, round(-s, 9)) for s, j in best], i
    assert not have
    assert nearest(df.limit(0), df, k=3).count() == 0 and nearest(df, df.limit(0), k=3).count() == 0


def test_recall_of_the_stopping_test(spark):
    from tablelens.llm.ann_projections import nearest
    g = np.random.default_rng(4)
    v = g.standard_normal((1500, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=20, block_rows=400).toPandas()
    hit = 0
    for i in range(0, 1500, 20):
        s = v @ v[i]
        s[i] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(got.vec_id[got.query_id == i]))
    assert hit / (75 * 20) >= 0.9


@pytest.mark.parametrize("block", [4096, 25])
def test_embedding_links(spark, block):
    from tablelens.llm.embed_dedup import embedding_duplicates
    rows, df = vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df, 0.9, block_rows=block).collect()}
    ids = [i for i, _ in rows]
    root, n = {i: i for i in ids}, {i: 0 for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    good = [(i, np.array(v)) for i, v in rows if fine(v)]
    for a, (i, v) in enumerate(good):
        for j, w in good[a + 1:]:
            if len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.9:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: (n[i], find(i), find(i) == i) for i in ids}
    assert embedding_duplicates(df.limit(0)).count() == 0
    assert embedding_duplicates(df.where("vec_id BETWEEN 400 AND 405")).count() == 6


@pytest.mark.parametrize("dim", [2, 3, 64])
def test_no_link_near_the_threshold_is_lost(dim):
    """Vectors almost on their neighbours' sign codes, with cosines a hair above the threshold."""
    from tablelens.llm.embed_dedup import encode, near_pairs, rotation
    g = np.random.default_rng(dim)
    n = 1500
    corner = (np.sign(g.standard_normal((n, dim))) / np.sqrt(dim)) @ rotation(dim).T
    aside = g.standard_normal((n, dim))
    aside -= (aside * corner).sum(axis=1, keepdims=True) * corner
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    turn = lambda t: np.cos(t)[:, None] * corner + np.sin(t)[:, None] * aside
    first = 10.0 ** g.uniform(-9, -1, n) * g.choice([-1, 0, 1], n)
    left, right = turn(first), turn(first + np.arccos(0.9) * g.choice([-1, 1], n) * (1 - 10.0 ** g.uniform(-12, -4, n)))
    codes, factor = encode(right)
    want = {i for i in range(n) if left[i] @ right[i] / np.linalg.norm(left[i]) / np.linalg.norm(right[i]) >= 0.9}
    i, j = near_pairs(left, right, codes, factor, 0.9)
    found = {int(a) for a, b in zip(i, j) if a == b}
    exact = np.einsum("ij,ij->i", left, right) / (np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1))
    assert len(want) > n / 2 and {k for k in want ^ found if abs(exact[k] - 0.9) > 1e-15} == set()


def test_embedding_rows_with_one_id_and_without(spark):
    from tablelens.llm.embed_dedup import embedding_duplicates
    e = np.eye(3).tolist()
    rows = [(1, e[0]), (1, e[1]), (2, e[0]), (3, e[1]), (3, e[1]), (None, e[0]), (None, None), (9, None), (9, e[2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(str, embedding_duplicates(df).collect()))
    want = [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False),
            (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert got == sorted(f"Row(vec_id={a}, n_links={b}, component_id={c}, kept={d})" for a, b, c, d in want)


def test_code_bounds_hold():
    from tablelens.llm.embed_dedup import encode, estimates, rotation, signs
    g = np.random.default_rng(8)
    x, y = g.standard_normal((300, 24)), g.standard_normal((300, 24))
    y[:150] = x[:150] + 0.2 * y[:150]
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    codes, a = encode(y)
    b = ((x @ rotation(24)) * signs(codes, 24)).sum(axis=1)
    reach, true = np.sqrt((1 - a * a) * (1 - b * b)), (x * y).sum(axis=1)
    assert (a * b - reach <= true + 1e-6).all() and (true <= a * b + reach + 1e-6).all()
    assert abs((b / a - true).mean()) < 0.03
    estimate, deviation, upper = estimates(x @ rotation(24), signs(codes, 24), a)
    all_true = x @ y.T
    off = np.abs(estimate - all_true) / np.maximum(deviation, 1e-12)
    assert (upper >= all_true - 1e-9).all() and (off <= 4).mean() > 0.999 and 0.5 < np.sqrt((off ** 2).mean()) < 1.5


def plain_verdict(url, rules, default):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    stem = rest[cut:]
    end = min([stem.find(c) for c in "?#" if c in stem] or [len(stem)])
    path = stem[:end]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_urls(spark):
    from tablelens.llm.queries import URL_RULES
    from tablelens.llm.url_filter import bloom_filter, filter_urls
    r = random.Random(1)
    hosts = ["a.net", "net", "B.Example.NET", "example.net", "xexample.com", "example.com", "m.example.com", "x.org", "net.x", "a.net:80", ""]
    urls = [None, "", "no scheme", "://net/", "http://net", "http://net?x=/", "a://b://net/x", "HTTP://ÄX.NET/É", "http://a\nb.net/en/"]
    urls += [f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/de/1', '/fr/x?q=1', '/en/a#/de/', '?/en/'])}" for _ in range(300)]
    rules = URL_RULES + [("example.com", "", "block"), ("com", "/de/1", "allow")] + [(f"spam{k}.io", "/", "block") for k in range(3000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None), (12, urls[12])], "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    for size in (16 << 20, 64):  # the second filter is far too small: more goes to the join, and nothing is lost
        got = filter_urls(df, listed, max_filter_bytes=size).select("page_id", "host", "path", "rule", "verdict").collect()
        want = [(i, *plain_verdict(u, rules, "allow")) for i, u in [*enumerate(urls), (0, None), (12, urls[12])]]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert filter_urls(df.limit(0), listed).count() == 0
    assert {x.verdict for x in filter_urls(df, listed.limit(0)).collect()} == {"allow"}
    full = bloom_filter(listed.select(F.concat("host", "path").alias("rule")))
    assert full.nbytes <= 16 << 20 and 0 < np.unpackbits(full.view(np.uint8)).mean() < 0.6


NEUTRAL = [f"w{k}" for k in range(400)]
RUDE = ["vilewort", "grotty", "scorn"]


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(NEUTRAL) for _ in range(r.randint(5, 60))]
        toxic, junk = r.random() < 0.25, r.random() < 0.2
        if toxic:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(RUDE) + r.choice(["", "ish", ",", "ly."]))
        if junk:
            words += ["click#", "buy#"]
        out.append((i, " ".join(words), int(toxic), int(junk)))
    return out


def test_toxicity_held_out(spark):
    from tablelens.llm.toxicity import toxicity
    data = corpus(1500, 1) + [(5000, None, 0, 0), (5001, "", 0, 0), (5002, "scornful grotty " + "w1 " * 20000, 1, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in data] + [(3, data[3][1])], "doc_id long, text string").withColumn("mark", F.lit(1))
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in data[:900]] + [(0, None, 1), (None, 1, 1), (1, data[1][3], data[1][2])], "doc_id long, junk int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels, ["junk", "toxic"], max_rows=700).collect()}
    held = data[900:]
    right = sum((got[i].p_toxic >= 0.5) == bool(x) for i, _, x, _ in held) / len(held)
    junk = sum((got[i].p_junk >= 0.5) == bool(q) for i, _, _, q in held) / len(held)
    assert right > 0.98 and junk > 0.98
    assert got[5002].p_toxic > 0.5 and got[5000].p_toxic < 0.5 and got[5001].p_toxic < 0.5
    assert toxicity(docs, labels, ["junk", "toxic"]).count() == docs.count()
    assert max(r.p_toxic for r in toxicity(docs, labels.limit(0), ["toxic"]).collect()) < 1e-9
    assert toxicity(docs.limit(0), labels, ["toxic"]).count() == 0


def newton(x, y, free, ridge=0.05):
    """Ridge logistic regression by Newton steps; the last ``free`` columns carry no penalty."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[len(w) - free:] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), x.T @ (p - y) + penalty * w)
        w -= step
        if abs(step).max() < 1e-10:
            break
    return w


def test_chain_equals_a_plain_chain():
    """Dense Newton fits, chi-square choice and folds by hand, category after category."""
    from tablelens.llm.toxicity import FOLDS, fit_chain, predict, numbered
    g = np.random.default_rng(6)
    n, m = 500, 40
    on = g.random((n, m)) < g.uniform(0.05, 0.4, m)
    first = (on[:, 0] | on[:, 1]) ^ (g.random(n) < 0.1)
    second = (first & on[:, 2]) ^ (g.random(n) < 0.1)
    y = np.stack([first, second], axis=1).astype(float)
    sizes, hashes = on.sum(axis=1), np.nonzero(on)[1].astype(np.uint32) * 7 + 3
    folds = g.integers(0, FOLDS, n)
    models, out = fit_chain(hashes, sizes, y.astype(int), folds, 1000)

    def chosen(rows, t):
        x = on[rows].astype(float)
        a, pos, k = x.sum(axis=0), t.sum(), len(t)
        both = x[t == 1].sum(axis=0)
        chi2 = k * (both * k - a * pos) ** 2 / np.maximum(a * (k - a) * pos * (k - pos), 1)
        return np.flatnonzero(chi2 >= 10.83)

    def fit(rows, t, earlier):
        cols = chosen(rows, t)
        w = newton(np.hstack([on[rows][:, cols].astype(float), earlier[rows], np.ones((len(t), 1))]), t, 1)
        return lambda at: 1 / (1 + np.exp(-np.hstack([on[at][:, cols].astype(float), earlier[at], np.ones((len(at), 1))]) @ w))

    plain, everyone = np.zeros((n, 2)), np.arange(n)
    final = np.zeros((n, 2))
    for k in range(2):
        for f in range(FOLDS):
            own, held = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            plain[held, k] = fit(own, y[own, k], plain[:, :k])(held)
        final[:, k] = fit(everyone, y[:, k], plain[:, :k])(everyone)
    assert abs(out - plain).max() < 0.02
    rows, names = numbered(hashes, sizes)
    for k in range(2):
        from dataclasses import replace
        own = replace(models[k], features=np.searchsorted(names, models[k].features))
        assert abs(predict(own, rows, plain[:, :k]) - final[:, k]).max() < 0.02
    assert ((final[:, 1] > 0.5) == second).mean() > 0.8


def test_chain_uses_out_of_fold_probabilities():
    from tablelens.llm.toxicity import FOLDS, fit_chain
    g = np.random.default_rng(0)
    a = g.random(600) < 0.4
    b = a ^ (g.random(600) < 0.05)  # the second category follows the first, and has no feature of its own
    hashes, sizes = [], []
    for x in a:
        f = sorted({10 if x else 20, *(100 + g.integers(0, 50, 5)).tolist()})
        hashes += f
        sizes.append(len(f))
    models, out = fit_chain(np.array(hashes, np.uint32), np.array(sizes), np.stack([a, b], axis=1).astype(int), np.arange(600) % FOLDS, 1000)
    assert ((out[:, 1] >= 0.5) == b).mean() > 0.9 and models[1].earlier.shape == (1,)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as cp
    data = corpus(400, 2)
    r = random.Random(9)
    passage = " ".join(r.choice(NEUTRAL) for _ in range(150))
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t, _, _ in data]
    rows += [(1000 + k, data[7][1], "en", "s1", 1) for k in range(5)]                     # copies
    rows += [(2000 + k, " ".join(r.choice(NEUTRAL) for _ in range(200)) + " " + passage, "en", "s2", 1) for k in range(4)]
    short = " ".join(r.choice(["a", "of", "it", "so", "we"]) + "qxz"[k % 3] for k in range(51))  # 51 words, under 200 bytes
    below = " ".join(r.choice(["ba", "pof", "lit"]) + "abcdef"[k % 6] for k in range(50))       # 50 words: stays
    rows += [(2100 + k, " ".join(r.choice(NEUTRAL) for _ in range(120)) + f" {short} end{k} {below} last{k}", "fr", "s3", 1) for k in range(3)]
    rows += [(3000, None, None, "s0", None), (3001, "", "en", "s0", 0), (None, "no id at all here", "en", "s0", 1)]
    sf = str(tmp_path)
    clash = ("tag", "kept", "spans", "n_bytes", "p_toxic", "p_low_quality", "others", "row", "fp", "id", "size", "copies", "base", "extra", "a b")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"<{c}>") for c in clash})
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1 - q, x) for i, _, x, q in data[:300]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in cp.STAGES:
        out = stage(spark, frames[-1], sf)
        if name != cp.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{sf}/{name}")
        frames.append(spark.read.parquet(f"{sf}/{name}"))
    _, clean, single, cut, mixed, tokens = frames
    kept = {x.doc_id for x in clean.collect()}
    wrong = sum((i in kept) == bool(x) for i, _, x, _ in data)
    assert wrong <= 4 and {2000, 2003, 3000, 3001, None} <= kept
    if 7 in kept:
        assert {x.doc_id for x in single.collect()} & {7, *range(1000, 1005)} == {7}
    texts = {x.doc_id: x.text for x in cut.collect()}
    assert all(passage not in (texts[k] or "") for k in range(2000, 2004)) and cut.count() == single.count()
    assert len(short) < 200 and all(short not in texts[k] and below in texts[k] and f"end{k - 2100} " in texts[k] for k in range(2100, 2103))
    assert all(x[c] == f"<{c}>" for x in mixed.collect() for c in clash)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in cut.collect())
    assert mixed.count() > 0 and {x.doc_id for x in mixed.collect()} <= set(texts)
    assert tokens.count() == mixed.count() and {x.doc_id: x.n_tokens for x in tokens.collect()}.keys() == {x.doc_id for x in mixed.collect()}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


@pytest.mark.parametrize("key", ["op2_url_filter", "op5_embedding_dedup", "op11_exact_dedup", "op13_conversation_trie"])
def test_oracles(spark, key):
    import __spark_entry__ as entry
    from tests.oracle_compare import compare, duckdb_con
    sf = "/root/testdata/sf0.001"
    ok, message = compare(spark, duckdb_con(sf), key, entry.queries()[key], entry.oracle_sql()[key], sf)
    assert ok, message
