"""Token counts, token files, BPE, SimHash, repeated substrings and mixing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "\n\n a  b\t\tc \n", "a <|endoftext|> b<|endoftext|>", "a \n b  c", "x" * 3000, "日本語 テスト 😀 \x1c\x1d a\x85b", "trail  ",
       "\r\n\r\nfoo 's 're don't", "é a ́b Σας ΟΔΟΣ İ", "1234 567890123", "　a b a", "The same words here", "The same words here",
       "foo\n\n<|endoftext|>bar", "a  <|endoftext|> \n <|endoftext|>\t\t<|endoftext|>  b", "\n\n<|endoftext|>\u3000 x  ",
       "word " * 4000, "the quick brown fox jumps over the lazy dog", "The quick  brown\nfox jumps over the lazy dog"]
TEXT_ROWS = [(i, t) for i, t in enumerate(ODD)] + [(13, "The same words here"), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(TEXT_ROWS, "doc_id long, text string")
    # clashing names must not disturb
    return df.withColumns({c: F.lit(7) for c in ("fp", "tag", "id", "size", "n_tokens", "spans", "kept", "ids", "source", "root", "a", "k")}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def library(name):
    t = tokenizers.Tokenizer.from_file(public.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def expect(values):
    return sorted(values, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_counts(odd, none):
    from tablelens.llm.token_count import count_tokens
    lib = library("word_bpe_49k.json")
    got = count_tokens(odd, public.path("word_bpe_49k.json"), limit=100, batch_bytes=64)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False))
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == expect([(i, len((t or "").encode()), n(t), n(t) > 100) for i, t in TEXT_ROWS])
    assert count_tokens(none, public.path("word_bpe_49k.json")).count() == 0


def test_counts_of_a_model_that_keeps_space(odd):
    pytest.importorskip("sentencepiece")
    import sentencepiece
    from tablelens.llm.token_count import count_tokens
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = count_tokens(odd, public.path("piece_bpe_32k.model"))
    assert rows(got, "doc_id", "n_tokens") == expect([(i, len(sp.encode(t or ""))) for i, t in TEXT_ROWS])


def test_bpe_round_trip(odd, none):
    from tablelens.llm.bpe import round_trip
    lib = library("byte_bpe_50k.json")
    got = round_trip(odd, public.path("byte_bpe_50k.json"), ids=True, texts=True, batch_bytes=64)
    want = []
    for i, t in TEXT_ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded") == expect(want)
    assert round_trip(none, public.path("byte_bpe_50k.json")).count() == 0


def test_backtracking_equals_merging_by_rank():
    from tablelens.llm.bpe import Bpe
    bpe, lib = Bpe(public.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    r = random.Random(5)
    for _ in range(1500):
        t = "".join(r.choice(["a", "b", "th", "in", "er", " ", "é", "ß", "9", ".", "Q"]) for _ in range(r.randint(1, 25)))
        ids = np.frombuffer(bpe.encode(t), "<u4")
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t
        assert bpe.decode(ids) == t


def test_runs_before_a_special_string_stay_whole():
    from tablelens.llm.bpe import Bpe
    from tablelens.llm.token_files import library_pieces
    path, lib = public.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    bpe, pieces = Bpe(path), library_pieces(path)
    assert np.frombuffer(bpe.encode("foo\n\n<|endoftext|>bar"), "<u4").tolist() == [21943, 628, 50256, 5657]
    r = random.Random(7)
    for _ in range(1500):
        t = "".join(r.choice(["<|endoftext|>", "<|endoftext|>", "a", "th", " ", "\n", "\t", "\u3000", "é", "<|", "9"]) for _ in range(r.randint(1, 15)))
        want = np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert bpe.encode(t) == want and pieces(t) == want, t


def test_crc32c():
    from tablelens.llm.crc32c import crc32c
    # published check values
    assert [hex(x) for x in crc32c([b"123456789", b"", b"a", b"\0" * 32, b"\xff" * 32])] == ["0xe3069283", "0x0", "0xc1d04330", "0x8a9136aa", "0x62a8ab43"]
    long = [bytes(random.Random(k).randbytes(k * 37)) for k in range(40)]

    def plain(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF
    assert crc32c(long).tolist() == [plain(x) for x in long]


def test_token_files(spark, odd, none, tmp_path):
    from tablelens.llm.token_files import build_index, read_records, token_files, with_start, write_records
    lib = library("byte_bpe_50k.json")
    got = token_files(odd, public.path("byte_bpe_50k.json"), 2, f"{tmp_path}/t", shard_bytes=2000)
    got = got.orderBy("start").collect()
    want = {}
    for i, t in TEXT_ROWS:
        want.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == len(TEXT_ROWS)
    at = 0
    for r in got:
        crcs = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in want[r.id]}
        assert r.start == at and crcs[r.ids_crc32] == r.n_tokens
        at += r.n_tokens
    index = spark.read.parquet(f"{tmp_path}/t/index")
    some = index.where("id % 3 = 0").orderBy(F.rand(1))
    back = rows(read_records(spark, f"{tmp_path}/t/data", some), "id", "ids")
    assert back == expect([(i, x) for i, xs in want.items() if i is not None and i % 3 == 0 for x in xs])
    write_records(none, f"{tmp_path}/e/data", public.path("byte_bpe_50k.json"), 2)
    assert with_start(build_index(spark, f"{tmp_path}/e/data", f"{tmp_path}/e/index")).count() == 0


def test_damaged_record_is_found():
    from tablelens.llm.token_files import frames, parse
    data = b"".join(f + b"\n" for f in frames([1, None], [np.arange(5, dtype="<u4"), np.arange(0, dtype="<u4")], False))
    assert len(parse(data)) == 2
    for k in (0, 9, 20, len(data) - 3):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises((ValueError, Exception)):
            parse(bytes(bad))


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(odd, none):
    from tablelens.llm.simhash import near_duplicates, one_of_each
    got = near_duplicates(odd)
    fp = {(i, t): plain_fingerprint(t) for i, t in TEXT_ROWS}
    keys = sorted(set(fp.values()))
    root = plain_components(keys, [(a, b) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for (i, _), f in fp.items():
        least[root[f]].append(i)
    first = {r: min(x for x in xs if x is not None) if any(x is not None for x in xs) else None for r, xs in least.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    have = rows(got, "doc_id", "fp")
    assert have == expect([(i, signed(fp[i, t])) for i, t in TEXT_ROWS])
    for r in got.collect():
        if r.doc_id is not None:
            assert r.component_id == first[root[fp[r.doc_id, dict(TEXT_ROWS)[r.doc_id]]]] or None in least[root[r.fp % (1 << 64)]]
    stay = one_of_each(odd)
    assert stay.columns == odd.columns and stay.count() == len(least)
    assert near_duplicates(none).count() == 0 and one_of_each(none).count() == 0


@pytest.mark.parametrize("bits,segments,full", [(2, 2, 64), (2, 2, 1), (3, 2, 2), (1, 4, 1), (2, 4, 64), (3, 3, 64), (0, 1, 1)])
def test_multi_index_links(spark, bits, segments, full):
    from tablelens.llm.components import components
    from tablelens.llm.simhash import links
    r = random.Random(bits * 10 + segments)
    base = [r.getrandbits(64) for _ in range(15)]
    fps = set(base)
    for b in base:
        for _ in range(r.choice([1, 3, 12])):
            b ^= sum(1 << r.randrange(64) for _ in range(r.randint(0, 3)))
            fps.add(b % (1 << 64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = links(df, bits, segments, full)
    pairs = {(x.a % (1 << 64), x.b % (1 << 64)) for x in got.collect()}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits]
    assert all((a ^ b).bit_count() <= bits for a, b in pairs)
    want, have = plain_components(fps, near), plain_components(fps, pairs)
    assert want == have
    roots = {x.node % (1 << 64): x.root for x in components(got).collect()}
    groups = defaultdict(set)
    for n, x in roots.items():
        groups[x].add(n)
    assert {frozenset(g) for g in groups.values()} == {frozenset(n for n in fps if want[n] == m) for m in set(want.values())} - {frozenset([n]) for n in fps if sum(v == want[n] for v in want.values()) == 1}


def test_components_of_a_chain_and_a_star(spark):
    from tablelens.llm.components import components
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (7, 8), (8, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 301 + 200
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + k] for k in range(200)}) == 1 and got[0] != got[1000]


def covered(texts, window):
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        on = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                on[i:i + window] = b"\1" * window
        out.append(bytes(on))
    return out


@pytest.mark.parametrize("seed,bucket", [(0, 16384), (1, 20), (2, 7)])
def test_repeats_against_all_substrings(spark, seed, bucket):
    from tablelens.llm.suffix_dedup import remove_repeats
    r = random.Random(seed)
    blocks = ["".join(r.choice("abc") for _ in range(r.randint(10, 60))) for _ in range(8)]
    texts = ["".join(r.choice(blocks) if r.random() < .5 else "".join(r.choice("abcdefg") for _ in range(r.randint(1, 30)))
                     for _ in range(r.randint(0, 8))) for _ in range(100)] + ["a" * 300, "ab" * 100, "", None, "x" * 39, "é" * 50, "Aé" + blocks[0] * 2]
    texts += [texts[0], texts[0]]
    data = [(i if i < 90 else 90, t) for i, t in enumerate(texts)] + [(None, blocks[1] * 2), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"tag": F.lit(1), "spans": F.lit(2), "kept": F.lit(3)})
    got = remove_repeats(df, window=40, kmer=10, bucket_rows=bucket)
    raw = [(t or "").encode() for _, t in data]
    want = []
    for (i, _), t, on in zip(data, raw, covered(raw, 40)):
        starts = sum(1 for k in range(len(t)) if on[k] and (k == 0 or not on[k - 1]))
        want.append((i, len(t), starts, bytes(c for c, o in zip(t, on) if not o)))
    have = [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got.collect()]
    assert expect(have) == expect(want)


@pytest.mark.parametrize("seed", [4, 5])
def test_repeated_words_against_all_word_strings(spark, seed):
    from tablelens.llm.suffix_dedup import remove_repeats
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(4, 20))] for _ in range(6)]
    texts = []
    for _ in range(80):
        ws = [w for _ in range(r.randint(0, 5)) for w in (r.choice(passages) if r.random() < .4 else [f"u{r.randrange(10 ** 6)}" for _ in range(r.randint(1, 9))])]
        texts.append("".join(w + r.choice([" ", "  ", "\n"]) for w in ws))
    texts += ["", None, "same " * 40, " é é é é é é é é é é ", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("own"))
    got = {x.doc_id: x for x in remove_repeats(df, window=8, words=True, keep=("id",), bucket_rows=16).collect()}
    parts = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", (t or "").encode())] for t in texts]
    words = [[(t or "").encode()[a:b] for a, b in p] for t, p in zip(texts, parts)]
    for i, (t, p, on) in enumerate(zip(texts, parts, covered([tuple(w) for w in words], 8))):
        raw, out, at, n = (t or "").encode(), b"", 0, 0
        k = 0
        while k < len(on):
            if on[k]:
                e = k
                while e + 1 < len(on) and on[e + 1]:
                    e += 1
                out, at, n, k = out + raw[at:p[k][0]], p[e][1], n + 1, e
            k += 1
        assert (bytes(got[i].kept), len(got[i].spans), got[i].others.id) == (out + raw[at:], n, "own")


def test_repeats_of_none_and_of_long_texts(spark, none):
    from tablelens.llm import suffix_dedup
    from tablelens.llm.suffix_dedup import remove_repeats
    assert remove_repeats(none).count() == 0
    r = random.Random(3)
    long = "".join(r.choice("abcdefghij") for _ in range(5000))
    whole = suffix_dedup.runs([long.encode()], 40, 10)
    assert whole[1][0] == 0 and whole[2][-1] == 5000 - 40 and (whole[1][1:] == whole[2][:-1] + 1).all()


def test_multikey_quicksort():
    from tablelens.llm.suffix_dedup import common_prefixes, multikey_quicksort
    r = np.random.default_rng(1)
    m = r.integers(0, 3, (700, 21)).astype(np.uint8)
    m[::3] = m[0]
    order = multikey_quicksort(m)
    keys = [bytes(m[i]) for i in order]
    assert keys == sorted(keys)
    lcp = common_prefixes(m, order)
    for k in range(1, 700):
        n = next((i for i in range(21) if keys[k][i] != keys[k - 1][i]), 21)
        assert lcp[k] == n


def test_mix(spark, none):
    from tablelens.llm.mix_sources import mix, mixed_rows
    r = random.Random(2)
    data = []
    for i in range(900):
        s = None if i % 50 == 0 else "abcdé"[min(4, int(r.expovariate(1)))]
        data.append((i, " ".join("w" * r.randint(1, 5) for _ in range(int(r.expovariate(1 / 60)))), s))
    data += [(7777, "one same row here", "c")] * 301  # one id, of many rows: a unit whose copies are dealt to its rows
    data += [(900, None, "a"), (901, "", "tiny"), (902, "one", "tiny2"), (5, "x y", "a"), (5, "x y", "a"), (None, "q " * 30, "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "id": F.lit(2), "copies": F.lit(9)})
    got = mix(df).collect()
    assert len(got) == len(data)
    again = Counter((x.id, x.size, x.source, x.taken) for x in mix(df.repartition(5)).collect())
    assert again == Counter((x.id, x.size, x.source, x.taken) for x in got)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.source_size == sum(len((t or "").split()) for _, t, s in data if s == x.source)
        largest[x.source] = max(largest[x.source], x.size)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:  # plain resharing
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= 2.0 * sizes[s]
            free.remove(s)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(1, 2 * largest[s])
    out = mixed_rows(df)
    assert out.columns == df.columns
    assert out.select(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).first().n >= 0
    words = lambda t: len((t or "").split())
    assert sum(words(x.text) for x in out.collect()) == sum(taken.values())
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and mixed_rows(empty).count() == 0


def test_pivotal_keeps_mass_and_expectation():
    from tablelens.llm.mix_sources import pivotal
    g = np.random.default_rng(0)
    size = g.integers(1, 50, 200).astype(float)
    mass = size * 0.3
    wins = np.zeros(200)
    for _ in range(2000):
        won, left, rest = pivotal(size, mass, g.random(200))
        kept = won.astype(float) * size
        if left >= 0:
            kept[left] = rest
        assert kept.sum() == pytest.approx(mass.sum())
        wins += won
        if left >= 0:
            wins[left] += rest / size[left]  # what its last draw would give
    assert abs(wins / 2000 - 0.3).max() < 0.06
