"""Repeated substrings: remove every byte covered by a string of ``window`` bytes that starts twice or more.

Sorting the suffixes at all bytes would shuffle hundreds of times the text, so suffixes are kept at anchors
only. The anchor of a window is the least of its ``kmer``-byte strings by a rolling hash (ties: leftmost). It
depends on the window's bytes alone, so equal windows have equal anchors at equal places, and comparing the
windows of equal anchors loses nothing. Neighbouring windows share their anchor; such a run is one row.

1. Anchor strings that occur once are dropped: their windows are unique.
2. Where all runs of an anchor string are equal, all their windows repeat.
3. The other runs, one of each kind, are ordered as a suffix array: sampled splitters range-partition the
   suffixes by their leading bytes from the anchor on, each bucket sorts its suffixes by multikey quicksort
   (and the reversed texts before the anchors too), and common prefix lengths of neighbours say which windows
   are equal: both sides must agree as far as the window goes. Suffixes with one anchor string lie in one
   bucket, up to a bucket's size; beyond it the splitters go on into the text after and before the anchor,
   and windows that reach a bucket's first or last suffix are compared across the boundaries by digest.

Hot strings: equal runs are counted before they are sorted, and many different runs of one anchor are dealt
over as many buckets as they need.

Runs are told apart by two independent 64-bit digests, boundary windows by one of 128 bits.

With ``words`` the texts are strings of words: each word is one symbol of eight bytes, and the same search runs
over symbols.

Defined results: a null text is empty; texts shorter than ``window`` are kept; a row repeated with its id is
a copy like any other; matches never cross rows; an empty table gives no rows; only ``id_col`` and ``keep``
pass through, the latter in one struct, so that any name may occur.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.chunks import release
from tablelens.llm.common import by_bytes, salted_join, written

_MUL = 0x9E3779B97F4A7C15  # odd, so that powers can be undone
_SEGMENT = (1 << 20) - (1 << 13)  # with its window less than a power of two


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up = np.full(n + 1, _MUL, np.uint64)
    down = np.full(n + 1, pow(_MUL, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    letters = np.random.default_rng(9).integers(0, 1 << 64, 256, dtype=np.uint64)
    return np.cumprod(up), np.cumprod(down), letters


def runs(texts: list[bytes], window: int, kmer: int):
    """Runs of windows with one anchor: arrays (text number, first window, last window, anchor), places
    within the texts, and the joined buffer with each run's shift into it."""
    parts, owner, base = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - window + 1), _SEGMENT):
            if len(t) >= window:
                parts.append(t[at:at + _SEGMENT + window - 1])
                owner.append(i)
                base.append(at)
    flat = b"".join(parts)
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, none, none, flat, none
    lens = np.array([len(p) for p in parts])
    ends = np.cumsum(lens)
    b = np.frombuffer(flat, np.uint8)
    n = len(b)
    size = 1 << max(16, n.bit_length())
    up, down, letters = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[b] * up[:n], out=sums[1:])
    h = (sums[kmer:] - sums[:-kmer]) * down[:n - kmer + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(n.bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # hash, then place
    width, w = window - kmer + 1, 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[:len(least) - (width - w)], least[width - w:])
    places = np.flatnonzero(np.arange(len(least)) <= np.repeat(ends - window, lens)[:len(least)])
    anchor = (least[places] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    breaks = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(places) != 1))
    first, last = places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]
    anchor = anchor[np.concatenate([[0], breaks + 1])]
    part = np.searchsorted(ends, first, side="right")
    shift = (ends - lens)[part] - np.array(base)[part]  # place in the buffer less place in the text
    return np.array(owner)[part], first - shift, last - shift, anchor - shift, flat, shift


def _run_rows(docs: DataFrame, id_col: str, window: int, kmer: int, words: bool) -> DataFrame:
    """One row per run: its document, windows, anchor and the digests of anchor string and run text. With ``words``
    texts become symbols here, in the same task."""
    schema = T.StructType([docs.schema[id_col], T.StructField("tag", T.LongType()), T.StructField("w1", T.IntegerType()),
                           T.StructField("w2", T.IntegerType()), T.StructField("at", T.IntegerType()),
                           T.StructField("fp", T.LongType()), T.StructField("sh", T.LongType())])

    def run(batches):
        release()
        digest = xxhash.xxh3_64_intdigest
        for batch in by_bytes(batches, "__text", _SEGMENT):
            texts = batch.column("__text").to_pylist()
            owner, w1, w2, at, flat, shift = runs([word_symbols(t) for t in texts] if words else texts, window, kmer)
            if len(owner):
                a, f, e = (at + shift).tolist(), (w1 + shift).tolist(), (w2 + shift + window).tolist()
                fp = np.array([digest(flat[i:i + kmer], 1) for i in a], np.uint64).view(np.int64)
                sh = np.array([digest(flat[i:j], 2) for i, j in zip(f, e)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(owner)), batch.column("tag").take(pa.array(owner)),
                     *[pa.array(x.astype(np.int32)) for x in (w1, w2, at)], pa.array(fp), pa.array(sh)], names=schema.names)

    return docs.mapInArrow(run, schema)


def multikey_quicksort(strings: np.ndarray) -> np.ndarray:
    """The order of the rows of a byte matrix, by three-way partitions on 8-byte symbols: rows that equal
    the pivot go on to the next symbol. Small parts are finished by comparing whole rests."""
    n, m = strings.shape
    wide = np.zeros((n, -(-m // 8) * 8), np.uint8)
    wide[:, :m] = strings
    words = wide.view(">u8").astype(np.uint64)
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        rows = order[lo:hi]
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        if hi - lo <= 64:
            rest = wide[rows, depth * 8:]
            keys = [r.tobytes() for r in rest]
            order[lo:hi] = rows[sorted(range(hi - lo), key=keys.__getitem__)]
            continue
        key = words[rows, depth]
        pivot = np.partition(key[:: max(1, len(key) // 64)], len(key[:: max(1, len(key) // 64)]) // 2)[len(key[:: max(1, len(key) // 64)]) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([rows[less], rows[same], rows[more]])
        a, c = int(less.sum()), int(same.sum())
        todo += [(lo, lo + a, depth), (lo + a, lo + a + c, depth + 1), (lo + a + c, hi, depth)]
    return order


def common_prefixes(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row (in order) has in common with the row before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 4096):
        rows = order[k - 1:k + 4096]
        differ = strings[rows[1:]] != strings[rows[:-1]]
        out[k:k + len(rows) - 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return out


def _matrix(strings: list[bytes]) -> np.ndarray:
    width = max(1, max(map(len, strings)))
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)


def bucket(texts: list[bytes], off: np.ndarray, count: np.ndarray, window: int, split: np.ndarray):
    """Windows of a bucket's runs that repeat in it: arrays (run, window) sorted, and the windows that
    must be compared across its boundaries: (run, window, repeats here), of runs whose anchor is ``split``."""
    n = len(texts)
    right, left = _matrix([t[o:] for t, o in zip(texts, off.tolist())]), _matrix([t[:o][::-1] for t, o in zip(texts, off.tolist())])
    by_right, by_left = multikey_quicksort(right), multikey_quicksort(left)
    lcp_right, lcp_left = common_prefixes(right, by_right), common_prefixes(left, by_left)
    least = off - np.array([len(t) - window for t in texts])  # a window's anchor is `o` bytes in: least <= o <= off
    lead = np.minimum.accumulate(np.concatenate([[window], lcp_right[1:]]))  # agreement with the first suffix
    tail = np.minimum.accumulate(np.concatenate([[window], lcp_right[:0:-1]]))[::-1]  # and with the last
    reach = np.zeros(n, np.int64)
    reach[by_right] = np.maximum(lead, tail)
    found, edge = [], []
    for o in range(int(least.min()), int(off.max()) + 1):
        rows = np.flatnonzero((least <= o) & (o <= off))
        if not len(rows):
            continue
        of_right, of_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        of_right[by_right] = np.cumsum(lcp_right < window - o)
        of_left[by_left] = np.cumsum(lcp_left < o)
        _, first, kind = np.unique(of_right[rows] * n + of_left[rows], return_index=True, return_inverse=True)
        repeats = np.bincount(kind, weights=count[rows])[kind] >= 2
        at = off[rows] - o
        found.append(np.stack([rows[repeats], at[repeats]], axis=1))
        far = split[rows] & (reach[rows] >= window - o) & (~repeats | (np.arange(len(rows)) == first[kind]))
        edge.append(np.stack([rows[far], at[far], repeats[far]], axis=1))
    found, edge = np.concatenate(found), np.concatenate(edge)
    return found[np.lexsort((found[:, 1], found[:, 0]))], edge


def _stretches(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first, last) of consecutive windows."""
    if not len(found):
        return found[:, 0], found[:, 1], found[:, 1]
    new = np.flatnonzero((np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(found) - 1]])
    return found[first, 0], found[first, 1], found[last, 1]


_KIND = ["fp", "sh", "off"]


def _sorted_runs(kinds: DataFrame, window: int, kmer: int, bucket_rows: int) -> DataFrame:
    """(fp, sh, off, first, last): the repeated windows of each kind of run (kinds: text and count)."""
    n = kinds.count()
    schema = "fp long, sh long, off int, first int, last int, digest binary, here boolean"

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        texts = t.column("text").to_pylist()
        off, count = t.column("off").to_numpy().astype(np.int64), t.column("n").to_numpy()
        found, edge = bucket(texts, off, count, window, t.column("split").to_numpy(zero_copy_only=False))
        rows, first, last = _stretches(found)
        names = _KIND + ["first", "last", "digest", "here"]
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [*[t.column(c).combine_chunks().take(pa.array(rows)) for c in _KIND], pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                 pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.bool_())], names=names)
        for k in range(0, len(edge), 50_000):
            e = edge[k:k + 50_000]
            marks = [xxhash.xxh3_128_digest(texts[r][a:a + window]) for r, a, _ in e.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*[t.column(c).combine_chunks().take(pa.array(e[:, 0])) for c in _KIND], pa.array(e[:, 1], pa.int32()), pa.array(e[:, 1], pa.int32()),
                 pa.array(marks, pa.binary()), pa.array(e[:, 2] == 1)], names=names)

    large = kinds.groupBy("fp").count().where(F.col("count") > bucket_rows).select("fp", F.lit(True).alias("split"))
    kinds = kinds.join(large, "fp", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    lead = F.substring("text", F.col("off") + 1, F.lit(kmer))
    after = F.when(F.col("split"), F.substring("text", F.col("off") + kmer + 1, F.length("text")))
    before = F.when(F.col("split"), F.reverse(F.hex(F.substring("text", F.lit(1), F.col("off")))))
    kinds = written(kinds.withColumns({"lead": lead, "after": after, "before": before}), "suffixes")
    out = written(kinds.repartitionByRange(max(1, -(-n // bucket_rows)), "lead", "after", "before")
                  .drop("lead", "after", "before").mapInArrow(run, schema), "buckets")
    inside = out.where("digest IS NULL").select(*_KIND, "first", "last")
    met = out.where("digest IS NOT NULL")
    twice = met.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    across = met.where("NOT here").join(twice, "digest", "left_semi").select(*_KIND, "first", "last")
    return inside.union(across)


def repeated_spans(docs: DataFrame, id_col: str, window: int = 400, kmer: int = 100, bucket_rows: int = 16384, words: bool = False) -> DataFrame:
    """(id_col, tag, spans): the byte spans (of symbols, with ``words``) to remove, unmerged, of each row of ``docs``
    (columns id_col, tag, __text) that has any. ``tag`` is a hash of the text, so that rows with equal ids stay apart."""
    all_runs = _run_rows(docs, id_col, window, kmer, words)
    shared = written(all_runs.groupBy("fp").agg(F.count("*").alias("n"), (F.min("sh") != F.max("sh")).alias("mixed"))
                     .where("n > 1"), "shared")
    rows = written(salted_join(all_runs, shared, ["fp"], "n").withColumn("off", F.col("at") - F.col("w1")).drop("at", "n"), "runs")
    whole = rows.where("NOT mixed").select(id_col, "tag", F.col("w1").alias("a"), (F.col("w2") + window).alias("b"))
    mixed = rows.where("mixed")
    kinds = mixed.groupBy(*_KIND).agg(F.count("*").alias("n"), F.min(F.struct(id_col, "tag", "w1", "w2")).alias("r"))
    asked = (kinds.select(F.col(f"r.`{id_col}`").alias("rid"), F.col("r.tag").alias("rtag"), F.struct(*_KIND, "n", "r.w1", "r.w2").alias("k"))
             .groupBy("rid", "rtag").agg(F.collect_list("k").alias("ks")))  # no more than a document has runs

    # rows repeated with their id are equal: any one of them serves
    docs = _symbols(docs) if words else docs
    one = docs.join(asked, F.col(f"`{id_col}`").eqNullSafe(F.col("rid")) & (F.col("tag") == F.col("rtag"))).select("__text", "ks")
    texts = one.select("__text", F.explode("ks").alias("k"))
    texts = texts.select("k.fp", "k.sh", "k.off", "k.n", F.substring("__text", F.col("k.w1") + 1, F.col("k.w2") - F.col("k.w1") + window).alias("text"))
    texts = written(texts.groupBy(*_KIND).agg(F.first("n").alias("n"), F.first("text").alias("text")), "kinds")
    found = written(_sorted_runs(texts, window, kmer, bucket_rows), "found")
    wanted = written(mixed.groupBy(*_KIND).agg(F.count("*").alias("n")).join(
        found.groupBy(*_KIND).agg(F.collect_list(F.struct("first", "last")).alias("parts")), _KIND), "found-kinds")  # no more than a run has windows
    partly = (salted_join(mixed, wanted, _KIND, "n").withColumn("part", F.explode("parts"))
              .select("*", "part.first", "part.last").select(id_col, "tag", (F.col("w1") + F.col("first")).alias("a"), (F.col("w1") + F.col("last") + window).alias("b")))
    return whole.union(partly).groupBy(id_col, "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans narrowed so that no character is cut: only characters with all bytes inside go."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SYMBOL = 8  # bytes of a word's digest


def word_ends(text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def word_symbols(text: bytes) -> bytes:
    """The text's words, each as a digest of eight bytes: strings of words become strings of bytes."""
    digest = xxhash.xxh3_64_digest
    return b"".join([digest(w) for w in _WORD.findall(text)])


def of_words(spans: list[tuple[int, int]], text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the words whose symbols are whole in the spans, from the first word's start to the last one's
    end (symbols that differ may agree in a few bytes, by which a span is too long)."""
    if not spans:
        return []
    at = word_ends(text)
    return [(at[-(-a // _SYMBOL)][0], at[b // _SYMBOL - 1][1]) for a, b in spans]


def _symbols(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in by_bytes(batches, "__text", 8 << 20):
            k = batch.schema.get_field_index("__text")
            yield batch.set_column(k, "__text", pa.array([word_symbols(t) for t in batch.column("__text").to_pylist()], pa.binary()))

    return df.mapInArrow(run, df.schema)


def remove_repeats(docs: DataFrame, window: int = 400, kmer: int = 0, id_col: str = "doc_id", text_col: str = "text",
                   characters: bool = False, bucket_rows: int = 16384, keep: tuple[str, ...] = (), words: bool = False) -> DataFrame:
    """(id_col, n_bytes, spans, kept, others): maximal removed spans and the remaining bytes, one row per input row;
    ``others`` is a struct of the columns ``keep``, whatever their names.
    ``window`` counts bytes, or with ``words`` words between ASCII white space, which are compared by digests of 64
    bits; then a span goes from its first word to its last, with the white space between them.
    With ``characters`` spans are narrowed to whole characters, so that ``kept`` is valid text."""
    size = window * (_SYMBOL if words else 1)
    kmer = kmer or max(1, size // 4 // _SYMBOL * _SYMBOL if words else size // 4)
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    others = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    df = docs.select(F.col(f"`{id_col}`").alias("__id"), others.alias("__others"), text.alias("__text")).withColumn("__tag", F.xxhash64("__text"))
    searched = df.select("__id", F.col("__tag").alias("tag"), "__text")
    spans = written(repeated_spans(searched, "__id", size, kmer, bucket_rows, words), "spans")
    spans = spans.select(F.col("__id").alias("__sid"), F.col("tag").alias("__stag"), F.col("spans").alias("__spans"))
    both = df.join(spans, F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__tag") == F.col("__stag")), "left").select("__id", "__others", "__text", "__spans")
    span = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    schema = T.StructType([T.StructField("id", df.schema["__id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span),
                           T.StructField("kept", T.BinaryType()), T.StructField("others", df.schema["__others"].dataType)])

    def cut(batches):
        for batch in by_bytes(batches, "__text", 8 << 20):
            texts, out, kept = batch.column("__text").to_pylist(), [], []
            for t, s in zip(texts, batch.column("__spans").to_pylist()):
                own = merged([(x["a"], x["b"]) for x in s]) if s else []
                if words:
                    own = of_words(own, t)
                elif characters:
                    own = whole_characters(t, own)
                out.append([{"a": a, "b": b} for a, b in own])
                cuts = [0, *(x for ab in own for x in ab), len(t)]
                kept.append(b"".join([t[a:b] for a, b in zip(cuts[::2], cuts[1::2])]) if own else t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(kept, pa.binary()), batch.column("__others")], names=schema.names)

    return both.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
