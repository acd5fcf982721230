"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits over word shingles (a bit is 1 if over half of the shingles' XXH64 have it).
Two fingerprints within ``bits`` of each other agree closely in one of ``segments`` parts: with
``bits = q * segments + a``, one of the first a + 1 parts differs in q bits at most or one of the others
in q - 1. So each distinct fingerprint is stored once per part, small Hamming balls around its parts are
enumerated as probes, and matches are verified on the whole distance.

A part that very many distinct fingerprints share would make pairs with the square of their number.
Fingerprints that meet in such a full part go another way that is exact as well and linear: each lists all
points within half the distance of itself; fingerprints that list the same point are within ``bits`` of
each other, and any two within ``bits`` list a common point.

Defined results: a null text or one without words has fingerprint 0, which links like any other; copies
share a fingerprint and are never paired one by one; repeated ids are rows of their own; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.chunks import release
from tablelens.llm.common import by_bytes, dealt, salted_join, text_bytes, written
from tablelens.llm.components import components

_PIECE = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text, ASCII letters lower-cased, as an unsigned integer."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lens = np.array([len(t) for t in tokens], dtype=np.int64)
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    if len(tokens) > words:
        starts, ends = starts[:len(tokens) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(starts)
    for k in range(0, n, _PIECE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k:k + _PIECE].tolist(), ends[k:k + _PIECE].tolist())],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, tag, fp), fp as a signed long; tag is a hash of the text that tells rows with equal ids apart."""
    df = text_bytes(docs, id_col, text=text_col).withColumn("tag", F.xxhash64("__text"))

    def run(batches):
        release()
        for batch in by_bytes(batches, "__text", 8 << 20):
            fps = np.array([fingerprint(t, words) for t in batch.column("__text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("tag"), pa.array(fps.view(np.int64))], names=[id_col, "tag", "fp"])

    return df.mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("tag", T.LongType()), T.StructField("fp", T.LongType())]))


def _masks(width: int, most: int) -> list[int]:
    """All flips of at most ``most`` of ``width`` bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probe(k: int, part):
    return lambda mask: F.struct(F.lit(k).alias("part"), part.bitwiseXOR(mask).alias("value"))


def links(fps: DataFrame, bits: int = 2, segments: int = 2, full: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp). Every pair within ``bits`` is connected by
    links, and no link is longer; pairs that meet in a part of at most ``full`` fingerprints are listed."""
    width = 64 // segments
    widths = [width] * (segments - 1) + [64 - width * (segments - 1)]
    q, a = divmod(bits, segments)
    radius = [q if k <= a else q - 1 for k in range(segments)]
    parts, probes, low = [], [], 0
    for k, w in enumerate(widths):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed((1 << w) - 1)))
        if radius[k] >= 0:
            parts.append(F.struct(F.lit(k).alias("part"), part.alias("value")))
            masks = F.array(*[F.lit(_signed(m)) for m in _masks(w, radius[k])])
            probes.append(F.transform(masks, _probe(k, part)))
        low += w
    stored = written(fps.select(F.col("fp").alias("b"), F.explode(F.array(*parts)).alias("p")).select("b", "p.part", "p.value"), "parts")
    crowded = written(stored.groupBy("part", "value").count().where(F.col("count") > full).select("part", "value"), "full-parts")
    asked = dealt(fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("p")).select("a", "p.part", "p.value"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    found = (asked.join(dealt(stored.join(crowded, ["part", "value"], "left_anti")), ["part", "value"])
             .where((F.col("a") < F.col("b")) & near).select("a", "b"))
    if crowded.isEmpty():
        return found.distinct()
    many = written(asked.join(crowded, ["part", "value"], "left_semi").select(F.col("a").alias("fp")).distinct(), "crowded")
    inner, outer = len(_masks(64, bits // 2)), _masks(64, -(-bits // 2))  # masks are listed by distance
    point = F.posexplode(F.transform(F.array(*[F.lit(_signed(m)) for m in outer]), lambda m: F.col("fp").bitwiseXOR(m)))
    meets = many.select("fp", point.alias("mask", "point"))
    # a point has no more members than the ball has masks
    stars = (meets.groupBy("point").agg(F.min(F.when(F.col("mask") < inner, F.col("fp"))).alias("a"), F.collect_set("fp").alias("members"))
             .where(F.col("a").isNotNull() & (F.size("members") > 1))
             .select("a", F.explode("members").alias("b")).where("a != b"))
    return found.union(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def classes(docs: DataFrame, words: int = 3, bits: int = 2, segments: int = 2, id_col: str = "doc_id",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id_col, tag, fp) and, for each distinct fp, the root of its component, the component's least
    (id, tag) and the number of rows."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(F.struct(F.col(f"`{id_col}`").alias("id"), "tag")).alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), bits, segments))
    rooted = written(dealt(distinct).join(dealt(roots), F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return rows, dealt(rooted).join(dealt(least), "root").select("fp", "root", "first", "n")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, segments: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id): component_id is the least id that links reach."""
    rows, rooted = classes(docs, words, bits, segments, id_col, text_col)
    return salted_join(rows, written(rooted, "rooted"), ["fp"], "n").select(id_col, "fp", F.col("first.id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3, bits: int = 2, segments: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the least id (ties: least text hash, then the
    least hash of all columns)."""
    _, rooted = classes(docs, words, bits, segments, id_col, text_col)
    first = written(rooted.groupBy("root").agg(F.first("first").alias("first")).select(F.col("first.id").alias("__id"), F.col("first.tag").alias("__tag")), "first")
    tagged = docs.withColumn("__text_tag", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))))
    kept = tagged.join(dealt(first), F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__text_tag") == F.col("__tag")), "left_semi")
    own = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = kept.groupBy(F.col(f"`{id_col}`"), "__text_tag").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), own).alias("__row"))
    return one.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
