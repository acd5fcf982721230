"""Token-ID files: length-delimited binary records with masked checksums, and an offset index.

A data file is a run of frames, in ascending id order across and within files:

    u64  length of the payload          u32  masked CRC-32C of those 8 bytes
    payload                             u32  masked CRC-32C of the payload
    u8   0x0A

(all little-endian). The payload is u8 flags (1: ids are 4 bytes wide, else 2; 2: the document id is
null), i64 document id, then the token ids with the end id. The closing byte is the record separator of
Spark's own sink, which writes the frames: files appear through its commit protocol, on any file system,
and a lost or repeated task leaves no half-written file. Readers use the lengths only.

The index (Parquet: shard, offset, n_bytes, id, n_tokens, ...) is made by a checked scan of the files;
``read_records`` fetches any subset of records, in any order, by it.

Defined results: a null text is an empty text (its record holds the end id only); rows with equal ids are
ordered by a hash of the text, and equal rows are interchangeable; null ids come first; an empty table
gives no files and an empty index.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.chunks import WIDE_SPACE, Pieces, held
from tablelens.llm.common import by_bytes, text_bytes
from tablelens.llm.crc32c import crc32c, masked

HEAD = struct.Struct("<QI")
KEY = struct.Struct("<Bq")

_ENDING = np.isin(np.arange(256), list(b",.;:!?"))
#: Letters of one or two UTF-8 bytes; letters beyond this block may be unknown to one of two tables of Unicode.
_LETTER = np.array([c < 0x530 and chr(c).isalpha() for c in range(0x800)])


def cuts(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the pieces of ``chunks`` start in the UTF-8 bytes of texts that lie one after the other; ``first`` and
    ``last`` are the places of each text's first and last byte. Punctuation after a letter, which never shares a
    token with it, starts a piece too, so that words are known with and without it."""
    space = (data == 32) | (data - np.uint8(9) < 5)
    start = np.zeros(len(data), bool)
    # a run of white space; what follows a run that doesn't end in a blank
    start[1:] = np.where(space[1:], ~space[:-1], space[:-1] & (data[:-1] != 32))
    before_word = np.zeros(len(data), bool)
    before_word[1:-1] = space[1:-1] & space[:-2] & ~space[2:]
    before_word[last] = False
    start |= before_word
    ending = np.flatnonzero(_ENDING[data])
    ending = ending[ending > 0]
    before = data[ending - 1]
    start[ending[(before < 0x80) & _LETTER[before]]] = True
    ending = ending[(before & 0xC0 == 0x80) & (ending > 1)]
    lead = data[ending - 2].astype(np.int64)
    start[ending[(lead & 0xE0 == 0xC0) & _LETTER[(lead & 0x1F) << 6 | data[ending - 1] & 0x3F]]] = True
    start[first] = True
    return np.flatnonzero(start)


def valid_utf8(texts: pa.Array) -> pa.Array:
    """The same binary texts, bytes that aren't UTF-8 as U+FFFD."""
    try:
        texts.cast(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace").encode() for t in texts.to_pylist()], pa.large_binary())
    return texts.cast(pa.large_binary())


class Whole(Pieces):
    """Pieces by a library whose tokens are not bytes."""

    def encoded(self, texts: pa.Array) -> list[bytes]:
        return self.many([t.decode("utf-8", "replace") for t in texts.to_pylist()])


class Batches:
    """Texts of a byte-level vocabulary to ids (little-endian u32), a batch at a time: texts are cut in one pass over
    their bytes, a batch's distinct pieces are looked up once, and the ids of all pieces are gathered by Arrow. Pieces
    not known yet are joined to one text, since the pre-tokenizer keeps them apart, and its ids cut by the tokens'
    numbers of bytes. The table has two halves: when the newer is full the older is dropped, so frequent pieces stay."""

    _UNCUT = b"-"  # no number of ids: a piece that holds white space outside ASCII

    def __init__(self, tok, token_bytes: np.ndarray, added: list[dict], most: int = 400_000, longest: int = 64,
                 pieces: int = 1 << 20, call: int = 1 << 14):
        self.tok, self.token_bytes = tok, token_bytes
        self.half, self.longest, self.pieces, self.call = most // 2, longest, pieces, call
        self.new, self.old = {}, {}
        # of two that start at one place the library takes the longer
        self.special = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.split = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")")
        self.apart = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))

    def alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, pieces: list[bytes]) -> list[bytes]:
        # a piece without a blank starts a line; the line break before it is a token of its own
        lines = [p if p[0] == 32 else b"\n" + p for p in pieces]
        text = b"".join(lines).decode()
        if not text.isascii() and WIDE_SPACE.search(text):
            uncut = {p for p in pieces if not p.isascii() and WIDE_SPACE.search(p.decode())}
            rest = [p for p in pieces if p not in uncut]
            got = dict(zip(rest, self.together(rest))) if rest else {}
            return [got.get(p, self._UNCUT) for p in pieces]
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        done = np.cumsum(self.token_bytes[ids])
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(sizes)
        last = np.searchsorted(done, ends)
        if len(done) == 0 or last[-1] >= len(done) or (done[last] != ends).any():
            return self.alone([p.decode() for p in pieces])
        breaks = sizes - np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.concatenate([[0], last[:-1] + 1]) + breaks
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip((4 * first).tolist(), (4 * last + 4).tolist())]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        out = []
        for k in range(0, len(pieces), self.call):
            some = pieces[k:k + self.call]
            words = [p for p in some if p[-1] > 32 or p[-1] not in b" \t\n\x0b\x0c\r"]
            got = dict(zip(words, self.together(words))) if words else {}
            if len(words) < len(some):
                spaces = [p for p in some if p not in got]
                got.update(zip(spaces, self.alone([p.decode() for p in spaces])))
            out += [got[p] for p in some]
        return out

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        got = list(map(self.new.get, pieces))
        absent = [k for k, e in enumerate(got) if e is None]
        if not absent:
            return got
        older = list(map(self.old.get, [pieces[k] for k in absent]))
        unknown = [k for k, e in zip(absent, older) if e is None]
        learnt = iter(self.learn([pieces[k] for k in unknown]))
        for k, e in zip(absent, older):
            got[k] = next(learnt) if e is None else e
        if len(self.new) + len(absent) > self.half:
            self.new, self.old = {}, self.new
        self.new.update((pieces[k], got[k]) for k in absent[:self.half] if len(pieces[k]) <= self.longest)
        return got

    def __call__(self, text: str) -> bytes:
        return self.encoded(pa.array([text.encode()], pa.binary()))[0]

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """The encodings of UTF-8 texts, none null."""
        texts = valid_utf8(texts)
        rows = texts.to_pylist() if self.special else []
        special = [k for k, t in enumerate(rows) if any(x in t for x in self.special)]
        if not special:
            return self._cut_and_encode(texts)
        if not self.apart:
            got = dict(zip(special, self.alone([rows[k].decode() for k in special])))
            rest = iter(self._cut_and_encode(pa.array([t for k, t in enumerate(rows) if k not in got], pa.large_binary())))
            return [got[k] if k in got else next(rest) for k in range(len(rows))]
        # special strings end a text; every second part is one
        known = dict(zip(self.special, self.alone([x.decode() for x in self.special])))
        parts = [self.split.split(t) for t in rows]
        plain = iter(self._cut_and_encode(pa.array([p for ps in parts for p in ps[::2]], pa.large_binary())))
        return [b"".join([known[p] if k % 2 else next(plain) for k, p in enumerate(ps)]) for ps in parts]

    def _cut_and_encode(self, texts: pa.Array) -> list[bytes]:
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if at[0] == at[-1]:
            return [b""] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        filled = at[:-1] < at[1:]
        starts = np.append(cuts(data, at[:-1][filled], at[1:][filled] - 1), len(data))
        ids, ends, uncut = [], [np.zeros(1, np.int64)], []
        for k in range(0, len(starts) - 1, self.pieces):
            some = starts[k:k + self.pieces + 1]
            pieces = pa.Array.from_buffers(pa.binary() if len(data) < 1 << 31 else pa.large_binary(), len(some) - 1, [
                None, pa.py_buffer(some.astype(np.int32 if len(data) < 1 << 31 else np.int64)), pa.py_buffer(data)]).dictionary_encode()
            known = pa.array(self.look_up(pieces.dictionary.to_pylist()), pa.large_binary())
            odd = np.flatnonzero(pc.binary_length(known).to_numpy() == len(self._UNCUT))
            if len(odd):
                uncut.append(k + np.flatnonzero(np.isin(pieces.indices.to_numpy(), odd)))
            got = known.take(pieces.indices)
            sizes = np.frombuffer(got.buffers()[1], np.int64)[got.offset:got.offset + len(got) + 1]
            ids.append(got.buffers()[2].to_pybytes()[sizes[0]:sizes[-1]])
            ends.append(ends[-1][-1] + sizes[1:] - sizes[0])
        raw, ends = b"".join(ids), np.concatenate(ends)
        bounds = ends[np.searchsorted(starts, at)].tolist()
        out = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        if uncut:
            for row in np.unique(np.searchsorted(at, starts[np.concatenate(uncut)], "right") - 1).tolist():
                out[row] = self.alone([texts[row].as_py().decode()])[0]
        return out


def library_pieces(path: str) -> Batches | Whole:
    """Texts to ids (little-endian u32) by the tokenizers library, repeated pieces remembered; one per
    Python worker, so that what a task has learnt serves the tasks after it."""
    return held(f"library {path}", lambda: _library_pieces(path))


def _library_pieces(path: str) -> Batches | Whole:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    byte_level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space")
    vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in added}}
    # byte-level vocabularies write one character for each byte, so a token has as many bytes as characters
    token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    for t, i in vocab.items():
        token_bytes[i] = len(t)
    batches = Batches(tok, token_bytes, added)
    return batches if byte_level else Whole(batches.alone, lambda text: batches.alone([text])[0], added)


def frames(keys: list, ids: list[np.ndarray], wide: bool) -> list[bytes]:
    """One frame (without its closing byte) for each record."""
    payloads = [KEY.pack(int(wide) | 2 * (k is None), k or 0) + x.astype("<u4" if wide else "<u2").tobytes()
                for k, x in zip(keys, ids)]
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(sizes)), masked(crc32c(payloads))
    return [b"".join((s, struct.pack("<I", h), p, struct.pack("<I", b)))
            for s, h, p, b in zip(sizes, heads.tolist(), payloads, bodies.tolist())]


def parse(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, payload) of each frame; raises if a checksum or length is wrong."""
    view, at, out, sums, sizes = memoryview(data), 0, [], [], []
    while at < len(data):
        size, head = HEAD.unpack_from(data, at)
        if at + 17 + size > len(data):
            raise ValueError(f"record at {at} is cut short")
        out.append((at, bytes(view[at + 12:at + 12 + size])))
        sizes.append((bytes(view[at:at + 8]), head))
        sums.append(struct.unpack_from("<I", data, at + 12 + size)[0])
        at += 17 + size
    if out:
        wrong = masked(crc32c([p for _, p in out])) != np.array(sums, dtype=np.uint32)
        wrong |= masked(crc32c([s for s, _ in sizes])) != np.array([h for _, h in sizes], dtype=np.uint32)
        if wrong.any():
            raise ValueError(f"wrong checksum at {out[int(np.flatnonzero(wrong)[0])][0]}")
    return out


def record(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, key = KEY.unpack_from(payload)
    return None if flags & 2 else key, np.frombuffer(payload, dtype="<u4" if flags & 1 else "<u2", offset=KEY.size)


def write_records(docs: DataFrame, path: str, model_path: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", shard_bytes: int = 16 << 20) -> None:
    """Encode every text, append ``end_id``, write the frames under ``path`` in ascending id order.
    ``shard_bytes`` is the text that a file holds, on average."""
    df = text_bytes(docs, id_col, text=text_col).withColumn(id_col, F.col(id_col).cast("long"))
    total = df.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    with open(model_path, encoding="utf-8") as f:
        wide = _vocabulary(f.read(), end_id) > 1 << 16

    def run(batches):
        pieces = library_pieces(model_path)
        end = struct.pack("<I", end_id)
        for batch in by_bytes(batches, "__text", 4 << 20):
            ids = [np.frombuffer(e + end, dtype="<u4") for e in pieces.encoded(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([pa.array(frames(batch.column(id_col).to_pylist(), ids, wide), pa.binary())],
                                             names=["frame"])

    (df.withColumn("__tie", F.xxhash64("__text"))
     .repartitionByRange(max(1, -(-total // shard_bytes)), F.col(id_col).asc_nulls_first(), F.col("__tie"))
     .sortWithinPartitions(F.col(id_col).asc_nulls_first(), "__tie", "__text")
     .drop("__tie").mapInArrow(run, "frame binary")
     .select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", "\n").text(path))


def _vocabulary(spec: str, end_id: int) -> int:
    model = json.loads(spec)
    return max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))]) + 1


_FILES = {"pathGlobFilter": "part-*"}
INDEX = ("shard string, offset long, n_bytes long, id long, n_tokens long, first long, ids_crc32 long")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").options(**_FILES).load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content"))


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files, checksums verified: the index rows (``first`` is the number of ids
    before the record in its file, ``ids_crc32`` that of the ids as little-endian u32)."""

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content")):
                rows, first = [], 0
                for at, payload in parse(data.as_buffer().to_pybytes()):
                    key, ids = record(payload)
                    rows.append((shard, at, len(payload) + 17, key, len(ids), first, zlib.crc32(ids.astype("<u4"))))
                    first += len(ids)
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                                     names=["shard", "offset", "n_bytes", "id", "n_tokens", "first", "ids_crc32"])

    return _shards(spark, path).mapInArrow(run, INDEX)


def with_start(index: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all records before. Only one row per file is put in order."""
    number = F.regexp_extract("shard", r"part-(\d+)", 1).cast("long")
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy(number, "shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return index.join(sums, "shard").withColumn("start", F.col("__before") + F.col("first")).drop("__before")


def build_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Scan the files once and write their index beside them."""
    scan_records(spark, path).write.parquet(index_path)
    return spark.read.parquet(index_path)


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(id, ids) of the records that ``index`` rows point to: each file that is pointed into is read once."""

    def fetch(_, files: pa.Table, rows: pa.Table) -> pa.Table:
        keys, out = [], []
        if files.num_rows:
            data = files.column("content")[0].as_buffer().to_pybytes()
            for at, n in zip(rows.column("offset").to_pylist(), rows.column("n_bytes").to_pylist()):
                key, ids = record(parse(data[at:at + n])[0][1])
                keys.append(key)
                out.append(ids.astype(np.int32))
        return pa.table({"id": pa.array(keys, pa.int64()), "ids": pa.array(out, pa.list_(pa.int32()))})

    return (_shards(spark, path).groupBy("shard").cogroup(index.select("shard", "offset", "n_bytes").groupBy("shard"))
            .applyInArrow(fetch, T.StructType([T.StructField("id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])))


def token_files(docs: DataFrame, model_path: str, end_id: int, path: str, id_col: str = "doc_id",
                text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """Write, index and read back: one row per record with its place and digest."""
    write_records(docs, f"{path}/data", model_path, end_id, id_col, text_col, shard_bytes)
    index = build_index(docs.sparkSession, f"{path}/data", f"{path}/index")
    return with_start(index)
