"""BPE encoding and decoding.

Encoding is a backtracking search. An Aho-Corasick automaton over the vocabulary finds the longest
token that starts at each position; tokens are appended greedily, and a token may follow another only
if the two are compatible, i.e. merging by rank would keep exactly this boundary. An incompatible token
gives way to its next shorter prefix token; when none is left, the previous token is taken back and the
position marked as a dead end. Each position fails once at most, so the work is linear in the text, and
the result is the one that merging in rank order gives. Pair answers are kept in a table.

Decoding gathers bytes from one blob by an offset table, for a whole batch at once.

Defined results: a null text is an empty text (no ids, empty decoding); repeated rows are encoded each;
an empty table gives no rows; only ``id_col`` passes through.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablelens.llm.chunks import Pieces, held
from tablelens.llm.common import by_bytes, text_bytes

_NONE = 1 << 60
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: the pre-token pattern of byte-level BPE, its white space spelt out.
PRE_TOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: each byte is one character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(extra)}


class Bpe:
    """Encoder and decoder of a byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import ahocorasick
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = {a + b for a, b in merges}
        # tokens numbered by the order in which merging makes them: base symbols, then merges
        base = [t for t in vocab if t not in made]
        order = {t: i for i, t in enumerate(base)}
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.pair: dict[int, int] = {}  # left << 32 | right -> the token they merge to
        for a, b in merges:
            if a in order and b in order and a + b not in order:
                order[a + b] = len(self.left)
                self.left.append(order[a])
                self.right.append(order[b])
                self.pair[order[a] << 32 | order[b]] = order[a + b]
        names = list(order)
        self.size = [len(t) for t in names]
        self.ids = np.array([vocab[t] for t in names], dtype="<u4")
        self.words = ahocorasick.Automaton()
        for t, i in order.items():
            self.words.add_word(t, i)
        self.words.make_automaton()
        self.shorter = [next((order[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in order), -1) for t in names]
        self.base_count = len(base)
        self.fits: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.by_id = {vocab[t]: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        self.by_id |= {i: t.encode() for t, i in self.special.items()}
        most = max(self.by_id) + 1
        self.offsets = np.zeros(most + 1, dtype=np.int64)
        self.offsets[1:] = np.cumsum([len(self.by_id.get(i, b"")) for i in range(most)])
        self.blob = np.frombuffer(b"".join(self.by_id.get(i, b"") for i in range(most)), dtype=np.uint8)
        self.symbols = {b: c for c, b in alphabet.items()}
        self.pieces = Pieces(self._encode_pieces, self._encode_whole, spec.get("added_tokens", []))
        self.known_words: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Would merging by rank leave the boundary between tokens a and b? Undo the later of the two
        last merges step by step; the boundary falls if an earlier merge joins what meets there."""
        x, y, limit, base, pair, left, right = a, b, _NONE, self.base_count, self.pair, self.left, self.right
        while pair.get(x << 32 | y, limit) >= limit:
            if x >= base and (x > y or y < base):
                limit, x = x, right[x]
            elif y >= base:
                limit, y = y + 1, left[y]
            else:
                return True
        return False

    def encode_symbols(self, text: str) -> list[int]:
        """Internal token numbers of one pre-token, written in the byte alphabet."""
        n, size, shorter, fits = len(text), self.size, self.shorter, self.fits
        longest = [-1] * n
        for end, token in self.words.iter(text):  # ends ascend: the last token of a start is its longest
            longest[end - size[token] + 1] = token
        dead: set[int] = set()
        out: list[int] = []
        at, token, last = 0, longest[0] if n else -1, -1
        while at < n:
            end = at + size[token]
            if end not in dead:
                ok = last < 0
                if not ok:
                    ok = fits.get(last << 32 | token)
                    if ok is None:
                        if len(fits) >= 400_000:
                            fits.clear()
                        ok = fits[last << 32 | token] = self.compatible(last, token)
                if ok:
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return out

    def _word(self, word: str) -> bytes:
        got = self.known_words.get(word)
        if got is None:
            got = self.ids[self.encode_symbols(word)].tobytes()
            if len(word) <= 64:
                if len(self.known_words) >= 100_000:
                    self.known_words.clear()
                self.known_words[word] = got
        return got

    def _encode_plain(self, text: str) -> bytes:
        """A text without special tokens: pre-tokens by the usual pattern, or by the library where
        characters newer than the pattern's tables may occur."""
        if not text:
            return b""
        if text.isascii() or max(text) < "\u0530":
            words = [w.encode().decode("latin-1").translate(self.symbols) for w in PRE_TOKENS.findall(text)]
        else:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(map(self._word, words))

    def _encode_whole(self, text: str) -> bytes:
        if self.split is None:
            return self._encode_plain(text)
        return b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._encode_plain(p)
                         for p in self.split.split(text)])

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [self._encode_whole(p) for p in pieces]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.pieces(text)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, gathered by the offset table."""
        start = self.offsets[ids]
        n = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        return self.blob[at + np.repeat(start - (ends - n), n)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")


def loaded(path: str) -> Bpe:
    """One encoder per Python worker: what a task has learnt serves the tasks after it."""
    return held(f"bpe {path}", lambda: Bpe(path))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False,
               texts: bool = False, batch_bytes: int = 2 << 20) -> DataFrame:
    """Encode and decode each row: (id_col, n_tokens, ids_sha256, decoded_sha256), and the outputs
    themselves if asked for: ``ids`` (array of int), ``decoded`` with ``texts``."""
    df = text_bytes(docs, id_col, text=text_col)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if texts:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches):
        bpe = loaded(path)
        for batch in by_bytes(batches, "__text", batch_bytes):
            raw = [bpe.encode(t.decode("utf-8", "replace")) for t in batch.column("__text").to_pylist()]
            n = [len(r) // 4 for r in raw]
            flat_ids = np.frombuffer(b"".join(raw), dtype="<u4")
            ends = np.cumsum([0, *n])
            size = np.diff(bpe.offsets)
            cuts = np.concatenate([[0], np.cumsum(size[flat_ids])])[ends].tolist()
            flat = bpe.decode_bytes(flat_ids).tobytes()
            back = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            try:
                flat.decode()
            except UnicodeDecodeError:
                back = [b.decode("utf-8", "replace").encode() for b in back]
            cols = [batch.column(id_col), pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back])]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_ids.astype(np.int32))))
            if texts:
                cols.append(pa.array([b.decode() for b in back], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))
