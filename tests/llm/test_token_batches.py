"""The batch encoder of token files against the library, and how much it asks of it."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

PARTS = ["<|endoftext|>", "a", "th", "é", "ß", "Ω", "日", "😀", "́", "ԯ", "԰", "9", "12", "'s", "'re", ",", ".", "!?", ";x", "%%",
         " ", "  ", "\n", "\t", "\r", "\x1c", "　", "\xa0"]


def encoder(**kw):
    from tablelens.llm.token_files import Batches, _library_pieces
    whole = _library_pieces(public.path("byte_bpe_50k.json"))
    return Batches(whole.tok, whole.token_bytes, [{"content": x.decode()} for x in whole.special], **kw)


def library():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("sizes", [{}, {"most": 20, "longest": 3, "pieces": 7, "call": 5}])
def test_batches_equal_the_library(sizes):
    r, batches, lib = random.Random(11), encoder(**sizes), library()
    for parts in (PARTS, PARTS[1:20] + PARTS[20:25], PARTS[1:5] + PARTS[15:21]):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(800)]
        column = pa.array([t.encode() for t in texts], pa.binary())
        assert batches.encoded(column) == lib(texts)
        assert batches.encoded(column.slice(13, 50)) == lib(texts[13:63])
    assert batches.encoded(pa.array([], pa.binary())) == [] and batches.encoded(pa.array([b"", b""], pa.binary())) == [b"", b""]
    assert batches.encoded(pa.array([b"a\xffb", b"c"], pa.binary())) == lib(["a�b", "c"])
    assert len(batches.new) <= batches.half >= len(batches.old)


def test_cuts_are_the_pieces_and_punctuation_after_letters():
    from tablelens.llm.chunks import PIECES
    from tablelens.llm.token_files import cuts
    r = random.Random(12)
    texts = [t for t in ("".join(r.choice(PARTS) for _ in range(r.randrange(15))) for _ in range(3000)) if t]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(t) for t in raw])
    first = ends - [len(t) for t in raw]
    want = [re.split(r"(?<=[a-zéßΩԯ])(?=[,.;:!?])", p) for t in texts for p in PIECES.findall(t)]
    data = b"".join(raw)
    at = [*cuts(np.frombuffer(data, np.uint8), first, ends - 1).tolist(), len(data)]
    assert [data[a:b].decode() for a, b in zip(at, at[1:])] == [x for p in want for x in p]


def test_frequent_words_are_encoded_once():
    batches, asked = encoder(most=60), []
    learn = batches.learn
    batches.learn = lambda pieces: asked.extend(pieces) or learn(pieces)
    letters = "abcdefghij"
    for k in range(40):
        rare = " ".join(f"x{letters[k % 10]}{letters[k // 10]}{c}" for c in letters)
        batches.encoded(pa.array([f"start with some, with. {rare} with! some\nwith some".encode()], pa.binary()))
    # the table was full many times, and punctuation at a word's end makes no new word
    assert asked.count(b" with") == asked.count(b" some") == asked.count(b"start") == 1
    assert not [p for p in asked if p[:5] == b" with" and p != b" with"]
