"""Token counts: batch encoding inside Arrow functions that return lengths only.

``count_tokens(docs)`` adds ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row. Arrow batches are
cut into slices of equal bytes; a text is cut at ASCII white space, which a tokenizer that drops white
space never joins over, so even a text of many megabytes is counted in short pieces. Each slice encodes
the words it has not met yet in one batch call, and only their lengths are kept (a bounded table).

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows are counted each; an
empty table gives no rows; other columns of the input pass through in ``keep`` only, so clashing names
can't arise; bytes that aren't UTF-8 count as U+FFFD does.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.chunks import Remembered, held
from tablelens.llm.common import by_bytes, text_bytes


def known_lengths(model_path: str) -> Remembered:
    """One table of counted words per Python worker: what a task has learnt serves the tasks after it."""
    return held(f"lengths {model_path}", lambda: Remembered(_lengths(model_path)))


def _lengths(model_path: str):
    """words (bytes) -> token counts, as the library gives without special tokens added."""
    if model_path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return lambda texts: [len(x) for x in sp.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(model_path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x) for x in tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts],
                                                           add_special_tokens=False)]


def drops_space(model_path: str) -> bool:
    """True if the tokenizer removes white space before merging, so that words are independent."""
    if model_path.endswith(".model"):
        return False
    import json
    with open(model_path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    return any(p.get("type") == "Split" and p.get("behavior") == "Removed" for p in parts)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row per input row."""
    df = text_bytes(docs, id_col, text=text_col)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    by_word = drops_space(model_path)

    def run(batches):
        known = known_lengths(model_path)
        for batch in by_bytes(batches, "__text", batch_bytes):
            texts = batch.column("__text").to_pylist()
            if by_word:
                words = [t.split() for t in texts]
                n = []
                for ws in words:
                    known.learn(ws)
                    n.append(sum(map(known.__getitem__, ws)))
                    known.forget_long()
            else:
                n = known.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"])

    return df.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
