"""The corpus pipeline: documents without toxic ones, one of each near-duplicate group, without repeated
passages, mixed to the sources' target weights, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their
input. ``run`` writes each result as Parquet in the shared scratch folder and reads it again for the next, so a
lost executor never costs more than one stage.

Defined results: rows with null ids or texts pass like others (a null text stays null where it is kept); an empty
table stays empty; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bpe import round_trip
from tablelens.llm.common import table, written
from tablelens.llm.mix_sources import mixed_rows
from tablelens.llm.queries import TOXIC_CHAIN, labelled, tokenizer
from tablelens.llm.simhash import one_of_each
from tablelens.llm.suffix_dedup import remove_repeats
from tablelens.llm.toxicity import toxicity


#: Repeated passages of so many words go: the stage's own window, in words, as passages differ in bytes.
PASSAGE_WORDS = 51


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain gives a toxic probability below one half."""
    # numbered names, so that no column is called like a probability
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    scored = toxicity(numbered, labelled(spark, sf_dir).withColumnRenamed("doc_id", names["doc_id"]), TOXIC_CHAIN, id_col=names["doc_id"],
                      text_col=names["text"], keep=list(names.values()))
    return scored.where(F.col("p_toxic") < 0.5).select(*[F.col(n).alias(c) for c, n in names.items()])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each SimHash group (3-word shingles, 2 bits)."""
    return one_of_each(docs, words=3, bits=2)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that are found twice or more; n_chars follows."""
    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs.withColumn("__no_text", F.col("text").isNull()), window=PASSAGE_WORDS, words=True, keep=(*others, "__no_text"))
    text = F.when(~F.col("others.__no_text"), F.col("kept").cast("string"))
    changed = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"others.`{c}`").alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixed_rows(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of their decoding."""
    return round_trip(docs, tokenizer("byte_bpe_50k.json"), ids=True)


STAGES = [("toxicity", without_toxic), ("simhash", without_near_duplicates), ("suffix_array", without_repeats),
          ("mixing", mixed), ("bpe", as_tokens)]

#: The chain's fit and the mix's draws are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
