"""A training corpus from raw documents in five stages.

Toxic documents go, passages that repeat go, one document of each group of near copies stays, the sources
are mixed to their target weights, and what is left is packed into sequences. Each stage takes the
documents that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwork.llm import line_dedup, mixing, near_dedup, packing, toxicity
from stemwork.llm.common import release, table, tables_written, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, with a model fitted on those of the labelled ones that are in docs.

    Where the labels are of one kind there is nothing to tell documents apart by, and all stay.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs if model.curve is None else toxicity.scan_all(docs, model, COLUMNS, details=False).where("score < 0.5").select(COLUMNS)


def drop_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their later repeated runs of lines; those of which no word is left go."""
    out = line_dedup.drop_repeated_lines(docs.select(COLUMNS))
    changed = F.col("lines_dropped") > 0
    out = out.where(~changed | (mixing.words(F.col("text")) > 0))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that with the smallest doc_id; repeated rows and null doc_ids too."""
    return near_dedup.one_of_each(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of 150 % of all words takes them, longer ones with greater odds."""
    mixed = mixing.mix(docs.select(COLUMNS), weight=mixing.by_length()).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens, every source at its own share."""
    return packing.with_crc(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Signatures, fitted models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. Tables that stages leave are deleted when the next is written."""
    docs, start = table(spark, sf_dir, "documents"), len(tables_written())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
