"""A corpus pipeline of five stages; each reads the whole of what its predecessor kept.

STAGES: (name, function(spark, docs, sf_dir) -> DataFrame).  All but the last
return the columns of documents.  run() writes each stage's result to the
shared folder as Parquet and rereads it as the next stage's docs.

Defined results: null and empty texts are scored like any other and, if kept,
stay as they are through line dedup; those, and texts that line dedup emptied
(plain copies of earlier ones), are near-duplicates of each other, so one stays;
a null id loses against any other in its group; repeated rows stand or fall
together; extra columns pass through all stages but the last; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import bpe, cnn, decontam, linedup, registry, simhash
from quadrel.llm.common import materialise, scratch, table
from quadrel.storage import mark, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional network doesn't reject."""
    return cnn.keep(docs, cnn.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts rid of lines that repeat, or nearly repeat, an earlier line; every document stays."""
    return linedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): ids of each text, and the text decoded from them."""
    coded = bpe.encode(docs, public_tokenizers.path(registry.TOKENIZER), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("bpe", tokens),
]

#: The first stage is a learned network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch(spark, name.replace(" ", "-"))
        begun = mark()
        docs = materialise(stage(spark, docs, sf_dir), name, path=kept)
        release(spark, begun)  # what the stage itself wrote; its result is whole now
    return STAGES[-1][1](spark, docs, sf_dir)
