"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. :func:`run` writes each stage's result to the shared folder and reads
it again as the next one's input, so a lost executor costs part of one stage.

Defined results of all stages: a null or empty text is never toxic, leaking, or a copy, and
is packed as an empty document; decisions are by row, whatever its doc_id (null or repeated);
the order among equal candidates is by doc_id, null last, then by the text's digest; an
empty table gives an empty one; other columns, whatever their names, are passed on by all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import decontamination, line_templates, near_duplicates, packing, toxicity
from refrain.llm.common import materialize, table
from refrain.llm.queries import tokenizer_path

#: The stages train, sample and search on whole inputs; SQL can't express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.score(docs, chain, reject="toxic").filter(~F.col("rejected")).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines, short ones too, whose template an earlier document has and at least three share; n_chars follows the text."""
    cleaned = line_templates.drop_recurring_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    return near_duplicates.drop_near_duplicates(docs, words=5, percent=80).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
