"""A corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes the documents that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import curriculum, line_windows, minmax_hash, packing, toxic_segments
from pulsegrid.llm.common import Scratch, table, training_rows

#: Documents of at least this score are rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC. The model learns from labels.

    Null and empty texts hold no evidence and stay; repeated rows are judged each; without labels all stay. An empty
    table gives none.
    """
    scratch = Scratch(spark, "toxicity")
    training = training_rows(docs, table(spark, sf_dir, "labels"), scratch, label="toxic", folds=3, held_out=1)
    model = toxic_segments.fit(training, "t", "y", scratch)
    whole = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    return toxic_segments.judge_toxicity(whole, model).where(F.col("score") < TOXIC).select("doc.*")


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later occurrences of a three-line window cover; n_chars follows the text.

    A document that loses every line goes, as nothing of it is left; one that was empty before stays, and so does a null
    text. The first document by id (null last) keeps its lines. An empty table gives none.
    """
    cleaned = line_windows.dedupe_lines(docs, Scratch(spark, "lines")).where("n_removed = 0 or n_removed < n_lines")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Rows of equal texts are near-duplicates, whatever their ids, and null ids come last; null texts, and texts without
    words, are never near-duplicates and all stay. An empty table gives none.
    """
    return minmax_hash.near_duplicates(docs, Scratch(spark, "minmax")).where("is_first").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, stored in the order of its training position.

    The rows are range-sorted, so the order of the written parts and of the rows in them is the order of training. A
    null source is a source of its own; null and empty texts have no words, cost nothing of the target and keep their
    place; ties are sorted by id; repeated rows are taken each on their own. An empty table gives none.
    """
    return curriculum.mix(docs, Scratch(spark, "mix")).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces; the sequence ids follow the order in which the documents are stored, the training order.

    Copies of a document are packed each on their own. A null text counts as empty and gives the end id alone; an empty
    table gives no piece. A table that isn't read from files is packed in the order of its partitions.
    """
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), order=packing.stored_order(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedupe_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The learned, the hashed and the tokenized stages aren't expressible; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
        if i > 1:
            scratch.drop(STAGES[i - 2][0])
    return docs
