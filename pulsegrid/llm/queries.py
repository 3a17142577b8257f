"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pulsegrid.llm import bucket_pointer, collocations, curriculum, gam, line_quality, line_windows, minmax_hash, periodic_runs, sharding, toxic_segments, url_rules
from pulsegrid.llm.common import Scratch, fold_of, table, training_rows
from pulsegrid.llm.media import media_digests
from pulsegrid.llm.packing import pack, piece_digests


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.PRODUCTION_RULES, Scratch(spark, "urls"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "component")


def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_windows.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lines"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = curriculum.schedule(curriculum.plan_mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix")))
    return planned.select("doc_id", "size", "source_size", "target", "copies", "taken", *[F.round(c, 9).alias(c) for c in ("first_position", "last_position")])


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "toxicity")
    training = training_rows(docs, table(spark, sf_dir, "labels"), scratch, label="toxic", folds=3, held_out=1)
    judged = toxic_segments.judge_toxicity(docs.select("doc_id", "text"), toxic_segments.fit(training, "t", "y", scratch))
    return judged.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "excess", F.size("passages").alias("n_passages"))


def op6_bucket_pointer_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_pointer.span_digests(table(spark, sf_dir, "documents"), Scratch(spark, "repeats"))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_chars", "kept", F.md5("clean_text").alias("clean_md5"))


def op8_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax_hash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "minmax"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_pairwise_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = training_rows(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality"), label="quality", folds=5, held_out=0, max_rows=gam.MAX_ROWS)
    judged = gam.judge_quality(docs.select("doc_id", "text"), gam.fit(training))
    return judged.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op11_longest_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "shards")))


def op12_double_array_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), Scratch(spark, "collocations"))


def op13_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {
    f.__name__: f
    for f in (
        op1_redirect_equivalence,
        op2_power_of_two_packing,
        op3_three_line_windows,
        op4_curriculum_mix,
        op5_toxic_segments,
        op6_bucket_pointer_refinement,
        op7_line_first_quality,
        op8_minmax_hashing,
        op9_pairwise_additive_quality,
        op10_png_media,
        op11_longest_processing_time,
        op12_double_array_collocations,
        op13_grammar_runs,
    )
}

ORACLE: dict[str, str] = {
    "op1_redirect_equivalence": url_rules.oracle(),
    "op3_three_line_windows": line_windows.ORACLE,
    "op4_curriculum_mix": curriculum.ORACLE,
    "op6_bucket_pointer_refinement": bucket_pointer.ORACLE,
    "op7_line_first_quality": line_quality.ORACLE,
    "op8_minmax_hashing": minmax_hash.ORACLE,
    "op11_longest_processing_time": sharding.ORACLE,
    "op12_double_array_collocations": collocations.ORACLE,
    "op13_grammar_runs": periodic_runs.ORACLE,
}
