"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results, beside those of the operators: an empty table gives an empty table at each stage; null and empty texts go with the quality rules, as do texts under their word count; repeated rows are judged alike, so that all
but the first line of each goes with line dedup, which leaves the repeated rows of one doc_id as they are; rows without doc_id take no part in near_duplicates and stay; texts of any length are treated whole; further columns of any name pass
through all stages but the last, which returns ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import jaccard, lines, mixing, quality, sentencepieces
from readloom.llm.common import stored, table
from readloom.shipping import shipped


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; thresholds come from the labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal or nearly equal an earlier one; n_chars follows the text. A document that is left without a word was a copy, and goes."""
    out = lines.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles. Lines that went already were what copies have in common, so documents are compared by the texts that the table documents has for their ids, and
    by what the stages before have left of them, where that differs; a document that isn't there by its own alone."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    whole = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")
    own = docs.select("doc_id", "text", *prints).where("doc_id is not null").join(whole.select("doc_id", *prints), ["doc_id", "h", "n"], "left_anti")
    judged = whole.join(ids, "doc_id", "left_semi").unionByName(own.select("doc_id", "text"))
    return jaccard.one_of_each_group(docs, width=5, num=80, den=100, judged=stored(judged))


@shipped
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.mix(docs)


@shipped
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Canonical ids of each text and its sampled segmentations; a document that was drawn several times has as many rows."""
    out = sentencepieces.encode(docs)
    samples = "transform(samples, s -> struct(s.rank, s.n_ids, round(s.log_prob, 6) as log_prob, round(s.log_inclusion, 6) as log_inclusion, s.ids_sha256, s.ids, s.decodes))"
    return out.select("doc_id", "n_ids", "ids", "decodes", F.expr(samples).alias("samples"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the sampled segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
