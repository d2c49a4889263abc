"""The corpus pipeline: five stages from the corpus operators, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, with ``n_chars`` kept true to the text.

Defined cases: null texts, without words, are rejected by the first stage; null ids, sources and other columns pass through; rows
alike in id and text are near-duplicates of each other; an empty table gives an empty table; further columns of any name are kept
up to the mix and left out by the last stage, whose columns are its own.
"""
from pyspark.sql import functions as F

from rostrum.llm import bpe, mixing, neardup, pii, quality
from rostrum.llm._spark import Scratch


def counted(docs):
    """``n_chars`` of the text as it is now; unchanged where there is none."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def quality_stage(spark, docs, sf_dir):
    """Rejected documents go, and boilerplate lines of the others."""
    return counted(quality.keep_good(docs))


def near_dup_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return neardup.drop_near_dups(docs)


def pii_stage(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    return counted(pii.mask(docs))


def mix_stage(spark, docs, sf_dir):
    """Documents stand as often as the mix uses them: not at all, once or twice."""
    return mixing.repeated(docs)


def bpe_stage(spark, docs, sf_dir):
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dup_stage),
    ("personal data", pii_stage),
    ("source mix", mix_stage),
    ("byte-level BPE", bpe_stage),
]
#: SQL expresses neither byte-pair merges nor the seeded mix; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES:
        with Scratch.group():  # the stage's own tables go when its result is written
            docs = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
