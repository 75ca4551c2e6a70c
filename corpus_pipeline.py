"""A corpus pipeline: toxic documents go, repeated blocks of lines go, one document of each near-duplicate group stays, sources are
mixed to target weights, and what is left is packed into token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeflow.llm import jaccard
from gazeflow.llm.common import shared_path, table
from gazeflow.llm.line_dedup import deduplicated
from gazeflow.llm.mixing import mix
from gazeflow.llm.packing import pack
from gazeflow.llm.simhash import one_of_each
from gazeflow.llm.toxicity import HELD_OUT, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The labels of sf_dir train the machine, as in op5_toxicity."""
    names = docs.columns
    scored = toxicity(docs, table(spark, sf_dir, "labels"), learns=f"NOT ({HELD_OUT})")
    at = scored.toDF(*(f"c{i}" for i in range(len(scored.columns))))
    return at.where(F.col(f"c{len(names) + 1}") == 0).select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of two lines or more go but for their first places; documents of which nothing is left go."""
    return deduplicated(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike (five-word shingles, Jaccard similarity 0.8 or more, chains joined) the one with the smallest
    doc_id stays."""
    return one_of_each(docs, find=jaccard.near_duplicates, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their targets: documents come as often as they are taken, the last of a source in part."""
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024: one row per piece, as in op4_packing."""
    import public_tokenizers

    return pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Toxicity, near-duplicates and packing have no SQL form. Tests hold the line and near-duplicate stages against brute force, of the
#: others only columns, falling counts and sequence sizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
