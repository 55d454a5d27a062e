"""A corpus pipeline of five operators; each stage works on all that the one before has kept."""

import secrets
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mix, neardup, pii, toxicity
from tessera.llm.common import remove, shared_dir, shuffles_go, table, written

#: A document is rejected from this score on.
TOXIC = 0.7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon rejects go; empty and null texts stay."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(written(toxicity.labelled(rows, table(spark, sf_dir, "labels")), "labelled"))
    return toxicity.score(docs, lexicon, into="_toxicity").where(F.col("_toxicity") < TOXIC).select(docs.columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the smallest doc_id."""
    gone = neardup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("_id"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_id"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words of the benchmark go, where they make up a twentieth of a document or exceed 13 words at a stretch."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=13, coverage=0.05, longest=13)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values get pseudonyms under the secret key of the setting spark.tessera.piiKey; null and empty texts stay, repeated rows each get the same.

    Without the setting a key is drawn for this run and forgotten: nobody can undo its pseudonyms, and those of another run differ."""
    key = spark.conf.get("spark.tessera.piiKey", None) or secrets.token_hex(32)
    return pii.pseudonymise(docs, key.encode(), spans=None)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (repeats) and how many words that makes (taken)."""
    out = mix.mix(docs).withColumnRenamed("_repeats", "repeats").where("repeats > 0")
    return out.select(*docs.columns, "size", "source_size", "target", "repeats", "taken")


STAGES = [("toxicity", toxicity_stage), ("minhash", minhash_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mix", mix_stage)]
#: Learned scores, near duplicates and pseudonyms can't be told in SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, from the documents table; each stage is written in the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with shuffles_go(spark):
            out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i:  # nothing reads what the stage before has written any more
            remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
