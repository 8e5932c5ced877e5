"""The corpus pipeline: stages applied one after another to documents, each written as Parquet and reread.

Each stage works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard_join, mixing, suffix_dedup, toxicity
from tessera.llm.common import Scratch, table

#: Share of the tokens that reach the mixing stage and are kept, in hundredths.
MIX_SHARE = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows with a null id stay."""
    found = jaccard_join.jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    with_id = docs.where("doc_id is not null").join(found, F.col("doc_id") == F.col("__kept"), "left_semi")
    return with_id.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that an earlier document has; n_chars follows, and what is left empty goes."""
    out = suffix_dedup.deduplicated(docs)
    emptied = (F.length("text") == 0) & (F.col("n_chars") > 0)
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that one epoch of the mix takes."""
    return mixing.select_documents(docs, MIX_SHARE)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and digests of its ids and of the text decoded from them."""
    return bpe.encode_digests(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", one_of_near_copies),
    ("suffix dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: A trained classifier has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
