"""Digests of files of any size: blocks hashed in tasks, folded to one digest a file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block, and of one read.
BLOCK_BYTES, READ_BYTES = 64 << 20, 1 << 20


def block_digests(spark: SparkSession, folders: list[str], block: int = BLOCK_BYTES) -> DataFrame:
    """(path, length, block, sha256) of all files below folders.

    Only names and lengths are listed; each block is a row, dealt evenly, and read by its task in small pieces, so
    neither a file nor a block is ever held. Spark doesn't list empty files, so they have no digest.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path", "length")
    last = F.ceil(F.col("length") / block).cast("long") - 1
    blocks = listed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, k in zip(part["path"], part["block"], strict=True):
                source, name = fs.FileSystem.from_uri(path)
                digest, left = hashlib.sha256(), block
                with source.open_input_file(name) as f:
                    f.seek(int(k) * block)
                    while left and (data := f.read(min(left, READ_BYTES))):
                        digest.update(data)
                        left -= len(data)
                out.append(digest.hexdigest())
            yield part.assign(sha256=out)

    return blocks.repartition("path", "block").mapInPandas(hashed, "path string, length long, block long, sha256 string")


def file_digests(blocks: DataFrame) -> DataFrame:
    """(path, length, blocks, tree): a file's digest is that of its blocks' digests, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda b: b["sha256"]), "")
    return blocks.groupBy("path", "length").agg(F.count("*").alias("blocks"), F.sha2(joined, 256).alias("tree"))


def damaged_blocks(told: DataFrame, found: DataFrame) -> DataFrame:
    """(path, block, state) of blocks that are missing, new or changed against a manifest of block digests."""
    a, b = told.select("path", "block", F.col("sha256").alias("a")), found.select("path", "block", F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").otherwise("changed")
    return a.join(b, ["path", "block"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", "block", state.alias("state"))
