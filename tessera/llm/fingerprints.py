"""Operator 1: document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks places; a chunk ends at one (normalised chunking: rare marks up to the normal
size, frequent ones behind it). An insertion moves chunks but leaves their digests. A fingerprint is the set of chunk
digests with chunk lengths; the likeness of two is the length they share over the length of the smaller.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, partitions, small_batches, table

LEAST, NORMAL, MOST = 16, 64, 256
#: Marks before and behind the normal size: a byte in 128, a byte in 32.
HARD, EASY = np.uint32(0x7F << 25), np.uint32(0x1F << 25)
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i])) for i in range(256)], np.uint32)

#: Documents of an id range, about; rows of ranges that are sent to every task, at most.
RANGE_DOCS, BROADCAST_RANGES = 20_000, 100_000

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def gear(data: bytes) -> np.ndarray:
    """At each byte the hash of the 32 bytes up to it: sums over 1, 2, 4, ... bytes, each from two of the one before."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):
        n = 1 << k
        if len(h) > n:
            h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    return h


def cuts(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks from a chunk's start on."""
    base = max(0, start - 31)
    h = gear(data[base:])
    easy = np.flatnonzero((h & EASY) == 0)
    hard = easy[(h[easy] & HARD) == 0] + (base + 1)
    easy, hard = (easy + (base + 1)).tolist(), hard.tolist()
    out, n = [], len(data)
    while start < n:
        i = bisect_left(hard, start + LEAST)
        if i < len(hard) and hard[i] < start + NORMAL:
            end = hard[i]
        else:
            i = bisect_left(easy, start + NORMAL)
            end = easy[i] if i < len(easy) and easy[i] < start + MOST else start + MOST
        start = min(end, n)
        out.append(start)
    return out


def chunk_set(data: bytes, start: int, ends: list[int]) -> set[int]:
    """Digest (48 bits) and length (16 bits) of each chunk, as one number."""
    out, digest = set(), xxhash.xxh3_64_intdigest
    for end in ends:
        out.add(digest(data[start:end]) >> 16 << 16 | (end - start))
        start = end
    return out


def likeness(a: set[int], b: set[int]) -> float:
    """Shared length over the length of the smaller set; two empty ones are alike, an empty one is like no other."""
    if not a or not b:
        return float(a == b)
    size = lambda s: sum([x & 0xFFFF for x in s])
    return size(a & b) / min(size(a), size(b))


def printed(chunks: set[int]) -> str:
    return base64.b64encode(np.array(sorted(chunks), ">u8").tobytes()).decode()


def edited(text: str, data: bytes, ends: list[int], following: str) -> tuple[bytes, set[int]]:
    """The text with its last quarter replaced, and its chunks; those before the edit are the text's own."""
    k = len(text) // 4
    head = text[: len(text) - k].encode()
    new = head + following[:k].encode()
    i = bisect_left(ends, len(head) + 1)  # chunks that end inside what is kept
    if i and ends[i - 1] == len(head) and len(data) == len(head):
        i -= 1  # the kept text's last chunk ended with the text, not at a mark
    start = ends[i - 1] if i else 0
    return new, chunk_set(data, 0, ends[:i]) | chunk_set(new, start, cuts(new, start))


def compared(batches: Batches) -> Batches:
    """Rows (coarse, fine, guest, doc_id, text) in this order: each document against the next one in its range."""

    def row(doc: tuple, following: tuple) -> tuple:
        i, text, data, ends, own = doc
        new, chunks = edited(text, data, ends, following[1])
        return i, len(text), hashlib.sha256(new).hexdigest(), printed(own), printed(chunks), likeness(own, chunks), likeness(own, following[4])

    last, last_bucket, ended = None, None, False
    for batch in batches:
        rows = []
        for coarse, fine, guest, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, bucket = text or "", (coarse, fine)
            if bucket != last_bucket:
                last, last_bucket, ended = None, bucket, False
            if ended:  # a repeated row of the guest
                continue
            data = text.encode()
            ends = cuts(data)
            doc = (i, text, data, ends, chunk_set(data, 0, ends))
            if last is not None:
                rows.append(row(last, doc))
            last, ended = doc, bool(guest)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """docs with coarse and fine: the range of doc_id, in two levels of about the square root of ranges each.

    Ranges are parted at approximate quantiles: the coarse ones of all ids, the fine ones of each coarse range's. The
    driver gets the coarse edges alone. Null ids are in the first range.
    """
    level = max(1, int(np.ceil(np.sqrt(ranges))))
    steps = [i / level for i in range(1, level)] or [0.5]
    behind = lambda edges: F.size(F.filter(F.array_distinct(edges), lambda e: e <= F.col("doc_id")))
    placed = lambda edges: F.when(F.col("doc_id").isNull() | edges.isNull(), 0).otherwise(behind(edges))
    coarse = docs.agg(F.percentile_approx("doc_id", steps, 10 * level)).first()[0]
    docs = docs.withColumn("coarse", placed(F.lit(coarse).cast("array<bigint>")))
    fine = docs.groupBy("coarse").agg(F.percentile_approx("doc_id", steps, 10 * level).alias("edges"))
    fine = F.broadcast(fine)  # at most a row a coarse range, together a number a range
    return docs.join(fine, "coarse").withColumn("fine", placed(F.col("edges"))).drop("edges")


def neighbours(docs: DataFrame) -> DataFrame:
    """(coarse, fine, guest, doc_id, text): documents by ranges of ids, each range followed by the first of the next one.

    A text moves once, the first of each range twice. Which document follows a range is found from the ranges' first
    ones: within a coarse range, and for its last one from the coarse ranges, which are few.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = docs.count()
    ranges = max(3 * partitions(spark), -(-n // RANGE_DOCS))
    docs = ranged(docs.withColumn("h", F.xxhash64("text")), ranges)
    firsts = docs.groupBy("coarse", "fine").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    heads = firsts.groupBy("coarse").agg(F.min("fine").alias("fine"), F.min_by("f", "fine").alias("f"), F.max("fine").alias("last"))
    # a row a coarse range; the first one follows the last one
    every = W.orderBy("coarse").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy("coarse")
    before = F.coalesce(F.lag(F.struct("coarse", "last")).over(order), F.last(F.struct("coarse", "last")).over(every))
    outer = heads.withColumn("b", before).select("coarse", "fine", F.col("b.coarse").alias("before_coarse"), F.col("b.last").alias("before_fine"), "f")
    inner = firsts.withColumn("p", F.lag("fine").over(W.partitionBy("coarse").orderBy("fine"))).where("p is not null").select("coarse", "fine", F.col("coarse").alias("before_coarse"), F.col("p").alias("before_fine"), "f")
    guests = outer.unionByName(inner).select(F.col("f.doc_id").alias("gid"), F.col("f.h").alias("gh"), F.struct(F.col("before_coarse").alias("coarse"), F.col("before_fine").alias("fine"), F.lit(1).alias("guest")).alias("place"))
    guests = F.broadcast(guests) if ranges <= BROADCAST_RANGES else guests
    tagged = docs.join(guests, docs.doc_id.eqNullSafe(F.col("gid")) & docs.h.eqNullSafe(F.col("gh")), "left")
    places = F.array_compact(F.array(F.struct("coarse", "fine", F.lit(0).alias("guest")), F.col("place")))
    placed = tagged.select(F.explode(places).alias("p"), "doc_id", "h", "text").select("p.coarse", "p.fine", "p.guest", "doc_id", "h", "text")
    dealt = placed.repartition(partitions(spark), "coarse", "fine")
    return dealt.sortWithinPartitions("coarse", "fine", "guest", F.col("doc_id").asc_nulls_first(), "h").drop("h")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs (doc_id, text); null texts count as empty, empty ones give ''."""
    small_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for b in batches:
            said = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([printed(chunk_set(d, 0, cuts(d))) for d in said], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edit_comparison(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edited text (the last quarter taken from the next one), and likenesses.

    Next is by ascending doc_id, null first, rows of one id by a hash of the text; the last is followed by the first.
    Null texts count as empty. A lone document follows itself. Other columns are ignored; an empty table stays empty. A
    very long text is one run of chunks in its task. Rows of one id, or without id, are one range, in one task.
    """
    small_batches(docs.sparkSession)
    return neighbours(docs).mapInArrow(compared, SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_comparison(table(spark, sf_dir, "documents"))
