"""Operator 5: shards by extendible hashing (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bits of the key's hash that a directory may use.
MAX_DEPTH = 48
#: Prefix bits by which the directory deepens in one round.
STEP = 12
#: Byte limit of a shard in the registered query.
LIMIT = 1_000_000


def key_bits(key: Column) -> Column:
    """The first MAX_DEPTH bits of md5 of the key's text, as 0/1 characters; a null key counts as empty."""
    hexes = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, MAX_DEPTH // 4)
    return F.lpad(F.conv(hexes, 16, 2), MAX_DEPTH, "0")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets (prefix, depth, shard_bytes, shard_rows) of rows (bits, n_bytes).

    Starts from one bucket of depth 0. An oversized bucket splits on its next bit, others stay. Rounds of STEP
    bits: byte sums a prefix of the round's depth come from one grouping with map-side sums, all shallower ones
    from that small table; rows go to another round only below prefixes that are still oversized. A bucket
    whose rows share all MAX_DEPTH bits (one key) can't split and stays, however large.
    """
    done, left, depth = None, rows, 0
    while True:
        top = min(depth + STEP, MAX_DEPTH)
        cells = left.groupBy(F.substring("bits", 1, top).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        # every depth of the round from the cells; at most STEP + 1 rows a cell
        levels = F.sequence(F.lit(depth), F.lit(top))
        sums = (
            cells.select(F.explode(levels).alias("depth"), "cell", "b", "n")
            .groupBy("depth", F.substring("cell", F.lit(1), F.col("depth")).alias("prefix"))
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
            .withColumn("over", F.col("shard_bytes") > limit)
        )
        parents = sums.select(F.col("depth").alias("pd"), F.col("prefix").alias("pp"), F.col("over").alias("parent_over"))
        # a bucket exists if its parent was oversized; it stays if it fits or if no bit is left
        final = (
            sums.join(parents, (F.col("depth") - 1 == F.col("pd")) & (F.substring("prefix", F.lit(1), F.col("depth") - 1) == F.col("pp")), "left")
            .where(F.when(F.col("depth") == depth, F.lit(depth == 0)).otherwise(F.col("parent_over")))
            .where(~F.col("over") | (F.col("depth") == MAX_DEPTH))
            .select("prefix", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")
        )
        done = final if done is None else done.unionByName(final)
        if top == MAX_DEPTH:
            return done
        open_cells = cells.where(F.col("b") > limit).select("cell")
        if open_cells.isEmpty():
            return done
        left = left.join(open_cells, F.substring("bits", 1, top) == F.col("cell"), "left_semi")
        depth = top


def assign(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (__bits, ...) with the bucket whose prefix starts their bits, as __depth, __prefix, ...: one equi-join on the
    prefixes a row may have.

    Depths in use are few, so each row is looked up once a depth in use, by (depth, prefix).
    """
    buckets = buckets.select(*(F.col(c).alias(f"__{c}") for c in buckets.columns))
    depths = buckets.agg(F.sort_array(F.collect_set("__depth")).alias("__depths"))
    tagged = rows.crossJoin(F.broadcast(depths))  # one row of at most MAX_DEPTH + 1 numbers
    tagged = tagged.withColumn("__depth", F.explode("__depths")).withColumn("__prefix", F.substring(F.col("__bits"), F.lit(1), F.col("__depth")))
    return tagged.drop("__depths").join(buckets, ["__depth", "__prefix"])


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Each row of df with (n_bytes, shard, depth, shard_bytes): its bucket in the extendible-hash directory.

    Null sizes count as 0. Repeated rows share a bucket, as equal keys do. An empty table has no buckets.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = df.select(F.col(key).alias("key"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes")).withColumn("bits", key_bits(F.col("key")))
    buckets = directory(rows, limit)
    placed = assign(rows.withColumnRenamed("bits", "__bits"), buckets)
    return placed.select(F.col("key").alias(key), "n_bytes", F.concat(F.lit("s"), "__prefix").alias("shard"), F.col("__depth").alias("depth"), F.col("__shard_bytes").alias("shard_bytes"))


def write_shards(df: DataFrame, key: str, size: Column, limit: int, path: str, name: str = "shard") -> None:
    """Writes df with all its columns as Parquet, one folder a shard, which the column of that name tells; equal rows go to
    equal shards. df must not have such a column."""
    if name in df.columns:
        raise ValueError(f"the table has a column {name}; give the shards another name")
    rows = df.withColumn("__bits", key_bits(F.col(key)))
    sized = rows.select(F.col("__bits").alias("bits"), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"))
    out = assign(rows, directory(sized, limit).select("depth", "prefix"))
    out = out.select(*(F.col(f"`{c}`") for c in df.columns), F.concat(F.lit("s"), "__prefix").alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible_shards(docs, "doc_id", F.octet_length("text"), LIMIT)


SQL = {
    "op5_sharding": f"""
with recursive k as (
  select doc_id, coalesce(strlen("text"), 0)::bigint n_bytes,
         substring(md5(coalesce(doc_id::varchar, '')), 1, {MAX_DEPTH // 4}) h from documents),
rows as (
  select doc_id, n_bytes, lpad(bin(('0x' || h)::ubigint::bigint), {MAX_DEPTH}, '0') bits from k),
tree(depth, prefix, b) as (
  select 0, ''::varchar, sum(n_bytes)::bigint from rows
  union all
  select t.depth + 1, substring(r.bits, 1, t.depth + 1), (sum(r.n_bytes) over (partition by substring(r.bits, 1, t.depth + 1)))::bigint
  from (select distinct depth, prefix, b from tree) t join rows r on substring(r.bits, 1, t.depth) = t.prefix
  where t.b > {LIMIT} and t.depth < {MAX_DEPTH}),
leaves as (select distinct depth, prefix, b from tree where b <= {LIMIT} or depth = {MAX_DEPTH})
select r.doc_id, r.n_bytes, 's' || l.prefix as shard, l.depth::int as depth, l.b as shard_bytes
from rows r join leaves l on substring(r.bits, 1, l.depth) = l.prefix
"""
}
