"""Names inside texts: many patterns at once, by automata over shards of the patterns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Bytes of patterns in one automaton, which takes some thirty times as much memory.
SHARD_BYTES = 4 << 20


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pattern, hits) from cells' patterns (kind 0) followed by their texts (kind 1)."""
    cell, automaton, built = None, None, False
    for batch in batches:
        keys, found, hits = [], [], []
        for c, kind, key, value in zip(*(batch.column(n).to_pylist() for n in ("cell", "kind", "key", "value")), strict=True):
            if c != cell:
                cell, automaton, built = c, ahocorasick.Automaton(), False
            if kind == 0:
                automaton.add_word(value, value)
                continue
            if not built:
                automaton.make_automaton()
                built = True
            if len(automaton):
                for pattern, n in Counter(p for _, p in automaton.iter(value)).items():
                    keys.append(key)
                    found.append(pattern)
                    hits.append(n)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(found, pa.string()), pa.array(hits, pa.int64())], ["key", "pattern", "hits"])


def held_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, pattern, hits): how often each text (key, text) holds each pattern (pattern), overlapping and nested ones too.

    Patterns are dealt to shards of SHARD_BYTES, texts to blocks; a shard meets a block in one cell, where its automaton is
    built once and the block's texts are streamed through it. So no side is broadcast, and a task holds one shard. Texts
    are copied once a shard, patterns once a block. Empty and null patterns are held by nothing; a null text holds nothing.
    """
    spark = texts.sparkSession
    patterns = patterns.select("pattern").where("pattern <> ''").distinct()
    size = patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    shard = lambda: F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    block = lambda: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind = texts.schema["key"].dataType
    left = patterns.select(F.pmod(F.xxhash64("pattern"), F.lit(shards)).cast("int").alias("s"), block().alias("b"), "pattern")
    left = left.select((F.col("s") * blocks + F.col("b")).alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), F.col("pattern").alias("value"))
    right = texts.where("text is not null").select(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int").alias("b"), shard().alias("s"), "key", "text")
    right = right.select((F.col("s") * blocks + F.col("b")).alias("cell"), F.lit(1).alias("kind"), "key", F.col("text").alias("value"))
    dealt = left.union(right).repartition("cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(searched, f"key {kind.simpleString()}, pattern string, hits long")


def looked_up(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages (page_key, file, page) with the entry (id, name, page) they stand for, as (page_key, id, how).

    exact: the entry of this file and page; else the first entry (least id) of the same page whose name the file holds
    (contained), or whose name holds the file (containing); else none. Names and files are compared as they are.
    """
    exact = pages.join(entries.select(F.col("name").alias("file"), "page", F.col("id").alias("exact")), ["file", "page"], "left")
    left = exact.where("exact is null").select("page_key", "file", "page")
    files, names = left.select(F.col("file").alias("v")).distinct(), entries.select(F.col("name").alias("v")).distinct()
    both = lambda df: df.select(F.col("v").alias("key"), F.col("v").alias("text"))
    down = held_patterns(both(files), names.select(F.col("v").alias("pattern"))).select(F.col("key").alias("file"), F.col("pattern").alias("name"), F.lit(1).alias("way"))
    up = held_patterns(both(names), files.select(F.col("v").alias("pattern"))).select(F.col("pattern").alias("file"), F.col("key").alias("name"), F.lit(2).alias("way"))
    found = left.join(down.union(up), "file").join(entries, ["name", "page"]).groupBy("page_key").agg(F.min(F.struct("id", "way")).alias("m"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("m.way") == 1, "contained").when(F.col("m.way") == 2, "containing").otherwise("none")
    return exact.join(found, "page_key", "left").select("page_key", F.coalesce("exact", "m.id").alias("id"), how.alias("how"))


_FILE = "case p_partkey % 3 when 0 then p_name when 1 then substring(p_name, 2, length(p_name) - 3) else p_brand || ' ' || p_name || ' ' || p_type end"


@query(f"""with e as (select p_name as name, p_size as page, min(p_partkey) id from part group by all), f as (select p_partkey, {_FILE} as file, (p_partkey * 7) % 50 + 1 as page from part),
x as (select f.*, e.id exact from f left join e on e.name = f.file and e.page = f.page),
c as (select x.p_partkey, min(case when contains(x.file, e.name) then e.id * 4 + 1 else e.id * 4 + 2 end) m from x join e on e.page = x.page and (contains(x.file, e.name) or contains(e.name, x.file)) where x.exact is null group by 1)
select x.p_partkey as page_key, coalesce(x.exact, m // 4) id, case when x.exact is not null then 'exact' when m % 4 = 1 then 'contained' when m % 4 = 2 then 'containing' else 'none' end how from x left join c using (p_partkey)""")
def historical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under whole, cut and longer file names, and the historical entry each stands for."""
    p = read(spark, sf_dir, "part")
    entries = p.groupBy(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("page")).agg(F.min("p_partkey").alias("id"))
    return looked_up(p.select(F.col("p_partkey").alias("page_key"), F.expr(_FILE).alias("file"), (F.col("p_partkey") * 7 % 50 + 1).alias("page")), entries)


@query("""with s as (select distinct unnest(string_split(text, '. ')) sentence from benchmark), t as (select * from s where length(sentence) >= 20)
select sentence, count(d.doc_id) documents, min(d.doc_id) first_document from t left join documents d on contains(d.text, t.sentence) group by all""")
def passages_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the benchmark, and in how many documents each stands, word for word."""
    sentences = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\. ")).alias("pattern")).where("length(pattern) >= 20").distinct()
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    found = held_patterns(docs, sentences).groupBy("pattern").agg(F.count("key").alias("documents"), F.min("key").alias("first_document"))
    return sentences.join(found, "pattern", "left").select(F.col("pattern").alias("sentence"), F.coalesce("documents", F.lit(0)).alias("documents"), "first_document")
