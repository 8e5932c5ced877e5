"""Sinks: keyed upserts, exports in text formats, artifact bundles with checksum manifests, snapshots, resumable work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], added: list[str] | None = None) -> DataFrame:
    """table with rows put in by key; new columns of rows are null in older ones. Numbers in added are added up instead
    (nulls as 0). rows has a key once: of repeated keys one row would have to win, so they are told apart first."""
    if not added:
        return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, *added)]
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    kept = [F.max_by(c, "__new").alias(c) for c in [*rest, *(c for c in table.columns if c not in (*keys, *added, *rest))]]
    return both.groupBy(*keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in added), *kept)


def by_metadata(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose JSON metadata has the value under the key."""
    return docs.where(F.get_json_object("metadata", f"$.{key}") == value)


def without_keys(payload: F.Column, denied: list[str]) -> F.Column:
    """A map without denied keys."""
    return F.map_filter(payload, lambda k, v: ~F.lower(k).isin([d.lower() for d in denied]))


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables as Parquet below path and the manifest of their files' checksums; gives the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.option("compression", "snappy").parquet(f"{path}/{name}")
    manifest = checksums(spark, [f"{path}/{name}" for name in tables])
    manifest.write.json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def checksums(spark: SparkSession, folders: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folders)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def damaged(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Files of a bundle that are missing, new or other than their manifest says."""
    told = spark.read.json(f"{path}/manifest").select("file", F.col("sha256").alias("told"))
    found = checksums(spark, [f"{path}/{n}" for n in names]).select("file", F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "new").otherwise("changed")
    return told.join(found, "file", "full_outer").where(~F.col("told").eqNullSafe(F.col("found"))).select("file", state.alias("state"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """CSV with header, JSON lines, text (one string column), XML or ORC."""
    writers = {
        "csv": lambda w: w.option("header", True).csv(path),
        "json": lambda w: w.json(path),
        "text": lambda w: w.text(path),
        "xml": lambda w: w.format("xml").option("rowTag", "row").save(path),
        "orc": lambda w: w.orc(path),
    }
    writers[kind](df.write)


def unfinished(units: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work without a checkpoint yet."""
    return units.join(finished, keys, "left_anti")


def work_queue(variants: DataFrame, chapters: int) -> DataFrame:
    """Every chapter of every variant as a unit to do."""
    return variants.withColumn("chapter", F.explode(F.sequence(F.lit(1), F.lit(chapters)))).withColumn("status", F.lit("open"))


def readable(queue: DataFrame, now: DataFrame, hidden: str) -> DataFrame:
    """Messages (read_at, ...) that no reader holds at a time (one row, now_): never read, or read so long ago."""
    free = F.col("read_at").isNull() | (F.col("read_at") + F.expr(f"interval {hidden}") <= F.col("now_"))
    return queue.crossJoin(F.broadcast(now)).where(free).drop("now_")


def appended(df: DataFrame, path: str) -> None:
    """Rows appended to a log of JSON lines."""
    df.write.mode("append").json(path)


def last_entries(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The n latest entries (ts, ...) of a log of JSON lines."""
    return newest(spark.read.schema(schema).json(path), n)


def markdown(df: DataFrame) -> DataFrame:
    """(line): rows as lines of a Markdown table, without the two lines of its head."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def published(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each world; a rollback is a new snapshot with an older content."""
    return snapshots.groupBy("world").agg(F.max_by(F.struct("version", "content"), "created_at").alias("s")).select("world", "s.version", "s.content")


def newest(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("ts")).limit(n)
