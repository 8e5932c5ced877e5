"""A proximity graph over vectors, made by neighbour descent, and a best-first search along it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import read
from .retrieval import checkpointed, dot

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Edges of a node; random partitions to start from, vectors of one of their cells; descent rounds; seed of the planes.
EDGES, TREES, LEAF, DESCENTS, SEED = 20, 4, 256, 2, 3
#: Edges a node passes on in a descent round; candidates that a search keeps, expands at a time, and its most rounds.
PASSED, BEAM, WIDTH, ROUNDS = 10, 64, 8, 12


def unit(vector: Column) -> Column:
    """The vector at length one; null for none, a zero one, and one with entries that aren't finite."""
    v = vector.cast("array<double>")
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x / norm))


def planes(vectors: DataFrame) -> tuple[np.ndarray, int, int]:
    """Random planes (a row each) of all trees, the number of planes a tree, and the number of vectors. Planes are as many
    as the logarithm of the vectors asks for, so they are all that is sent to tasks."""
    n, d = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    return np.random.default_rng(SEED).standard_normal((TREES * depth, d)), depth, n


def with_cells(vectors: DataFrame, normals: np.ndarray, depth: int) -> DataFrame:
    """vectors (id, v) once a tree, with (tree, cell): the sides of the tree's planes that a vector lies on."""
    kind = vectors.schema["id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(n, -1)
            sides = (x @ normals.T > 0).reshape(n, TREES, depth) if depth else np.zeros((n, TREES, 0), bool)
            cells = (sides * (1 << np.arange(depth))).sum(axis=2).astype(np.int64)
            take = pa.array(np.repeat(np.arange(n), TREES))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(cells.ravel())], ["id", "v", "tree", "cell"])

    return vectors.select("id", "v").mapInArrow(coded, f"id {kind}, v array<double>, tree int, cell long")


def best_of_groups(rows: DataFrame, group: list[str], best: Callable[[np.ndarray, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """(id, other, sim) that best gives for the ids and vectors of each group; groups are bounded, and streamed one by one."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                a, b, s = best(np.array(ids), np.array(vectors))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float64())], ["id", "other", "sim"])

        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True))
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, (key, i) in enumerate(zip(keys, batch.column("id").to_pylist(), strict=True)):
                if key != at:
                    yield from flush()
                    at, ids, vectors = key, [], []
                ids.append(i)
                vectors.append(v[k])
        yield from flush()

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, f"id {kind}, other {kind}, sim double")


def nearest_of(k: int) -> Callable:
    """The k nearest others of each of a group's vectors."""

    def best(ids: np.ndarray, v: np.ndarray) -> tuple:
        sims = v @ v.T
        np.fill_diagonal(sims, -2)
        m = min(k, len(ids) - 1)
        top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        return np.repeat(ids, m), ids[top.ravel()], np.take_along_axis(sims, top, 1).ravel()

    return best


def kept_edges(pairs: DataFrame, k: int) -> DataFrame:
    """The k best distinct (id, other, sim) an id; of equal ones the smaller id."""
    pairs = pairs.where("id <> other").groupBy("id", "other").agg(F.max("sim").alias("sim"))
    return pairs.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k).drop("r")


def neighbour_graph(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, other, sim), at most EDGES an id, by cosine; and (tree, cell, id), where searches may start.

    Vectors (id, v), v of length one, are cut into cells by random planes, TREES times; cells over LEAF are dealt to
    several by a hash. Inside cells all pairs are compared, which is bounded. Then, DESCENTS times, each node brings its
    neighbours, and those it is among the best of, together: at most twice EDGES, which are compared with one another.
    So work grows with the vectors, never with their square.
    """
    normals, depth, _ = planes(vectors)
    placed = with_cells(vectors, normals, depth)
    sizes = placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("parts"))
    dealt = placed.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))
    edges = checkpointed(kept_edges(best_of_groups(dealt.select("id", "v", "tree", "cell", "part"), ["tree", "cell", "part"], nearest_of(EDGES)), EDGES))
    for _ in range(DESCENTS):
        back = edges.withColumn("r", F.row_number().over(W.partitionBy("other").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= EDGES)
        members = edges.select(F.col("id").alias("hub"), F.col("other").alias("id")).union(back.select(F.col("other").alias("hub"), "id")).distinct()
        found = best_of_groups(members.join(vectors.select("id", "v"), "id"), ["hub"], nearest_of(PASSED))
        edges = checkpointed(kept_edges(edges.union(found), EDGES))
    starts = placed.withColumn("r", F.row_number().over(W.partitionBy("tree", "cell").orderBy(F.xxhash64("id")))).where(F.col("r") <= WIDTH).select("tree", "cell", "id")
    return edges, starts


def searched(graph: DataFrame, starts: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, sim): the k nearest found of each query (query_id, v) along the graph.

    Starts in the query's own cells. In a round each query expands the WIDTH best of its candidates that it hasn't expanded
    yet; the BEAM best stay. It ends when no query has any left, or after ROUNDS.
    """
    normals, depth, _ = planes(vectors)
    asked = queries.select("query_id", F.col("v").alias("q"))
    entry = with_cells(queries.select(F.col("query_id").alias("id"), "v"), normals, depth).select(F.col("id").alias("query_id"), "tree", "cell").join(starts, ["tree", "cell"]).select("query_id", "id").distinct()

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors.select("id", "v"), "id").join(asked, "query_id").select("query_id", "id", dot(F.col("v"), F.col("q")).alias("sim"))

    best = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    beam = checkpointed(measured(entry).withColumn("open", F.lit(True)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEAM))
    for _ in range(ROUNDS):
        ranked = beam.withColumn("o", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("open"), "r")))
        now = (F.col("o") <= WIDTH) & F.col("open")
        front = ranked.where(now)
        if front.isEmpty():
            break
        seen = ranked.select("query_id", "id", "sim", (F.col("open") & ~now).alias("open"))
        new = front.select("query_id", F.col("id").alias("from")).join(graph.select(F.col("id").alias("from"), F.col("other").alias("id")), "from").select("query_id", "id").distinct()
        new = measured(new.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")).withColumn("open", F.lit(True))
        beam = checkpointed(seen.unionByName(new).withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEAM))
    return beam.where(F.col("r") <= k).select("query_id", F.col("r").alias("rank"), "id", "sim")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v) of the embeddings that have a direction, those of the most common length."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("v")).where("id is not null and v is not null")
    common = e.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").select("d").limit(1)
    return e.join(F.broadcast(common), F.size("v") == F.col("d")).drop("d").dropDuplicates(["id"])


def vector_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding (itself among them), found along the proximity graph of all."""
    vectors = checkpointed(unit_vectors(spark, sf_dir))
    graph, starts = neighbour_graph(vectors)
    found = searched(graph, starts, vectors, vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"))


QUERIES["vector_graph_search"] = vector_graph_search
