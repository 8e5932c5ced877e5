"""Operator 3: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids part the vectors into lists; a vector's residual to its centroid is kept as codes of sub-vectors. A
query goes to the lists nearest to it. There, distances come from tables of the query's sub-vectors against all codes
(asymmetric distances), and the best are ranked again by the exact measure on the original vectors.

Lists grow with the square root of the vectors. Their centroids come in two levels: cells, fitted on a bounded sample, and
the lists of each cell, fitted in Spark on a share of the vectors, a group a cell. So a vector is compared with the cells
and with one cell's lists only. Codes and the number of lists to probe are fitted on the bounded sample; every vector is
indexed. A list, and a list's queries, are cut into blocks of bounded size, so no list need fit a task. A vector moves
once, with its codes, to its list's block, where the exact ranking needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, Scratch, partitions, small_batches, table

#: Vectors that cells, codes and probes are fitted on, at most; queries among them by which the probes are chosen.
FIT_ROWS, FIT_QUERIES, SEED = 16_384, 256, 11
#: Vectors a list that its cell's lists are fitted on, about.
FIT_LIST = 64
#: Sub-vectors, codes of each, rounds of k-means.
PARTS, CODES, ROUNDS = 16, 256, 8
#: Share of near neighbours that the probed lists must hold in the sample.
COVER = 0.97
#: Candidates and queries of a block; candidates that are ranked again, in a block.
BLOCK, QUERY_BLOCK, RERANK = 4096, 8192, 96
NEAREST, QUERY_STEP = 5, 50


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k rows of x; a centre without rows stays."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = nearest_rows(x, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, d], minlength=len(centres)) for d in range(x.shape[1])], 1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class Index:
    """What is fitted. centres: of all lists, those of a cell together, from start[cell] to start[cell + 1]; there are about
    as many as the square root of the vectors. The codebooks' size depends on the parameters alone."""

    cells: np.ndarray
    centres: np.ndarray
    start: np.ndarray
    codebooks: list[np.ndarray]
    probes: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest of its cell's."""
        cell = nearest_rows(x, self.cells)
        out = np.empty(len(x), np.int64)
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            out[own] = self.start[c] + nearest_rows(x[own], self.centres[self.start[c] : self.start[c + 1]])
        return out

    def ranking(self, x: np.ndarray) -> np.ndarray:
        """All lists for each row, nearest first."""
        far = (self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)
        return np.argsort(far, axis=1, kind="stable")

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The lists to probe for each row, nearest first."""
        return self.ranking(x)[:, : self.probes]

    def encoded(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        return np.stack([nearest_rows(part, book) for part, book in zip(np.array_split(rest, len(self.codebooks), axis=1), self.codebooks, strict=True)], 1).astype(np.uint8)

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded vectors of a list."""
        rest, out = queries - self.centres[which], 0
        for k, (part, book) in enumerate(zip(np.array_split(rest, len(self.codebooks), axis=1), self.codebooks, strict=True)):
            tables = (part * part).sum(1)[:, None] + (book * book).sum(1) - 2 * (part @ book.T)
            out = out + tables[:, codes[:, k]]
        return out


def list_centres(rows: DataFrame, n: int, cells: np.ndarray, lists: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of all lists and where each cell's begin: k-means in every cell, a group of bounded size each.

    About FIT_LIST vectors a list are taken, by a hash of the id: as many a cell on average as its lists need.
    """
    each = -(-lists // len(cells))
    share = min(1.0, FIT_LIST * lists / n)
    taken = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def placed(batches: Batches) -> Batches:
        for batch in batches:
            _, x = rows_of(batch, dims)
            u = unit(x) if len(x) else x
            cell = nearest_rows(u, cells) if len(u) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in u], pa.binary())], names=["cell", "u"])

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(group["u"])), np.float64).reshape(-1, dims)
        x = x[np.random.default_rng(SEED).permutation(len(x))[: 4 * FIT_LIST * each]]  # a cell far above the average
        return pd.DataFrame({"cell": group["cell"].iloc[0], "centres": [kmeans(x, min(each, len(x)), SEED).tobytes()]})

    found = {r.cell: np.frombuffer(r.centres, np.float64).reshape(-1, dims) for r in taken.mapInArrow(placed, "cell int, u binary").groupBy("cell").applyInPandas(fitted, "cell int, centres binary").collect()}
    own = [found.get(c, cells[c : c + 1]) for c in range(len(cells))]
    return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def fit_index(x: np.ndarray, rows: DataFrame, n: int) -> Index:
    """An index for n rows, whose cells, codes and probes come from a sample x of unit vectors."""
    lists = int(np.ceil(np.sqrt(n)))
    cells = kmeans(x, min(int(np.ceil(np.sqrt(lists))), len(x)), SEED)
    centres, start = list_centres(rows, n, cells, lists, x.shape[1])
    index = Index(cells, centres, start, [], len(centres))
    at = index.lists(x)
    rest = x - centres[at]
    parts = min(PARTS, x.shape[1])
    index.codebooks = [kmeans(np.ascontiguousarray(p), min(CODES, len(x)), SEED + k) for k, p in enumerate(np.array_split(rest, parts, axis=1))]
    # lists to probe: as many as hold COVER of the sample's own near neighbours
    q = x[:FIT_QUERIES]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    best = at[np.argsort(-near, axis=1)[:, : min(NEAREST, len(x) - 1)]]
    rank = np.argsort(index.ranking(q), axis=1)[np.arange(len(q))[:, None], best]
    index.probes = int(min(len(centres), np.quantile(rank, COVER, method="higher") + 1))
    return index


def usable(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, v array<double>) of rows that take part: with an id, finite components, and not all zero."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)


def rows_of(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and original vectors of a batch (id, v); those of another length are left out."""
    ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    ok = np.diff(v.offsets.to_numpy()) == dims
    flat = [np.array(x, np.float64) for x, y in zip(v.to_pylist(), ok, strict=True) if y]
    return ids[ok].astype(np.int64), np.stack(flat) if flat else np.zeros((0, dims))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, which keeps tiny and huge ones in range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


CELLS = "list int, kind int, id long, v binary, codes binary"
CELLS_ARROW = pa.schema([("list", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("v", pa.binary()), ("codes", pa.binary())])


def listed(index: Index, step: int) -> Callable[[Batches], Batches]:
    """Vectors to a row in their list (kind 0), and for queries (ids divisible by step) one in each probed list (kind 1)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, x = rows_of(batch, index.dims)
            if not len(ids):
                continue
            u = unit(x)
            at = index.lists(u)
            codes = index.encoded(u, at)
            raw = [r.tobytes() for r in x]
            rows = [(int(a), 0, int(i), v, c.tobytes()) for a, i, v, c in zip(at, ids, raw, codes, strict=True)]
            for k in np.flatnonzero(ids % step == 0):
                rows += [(int(a), 1, int(ids[k]), raw[k], None) for a in index.probed(u[k : k + 1])[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), CELLS_ARROW, strict=True)], schema=CELLS_ARROW)

    return run


FOUND = "query_id long, vec_id long, score double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def halved(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to components of at most 1: squares stay in range, and no digit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, in double precision; row by row, so that equal rows have equal results."""
    q, x = halved(q), halved(x)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def ranked(index: Index, nearest: int) -> Callable[[Batches], Batches]:
    """Rows sorted by (list, block, group, kind, id) to each query's best of a block: candidates first, then queries."""

    def answer(which: int, ids: list, vectors: list, codes: list, queries: list) -> list[tuple]:
        ids, first = np.unique(np.array(ids, np.int64), return_index=True)
        x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, index.dims)[first]
        c = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(index.codebooks))[first]
        q = np.stack([np.frombuffer(v, np.float64) for _, v in queries])
        far = index.distances(unit(q), which, c)
        rows = []
        for (query, _), own, d in zip(queries, q, far, strict=True):
            # of equal distances the smaller ids
            best = np.argsort(d, kind="stable")[: RERANK + 1]
            best = best[ids[best] != query]
            score = cosines(own, x[best])
            top = np.lexsort((ids[best], -score))[:nearest]
            rows += [(query, int(ids[best[k]]), float(score[k])) for k in top]
        return rows

    def run(batches: Batches) -> Batches:
        cell, ids, vectors, codes, queries = None, [], [], [], []

        def done():
            rows = answer(cell[0], ids, vectors, codes, queries) if ids and queries else []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), FOUND_ARROW, strict=True)], schema=FOUND_ARROW) if rows else None

        for batch in batches:
            for which, block, group, kind, i, v, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (which, block, group) != cell:
                    if (out := done()) is not None:
                        yield out
                    cell, ids, vectors, codes, queries = (which, block, group), [], [], [], []
                if kind == 0:
                    ids.append(i)
                    vectors.append(v)
                    codes.append(c)
                else:
                    queries.append((i, v))
                    if len(queries) == 256:
                        if (out := done()) is not None:
                            yield out
                        queries = []
        if (out := done()) is not None:
            yield out

    return run


def sample(rows: DataFrame) -> np.ndarray:
    """Unit vectors to fit on, chosen by a hash of the id."""
    return unit(np.array([r.v for r in rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(FIT_ROWS).collect()]))


#: Lengths of vectors that one table may have.
LENGTHS = 64
RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, id_col: str, column: str, step: int = QUERY_STEP, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, by cosine, ties to the smaller id.

    Queries are the ids divisible by step; a query's candidates are all other ids. Vectors that are null, zero, or with
    null or non-finite components take no part, nor do rows without id; of rows with one id the one with the least vector
    counts. Vectors of different lengths have no cosine: each length is searched on its own, and a table with more than
    LENGTHS of them is an error. Without two vectors of a length it has no results; so has an empty table. Columns beside
    the two named aren't looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    rows = usable(vectors, id_col, column)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    lengths = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).limit(LENGTHS + 1).collect()}
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} lengths")
    out = spark.createDataFrame([], RESULT)
    for k, (d, n) in enumerate((d, n) for d, n in sorted(lengths.items()) if n > 1):
        found = searched(rows.where(F.size("v") == d), n, step, nearest)
        out = out.unionByName(found) if k else found
    return out


def searched(rows: DataFrame, n: int, step: int, nearest: int) -> DataFrame:
    """The search among n rows (id, v), each id once, of one length."""
    spark = rows.sparkSession
    x = sample(rows)
    index = fit_index(x, rows, n)
    scratch, parts = Scratch(spark), partitions(spark)
    cells = scratch.write(rows.mapInArrow(listed(index, step), CELLS), "cells")
    counts = cells.groupBy("list").agg(F.count_if(F.col("kind") == 0).alias("rows"), F.count_if(F.col("kind") == 1).alias("queries"))
    counts = counts.select("list", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("groups")).where("blocks > 0 and groups > 0")
    sized = cells.join(F.broadcast(counts), "list")  # a row a list: about the square root of the vectors
    salt = F.xxhash64("id")
    blocks = F.when(F.col("kind") == 0, F.array(F.pmod(salt, F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    groups = F.when(F.col("kind") == 1, F.array(F.pmod(salt, F.col("groups")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("groups") - 1))
    dealt = sized.withColumn("block", F.explode(blocks)).withColumn("group", F.explode(groups)).select("list", "block", "group", "kind", "id", "v", "codes")
    found = dealt.repartition(parts, "list", "block", "group").sortWithinPartitions("list", "block", "group", "kind", "id").mapInArrow(ranked(index, nearest), FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
