"""Retrieval, vectors and graphs: cosine search, similarity edges, caches, evidence cascade, traversal, curricula."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rows of a block when all pairs of vectors are compared.
BLOCK = 2048


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.greatest(n, F.lit(1e-300)))


def nearest(vectors: DataFrame, asked: DataFrame, k: int, least: float, labels: list[int] | None = None) -> DataFrame:
    """The k rows nearest to one asked vector, of the given labels (None: of all), with at least that similarity."""
    rows = vectors.where(F.col("embedding").isNotNull())
    if labels is not None:
        rows = rows.where(F.col("label").isin(labels))
    q = asked.limit(1).select(F.col("embedding").alias("q"))  # one row
    s = rows.crossJoin(F.broadcast(q)).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("q")), 4))
    return s.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "vec_id").limit(k).select("vec_id", "similarity")


_COS = "round(list_cosine_similarity({a}::double[], {b}::double[]), 4)"


@query(f"""with s as (select e.vec_id, {_COS.format(a="e.embedding", b="q.embedding")} similarity from embeddings e, (select embedding from embeddings where vec_id = 7) q where e.label in (1, 2, 3) and e.embedding is not null)
select * from s where similarity >= 0.05 order by similarity desc, vec_id limit 20""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id = 7"), 20, 0.05, [1, 2, 3])


@query(f"""with s as (select e.vec_id, {_COS.format(a="e.embedding", b="q.embedding")} similarity, e.label from embeddings e, (select embedding, label from embeddings where vec_id = 7) q where e.vec_id <> 7 and e.label = q.label)
select max_by(vec_id, (similarity, -vec_id)) hit, max(similarity) similarity, max(similarity) >= 0.88 usable from s""")
def semantic_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar stored entry of the same theme, and whether it is near enough to serve."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"), F.col("label").alias("theme"))
    s = e.where("vec_id <> 7").join(F.broadcast(q), F.col("label") == F.col("theme")).withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("q")), 4))
    return s.agg(F.max_by("vec_id", F.struct("similarity", -F.col("vec_id"))).alias("hit"), F.max("similarity").alias("similarity"), (F.max("similarity") >= 0.88).alias("usable"))


def similarity_edges(vectors: DataFrame, least: float) -> DataFrame:
    """(src, dst, weight) with src < dst of every pair whose cosine reaches least.

    Exact, so all pairs are compared, as products of blocks of at most about BLOCK rows; only edges leave a task.
    """
    rows = vectors.where("embedding is not null and vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // BLOCK))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    # a pair of blocks is named by its smaller and its larger number
    pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def product(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        x = np.stack(part["v"].to_numpy()) if len(part) else np.zeros((0, 1))
        norm = np.sqrt((x * x).sum(1))
        raw, norm = x, np.where(norm == 0, 1, norm)
        x = x / norm[:, None]
        ids, side = part["vec_id"].to_numpy(), part["own"].to_numpy()
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found = np.argwhere(x[a] @ x[b].T >= least - 1e-4)  # weights are rounded below
        s, d = a[found[:, 0]], b[found[:, 1]]
        ok = (ids[s] < ids[d]) if i == j else np.ones(len(s), bool)
        s, d = s[ok], d[ok]
        weight = np.round((raw[s] * raw[d]).sum(1) / (norm[s] * norm[d]), 4)
        keep = weight >= least
        lo, hi = np.minimum(ids[s], ids[d])[keep], np.maximum(ids[s], ids[d])[keep]
        return pd.DataFrame({"src": lo, "dst": hi, "weight": weight[keep]})

    return pairs.select("i", "j", "own", "vec_id", "v").groupBy("i", "j").applyInPandas(product, "src long, dst long, weight double")


_EDGES = f"""ed as (select a.vec_id src, b.vec_id dst, {_COS.format(a="a.embedding", b="b.embedding")} weight from embeddings a join embeddings b on a.vec_id < b.vec_id),
edges as (select * from ed where weight >= 0.3)"""


@query(f"with {_EDGES} select src, dst, weight from edges")
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_edges(read(spark, sf_dir, "embeddings"), 0.3)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder of spark.checkpoint.dir; a folder of our own only if that is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def bfs(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop) reached from start (node) within so many hops over undirected edges (src, dst)."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        seen = checkpointed(seen.unionByName(front.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))))
    return seen


@query(f"""with recursive {_EDGES}, b as (select src u, dst v from edges union all select dst, src from edges),
r(node, hop) as (select 7::bigint, 0 union select b.v, r.hop + 1 from r join b on b.u = r.node where r.hop < 2) select node, min(hop)::int hop from r group by node""")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return bfs(checkpointed(similarity_edges(e, 0.3)), e.where("vec_id = 7").select(F.col("vec_id").alias("node")), 2)


@query(f"""with {_EDGES}, n as (select vec_id from embeddings where label = 3) select src, dst, weight from edges where src in (from n) and dst in (from n)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends among the nodes of one label."""
    e = read(spark, sf_dir, "embeddings")
    return similarity_edges(e.where("label = 3"), 0.3)  # only its nodes are compared


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way from a node without prerequisites (edges before -> node); cyclic nodes have none.

    A round settles the nodes whose prerequisites are all settled (Kahn), until a round settles nothing.
    """
    need = edges.groupBy("node").agg(F.count("*").alias("need"))
    settled = checkpointed(nodes.join(need, "node", "left_anti").select("node", F.lit(0).alias("level")))
    level, before, now = 0, 0, settled.count()
    while now > before:
        level, before = level + 1, now
        met = edges.join(settled.select(F.col("node").alias("before")), "before").groupBy("node").agg(F.count("*").alias("met"))
        fresh = met.join(need, "node").where("met = need").select("node").join(settled, "node", "left_anti").select("node", F.lit(level).alias("level"))
        settled = checkpointed(settled.unionByName(fresh))
        now = settled.count()
    return settled


_COURSES = """n as (select p_partkey + 1 node, p_size / 50.0 mastery from part), e as (select node // 2 before, node from n where node > 1 union select node // 3, node from n where node >= 3)"""


def courses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node, mastery) and edges (before, node): items numbered from 1, each needing the ones of its half and its third."""
    n = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("node"), (F.col("p_size") / 50.0).alias("mastery"))
    half = n.where("node > 1").select(F.expr("node div 2").alias("before"), "node")
    third = n.where("node >= 3").select(F.expr("node div 3").alias("before"), "node")
    return n, half.union(third).distinct()


@query(f"""with recursive {_COURSES}, r(node, level) as (select 1::bigint, 0 union select e.node, r.level + 1 from r join e on e.before = r.node) select node, max(level)::int level from r group by node""")
def curriculum_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses with levels in order of prerequisites."""
    n, e = courses(spark, sf_dir)
    return topological_levels(n.select("node").distinct(), e)


@query(f"""with {_COURSES} select n.node, coalesce(bool_and(m.mastery >= 0.4), true) unlocked from n left join e on e.node = n.node left join n m on m.node = e.before group by n.node""")
def prerequisite_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses whose prerequisites are all mastered well enough."""
    n, e = courses(spark, sf_dir)
    m = n.select(F.col("node").alias("before"), "mastery")
    return n.select("node").join(e, "node", "left").join(m, "before", "left").groupBy("node").agg(F.coalesce(F.bool_and(F.col("mastery") >= 0.4), F.lit(True)).alias("unlocked"))


def ancestry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, path): the way to the root over each node's first parent (the least before); none for nodes that lead into a cycle.

    A round doubles how far each node has come, by joining it with the way of where it stands; so rounds grow with the
    logarithm of the depth. A cycle comes back to where it was, which a round without progress tells.
    """
    parent = edges.groupBy("node").agg(F.min("before").alias("parent"))
    way = nodes.select("node").distinct().join(parent, "node", "left")
    # path: from the node up to, not with, top; top is null behind the root
    way = checkpointed(way.select("node", F.array("node").alias("path"), F.col("parent").alias("top")))
    left, before = way.where("top is not null").count(), -1
    while left and left != before:
        further = way.select(F.col("node").alias("top"), F.col("path").alias("more"), F.col("top").alias("next"))
        joined = way.join(further, "top", "left")
        way = checkpointed(joined.select("node", F.when(F.col("top").isNull(), F.col("path")).otherwise(F.concat("path", F.coalesce("more", F.array("top")))).alias("path"), F.when(F.col("top").isNotNull(), F.col("next")).alias("top")))
        before, left = left, way.where("top is not null").count()
    return way.where("top is null").select("node", "path")


@query(f"""with recursive {_COURSES}, p as (select node, min(before) parent from e group by node), r(node, up, depth) as (select node, node, 0 from n union all select r.node, p.parent, depth + 1 from r join p on p.node = r.up)
select node, string_agg(up::varchar, '>' order by depth) path from r group by node""")
def ancestry_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to the root over each course's first prerequisite."""
    n, e = courses(spark, sf_dir)
    return ancestry(n, e).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def subgraph(vectors: DataFrame, asked: DataFrame, seeds: int, least: float, edge: float) -> DataFrame:
    """(node, seed): the nearest so many nodes to one asked vector, of at least that similarity, and their neighbours.

    Only seeds, a bounded number, are compared with all nodes.
    """
    near = nearest(vectors, asked, seeds, least).select(F.col("vec_id").alias("s"))
    rows = vectors.where("embedding is not null").select("vec_id", "embedding")
    own = F.broadcast(rows.join(near, F.col("vec_id") == F.col("s"), "left_semi").select(F.col("vec_id").alias("s"), F.col("embedding").alias("q")))
    around = rows.crossJoin(own).where((F.col("vec_id") != F.col("s")) & (F.round(cosine(F.col("embedding"), F.col("q")), 4) >= edge)).select(F.col("vec_id").alias("node"), F.lit(False).alias("seed"))
    return near.select(F.col("s").alias("node"), F.lit(True).alias("seed")).union(around).groupBy("node").agg(F.bool_or("seed").alias("seed"))


@query(f"""with s as (select vec_id from (select e.vec_id, {_COS.format(a="e.embedding", b="q.embedding")} c from embeddings e, (select embedding from embeddings where vec_id = 11) q where e.embedding is not null) where c >= 0.1 order by c desc, vec_id limit 5),
a as (select e.vec_id node, false seed from embeddings e join embeddings x on x.vec_id <> e.vec_id and x.vec_id in (from s) where {_COS.format(a="e.embedding", b="x.embedding")} >= 0.3 union all select vec_id, true from s) select node, bool_or(seed) seed from a group by node""")
def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entry points of a question in the similarity graph, and all that is linked with them."""
    e = read(spark, sf_dir, "embeddings")
    return subgraph(e, e.where("vec_id = 11"), 5, 0.1, 0.3)


class Reading:
    """Regions of one page that wait to be read: open ones in a heap by place, others with the number they wait for."""

    def __init__(self, places: dict):
        self.places, self.waiting, self.unlocks, self.heap = places, dict.fromkeys(places, 0), {}, []

    def require(self, region, before) -> None:
        if before in self.places and before != region and region not in self.unlocks.setdefault(before, set()):
            self.unlocks[before].add(region)
            self.waiting[region] += 1

    def opened(self, region) -> None:
        heapq.heappush(self.heap, (self.places[region], region))

    def __iter__(self):
        for region, n in self.waiting.items():
            if not n:
                self.opened(region)
        read = set()
        while self.heap:
            region = heapq.heappop(self.heap)[1]
            read.add(region)
            yield region
            for other in self.unlocks.get(region, ()):
                self.waiting[other] -= 1
                if not self.waiting[other]:
                    self.opened(other)
        yield from sorted(self.places.keys() - read, key=lambda region: (self.places[region], region))


def in_order(regions: list[tuple]) -> list:
    """Regions (region, x1, y1, before: regions read earlier) of a page in reading order: always the topmost of those whose
    prerequisites have been read, of equally high ones the leftmost; what cycles hold up comes last, by place."""
    reading = Reading({region: (y, x) for region, x, y, _ in regions})
    for region, _, _, before in regions:
        for b in before if before is not None else ():
            reading.require(region, b)
    return list(reading)


def reading_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page, region, x1, y1, before) sorted by page to (page, region, position); one page is held at a time."""

    def of(page, regions: list[tuple]) -> list[tuple]:
        return [(page, region, k) for k, region in enumerate(in_order(regions), 1)]

    page, held = None, []
    for batch in batches:
        out = []
        for own, *region in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != page and held:
                out += of(page, held)
                held = []
            page = own
            held.append(tuple(region))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), POSITIONS, strict=True)], schema=POSITIONS)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*of(page, held), strict=True), POSITIONS, strict=True)], schema=POSITIONS)


POSITIONS = pa.schema([("page", pa.int64()), ("region", pa.int64()), ("position", pa.int32())])


def read_in_order(regions: DataFrame) -> DataFrame:
    """(page, region, position) of regions (page, region, x1, y1, before); a page must fit a task, pages without id are one."""
    sorted_ = regions.select("page", "region", "x1", "y1", "before").repartition("page").sortWithinPartitions("page")
    return sorted_.mapInArrow(reading_order, "page long, region long, position int")


@query("""with b as (select l_partkey page, l_orderkey * 10 + l_linenumber region, l_suppkey x1, l_quantity y1 from lineitem), d as (select page, region, min(x1) x1, min(y1) y1 from b group by all)
select page, region, (row_number() over (partition by page order by y1, x1, region))::int as position from d""")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each page without prerequisites: by place."""
    b = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region"), F.col("l_suppkey").alias("x1"), F.col("l_quantity").alias("y1"))
    d = b.groupBy("page", "region").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    return d.select("page", "region", F.row_number().over(W.partitionBy("page").orderBy("y1", "x1", "region")).alias("position"))


def precedence(boxes: DataFrame) -> DataFrame:
    """boxes (page, region, x1, y1, x2, y2) with before: the regions above that share columns with it, and those left of it
    that share lines with it.

    Regions of a page meet by the strips they cross, STRIPS a page and direction, so only regions of one strip are compared.
    """
    ends = boxes.groupBy("page").agg(F.min("x1").alias("px"), F.min("y1").alias("py"), F.max("x2").alias("qx"), F.max("y2").alias("qy"))
    b = boxes.join(ends, "page")

    def strips(low: str, high: str, start: str, end: str) -> Column:
        at = lambda v: F.floor((F.col(v) - F.col(start)) / F.greatest(F.col(end) - F.col(start), F.lit(1e-9)) * STRIPS)
        return F.sequence(at(low), at(high))

    def pairs(along: str, across: str) -> DataFrame:
        own = [F.col(c) for c in ("page", "region")]
        one = b.select(*own, F.col(f"{across}1").alias("lo"), F.col(f"{across}2").alias("hi"), F.col(f"{along}1").alias("start"), F.explode(strips(f"{across}1", f"{across}2", f"p{across}", f"q{across}")).alias("strip"))
        other = b.select("page", F.col("region").alias("first"), F.col(f"{across}1").alias("lo_"), F.col(f"{across}2").alias("hi_"), F.col(f"{along}2").alias("end_"), F.explode(strips(f"{across}1", f"{across}2", f"p{across}", f"q{across}")).alias("strip"))
        return one.join(other, ["page", "strip"]).where("region <> first and end_ <= start and lo < hi_ and lo_ < hi").select("page", "region", "first").distinct()

    edges = pairs("y", "x").union(pairs("x", "y")).groupBy("page", "region").agg(F.array_sort(F.collect_set("first")).alias("before"))
    return boxes.join(edges, ["page", "region"], "left").withColumn("before", F.coalesce("before", F.array().cast("array<long>")))


#: Strips that a page is cut into to find regions side by side.
STRIPS = 16


@query(None)
def layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each order's page in reading order, by what stands above and left of them."""
    l = read(spark, sf_dir, "lineitem").where("l_orderkey is not null")
    b = l.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("region")).agg(F.min(F.col("l_partkey") % 97).cast("double").alias("x1"), F.min(F.col("l_suppkey") % 89).cast("double").alias("y1"), F.max("l_quantity").alias("w"))
    b = b.select("page", "region", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("w") / 2).alias("y2"))
    return read_in_order(precedence(b))


def looked_up(terms: DataFrame, lex: DataFrame) -> DataFrame:
    """(term, item, tier, confidence) of terms (term) in a lexicon (item_id, raw): exactly, normalised, by stem."""
    lex = lex.withColumn("lemma", F.lower("raw"))
    exact = lex.groupBy(F.col("raw").alias("term")).agg(F.min("item_id").alias("e"))
    norm = lex.groupBy("lemma").agg(F.min("item_id").alias("n"))
    stem = norm.where(F.length("lemma") >= 4).groupBy(F.substring("lemma", 1, 4).alias("stem")).agg(F.min("n").alias("v"))
    t = terms.withColumn("lemma", F.lower("term")).withColumn("stem", F.when(F.length("term") >= 4, F.substring("lemma", 1, 4)))
    t = t.join(exact, "term", "left").join(norm, "lemma", "left").join(stem, "stem", "left")
    tier = F.when(F.col("e").isNotNull(), "exact").when(F.col("n").isNotNull(), "normalised").when(F.col("v").isNotNull(), "variant").otherwise("none")
    confidence = F.when(F.col("e").isNotNull(), 1.0).when(F.col("n").isNotNull(), 0.95).when(F.col("v").isNotNull(), 0.9).otherwise(0.0)
    return t.select("term", F.coalesce("e", "n", "v").alias("item"), tier.alias("tier"), confidence.alias("confidence"))


_SPLIT = """regexp_split_to_array("text", '[ \\t\\n\\x0B\\f\\r]+')"""
_CASCADE = f"""with w as (select distinct item_id, raw, lower(raw) lemma from (select item_id, unnest({_SPLIT}) raw from benchmark) where raw <> ''),
e as (select raw, min(item_id) item from w group by raw), n as (select lemma, min(item_id) item from w group by lemma), v as (select substring(lemma, 1, 4) stem, min(item) item from n where length(lemma) >= 4 group by 1),
t as (select distinct term from (select unnest({_SPLIT}) term from documents) where term <> '')
select term, coalesce(e.item, n.item, v.item) item, case when e.item is not null then 'exact' when n.item is not null then 'normalised' when v.item is not null then 'variant' else 'none' end tier,
 case when e.item is not null then 1.0 when n.item is not null then 0.95 when v.item is not null then 0.9 else 0.0 end::double confidence
from t left join e on e.raw = t.term left join n on n.lemma = lower(t.term) left join v on v.stem = substring(lower(t.term), 1, 4) and length(t.term) >= 4"""


@query(_CASCADE)
def evidence_cascade_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document looked up in a lexicon of all words of the benchmark: exactly, normalised, by stem; the
    first that finds something gives the confidence."""
    words = lambda name: F.explode(F.split("text", r"\s+")).alias(name)
    lex = read(spark, sf_dir, "benchmark").select("item_id", words("raw")).where("raw != ''").distinct()
    terms = read(spark, sf_dir, "documents").select(words("term")).where("term != ''").distinct()
    return looked_up(terms, lex)


@query(_CASCADE)
def evidence_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_cascade_terms(spark, sf_dir)


@query("""with t as (select p_name label, p_partkey id from part), s as (select id, label, case when label = 'small' then 1.0 when starts_with(label, 'small') then 0.92 when contains(label, 'small') then 0.78 end score from (select id, lower(label) label from t))
select id, label, score::double score from s where starts_with(label, 'small') order by score desc, label, id limit 8""")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight labels that start with what was typed, the best first."""
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label")).where(F.startswith("label", F.lit("small")))
    return s.withColumn("score", T.text_score(F.lit("small"), F.col("label"))).orderBy(F.desc("score"), "label", "id").limit(8)


@query("""select label facet, count(*) n, min(vec_id) first_id from embeddings group by label""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("facet")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("""with k as (select md5(lower(trim("text", ' '))) key, min(turn) first_turn, count(*) uses from conversations where "text" is not null group by 1) select key, first_turn, uses, uses > 1 hit from k""")
def exact_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by the hash of their text: how often a cache would have served one."""
    key = F.md5(F.lower(F.trim("text")))
    return read(spark, sf_dir, "conversations").where("text is not null").groupBy(key.alias("key")).agg(F.min("turn").alias("first_turn"), F.count("*").alias("uses"), (F.count("*") > 1).alias("hit"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / F.greatest(union, F.lit(1e-9)))


def fuse_boxes(page: pd.DataFrame, least: float = 0.55) -> pd.DataFrame:
    """Boxes of a page clustered greedily by overlap, in order of confidence: weighted mean box, summed-confidence label."""
    rows, taken = page.sort_values(["layout_confidence", "x1", "y1"], ascending=[False, True, True]).to_dict("records"), set()
    out = []
    for i, seed in enumerate(rows):
        if i in taken:
            continue
        group = []
        for k in range(i, len(rows)):
            r = rows[k]
            w = max(0, min(seed["x2"], r["x2"]) - max(seed["x1"], r["x1"]))
            h = max(0, min(seed["y2"], r["y2"]) - max(seed["y1"], r["y1"]))
            union = (seed["x2"] - seed["x1"]) * (seed["y2"] - seed["y1"]) + (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) - w * h
            if k not in taken and union > 0 and w * h / union >= least or k == i:
                taken.add(k)
                group.append(r)
        total = sum(r["layout_confidence"] for r in group) or 1.0
        votes: dict[str, float] = {}
        for r in group:
            votes[r["label"]] = votes.get(r["label"], 0) + r["layout_confidence"]
        mean = {c: sum(r[c] * r["layout_confidence"] for r in group) / total for c in ("x1", "y1", "x2", "y2")}
        out.append({"page": seed["page"], "label": max(sorted(votes), key=votes.get), **mean, "layout_confidence": total / len(group), "boxes": len(group)})
    return pd.DataFrame(out, columns=["page", "label", "x1", "y1", "x2", "y2", "layout_confidence", "boxes"])


def fused_layout(boxes: DataFrame) -> DataFrame:
    """Pages' boxes fused; a page is one group, as greedy clustering is sequential within it."""
    return boxes.groupBy("page").applyInPandas(lambda page: fuse_boxes(page), "page long, label string, x1 double, y1 double, x2 double, y2 double, layout_confidence double, boxes int")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics: of each key the row that is last in order."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
