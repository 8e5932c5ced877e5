"""Operator 7: n-gram Jaccard join with size-banded tiles and hashed bitmaps.

Texts with equal shingle sets are one class. Classes that share enough rare shingles are brought together (exactly: no
pair that links is missed), sorted by set size and cut into tiles; only tiles whose size bands can link meet. In a tile,
bits that one bitmap has and the other lacks bound the overlap from above; what passes is intersected exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, Scratch, lean, partitions, small_batches, table, texts
from .components import connected

SHINGLE_WORDS = 5
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Candidates are sought by the shingles whose hash is below this share of all hashes.
LOW = np.uint64(int(0.3 * 2**64))
#: Sets of a tile side, and the most bits of a bitmap.
TILE, MOST_BITS = 512, 1 << 15
#: Keys that the counts of one size of a component are dealt over.
SALTS = 64
#: Columns of a matrix of sets that are multiplied at a time.
COLUMNS = 4096
SALT = np.uint64(0x9E3779B97F4A7C15)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words are parted by these characters alone.
BLANKS = str.maketrans("\t\n\v\f\r", "     ")
POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 2**64)) for k in range(SHINGLE_WORDS)]


class Shingles:
    """Sorted 64-bit hashes of a text's distinct shingles; word hashes are remembered, up to a bound."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def word(self, w: str) -> int:
        if len(self.words) > 300_000:
            self.words.clear()
        found = self.words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return found

    def __call__(self, text: str) -> np.ndarray:
        known = self.words.get
        words = [w for w in text.translate(LOWER).translate(BLANKS).split(" ") if w]
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < SHINGLE_WORDS:
            return np.array([xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))], np.uint64)
        h = np.array([known(w) or self.word(w) for w in words], np.uint64)
        n = len(h) - SHINGLE_WORDS + 1
        x = h[:n] * POWERS[0]
        for k in range(1, SHINGLE_WORDS):
            x = (x ^ (x >> np.uint64(29))) * POWERS[1] + h[k : k + n]
        x ^= x >> np.uint64(32)
        x *= POWERS[1]
        x ^= x >> np.uint64(29)
        return np.unique(x)


def spare(n: int) -> int:
    """How many shingles a set of n can have that a linked set lacks."""
    return n - -(-PERCENT * n // 100)


SETS = "doc_id long, n long, sig binary, k long, sought binary"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("k", pa.int64()), ("sought", pa.binary())])


def summarised(batches: Batches) -> Batches:
    """(doc_id, text) to set size, digest of the set, and the hashes by which it is sought (not for a repeated set).

    These are the hashes below LOW; all of them for a set that could link without sharing one of those.
    """
    make, seen = Shingles(), set()
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            h = make(text)
            if not len(h):
                rows.append((i, 0, None, None, None))
                continue
            sig = xxhash.xxh3_128_digest(h.tobytes())
            sought = None
            if sig not in seen and i is not None:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
                low = h[: np.searchsorted(h, LOW)]
                sought = (low if len(low) > spare(len(h)) else h).tobytes()
            rows.append((i, len(h), sig, int.from_bytes(sig[:8], "little", signed=True), sought))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SETS_ARROW, strict=True)], schema=SETS_ARROW)


def keys(n: int, sought: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The hashes of a set in each of the two searches: among all sets below LOW, and among the sets sought by all
    their hashes (there with other hash values, so that the searches don't meet)."""
    low = sought[: np.searchsorted(sought, LOW)]
    return [(0, low)] if len(low) > spare(n) else [(0, low), (1, sought ^ SALT)]


def grouped(batches: Batches, width: int):
    """(first column, rows) of runs of rows whose first column is equal; columns after it as tuples."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:width])
    if rows:
        yield key, rows


def bucket_counts(ranges: int):
    """Sets by bucket to (range, bucket, hashes and counts): in how many of the bucket's sets each hash is."""

    def run(batches: Batches) -> Batches:
        for bucket, rows in grouped(batches, 4):
            seen, parts = set(), []
            for n, sig, sought in rows:
                if sig not in seen:
                    seen.add(sig)
                    parts += [h for _, h in keys(n, np.frombuffer(sought, np.uint64))]
            h, count = np.unique(np.concatenate(parts), return_counts=True)
            place = ((h >> np.uint64(20)) % np.uint64(ranges)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(ranges + 1))
            out = [(r, bucket, h[own].tobytes(), count[own].astype(np.uint32).tobytes()) for r in range(ranges) if len(own := order[edges[r] : edges[r + 1]])]
            if out:
                yield _batch(out, COUNTS_ARROW)

    return run


COUNTS = "place int, bucket int, hashes binary, counts binary"
COUNTS_ARROW = pa.schema([("place", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def shared_counts(batches: Batches) -> Batches:
    """Counts by range, summed over buckets and sent back to each bucket for the hashes that two sets or more have."""
    for place, rows in grouped(batches, 4):
        h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        c = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]).astype(np.int64)
        _, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, c)[inverse]
        at, out = 0, []
        for bucket, hashes, _ in rows:
            n = len(hashes) // 8
            ok = total[at : at + n] >= 2
            if ok.any():
                out.append((place, bucket, h[at : at + n][ok].tobytes(), total[at : at + n][ok].astype(np.uint32).tobytes()))
            at += n
        if out:
            yield _batch(out, COUNTS_ARROW)


PREFIX = "h long, k long"
PREFIX_ARROW = pa.schema([("h", pa.int64()), ("k", pa.int64())])


def rare_prefixes(batches: Batches) -> Batches:
    """A bucket's shared counts, then its sets, to (hash, set): the rarest shared hashes of each set that can link.

    In a search, a set lacks at most spare(n) of another's hashes that it links with, so it shares all but so many of
    its own, and the first one that both have, in any order of hashes, is among the first spare(n) + 1 of each. The
    order here is by count, rarest first; hashes of one set alone come first of all and make no row.
    """
    for _, rows in grouped(batches, 6):
        known = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)) for n, _, _, h, c in rows if n is None]
        if not known:
            continue
        h, c = np.concatenate([x[0] for x in known]), np.concatenate([x[1] for x in known])
        order = np.argsort(h)
        h, c = h[order], c[order]
        seen, hashes, sets = set(), [], []
        for n, sig, sought, _, _ in rows:
            if n is None or sig in seen:
                continue
            seen.add(sig)
            k = int.from_bytes(sig[:8], "little", signed=True)
            for _, own in keys(n, np.frombuffer(sought, np.uint64)):
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                shared = h[at] == own
                alone = len(own) - int(shared.sum())
                if alone > spare(n) or alone == len(own):
                    continue
                own, count = own[shared], c[at[shared]]
                first = own[np.lexsort((own, count))[: spare(n) + 1 - alone]]
                hashes.append(first)
                sets.append(np.full(len(first), k, np.int64))
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(sets))], schema=PREFIX_ARROW)


def linked(nx: np.ndarray, ny: np.ndarray, both: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (nx + ny - both)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of hashed bits a set, as 64-bit words; wide enough to be sparse in the largest set, up to a bound."""
    bits = 256
    while bits < 4 * max(map(len, sets)) and bits < MOST_BITS:
        bits *= 2
    out = np.zeros((len(sets), bits), bool)
    for row, s in zip(out, sets, strict=True):
        row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one by one, or by products of 0-1 matrices where that is less work."""
    n = np.array([len(s) for s in sets], np.int64)
    one_by_one = 2e-5 * len(x) + 5e-8 * (n[x] + n[y]).sum()
    used = np.unique(np.concatenate([x, y]))
    _, column, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    left, right = np.unique(x), np.unique(y)
    wide = int((count > 1).sum())
    if one_by_one <= 1e-10 * wide * len(left) * len(right):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    row = np.repeat(used, n[used])
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2 ** 24 are exact
    for first in range(0, wide, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, wide - first)), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part[left] @ part[right].T
    return both[np.searchsorted(left, x), np.searchsorted(right, y)].astype(np.int64)


def tile_links(sets: list[np.ndarray], second: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """All links (x, y), in order of x, of sets sorted by size; cross: only between the tile's two sides."""
    n = np.array([len(s) for s in sets], np.int64)
    bits, left, right = bitmaps(sets), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in range(len(sets)):
        end = int(np.searchsorted(n, 100 * n[x] // PERCENT, "right"))  # larger ones can't link
        y = np.arange(x + 1, end)
        if cross:
            y = y[second[y] != second[x]]
        if not len(y):
            continue
        b = bits[y]
        most = np.minimum(n[x] - np.bitwise_count(bits[x] & ~b).sum(1, dtype=np.int64), n[y] - np.bitwise_count(b & ~bits[x]).sum(1, dtype=np.int64))
        y = y[linked(n[x], n[y], most)]
        left.append(np.full(len(y), x))
        right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    if len(x):
        ok = linked(n[x], n[y], overlaps(sets, x, y))
        x, y = x[ok], y[ok]
    return x, y


def forest(size: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what isn't joined yet: they have the components of all."""
    label, out = np.arange(size), []
    cuts = np.flatnonzero(np.diff(x)) + 1
    for a, own in zip(x[np.r_[0, cuts]].tolist() if len(x) else [], np.split(y, cuts), strict=len(x) > 0):
        names, at = np.unique(label[own], return_index=True)
        new = names != label[a]
        out += [(a, int(b)) for b in own[at[new]]]
        if new.any():
            label[np.isin(label, names[new])] = label[a]
    return out


TILES = "tile long, comp long, i int, j int, side int, n long, rep long, k long, copies long, hashes binary"
TILES_ARROW = pa.schema([("tile", pa.int64()), ("comp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("n", pa.int64()), ("rep", pa.int64()), ("k", pa.int64()), ("copies", pa.int64()), ("hashes", pa.binary())])
#: Links that tell the components (k null), or how many links to other sets each text of a class k has in some tiles.
EDGES = "a long, b long, k long, n long"
EDGES_ARROW = pa.schema([(c, pa.int64()) for c in ("a", "b", "k", "n")])


def placed(batches: Batches) -> Batches:
    """(rep, text, sig, k, copies, tiles) to a row a tile with the text's whole set; texts of another set under one id go."""
    make = Shingles()
    for batch in batches:
        rows = []
        for rep, text, sig, k, copies, tiles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = make(text or "")
            if xxhash.xxh3_128_digest(h.tobytes()) == sig:
                rows += [(t["tile"], t["comp"], t["i"], t["j"], t["side"], len(h), rep, k, copies, h.tobytes()) for t in tiles]
        if rows:
            yield _batch(rows, TILES_ARROW)


def tile_edges(batches: Batches) -> Batches:
    """Rows sorted by (tile, comp, i, j, n, rep, k) to the links found in each tile: a forest of them, and their number
    by class, each link counted as often as the other class has texts."""
    key, sets, rows, number = None, [], [], {}

    def found() -> list[tuple]:
        if len(sets) < 2:
            return []
        reps, names, copies, sides = zip(*rows, strict=True)
        x, y = tile_links(sets, np.array(sides), key[2] != key[3])
        copies = np.array(copies, float)
        total = np.bincount(x, copies[y], len(sets)) + np.bincount(y, copies[x], len(sets))
        for k in np.flatnonzero(total).tolist():
            number[names[k]] = number.get(names[k], 0) + int(total[k])
        return [(reps[a], reps[b], None, None) for a, b in forest(len(sets), x, y)]

    def counted() -> list[tuple]:
        out = [(None, None, k, n) for k, n in number.items()]
        number.clear()
        return out

    for batch in batches:
        out = []
        for tile, comp, i, j, side, _, rep, k, copies, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (tile, comp, i, j) != key:
                out += found() if key else []
                key, sets, rows = (tile, comp, i, j), [], []
            if not rows or rows[-1][:2] != (rep, k):
                sets.append(np.frombuffer(hashes, np.uint64))
                rows.append((rep, k, copies, side))
        if len(number) > 200_000:
            out += counted()
        if out:
            yield _batch(out, EDGES_ARROW)
    if out := (found() if key else []) + counted():
        yield _batch(out, EDGES_ARROW)


def blocked(members: DataFrame) -> DataFrame:
    """members (comp, rep, n, sig, k, copies) with block: about TILE members of a component each, in order of size.

    A member's place is estimated: members of smaller sets, counted, and its share by hash of those of its own size. So
    members are never ordered in one place, however large a component is; sizes are counted with map-side sums, and
    the counts of a size are dealt over SALTS keys when members look them up. Small components are one block.
    """
    sizes = members.groupBy("comp", "n").agg(F.count("*").alias("c"))
    whole = sizes.groupBy("comp").agg(F.sum("c").alias("total")).where(F.col("total") > TILE)
    # a row a size of a large component
    before = W.partitionBy("comp").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.join(whole, "comp").withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    starts = starts.select("comp", "n", "c", "start", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.shiftright("k", 20), F.lit(SALTS)).cast("int")).join(starts, ["comp", "n", "salt"], "left")
    share = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return salted.select("comp", "rep", "n", "sig", "k", "copies", F.coalesce(F.floor((F.col("start") + share * F.col("c")) / TILE), F.lit(0)).cast("int").alias("block"))


def tiling(members: DataFrame) -> DataFrame:
    """(rep, sig, k, copies, tiles): a tile is two blocks of a component whose sizes can link, or one with itself."""
    blocks = blocked(members)
    span = blocks.groupBy("comp", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left = span.select("comp", F.col("block").alias("i"), "most")
    right = span.select("comp", F.col("block").alias("j"), "least")
    pairs = left.join(right, "comp").where((F.col("i") <= F.col("j")) & (100 * F.col("most") >= PERCENT * F.col("least"))).select("comp", "i", "j")
    sides = pairs.select("comp", "i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).unionByName(pairs.where("i != j").select("comp", "i", "j", F.lit(1).alias("side"), F.col("j").alias("block")))
    tile = F.struct(F.xxhash64("comp", "i", "j").alias("tile"), "comp", "i", "j", "side")
    return blocks.join(sides, ["comp", "block"]).groupBy("rep", "sig", "k", "copies").agg(F.collect_list(tile).alias("tiles"))


def jaccard_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs (doc_id, text).

    n_links counts the other rows with an id whose sets link with this one's, copies among them. component_id is the smallest doc_id reachable over links. Null and empty texts, and texts without words, have no
    shingles, no links and their own id; rows with a null id take no part and have nulls there. Ids
    should be distinct: of different texts under one id, each has its own class's component, and classes whose smallest
    id is the same are one. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, n = Scratch(spark), partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = scratch.write(docs.mapInArrow(lean(summarised), SETS), "sets")
    rows = scratch.write(sets.select("doc_id", "n", "sig"), "rows")
    classes = scratch.write(sets.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("k").alias("k"), F.count("*").alias("copies")), "classes")

    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = ranges = max(2 * n, total // 5_000_000)
    sought = sets.where("sought is not null").withColumn("bucket", F.pmod("k", F.lit(buckets)).cast("int"))
    own = sought.select("bucket", "n", "sig", "sought").repartition(n, "bucket").sortWithinPartitions("bucket")
    counts = scratch.write(own.mapInArrow(lean(bucket_counts(ranges)), COUNTS).repartition(n, "place").sortWithinPartitions("place").mapInArrow(lean(shared_counts), COUNTS), "counts")
    none = lambda kind: F.lit(None).cast(kind)
    told = counts.select("bucket", none("long").alias("n"), none("binary").alias("sig"), none("binary").alias("sought"), "hashes", "counts")
    asked = sought.select("bucket", "n", "sig", "sought", none("binary").alias("hashes"), none("binary").alias("counts"))
    both = told.unionByName(asked).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("n").isNotNull())
    prefixes = scratch.write(both.mapInArrow(lean(rare_prefixes), PREFIX), "prefixes")
    scratch.drop("counts", "sets")

    hubs = prefixes.groupBy("h").agg(F.min("k").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    near = prefixes.join(hubs, "h").where("k != hub").select(F.col("k").alias("a"), F.col("hub").alias("b"))
    comps = connected(near, scratch, "near")
    members = scratch.write(classes.join(comps, classes.k == comps.node).select(F.col("component").alias("comp"), "rep", "n", "sig", "k", "copies"), "members")
    scratch.drop("prefixes")

    tiles = docs.join(tiling(members), docs.doc_id == F.col("rep")).select("rep", "text", "sig", "k", "copies", "tiles").mapInArrow(lean(placed), TILES)
    links = tiles.repartition(n, "tile").sortWithinPartitions("tile", "comp", "i", "j", "n", "rep", "k").mapInArrow(lean(tile_edges), EDGES)
    links = scratch.write(links, "links")
    found = connected(links.where("k is null").select("a", "b"), scratch, "links_")
    number = links.where("k is not null").groupBy("k").agg(F.sum("n").alias("others"))
    joined = classes.join(found, classes.rep == found.node, "left").join(number, "k", "left")
    roots = scratch.write(joined.select("sig", F.coalesce("component", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")), "roots")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(roots, "sig", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(known, F.coalesce("root", "doc_id")).alias("component_id"), F.when(known, F.coalesce("links", F.lit(0))).alias("n_links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of jaccard_links()."""
    return jaccard_links(docs).drop("n_links")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))
