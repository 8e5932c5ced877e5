"""Operator 2: BPE encoding and decoding through a table of distinct words.

Words (the tokenizer's own split, its added tokens apart) are the unit: ids of a text are the ids of its words in
order. Runs of documents ("flushes") list their distinct words and keep each document as positions into that list.
The lists meet by word-hash range, where each distinct word of the corpus is encoded once; the ids go back to the
flushes, where they replace positions. Only words and positions move, never texts or one row a word.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Scratch, lean, partitions, small_batches, table, texts

#: Characters of text in a flush; a longer document is a flush of its own.
FLUSH_CHARS = 32_000_000

#: Distinct words that a range remembers; a range with more of them starts anew, and encodes some once more.
REMEMBERED = 400_000
#: The largest vocabulary whose id-to-piece table is sent to every task.
MOST_PIECES = 1_000_000

#: A word's number of tokens is kept in two bytes; from this one on, the exact number is listed apart.
MOST_U2 = 65535

#: Fixed value: the split of byte-level BPE tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

FLUSH_SCHEMA = "flush string, part int, data binary"
DOC_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def splitter(path: str) -> Callable[[str], list[str]]:
    """Text to words; the strings of added tokens are words of their own."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    if conf["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or conf["normalizer"]:
        raise ValueError("a byte-level tokenizer without normaliser or prefix space is asked for")
    found = regex.compile(PATTERN).findall
    added = [t["content"] for t in conf["added_tokens"]]
    if not added:
        return found
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split
    kept = frozenset(added)

    def words(text: str) -> list[str]:
        if not any(a in text for a in added):
            return found(text)
        return [w for part in cut(text) for w in ((part,) if part in kept else found(part))]

    return words


@lru_cache(2)
def pieces(path: str) -> dict[int, bytes]:
    """The id-to-piece table, pieces as bytes; its size is the tokenizer's vocabulary."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(keep)]
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {i: bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds), 8), 8 * (len(kinds) + 1), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def word_range(words: list[str], ranges: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), "u8", len(words)) % np.uint64(ranges)


def flushes(path: str, ranges: int) -> Callable[[Batches], Batches]:
    """Batches of (doc_id, text) to rows of a flush: part -1 has the documents, part r its distinct words of range r."""

    def emit(ids: list, arrays: list[np.ndarray], words: dict[str, int]) -> Iterable[tuple]:
        flush, names = uuid.uuid4().hex, list(words)
        at = np.array([len(a) for a in arrays], np.uint32)
        flat = np.concatenate([*arrays, np.zeros(0, np.uint32)])
        arrays.clear()
        words.clear()
        part = word_range(names, ranges)
        # numbers by frequency, range and spelling: small numbers are frequent, and a range's rare words have
        # neighbouring numbers and spellings
        spelled = np.empty(len(names), np.int64)
        spelled[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort((spelled, part, -np.bincount(flat, minlength=len(names))))
        rank = np.empty(len(names), np.uint32)
        rank[order] = np.arange(len(names), dtype=np.uint32)
        flat = rank[flat]
        far = flat[flat >= 255]
        low = np.minimum(flat, 255, out=flat).astype(np.uint8)
        del flat
        far = np.concatenate([(far >> s).astype(np.uint8) for s in (0, 8, 16, 24)])
        nulls = np.array([i is None for i in ids], np.uint8)
        yield flush, -1, pack(np.array([i or 0 for i in ids], "<i8"), nulls, at, low, far)
        order = order[np.argsort(part[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for own in np.split(order, cuts) if len(names) else []:
            text = "\0".join(names[i].replace("\1", "\1\1").replace("\0", "\1\2") for i in own).encode("utf-8", "surrogatepass")
            yield flush, int(part[own[0]]), pack(np.diff(rank[own], prepend=np.uint32(0)), np.frombuffer(text, np.uint8))

    def run(batches: Batches) -> Batches:
        split = splitter(path)
        ids, arrays, words, held = [], [], {}, 0

        def out():
            rows = list(zip(*emit(ids, arrays, words), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], names=["flush", "part", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if held and held + len(text) > FLUSH_CHARS:
                    yield out()
                    ids, arrays, words, held = [], [], {}, 0
                place = words.setdefault
                arrays.append(np.array([place(w, len(words)) for w in split(text)], np.uint32))
                ids.append(i)
                held += len(text)
        if ids:
            yield out()

    return run


def id_kind(path: str) -> str:
    """The smallest number that holds every id."""
    return "<u2" if max(pieces(path)) < 1 << 16 else "<u4"


def listed(data: bytes) -> tuple[np.ndarray, list[str]]:
    gaps, raw = unpack(data, "<u4", "u1")
    return gaps, [w.replace("\1\2", "\0").replace("\1\1", "\1") if "\1" in w else w for w in raw.tobytes().decode("utf-8", "surrogatepass").split("\0")]


def encoded(path: str) -> Callable[[Batches], Batches]:
    """Word lists sorted by range to (flush, part, data) with the words' ids; a word is encoded once in its range."""

    def run(batches: Batches) -> Batches:
        tok, current, known = tokenizer(path), None, {}
        kind = id_kind(path)
        for batch in batches:
            rows = []
            for flush, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current:
                    current, known = part, {}
                gaps, words = listed(data)
                if len(known) + len(words) > REMEMBERED:
                    known = {}
                if new := [w for w in words if w not in known]:
                    known.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(new, tok.encode_batch(new, add_special_tokens=False), strict=True))
                got = [known[w] for w in words]
                flat = np.frombuffer(b"".join(got), kind)
                counts = np.array([len(g) for g in got], np.int64) // flat.itemsize
                rows.append((flush, part, pack(gaps, np.minimum(counts, MOST_U2).astype("<u2"), counts[counts >= MOST_U2], flat)))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["flush", "part", "data"])

    return run


def joined(make: Callable, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Rows sorted by (flush, part): a flush's documents come first, then its words' ids; make gets them together."""

    def run(batches: Batches) -> Batches:
        docs = flush = None
        words: list[bytes] = []
        for batch in batches:
            for f, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != flush:
                    if docs is not None:
                        yield from make(docs, words, schema)
                    docs, flush, words = None, f, []
                if part < 0:
                    docs = data
                else:
                    words.append(data)
        if docs is not None:
            yield from make(docs, words, schema)

    return run


@dataclass
class Flush:
    """A flush put together again: ids of its documents, their word numbers, and the words' token ids, flat, by number."""

    ids: list
    numbers: list[np.ndarray]
    flat: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, docs: bytes, words: list[bytes], kind: str) -> Flush:
        ids, nulls, at, low, far = unpack(docs, "<i8", "u1", "<u4", "u1", "u1")
        numbers = low.astype(np.uint32)
        numbers[low == 255] = np.ascontiguousarray(far.reshape(4, -1).T).view("<u4").ravel()
        del docs, low, far
        places, sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)]
        for gaps, short, long, flat in (unpack(w, "<u4", "<u2", "<i8", kind) for w in words):
            size = short.astype(np.int64)
            size[short == MOST_U2] = long
            places.append(np.cumsum(gaps, dtype=np.int64))
            sizes.append(size)
            flats.append(flat)
        place, size = np.concatenate(places), np.concatenate(sizes)
        first, counts = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        first[place], counts[place] = np.cumsum(size) - size, size
        parts = np.split(numbers, np.cumsum(at)[:-1]) if len(at) else []
        return cls([None if z else int(i) for i, z in zip(ids, nulls, strict=True)], parts, np.concatenate(flats), first, counts)

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """Token ids of a text, by its word numbers."""
        counts = self.counts[numbers]
        shift = np.repeat(self.first[numbers] - (np.cumsum(counts) - counts), counts)
        return self.flat[np.arange(len(shift)) + shift]


def digests(path: str) -> Callable:
    def make(docs: bytes, words: list[bytes], schema: pa.Schema):
        piece = pieces(path)
        decimal = {i: str(i) for i in piece}
        flush, rows = Flush.of(docs, words, id_kind(path)), []
        for i, n in zip(flush.ids, flush.numbers, strict=True):
            ids = flush.tokens(n).tolist()
            # decoding: the text's ids joined with the id-to-piece table, in order
            said = b"".join(map(piece.__getitem__, ids)).decode("utf-8", "replace").encode()
            rows.append((i, len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(said).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return make


def token_ids(path: str) -> Callable:
    def make(docs: bytes, words: list[bytes], schema: pa.Schema):
        flush = Flush.of(docs, words, id_kind(path))
        for i, n in zip(flush.ids, flush.numbers, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([flush.tokens(n)], pa.list_(pa.int32()))], schema=schema)

    return make


def _encode(docs: DataFrame, path: str, make: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    scratch, n = Scratch(spark), partitions(spark)
    flushed = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(flushes(path, n)), FLUSH_SCHEMA), "flushes")
    words = flushed.where("part >= 0").repartition(n, "part").sortWithinPartitions("part").mapInArrow(lean(encoded(path)), FLUSH_SCHEMA)
    both = flushed.where("part < 0").unionByName(words)
    return both.repartition(n, "flush").sortWithinPartitions("flush", "part").mapInArrow(lean(joined(make, arrow)), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text), as the tokenizer at path gives them.

    Null and empty texts have no ids; repeated rows and null ids stay, one result a row; other columns are ignored; an empty
    table stays empty. A text longer than FLUSH_CHARS is a flush of its own, and must fit a task.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _encode(docs, path, token_ids(path), "doc_id long, ids array<int>", arrow)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece binary): a row an id of the vocabulary."""
    return spark.createDataFrame(sorted(pieces(path).items()), "id int, piece binary")


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): a row an id, joined with the id-to-piece table, put together by place.

    Repeated rows and null ids of documents stay, one result a row. Null and empty ids give an empty text; an id that the
    vocabulary lacks raises an error. Bytes that are no UTF-8 become replacement characters, as the library has it.
    """
    spark = encoded_docs.sparkSession
    table = piece_table(spark, path)
    table = F.broadcast(table) if len(pieces(path)) <= MOST_PIECES else table
    rows = Scratch(spark).write(encoded_docs.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").withColumn("row", F.monotonically_increasing_id()), "ids")
    placed = rows.select("row", F.posexplode("ids").alias("place", "id")).join(table, "id", "left")
    checked = placed.withColumn("piece", F.when(F.col("piece").isNull(), F.raise_error(F.concat(F.lit("no piece has id "), F.col("id").cast("string")))).otherwise(F.col("piece")))
    joined = checked.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]).alias("pieces"))

    @F.pandas_udf("string")
    def said(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: b"".join(p if p is not None else ()).decode("utf-8", "replace"))

    return rows.select("doc_id", "row").join(joined, "row", "left").select("doc_id", said("pieces").alias("text"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode(), with digests of the ids and of the text decoded from them in place of the ids."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _encode(docs, path, digests(path), DOC_SCHEMA, arrow)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), default_path())
