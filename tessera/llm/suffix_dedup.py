"""Operator 8: removal of repeated byte strings by suffix sorting with a difference cover.

Two equal strings of LENGTH bytes have equal anchors (the place of the least hash of ANCHOR bytes among all those in the
string). So the suffixes to be sorted are dealt by the hash of their anchor: equal strings meet in one range, and each
range's suffix array is built on its own. In a range, suffixes at two of three places (a difference cover modulo 3) are
sorted by triples of characters; the triples' names make a shorter text, sorted the same way, until names tell LENGTH
bytes apart; the remaining suffixes are merged in. Neighbours in the sorted order with equal prefixes of LENGTH bytes
are repeats of the smallest document among them.

Before that, what only one text has is left out: a string of LENGTH bytes holds its anchor and what is next to it, BEFORE
bytes on the left or AFTER on the right, so it can't repeat unless another text has the anchor with the same side.
Anchors alone are too short for that: the more text there is, the more of them are shared by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Scratch, lean, partitions, small_batches, table

#: Length of the strings that are looked for, bytes of an anchor, and anchors that such a string has.
LENGTH, ANCHOR = 50, 16
SPAN = LENGTH - ANCHOR + 1
#: Bytes next to an anchor, of which a string has those on the left (if it starts so far before it) or those on the right.
BEFORE = (LENGTH - ANCHOR) // 2
AFTER = LENGTH - ANCHOR - BEFORE + 1
#: Text bytes that a task looks at together before it sends what it found, and about how many a range gets.
FLUSH_BYTES, RANGE_BYTES = 6_000_000, 150_000

#: An anchor that more texts than this have is hot: the strings around it are dealt by so many neighbouring starts, by the
#: hash of the bytes that all of these have (the anchor's among them), not together.
HOT_TEXTS, HOT_STARTS = 2000, 7
#: Bytes of strings that are suffix-sorted at once; more of one hash are sorted by classes of equal strings.
SORT_BYTES = 1_000_000

PRIME = 0x9E3779B97F4A7C15
NO_ID = np.int64(np.iinfo(np.int64).max)


def anchor_hashes(data: bytes) -> np.ndarray:
    """Hash of the ANCHOR (16) bytes from each place on: two 8-byte words, mixed."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = np.array(words[:-8])
    h *= np.uint64(PRIME)
    h ^= h >> np.uint64(29)
    h += words[8:]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(PRIME)
    return h


#: Bits of a place that fit beside a hash; strings are looked at in pieces of so many, which the processor's cache holds.
PLACE_BITS = 16
PIECE = 1 << PLACE_BITS - 1


def window_anchors(h: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes the place of its anchor: the first of the least hashes in SPAN places.

    A place stands in the low bits of its hash, so least values of 2, 4, ... places, then of two overlapping runs, also
    say where they are, and of equal hashes the first is least.
    """
    mask = np.uint64((1 << PLACE_BITS) - 1)
    best = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    n, width = len(h) - SPAN + 1, 1
    while 2 * width <= SPAN:
        best = np.minimum(best[width:], best[:-width])
        width *= 2
    shift = SPAN - width
    if shift:
        best = np.minimum(best[shift:][:n], best[:n])
    return (best[:n] & mask).astype(np.int32)


def anchors(data: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first string, text) of each anchor of texts, in order: strings from first on have it, up to the next's.

    data: the texts, one after another; text k is from begin[k] to begin[k + 1]. Strings are those inside one text.
    """
    n, out = len(data) - LENGTH + 1, [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        h = anchor_hashes(data[a : b + LENGTH - 1])
        at = window_anchors(h)
        new = np.r_[True, at[1:] != at[:-1]]
        new[begin[np.searchsorted(begin, a) : np.searchsorted(begin, b)] - a] = True
        first = np.flatnonzero(new)
        out.append((at[first] + np.int64(a), h[at[first]], first + a))
    place, h, first = (np.concatenate([o[k] for o in out]) for k in range(3))
    text = np.searchsorted(begin, first, side="right") - 1
    # not strings that end in another text, nor an anchor once more where a piece begins
    ok = (first + LENGTH <= begin[text + 1]) & np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])][: len(first)]
    return place[ok], h[ok], first[ok], text[ok]


def mixed(words: np.ndarray, *at: np.ndarray) -> np.ndarray:
    """A number from 1 to 65535 for the 8-byte words at some places."""
    h = np.zeros(len(at[0]), np.uint64)
    for k in at:
        h = (h ^ words[k]) * np.uint64(PRIME)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(32)) % np.uint64(65535) + np.uint64(1)


class Anchored:
    """The anchors of texts: text (its number), place, hash, first and end of the strings around it, left and right.

    left and right are digests of the BEFORE and AFTER bytes beside the anchor, 0 where no string around it has them.
    Places count through all texts, joined in data; text k begins at begin[k].
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.begin = np.cumsum([0, *map(len, texts)])
        self.place, self.hash, self.first, self.text = anchors(self.data, self.begin)
        self.end = np.append(self.first[1:], 0)[: len(self.first)]
        last = np.flatnonzero(np.append(np.diff(self.text) > 0, True)[: len(self.text)])  # of each text
        self.end[last] = self.begin[self.text[last] + 1] - LENGTH + 1
        words = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        #: Strings from here on have the right side, those before have the left one.
        self.middle = self.place - BEFORE + 1
        most, after = len(words) - 1, self.place + ANCHOR
        before = np.maximum(self.place - BEFORE, 0)
        self.left = np.where(self.first < self.middle, mixed(words, before, before + 8, before + BEFORE - 8), np.uint64(0))
        self.right = np.where(self.end > self.middle, mixed(words, np.minimum(after, most), np.minimum(after + 8, most), np.minimum(after + AFTER - 8, most)), np.uint64(0))


# ---- which anchors two texts or more have


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def grouped(batches: Batches):
    """(first column, rows) of runs of rows whose first column is equal."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


ANCHORS = "place int, high binary, low binary, lefts binary, rights binary, names binary, numbers binary, texts binary"
ANCHORS_ARROW = pa.schema([("place", pa.int32()), *((c, pa.binary()) for c in ("high", "low", "lefts", "rights", "names", "numbers", "texts"))])
KEPT = np.uint64(0xFFFFFFFFFFFF0000)


def split_hashes(h: np.ndarray) -> tuple[bytes, bytes]:
    """The upper 48 bits of hashes, as 32 and 16 of them; two hashes that these don't tell apart do no harm here."""
    return (h >> np.uint64(32)).astype(np.uint32).tobytes(), (h >> np.uint64(16)).astype(np.uint16).tobytes()


def whole_hashes(high: bytes, low: bytes) -> np.ndarray:
    return np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint16).astype(np.uint64) << np.uint64(16)


def place_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(ranges)).astype(np.int32)


def bucket_of(owner: np.ndarray, buckets: int) -> np.ndarray:
    return (owner % np.uint64(buckets)).astype(np.int32)


def listed_anchors(ranges: int, buckets: int) -> Callable[[Batches], Batches]:
    """(owner, text) to (range, hashes, sides, owners): each text's anchors, by range. owner is a digest of the text.

    A hash that comes more than twice in a bucket of texts, in one flush, is listed for the first and the last of them:
    enough to tell that it is shared, and whom to tell. How many a row stands for (255 for more) goes with it; the sides
    of those left out aren't known.
    """

    def flush(owners: list[int], texts: list[bytes]) -> pa.RecordBatch:
        found = Anchored(texts)
        owners = np.array(owners, np.uint64)
        order = np.argsort(found.hash)
        h, text, left, right = found.hash[order] & KEPT, found.text[order], found.left[order], found.right[order]
        stands = np.ones(len(h), np.int64)
        run = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(run, len(h)))
        many = np.flatnonzero(np.repeat(size > 1, size))
        bucket = bucket_of(owners[text[many]], buckets)
        many = many[np.lexsort((right[many], left[many], text[many], bucket, h[many]))]
        bucket = bucket_of(owners[text[many]], buckets)
        same = lambda *columns: np.r_[False, np.logical_and.reduce([c[1:] == c[:-1] for c in columns])] if len(many) else np.zeros(0, bool)
        again = same(h[many], text[many], left[many], right[many])
        stands[many[again]] = 0  # the same once more in its text
        many, bucket = many[~again], bucket[~again]
        starts = np.flatnonzero(~same(h[many], bucket))
        ends = np.append(starts[1:], len(many))[: len(starts)] - 1
        inner = np.ones(len(many), bool)
        inner[starts] = inner[ends] = False
        stands[many[inner]] = 0
        stands[many[ends]] = np.where(ends > starts, ends - starts, 1)
        kept = np.flatnonzero(stands)
        place = place_of(h[kept], ranges)
        kept = kept[np.argsort(place.astype(np.uint16) if ranges < 65536 else place, kind="stable")]
        h, text, left, right, stands = h[kept], text[kept], left[kept].astype(np.uint16), right[kept].astype(np.uint16), np.minimum(stands[kept], 255).astype(np.uint8)
        edges = np.searchsorted(place_of(h, ranges), np.arange(ranges + 1))
        rows = []
        for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if a < b:
                used = np.zeros(len(owners), bool)
                used[text[a:b]] = True
                numbers = (np.cumsum(used) - 1)[text[a:b]].astype(number_type(int(used.sum())))
                rows.append((r, *split_hashes(h[a:b]), left[a:b].tobytes(), right[a:b].tobytes(), owners[used].tobytes(), numbers.tobytes(), stands[a:b].tobytes()))
        return _batch(rows, ANCHORS_ARROW)

    def run(batches: Batches) -> Batches:
        owners, texts, held, seen = [], [], 0, set()
        for batch in batches:
            for owner, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                owner &= 0xFFFFFFFFFFFFFFFF
                if len(data) < LENGTH or owner in seen:
                    continue
                seen.add(owner)
                owners.append(owner)
                texts.append(data)
                held += len(data)
                if held > FLUSH_BYTES:
                    yield flush(owners, texts)
                    owners, texts, held, seen = [], [], 0, set()
        if texts:
            yield flush(owners, texts)

    return run


def number_type(n: int) -> type:
    return np.uint16 if n < 65536 else np.uint32


#: What is told: anchors with a left side that is shared, with a right side, and anchors whose sides aren't all known.
LEFT, RIGHT, ANY = range(3)
#: sizes: how many hashes there are of each side, first those that aren't hot, then those that are.
SHARED = "bucket int, sizes binary, high binary, low binary"
SHARED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sizes", "high", "low"))])


def two_owners(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each row whether rows with its key have different owners."""
    order = np.argsort(key)
    k, o = key[order], owner[order]
    head = np.r_[True, k[1:] != k[:-1]]
    heads = np.flatnonzero(head)
    out = np.empty(len(key), bool)
    out[order] = (np.minimum.reduceat(o, heads) != np.maximum.reduceat(o, heads))[np.cumsum(head) - 1]
    return out


def shared_anchors(buckets: int) -> Callable[[Batches], Batches]:
    """Lists of a range to (bucket, sizes, hashes): what two texts or more have, told to the buckets of these texts."""

    def run(batches: Batches) -> Batches:
        for _, rows in grouped(batches):
            h = np.concatenate([whole_hashes(r[0], r[1]) for r in rows])
            sides = [np.concatenate([np.frombuffer(r[k], np.uint16) for r in rows]).astype(np.uint64) for k in (2, 3)]
            owner = np.concatenate([(names := np.frombuffer(r[4], np.uint64))[np.frombuffer(r[5], number_type(len(names)))] for r in rows])
            texts = np.concatenate([np.frombuffer(r[6], np.uint8) for r in rows])
            # anchors that come once are done
            order = np.argsort(h)
            head = np.r_[True, h[order[1:]] != h[order[:-1]]]
            more = ~(head & np.r_[head[1:], True])
            order, head = order[more], head[more]
            if not len(order):
                continue
            h, owner, texts, sides = h[order], owner[order], texts[order], [x[order] for x in sides]
            heads, group = np.flatnonzero(head), np.cumsum(head) - 1
            hot = (np.add.reduceat(texts, heads, dtype=np.int64) > HOT_TEXTS)[group]
            known = (np.maximum.reduceat(texts, heads) < 2)[group]
            keys, cells = [], []
            for side, digest in ((LEFT, sides[0]), (RIGHT, sides[1]), (ANY, np.zeros(len(h), np.uint64))):
                own = np.flatnonzero(~known if side == ANY else known & (digest > 0))
                if len(own):
                    key = h[own] | digest[own]
                    ok = two_owners(key, owner[own])
                    keys.append(key[ok])
                    cells.append(bucket_of(owner[own[ok]], buckets).astype(np.int64) * 6 + 2 * side + hot[own[ok]])
            key, cell = np.concatenate(keys), np.concatenate(cells)
            if not len(key):
                continue
            order = np.lexsort((key, cell))
            key, cell = key[order], cell[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]
            key, cell = key[new], cell[new]
            bucket = cell // 6
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*cuts[1:].tolist(), len(key)]
            out = [(b, np.bincount(cell[a:e] % 6, minlength=6).astype(np.int32).tobytes(), (key[a:e] >> np.uint64(32)).astype(np.uint32).tobytes(), key[a:e].astype(np.uint32).tobytes()) for b, a, e in zip(bucket[cuts].tolist(), cuts.tolist(), ends, strict=True)]
            yield _batch(out, SHARED_ARROW)

    return run


# ---- strings around shared anchors, by range


def planes(x: np.ndarray) -> bytes:
    """All first bytes of numbers, then all second ones, and so on: the zeros of small numbers stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def key_planes(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Nothing where keys are the ids, as they are if no two rows have one id."""
    return b"" if np.array_equal(keys, ids) else planes(keys)


def keys_and_ids(keys: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids_ = from_planes(ids, np.int64)
    return from_planes(keys, np.int64) if keys else ids_, ids_


#: Strings of a range (place not null), or runs of starts already known to be removed (place null), as in REMOVED. Half the
#: bits of hashes go, enough to tell a range's anchors apart; they, ids, keys and starts are in planes.
STRINGS = "place int, hashes binary, ids binary, keys binary, starts binary, spans binary, sizes binary, data binary, bucket int"
STRINGS_ARROW = pa.schema([("place", pa.int32()), *((c, pa.binary()) for c in ("hashes", "ids", "keys", "starts", "spans", "sizes", "data")), ("bucket", pa.int32())])


def packed(strings: list[tuple], ranges: int) -> list[tuple]:
    """(hash, id, key, start, span, bytes) by range of the hash."""
    if not strings:
        return []
    h, ids, keys, starts, spans, data = zip(*strings, strict=True)
    place = place_of(np.array(h, np.uint64), ranges)
    order = np.argsort(place, kind="stable")
    place, cuts = place[order], np.flatnonzero(np.diff(place[order], prepend=-1))
    sizes = np.array([len(d) for d in data], np.int32)
    h = (np.array(h, np.uint64) >> np.uint64(32)).astype(np.uint32)
    ids, keys, starts, spans = np.array(ids, np.int64), np.array(keys, np.int64), np.array(starts, np.int32), np.array(spans, np.int32)
    h, ids, keys, starts, spans, sizes = (x[order] for x in (h, ids, keys, starts, spans, sizes))
    order, rows = order.tolist(), []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        text = b"".join([data[k] for k in order[a:b]])
        rows.append((int(place[a]), planes(h[a:b]), planes(ids[a:b]), key_planes(keys[a:b], ids[a:b]), planes(starts[a:b]), spans[a:b].tobytes(), sizes[a:b].tobytes(), pa.compress(text, codec="zstd", asbytes=True), None))
    return rows


def unpacked(hashes: bytes, ids: bytes, keys: bytes, starts: bytes, spans: bytes, sizes: bytes, data: bytes):
    """(hash, bytes, id, key, start, span) of a row of STRINGS."""
    key, id_ = keys_and_ids(keys, ids)
    ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64).tolist()
    begin, text = 0, pa.decompress(data, decompressed_size=ends[-1], codec="zstd", asbytes=True)
    for h, i, k, a, n, end in zip(from_planes(hashes, np.uint32).tolist(), id_.tolist(), key.tolist(), from_planes(starts, np.int32).tolist(), np.frombuffer(spans, np.int32).tolist(), ends, strict=True):
        yield h, text[begin:end], i, k, a, n
        begin = end


class Merged:
    """Equal strings merged: of each the smallest document's is kept; those of larger ids are repeats, wholly.

    A string has a start and a span: how many starts of LENGTH bytes it stands for, its own, or more if the text goes on
    with the same string from where its last start ends (as runs of one character do).
    """

    def __init__(self):
        self.kept: dict[tuple[int, bytes], list[int]] = {}
        self.again: dict[tuple[int, bytes], list[list[int]]] = {}
        self.gone: dict[tuple[int, int], list[list[int]]] = {}

    def add(self, hash_: int, data: bytes, owner: int, key: int, start: int, span: int = 0) -> None:
        name, new = (hash_, data), [owner, key, start, span or len(data) - LENGTH + 1]
        old = self.kept.setdefault(name, new)
        if old is new:
            return
        if old[0] == owner:  # this document once more: its places stay
            for known in (old, *self.again.get(name, ())[-1:]):
                if known[1] == key and known[2] <= start <= known[2] + known[3]:  # the same starts, or going on from them
                    known[3] = max(known[3], start + new[3] - known[2])
                    return
            self.again.setdefault(name, []).append(new)
            return
        if old[0] > owner:
            self.kept[name], old, new = new, new, old
        runs = self.gone.setdefault((new[1], new[0]), [])
        if runs and runs[-1][1] == new[2]:
            runs[-1][1] = new[2] + new[3]
        else:
            runs.append([new[2], new[2] + new[3]])

    def strings(self) -> list[tuple]:
        return [(k[0], *v, k[1]) for k, v in self.kept.items()] + [(k[0], *v, k[1]) for k, all_ in self.again.items() for v in all_]

    def gone_runs(self) -> list[tuple[np.ndarray, ...]]:
        """Keys, ids, firsts and ends of the runs of starts that are gone."""
        n = [len(runs) for runs in self.gone.values()]
        names = np.array(list(self.gone), np.int64).reshape(-1, 2)
        runs = np.array([r for all_ in self.gone.values() for r in all_], np.int64).reshape(-1, 2)
        return [(np.repeat(names[:, 0], n), np.repeat(names[:, 1], n), runs[:, 0], runs[:, 1])]


def by_bucket(found: list[tuple[np.ndarray, ...]], buckets: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """Keys, ids, firsts and lengths of runs, packed by bucket of the key."""
    key, owner, first, end = (np.concatenate([f[k] for f in found]) for k in range(4))
    bucket = bucket_of((key.astype(np.uint64) * np.uint64(PRIME)) >> np.uint64(32), buckets)  # keys may be ids in steps
    order = np.lexsort((owner, key, bucket))
    bucket, key, owner, first, length = bucket[order], key[order], owner[order], first[order].astype(np.int32), (end - first)[order].astype(np.int32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), key_planes(key[a:b], owner[a:b]), planes(owner[a:b]), planes(first[a:b]), planes(length[a:b])) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False)]


def found_in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys are among known, which are in order."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def hot_parts(place: int, first: int, end: int) -> list[tuple[int, int, slice]]:
    """(first, end, common) of the parts of a hot anchor's starts: common is what all strings of a whole part would have.

    Equal strings have their anchor at the same place in them, so they are in the same part and have the same common bytes.
    """
    out, low = [], place - SPAN + 1
    low += (first - low) // HOT_STARTS * HOT_STARTS
    for k in range(low, end, HOT_STARTS):
        last = min(k + HOT_STARTS - 1, place)
        out.append((max(k, first), min(last + 1, end), slice(last, k + LENGTH)))
    return out


#: Text bytes looked at together when strings are cut out.
LOOK_BYTES = 1_000_000


def strings_of(ranges: int, removed: int) -> Callable[[Batches], Batches]:
    """A bucket's shared hashes, then its texts by (owner, id), to strings by range.

    Rows: (bucket, owner, id, key, text, sizes, high, low). Of equal texts only the smallest id's goes on. The strings
    around one anchor go together, as one longer string; around a hot one as one for HOT_STARTS starts, counted from the
    anchor. What is known to be removed goes to as many buckets as removed says.
    """

    def run(batches: Batches) -> Batches:
        merged, held = Merged(), 0

        def out() -> pa.RecordBatch | None:
            rows = packed(merged.strings(), ranges) + [(None, None, i, k, a, n, None, None, b) for b, k, i, a, n in by_bucket(merged.gone_runs(), removed)]
            return _batch(rows, STRINGS_ARROW) if rows else None

        def cut(told: dict[tuple[int, bool], list[np.ndarray]], texts: list[tuple[int, int, bytes]]) -> int:
            """Put the strings of texts (id, key, bytes) that may repeat into merged; about the memory they take."""
            if not texts or not told:
                return 0
            known = {k: np.sort(np.concatenate(v)) for k, v in told.items()}
            told.update({k: [v] for k, v in known.items()})
            found = Anchored([t[2] for t in texts])
            h, none = found.hash & KEPT, np.zeros(0, np.uint64)
            ok, hot = [], np.zeros(len(h), bool)
            for side, digest in ((LEFT, found.left), (RIGHT, found.right), (ANY, np.zeros(len(h), np.uint64))):
                cold, hots = (found_in(known.get((side, k), none), h | digest) for k in (False, True))
                ok.append(cold | hots)
                hot |= hots
            first = np.where(ok[LEFT] | ok[ANY], found.first, np.maximum(found.first, found.middle))
            end = np.where(ok[RIGHT] | ok[ANY], found.end, np.minimum(found.end, found.middle))
            at = np.flatnonzero((ok[LEFT] | ok[RIGHT] | ok[ANY]) & (first < end))
            data, begin, size = found.data, found.begin.tolist(), 0
            for n, hash_, place, a, b, hot_ in zip(found.text[at].tolist(), found.hash[at].tolist(), found.place[at].tolist(), first[at].tolist(), end[at].tolist(), hot[at].tolist(), strict=True):
                i, key, _ = texts[n]
                if hot_:
                    for k, z, common in hot_parts(place, a, b):
                        merged.add(xxhash.xxh3_64_intdigest(data[common]), data[k : z + LENGTH - 1], i, key, k - begin[n])
                        size += z - k + LENGTH + 200
                else:
                    merged.add(hash_, data[a : b + LENGTH - 1], i, key, a - begin[n])
                    size += b - a + LENGTH + 200
            return size

        bucket, told, texts, waiting, last = None, {}, [], 0, (None, None, None)
        for batch in batches:
            for b, owner, i, key, text, sizes, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    held += cut(told, texts)
                    bucket, told, texts, waiting, last = b, {}, [], 0, (None, None, None)
                if high is not None:
                    keys = np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)
                    for cell, part in enumerate(np.split(keys, np.cumsum(np.frombuffer(sizes, np.int32))[:-1])):
                        if len(part):
                            told.setdefault((cell // 2, bool(cell % 2)), []).append(part)
                    continue
                data = (text or "").encode()
                if len(data) < LENGTH:
                    continue
                if owner == last[0] and data == last[1]:
                    if i != last[2]:
                        merged.gone.setdefault((key, i), []).append([0, len(data) - LENGTH + 1])
                        held += 50
                else:
                    last = (owner, data, i)
                    texts.append((i, key, data))
                    waiting += len(data)
                    if waiting > LOOK_BYTES:
                        held += cut(told, texts)
                        texts, waiting = [], 0
                if held > 2 * FLUSH_BYTES:
                    if (found := out()) is not None:
                        yield found
                    merged, held = Merged(), 0
        cut(told, texts)
        if (found := out()) is not None:
            yield found

    return run


# ---- suffix sorting


def ranks(keys: np.ndarray) -> np.ndarray:
    """Names of keys: equal keys have equal names, in their order, from 1 on."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[True, s[1:] != s[:-1]]) if len(s) else s
    return out


def triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """A number for each triple, in the order of triples."""
    if most < 1 << 21:
        return a << np.int64(42) | b << np.int64(21) | c
    return ranks(ranks(a << np.int64(31) | b) << np.int64(32) | c) if most < 1 << 31 else ranks(ranks(ranks(a) << np.int64(32) | ranks(b)) << np.int64(32) | ranks(c))


def suffix_order(text: np.ndarray, covers: int) -> np.ndarray:
    """Places of a text (numbers of 1 or more) in the order of their suffixes, by `covers` bytes a number, up to LENGTH.

    Beyond that prefix the order of equal suffixes is any.
    """
    n = len(text)
    s = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    most = int(s.max()) + 1
    sample = np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])  # the difference cover {1, 2} modulo 3
    name = ranks(triples(s[sample], s[sample + 1], s[sample + 2], most)) if len(sample) else np.zeros(0, np.int64)
    if len(sample) and int(name.max()) < len(sample) and 3 * covers < LENGTH:
        # names in the order of the sample are a text of their own: one class of places after the other, a 0 between
        ones = len(np.arange(1, n, 3))
        inner = np.concatenate([name[:ones] + 1, [1], name[ones:] + 1])
        order = suffix_order(inner, 3 * covers)
        order = order[order != ones]
        order = np.where(order > ones, order - 1, order)
    else:
        order = np.argsort(name)
    sorted_sample = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    zero = np.arange(0, n, 3)
    wide = np.int64(len(sample) + 2)
    zero = zero[np.argsort(s[zero] * wide + rank[zero + 1])]
    # merging: a place of class 0 against class 1 by one character and a rank, against class 2 by two and a rank
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    # where suffixes are equal beyond LENGTH bytes the keys needn't be in order, so the searched ones are sorted
    less_one = np.searchsorted(np.sort(s[one] * wide + rank[one + 1]), s[zero] * wide + rank[zero + 1])
    pair = ranks(np.concatenate([s[two], s[zero]]) * np.int64(most) + np.concatenate([s[two + 1], s[zero + 1]]))
    pair = pair * wide + np.concatenate([rank[two + 2], rank[zero + 2]])
    less_two = np.searchsorted(np.sort(pair[: len(two)]), pair[len(two) :])
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(less_one + less_two) + np.arange(len(zero)) if len(zero) else zero
    is_zero = np.zeros(n, bool)
    is_zero[at] = True
    out[at] = zero
    out[~is_zero] = sorted_sample
    return out


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    return out


def first_owner(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each start the least owner among the starts with the same LENGTH bytes.

    data: bytes of all strings, one after another; starts: places where LENGTH bytes of one string begin.
    """
    order = suffix_order(data.astype(np.int64) + 1, 1)
    wanted = np.full(len(data), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = wanted[order]
    order = order[order >= 0]  # starts in suffix order
    words = words_at(data)
    at = starts[order]
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # neighbours' prefixes compared
        w = words[at + k]
        same &= w[1:] == w[:-1]
    group = np.cumsum(np.r_[False, ~same]) if len(at) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.r_[True, ~same])) if len(at) else owner
    out = np.empty(len(starts), owner.dtype)
    out[order] = least[group]
    return out


def first_owner_by_class(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """first_owner, by classes of strings (equal ones are in one class) of some SORT_BYTES together."""
    words, classes = words_at(data), np.uint64(len(starts) * LENGTH // SORT_BYTES + 1)
    kind = mixed(words, *(starts + k for k in (*range(0, LENGTH - 8, 8), LENGTH - 8))) % classes
    order = np.argsort(kind, kind="stable")
    out = np.empty(len(starts), owner.dtype)
    for own in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        out[own] = first_owner(data[starts[own][:, None] + np.arange(LENGTH)].ravel(), np.arange(len(own)) * LENGTH, owner[own])
    return out


# ---- from strings to removed bytes

#: Runs of removed starts, packed by bucket of their texts' keys.
REMOVED = "bucket int, keys binary, ids binary, firsts binary, lengths binary"
REMOVED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "firsts", "lengths"))])

RUNS = "key long, id long, runs binary"
RUNS_ARROW = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("runs", pa.binary())])


def repeats(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, spans: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Removed starts of texts whose strings are given, as runs: keys, ids, firsts and ends of them."""
    begin = np.cumsum(sizes) - sizes
    windows = sizes - LENGTH + 1
    string = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    least = (first_owner if len(data) <= SORT_BYTES else first_owner_by_class)(data, begin[string] + offset, ids[string])
    gone = np.flatnonzero(least < ids[string])
    # a string that goes on: its starts come again, a string's windows further each time
    string, times = string[gone], -(-spans[string[gone]] // windows[string[gone]])
    again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    string = np.repeat(string, times)
    place = starts[string] + np.repeat(offset[gone], times) + again * windows[string]
    string, place = string[(ok := place < starts[string] + spans[string])], place[ok]
    if (times > 1).any():
        order = np.lexsort((place, string))
        string, place = string[order], place[order]
    new = np.r_[True, (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)][: len(string)]
    last = np.r_[new[1:], True][: len(string)]
    return keys[string[new]], ids[string[new]], place[new], place[last] + 1


def runs_by_text(batches: Batches) -> Batches:
    """Packed runs by bucket to one row for each text: packed (first, end) of its runs."""
    for _, rows in grouped(batches):
        key, owner = (np.concatenate(c) for c in zip(*(keys_and_ids(*r[:2]) for r in rows), strict=True))
        first, length = (np.concatenate([from_planes(r[k], np.int32) for r in rows]) for k in (2, 3))
        order = np.lexsort((first, owner, key))
        key, owner, runs = key[order], owner[order], np.stack([first[order], (first + length)[order]], 1)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        yield _batch([(k, o, runs[a:b].tobytes()) for k, o, a, b in zip(key[cuts].tolist(), owner[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True)], RUNS_ARROW)


def sorted_ranges(removed: int) -> Callable[[Batches], Batches]:
    """Strings by range to the removed starts of their texts, in as many buckets as removed says.

    Equal strings are merged first. Anchors with one text's strings left are done; the others' are suffix-sorted,
    about RANGE_BYTES at a time, all of an anchor together (at most some HOT_TEXTS strings, more where it is hot).
    """

    def run(batches: Batches) -> Batches:
        for _, rows in grouped(batches):
            merged = Merged()
            for row in rows:
                for string in unpacked(*row):
                    merged.add(*string)
            strings, found = merged.strings(), merged.gone_runs()
            del merged
            hashes = np.array([s[0] for s in strings], np.uint64)
            order = np.argsort(hashes, kind="stable")
            order = order[two_owners(hashes, np.array([s[1] for s in strings], np.int64))[order]] if len(strings) else order
            hashes = hashes[order]
            cuts = np.append(np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]), len(hashes)).tolist()
            group: list[tuple] = []
            held, order = 0, order.tolist()
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                own = [strings[k] for k in order[at:end]]
                group += own
                held += sum([len(s[5]) for s in own])
                if held > RANGE_BYTES or end == len(order):
                    _, ids, keys, starts, spans, data = zip(*group, strict=True)
                    sizes = np.array([len(d) for d in data], np.int64)
                    found.append(repeats(np.array(ids, np.int64), np.array(keys, np.int64), np.array(starts, np.int64), np.array(spans, np.int64), sizes, np.frombuffer(b"".join(data), np.uint8)))
                    group, held = [], 0
            if gone := by_bucket(found, removed):
                yield _batch(gone, REMOVED_ARROW)

    return run


def covered(runs: list[bytes]) -> np.ndarray:
    """(first, end) of the maximal runs of bytes that strings at removed starts cover."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    r = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in runs]).astype(np.int64)
    r[:, 1] += LENGTH - 1
    r = r[np.argsort(r[:, 0], kind="stable")]
    most = np.maximum.accumulate(r[:, 1])
    new = np.r_[True, r[1:, 0] > most[:-1]]
    return np.stack([r[new, 0], most[np.r_[new[1:], True]]], 1)


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def kept_text(data: bytes, spans: np.ndarray) -> str:
    """What is left as text: a character of which a part is to be removed stays whole."""
    inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80
    whole = []
    for a, b in spans.tolist():
        while inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        whole.append((a, max(a, b)))
    return kept_bytes(data, np.array(whole, np.int64).reshape(-1, 2)).decode()


def keyed(docs: DataFrame, one_row_an_id: bool) -> DataFrame:
    """docs with __id (null: larger than any), __owner (a digest of the text) and __key (the id, or a digest of id and text)."""
    text, id_ = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.withColumns({"__id": F.coalesce(id_, F.lit(int(NO_ID))), "__owner": F.xxhash64(text), "__key": id_ if one_row_an_id else F.xxhash64(id_, text)})


def with_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with __runs: the removed starts of each text, as pieces of packed (first, end)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, n = Scratch(spark), partitions(spark)
    total, rows, ids = docs.select(F.octet_length("text").alias("bytes"), F.col("doc_id").cast("long").alias("id")).agg(F.sum("bytes"), F.count("*"), F.count_distinct("id")).first()
    docs, total = keyed(docs, rows == ids), total or 0
    ranges = buckets = max(2 * n, int(total // 20_000_000))
    texts_in = max(n, ranges // 2)  # buckets of texts when runs meet
    listed = docs.select("__owner", "text").mapInArrow(lean(listed_anchors(ranges, buckets)), ANCHORS)
    shared = scratch.write(listed.repartition(n, "place").sortWithinPartitions("place").mapInArrow(lean(shared_anchors(buckets)), SHARED), "shared")
    none = lambda kind: F.lit(None).cast(kind)
    # as unsigned: the same bucket as in listed_anchors
    bucket = F.pmod(F.pmod(F.shiftrightunsigned("__owner", 32), F.lit(buckets)) * F.lit((1 << 32) % buckets) + F.pmod(F.col("__owner").bitwiseAND(0xFFFFFFFF), F.lit(buckets)), F.lit(buckets)).cast("int")
    texts = docs.where(F.octet_length("text") >= LENGTH).select(bucket.alias("bucket"), F.col("__owner").alias("owner"), F.col("__id").alias("id"), F.col("__key").alias("key"), "text", none("binary").alias("sizes"), none("binary").alias("high"), none("binary").alias("low"))
    told = shared.select("bucket", none("long").alias("owner"), none("long").alias("id"), none("long").alias("key"), none("string").alias("text"), "sizes", "high", "low")
    both = texts.unionByName(told).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("owner").asc_nulls_first(), "id")
    strings = scratch.write(both.mapInArrow(lean(strings_of(ranges, texts_in)), STRINGS), "strings")
    scratch.drop("shared")
    strings_only = strings.where("place is not null").select("place", "hashes", "ids", "keys", "starts", "spans", "sizes", "data")
    found = strings_only.repartition(n, "place").sortWithinPartitions("place").mapInArrow(lean(sorted_ranges(texts_in)), REMOVED)
    removed = scratch.write(strings.where("place is null").select("bucket", "keys", "ids", F.col("starts").alias("firsts"), F.col("spans").alias("lengths")).unionByName(found), "removed")
    scratch.drop("strings")
    runs = removed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(runs_by_text), RUNS)
    gone = runs.select(F.col("key").alias("__gone_key"), F.col("id").alias("__gone_id"), F.array("runs").alias("__runs"))
    joined = docs.join(gone, (F.col("__key") == F.col("__gone_key")) & (F.col("__id") == F.col("__gone_id")), "left")
    return joined.drop("__gone_key", "__gone_id", "__id", "__owner", "__key")


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DIGESTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def digested(batches: Batches) -> Batches:
    for batch in batches:
        rows = []
        for i, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data, spans = (text or "").encode(), covered(runs or [])
            rows.append((i, len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
        if rows:
            yield _batch(rows, DIGESTS_ARROW)


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs (doc_id, text).

    A byte goes if a string of LENGTH bytes around it also starts in a document with a smaller doc_id. Null texts count
    as empty; shorter texts keep everything; null ids are larger than all others; rows of one id never remove each
    other. Other columns are ignored.
    """
    return with_runs(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long"), "text", "__runs").mapInArrow(lean(digested), DIGESTS)


def _kept(text: pd.Series, runs: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else kept_text(t.encode(), covered(list(r) if r is not None else [])) for t, r in zip(text, runs, strict=True)], dtype=object)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated strings removed from text, at whole characters; the other columns stay as they are."""
    out = with_runs(docs)
    # told to be non-deterministic, so that filters on the new text don't run it (and a worker) a second time
    kept = F.pandas_udf(_kept, "string").asNondeterministic()
    return out.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(kept("text", "__runs"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
