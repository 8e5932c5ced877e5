"""Operator 4: exact token counts at every prefix of a text, by dynamic programming.

A BPE encoding has this property: cut it after any token, and what stands before is the encoding of its own text.
So the encoding of a prefix is the encoding of a shorter prefix and one last token, and the last token is the one
whose pair with the token before it would be encoded as these two. last[i] and count[i] follow from shorter prefixes.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, small_batches, table, texts

#: Token limit of the registered query.
TOKEN_LIMIT = 4096
#: Entries of a worker's table of pairs, and of its table of units' prefix counts; a full table starts anew.
REMEMBERED, REMEMBERED_UNITS = 200_000, 600_000
#: Longer units are counted, not remembered.
LONGEST_REMEMBERED = 32

#: Runs of letters, or of other characters, with the blanks before them. No piece reaches over the end of one (this is
#: checked when a model is loaded), so units are encoded one by one.
UNITS = regex.compile(r"\n| *\p{L}+| *[^\p{L} \n]+| +").findall


class PrefixCounter:
    """Counts of a sentencepiece BPE model with byte fallback, identity normalisation and a dummy blank in front."""

    def __init__(self, path: str):
        import sentencepiece as spm

        sp = spm.SentencePieceProcessor(model_file=path)
        scores = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(UNITS(p) != [p] or (p[:2] == "  " and p.strip(" ")) for p in scores):
            raise ValueError("a piece of this model crosses units")
        #: characters first, then merged pieces in the order of their merges
        self.rank = {p: i for i, p in enumerate(sorted(scores, key=lambda p: (len(p) > 1, -scores[p], p)))}
        self.longest = max(map(len, self.rank))
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: the stored counts: of each unit at every prefix, as bytes of 1 or 4 a count
        self.units: dict[str, bytes | array] = {}

    def split_of(self, token: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the token; itself twice for a character; None if plain BPE never makes it."""
        if token not in self.halves:
            parts, rank = list(token), self.rank
            while len(parts) > 2:
                best, at = min((rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (token, token) if len(parts) == 1 else tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def stays(self, a: str, b: str) -> bool:
        """Whether the text of token a and token b is encoded as these two (a empty: b alone as itself).

        Merges are undone from the last one back; no earlier state may hold, at the border, two parts that merge
        before the one just undone.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.split_of(b) is not None and (not a or self.border_holds(a, b))
        return found

    def border_holds(self, a: str, b: str) -> bool:
        rank, limit = self.rank, np.inf
        while True:
            if rank.get(a + b, np.inf) < limit:
                return False
            for first in (rank[a] > rank[b], rank[a] <= rank[b]):  # undo the later merge; else the other one
                if first and len(a) > 1:
                    limit, a = rank[a], self.split_of(a)[1]
                    break
                if not first and len(b) > 1:
                    limit, b = rank[b] + 1, self.split_of(b)[0]
                    break
            else:
                return True

    def counted(self, u: str) -> list[int]:
        """Tokens of u[:1], u[:2], ..., u."""
        rank, longest, stays = self.rank, self.longest, self.stays
        last, count = [""], [0]
        for i in range(1, len(u) + 1):
            for j in range(max(0, i - longest), i):
                t = u[j:i]
                if t in rank and stays(last[j], t):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:  # no piece: the character's bytes, and nothing merges with them
                last.append("")
                count.append(count[i - 1] + len(u[i - 1].encode("utf-8", "surrogatepass")))
        del count[0]
        return count

    def unit(self, u: str) -> bytes | array:
        found = self.units.get(u)
        if found is None:
            counts = self.counted(u)
            found = bytes(counts) if max(counts) < 256 else array("I", counts)
            if len(u) <= LONGEST_REMEMBERED:
                if len(self.units) > REMEMBERED_UNITS:
                    self.units.clear()
                self.units[u] = found
        return found

    def split(self, text: str) -> list[str]:
        return UNITS(" " + text.replace("▁", " ")) if text else []

    def within(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and how many of its code points fit the budget, from the stored counts of its units.

        Counts in a unit can fall again, so the last unit that starts below the budget is sought for the longest prefix
        that fits, then the ones before it.
        """
        known, make = self.units.get, self.unit
        stored = [known(u) or make(u) for u in self.split(text)]
        ends = [c[-1] for c in stored]
        total = sum(ends)
        if total <= budget:
            return total, len(text)
        base, size = total, sum(map(len, stored)) - 1  # the dummy blank is no code point of the text
        for k in range(len(stored) - 1, -1, -1):
            base, size = base - ends[k], size - len(stored[k])
            if base < budget:
                fits = [j for j, c in enumerate(stored[k], 1) if base + c <= budget]
                if fits and size + fits[-1] > 0:
                    return total, size + fits[-1]
        return total, 0

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of text[:0], text[:1], ..., text."""
        out, base = [0], 0
        for k, u in enumerate(self.split(text)):
            own = self.unit(u)
            out.extend([base + c for c in (list(own)[1:] if k == 0 else own)])  # the dummy blank alone is no prefix
            base += own[-1]
        return np.array(out, np.int32)


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def mapped(path: str, make: Callable, arrow: pa.Schema) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *make(own, texts(b.column(1)), arrow)], schema=arrow)

    return run


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts array<int>) of docs (doc_id, text): counts[i] is the token count of the first i code points.

    Null and empty texts give [0]. Repeated rows and null ids stay; other columns are ignored. No shuffle.
    """
    small_batches(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])
    make = lambda own, said, s: [pa.array([own.prefixes(t) for t in said], s.field(1).type)]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mapped(path, make, arrow), "doc_id long, counts array<int>")


def tokens_of_prefix(counts: Column, n_chars: Column) -> Column:
    """Token count of the first n_chars code points, from stored counts."""
    return F.get(counts, F.least(n_chars, F.size(counts) - 1))


def longest_within(counts: Column, budget: int) -> Column:
    """The most code points whose tokens fit the budget, from stored counts (a longer prefix can have fewer tokens)."""
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True)


def token_totals(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within_limit) of docs (doc_id, text).

    n_tokens is the count at the last prefix, chars_within_limit the longest prefix of at most limit tokens, both from
    the prefix counts that are stored by unit. Null and empty texts have none; repeated rows and null ids stay, one
    result a row; other columns are ignored; an empty table stays empty. A very long unit is counted, not stored, in
    time that grows with its length times the longest piece.
    """
    small_batches(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("chars_within_limit", pa.int64())])

    def make(own: PrefixCounter, said: list[str], _) -> list[pa.Array]:
        found = [own.within(t, limit) for t in said]
        return [pa.array([len(t.encode()) for t in said], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))]

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mapped(path, make, arrow), "doc_id long, n_bytes long, n_tokens long, chars_within_limit long")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within_limit")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_totals(table(spark, sf_dir, "documents"), default_path(), TOKEN_LIMIT).drop("chars_within_limit")


def op4_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4_token_counts, with the longest prefix of each text that the limit allows."""
    return token_totals(table(spark, sf_dir, "documents"), default_path(), TOKEN_LIMIT)
