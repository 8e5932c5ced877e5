"""Operator 11: conversations repaired by a forward Viterbi pass over four grammar states.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Its
states are start, s, u and a: the initial of the last turn kept. Rows of a conversation are sorted by ranges, so a long
conversation spans partitions: each piece of it becomes a table of least (cost, audit) from state to state, and a fold
over a conversation's pieces chooses among them. Conversations inside a partition are finished there.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, lean, small_batches, table

#: A piece of a conversation ends after about so many bytes of text or so many rows.
PIECE_BYTES, PIECE_ROWS = 4 << 20, 50_000
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: What inserted turns lead to from a state: (number of inserts, state). More inserts come back to a state at a cost.
CLOSURE = {START: ((0, START), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
INITIALS = ("s", "u", "a")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
OUT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows by crc32 of conv_id:turn, n times each; 0 for a row that is dropped.

    Nulls count as one space, apart from conv_id and turn themselves, which stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("n"))


def described(rows: DataFrame) -> DataFrame:
    """rows with (k, fault): a digest of role and text, and 2 for blank texts, 1 for truncated ones, else 0."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", 2).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    return rows.withColumns({"k": digest(F.col("role"), F.col("text")), "fault": fault})


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def later_copies(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, k) of texts that an earlier turn of their conversation has in the same role.

    Narrow rows only: the first turn of each digest by a grouping, joined where there are other turns.
    """
    narrow = rows.where("n > 0 and fault < 2").select("conv_id", "turn", "k")
    firsts = narrow.groupBy(F.col("conv_id").alias("c"), F.col("k").alias("d")).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.bool_or(F.isnull("turn")).alias("open"))
    firsts = firsts.where("lo < hi or (open and lo is not null)")
    later = F.col("turn").isNotNull() & (F.col("open") | (F.col("turn") > F.col("lo")))
    return narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("d"))).where(later).select("conv_id", "turn", "k").distinct()


def merged_copies(batches: Batches) -> Batches:
    """Equal rows of a batch as one, with their number: copies of one row don't fill a range."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t.group_by(["conv_id", "turn", "k", "fault", "role", "text"]).aggregate([("n", "sum")]).rename_columns(["conv_id", "turn", "k", "fault", "role", "text", "n"])
        t = t.set_column(6, "n", t["n"].cast(pa.int64())).select(batch.schema.names)
        yield from t.combine_chunks().to_batches()


@lru_cache(maxsize=None)
def step(layer: tuple, initial: str, fault: int) -> tuple:
    """The next layer after a row, what all its costs are above the one before, and from which state by which edits.

    A layer holds for each state None or (cost above the least, rank of its audit). Audits of a layer end on a row's own
    edit, so none starts another, and their order stays whatever follows: ranks replace them. States that can't win any
    more, not even by a tie, are left out, so there are few layers: from a, any end of start costs at most a deletion
    more (of a system turn that start may keep), and any end of s no more.
    """
    best: list = [None] * 4
    for i, found in enumerate(layer):
        if found is None:
            continue
        for inserts, at in CLOSURE[i]:
            cost, before = found[0] + INSERT * inserts, "I" * inserts
            moves = [(cost + DELETE, before + "D", at)]
            if fault < 2:
                cost += CUT * fault
                kept = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}.get((initial, at))
                if kept is not None:
                    moves.append((cost, before + "K", kept))
                moves.append((cost + REROLE, before + "R", ASSISTANT if at == USER else USER))
            for c, edits, j in moves:
                if best[j] is None or (c, found[1], edits) < best[j][:3]:
                    best[j] = (c, found[1], edits, i)
    ended = min(x[0] + d for x, d in zip(best, (2 * INSERT, 2 * INSERT, INSERT, 0), strict=True) if x)
    if best[START] and best[START][0] > ended + DELETE:
        best[START] = None
    if best[SYSTEM] and best[SYSTEM][0] > ended:
        best[SYSTEM] = None
    order = {j: r for r, j in enumerate(sorted((j for j in range(4) if best[j]), key=lambda j: best[j][1:3]))}
    least = min(x[0] for x in best if x)
    return tuple(x and (x[0] - least, order[j]) for j, x in enumerate(best)), least, tuple(x and (x[3], x[2]) for x in best)


def paths(rows: list, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of rows (initial, fault) from a state to each other that they may end in."""
    layer, total, back = tuple((0, 0) if j == entry else None for j in range(4)), 0, []
    for initial, fault in rows:
        layer, more, came = step(layer, initial, fault)
        total += more
        back.append(came)
    found = {}
    for j in range(4):
        if layer[j]:
            at, edits = j, []
            for came in reversed(back):
                at, e = came[at]
                edits.append(e)
            found[j] = (total + layer[j][0], "".join(reversed(edits)))
    return found


def repaired(rows: list, audit: str, at: int) -> Iterator[str]:
    """The turns that an audit's edits leave of rows (role, text), as role:text, from a state on."""
    row = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(row)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if at == USER else "user"
        at = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield f"{role}:{text}"


class Piece:
    """Consecutive rows of one conversation, as they are read."""

    def __init__(self, conv, turn, k, part: int = 0):
        self.conv, self.turn, self.k, self.part = conv, turn, k, part
        self.rows, self.classes, self.size = [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = None

    def add(self, turn, role: str, text: str, fault: int, n: int, seen: bool) -> None:
        """A row, n times. Turns don't fall; seen tells that its first copy isn't the first of the conversation."""
        if turn is not None:
            self.lo = turn if self.lo is None else self.lo
            self.turns += turn != self.hi
            self.hi = turn
        first = role[:1]
        for copy in range(n):
            gone = fault == 2 or seen or copy > 0
            self.blank += fault == 2
            self.duplicate += fault < 2 and gone
            self.truncated += fault == 1 and not gone
            self.illegal += bool(self.classes) and (self.classes[-1][0], first) not in LEGAL
            self.classes.append((first if first in INITIALS else "-", 2 if gone else fault))
            self.rows.append((role, text))
        self.size += len(text) + len(role)

    @property
    def full(self) -> bool:
        return self.size >= PIECE_BYTES or len(self.rows) >= PIECE_ROWS


class Fold:
    """A conversation's pieces, folded in order: for each state the least (cost, audit) so far, its rank and the digest of
    what it leaves, so that texts are read once."""

    def __init__(self, conv):
        self.conv, self.kept = conv, {START: (0, 0, (), hashlib.sha256(), False)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.last = None

    def add(self, rows: list, classes: list, tables: dict, sums: tuple) -> None:
        """tables: paths() by entry state; sums: (blank, duplicate, truncated, illegal, turns, lo, hi) of the piece."""
        blank, duplicate, truncated, illegal, turns, lo, hi = sums
        self.blank, self.duplicate, self.truncated, self.illegal = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.illegal + illegal
        if classes:
            self.illegal += self.last is not None and (self.last, classes[0][0]) not in LEGAL
            self.last = classes[-1][0]
        if lo is not None:
            self.turns += turns - (self.hi == lo)
            self.lo, self.hi = lo if self.lo is None else self.lo, hi
        best = {}
        for i, (cost, rank, *_) in self.kept.items():
            for j, (more, edits) in tables[i].items():
                best[j] = min(best.get(j, (cost + more, rank, edits, i)), (cost + more, rank, edits, i))
        kept = {}
        for rank, j in enumerate(sorted(best, key=lambda j: best[j][1:3])):
            cost, _, edits, i = best[j]
            _, _, before, sha, begun = self.kept[i]
            sha = sha.copy()
            for line in repaired(rows, edits, i):
                sha.update((("\n" if begun else "") + line).encode())
                begun = True
            kept[j] = (cost, rank, (before, edits), sha, begun)
        self.kept = kept

    def result(self) -> tuple:
        ends = [(cost + INSERT * n, rank, n, j) for j, n in ((START, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)) if j in self.kept for cost, rank, *_ in [self.kept[j]]]
        cost, _, inserts, j = min(ends)
        _, _, chain, sha, begun = self.kept[j]
        for line in repaired([], "I" * inserts, j):
            sha.update((("\n" if begun else "") + line).encode())
            begun = True
        parts = ["I" * inserts]
        while chain:
            chain, edits = chain
            parts.append(edits)
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(parts)), sha.hexdigest())


def sums_of(p: Piece) -> tuple:
    return (p.blank, p.duplicate, p.truncated, p.illegal, p.turns, p.lo, p.hi)


def pieces(batches: Batches) -> Iterator[tuple[Piece, bool]]:
    """Sorted rows as pieces, and whether a piece is a whole conversation: not the first or the last of its partition, whose
    other rows may be elsewhere, and not cut."""
    piece, whole, marked, before = None, False, None, None
    first = True
    for batch in batches:
        for conv, turn, k, fault, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "k", "fault", "role", "text", "n")), strict=True):
            key = (conv, turn, k)
            if piece is None or piece.conv != conv:
                if piece is not None:
                    yield piece, whole
                piece, whole, first = Piece(conv, turn, k), not first, False
            if n < 0:
                marked = key
            while n > 0:
                if piece.full:
                    yield piece, False
                    piece, whole = Piece(conv, turn, k, piece.part + 1), False
                some = min(n, PIECE_ROWS)
                piece.add(turn, role, text, fault, some, key in (marked, before))
                before, n = key, n - some
    if piece is not None:
        yield piece, False


def layers(batches: Batches) -> Batches:
    """Finished conversations, and pieces of others for the fold."""
    kind = None

    def flush(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*NAMES, "turn", "k", "part", "piece"])

    def typed(source: Batches) -> Batches:
        nonlocal kind
        for b in source:
            kind = b.schema.field("conv_id").type
            yield b

    out, size = [], 0
    for p, whole in pieces(typed(batches)):
        if whole:
            fold = Fold(p.conv)
            fold.add(p.rows, p.classes, {START: paths(p.classes, START)}, sums_of(p))
            out.append((*fold.result(), None, None, None, None))
        else:
            tables = {entry: paths(p.classes, entry) for entry in range(4)}
            out.append((p.conv, *[None] * 8, p.turn, p.k, p.part, pickle.dumps((p.rows, p.classes, tables, sums_of(p)))))
        size += p.size
        if len(out) >= 4096 or size >= PIECE_BYTES:
            yield flush(out)
            out, size = [], 0
    if out:
        yield flush(out)


def folded(batches: Batches) -> Batches:
    """Finished conversations as they are; pieces, in order, folded by conversation."""
    fold, names = None, None
    for batch in batches:
        names, kind = list(NAMES), batch.schema.field("conv_id").type
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        done = batch.filter(pc.is_null(batch.column("piece"))).select(names)
        if done.num_rows:
            yield done
        out = []
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece"), strict=True):
            if not piece.is_valid:
                continue
            if fold is None or fold.conv != conv:
                if fold is not None:
                    out.append(fold.result())
                fold = Fold(conv)
            fold.add(*pickle.loads(piece.as_py()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if fold is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(fold.result(), types, strict=True)], names)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) of conversations, n copies each, repaired: a row a conversation.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). Null roles and texts must have been
    replaced. A null conv_id is a conversation of its own; null turns come first; rows of one turn are taken by a digest
    of role and text. Copies of a row stand side by side. A conversation whose rows all have n = 0 is empty. Other columns
    are not looked at. An empty table has no conversations. A turn's text must fit into one cell, however long; those of a
    conversation needn't fit into memory together, but its audit, a letter an edit, is one cell.
    """
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    small_batches(spark, 4096)
    rows = described(rows.select("conv_id", "turn", "role", "text", "n")).select("conv_id", "turn", "k", "fault", "role", "text", F.col("n").cast("long").alias("n"))
    marks = later_copies(rows).select("conv_id", "turn", "k", F.lit(0).alias("fault"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).cast("long").alias("n"))
    fewer = rows.mapInArrow(lean(merged_copies), f"conv_id {kind}, turn long, k binary, fault int, role string, text string, n long")
    dealt = fewer.unionByName(marks).repartitionByRange("conv_id", "turn", "k").sortWithinPartitions("conv_id", "turn", "k", "n")
    found = dealt.mapInArrow(lean(layers), OUT.format(kind=kind) + ", turn long, k binary, part long, piece binary")
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "k", "part").mapInArrow(folded, OUT.format(kind=kind))


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(table(spark, sf_dir, "conversations")))
