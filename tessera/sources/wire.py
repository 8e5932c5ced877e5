"""Rows as messages in a tagged binary form: numbered fields, varints, lengths before texts and messages, no schema inside.

Encoding and decoding are functions from DataFrames to DataFrames; unknown fields are kept through a round trip.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: How a value stands on the wire: a varint, eight bytes, a length and bytes, four bytes.
VARINT, EIGHT, LENGTH, FOUR = 0, 1, 2, 5
#: Wire types by kind. int: two's complement of 64 bits; sint: zigzag; message: nested fields.
KINDS = {"int": VARINT, "sint": VARINT, "bool": VARINT, "double": EIGHT, "float": FOUR, "string": LENGTH, "bytes": LENGTH, "message": LENGTH}
TYPES = {"int": T.LongType(), "sint": T.LongType(), "bool": T.BooleanType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "bytes": T.BinaryType()}
#: The column that holds fields of other numbers, as they came.
UNKNOWN = "unknown_fields"


@dataclass(frozen=True)
class Field:
    """A field of a message: number, name, kind, whether it repeats, and the fields of a nested message."""

    number: int
    name: str
    kind: str
    repeated: bool = False
    fields: tuple[Field, ...] = ()

    @property
    def packed(self) -> bool:
        """Repeated numbers stand together behind one tag."""
        return self.repeated and KINDS[self.kind] != LENGTH

    def type(self) -> T.DataType:
        one = schema(self.fields) if self.kind == "message" else TYPES[self.kind]
        return T.ArrayType(one) if self.repeated else one


def schema(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.type()) for f in fields), T.StructField(UNKNOWN, T.BinaryType())])


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError(f"a varint is cut or too long at byte {at}")
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n & (1 << 64) - 1, at


def scalar(kind: str, value) -> bytes:
    if kind == "int":
        return varint(value)
    if kind == "sint":
        return varint(value << 1 if value >= 0 else -value * 2 - 1)
    if kind == "bool":
        return varint(int(value))
    if kind in ("double", "float"):
        return struct.pack("<d" if kind == "double" else "<f", value)
    data = value.encode() if kind == "string" else bytes(value)
    return varint(len(data)) + data


def encoded(fields: tuple[Field, ...], row: dict) -> bytes:
    """The message of a row; fields by number, absent ones (null, empty lists) left out, unknown ones at the end."""
    out = bytearray()
    for f in sorted(fields, key=lambda f: f.number):
        value = row.get(f.name)
        if value is None or (f.repeated and not value):
            continue
        tag = varint(f.number << 3 | KINDS[f.kind])
        if f.packed:
            body = b"".join(scalar(f.kind, v) for v in value)
            out += varint(f.number << 3 | LENGTH) + varint(len(body)) + body
            continue
        for v in value if f.repeated else [value]:
            out += tag + (scalar("bytes", encoded(f.fields, v)) if f.kind == "message" else scalar(f.kind, v))
    return bytes(out) + (row.get(UNKNOWN) or b"")


def taken(data: bytes, at: int, wire: int) -> tuple[int | bytes, int]:
    """What stands at a place in a wire type, and the place behind it."""
    if wire == VARINT:
        return read_varint(data, at)
    if wire == LENGTH:
        size, at = read_varint(data, at)
    elif wire in (EIGHT, FOUR):
        size = 8 if wire == EIGHT else 4
    else:
        raise ValueError(f"wire type {wire} at byte {at}")
    if at + size > len(data):
        raise ValueError(f"a field is cut at byte {at}")
    return data[at : at + size], at + size


def value_of(f: Field, raw: int | bytes):
    if f.kind == "int":
        return raw - (1 << 64) if raw >> 63 else raw
    if f.kind == "sint":
        return raw >> 1 if raw & 1 == 0 else -(raw >> 1) - 1
    if f.kind == "bool":
        return bool(raw)
    if f.kind in ("double", "float"):
        return struct.unpack("<d" if f.kind == "double" else "<f", raw)[0]
    if f.kind == "message":
        return decoded(f.fields, raw)
    return raw.decode() if f.kind == "string" else raw


def decoded(fields: tuple[Field, ...], data: bytes) -> dict:
    """The row of a message: the last of several values counts, repeated fields gather, other numbers go to UNKNOWN."""
    known, at = {f.number: f for f in fields}, 0
    row: dict = {f.name: [] if f.repeated else None for f in fields}
    unknown = bytearray()
    while at < len(data):
        begin = at
        tag, at = read_varint(data, at)
        wire, f = tag & 7, known.get(tag >> 3)
        raw, at = taken(data, at, wire)
        if f is not None and f.packed and wire == LENGTH:
            k = 0
            while k < len(raw):
                one, k = taken(raw, k, KINDS[f.kind])
                row[f.name].append(value_of(f, one))
        elif f is None or wire != KINDS[f.kind]:
            unknown += data[begin:at]
        elif f.repeated:
            row[f.name].append(value_of(f, raw))
        else:
            row[f.name] = value_of(f, raw)
    row[UNKNOWN] = bytes(unknown) or None
    return row


def encode(df: DataFrame, fields: tuple[Field, ...], keys: list[str], column: str = "message") -> DataFrame:
    """(keys, message) of rows whose other columns are the fields; columns that are no field are left out."""
    names = [f.name for f in fields] + [c for c in df.columns if c == UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(names).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([encoded(fields, r) for r in rows], pa.binary())], [*keys, column])

    out = T.StructType([*(df.schema[k] for k in keys), T.StructField(column, T.BinaryType())])
    return df.select(*dict.fromkeys([*keys, *names])).mapInArrow(run, out)


def decode(df: DataFrame, fields: tuple[Field, ...], keys: list[str], column: str = "message") -> DataFrame:
    """(keys, fields, unknown_fields) of rows of messages; a null message has only nulls. A damaged one is an error."""
    inner = schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in inner.fields]
        for batch in batches:
            rows = [decoded(fields, m) if m is not None else {} for m in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([r.get(f.name) for r in rows], t) for f, t in zip(inner.fields, types, strict=True))], [*keys, *inner.names])

    return df.select(*keys, column).mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), *inner.fields]))
