"""Messages against bytes put together by hand, and round trips."""

import math

import pytest

from tessera.sources import wire
from tessera.sources.wire import Field

LINE = (Field(1, "n", "int"), Field(2, "label", "string"))
FIELDS = (Field(1, "a", "int"), Field(2, "b", "string"), Field(3, "c", "message", False, LINE), Field(4, "d", "int", True), Field(5, "e", "sint"), Field(6, "f", "double"), Field(7, "g", "bool"), Field(8, "h", "message", True, LINE), Field(16, "i", "bytes"), Field(17, "j", "float", True), Field(18, "k", "string", True))


@pytest.mark.parametrize(
    ("row", "data"),
    [
        ({"a": 150}, "089601"),
        ({"b": "testing"}, "120774657374696e67"),
        ({"c": {"n": 150}}, "1a03089601"),
        ({"d": [3, 270, 86942]}, "2206038e029ea705"),
        ({"a": -1}, "08ffffffffffffffffff01"),
        ({"e": -1}, "2801"),
        ({"e": 1}, "2802"),
        ({"e": -(2**63)}, "28ffffffffffffffffff01"),
        ({"f": 1.0, "g": True}, "31000000000000f03f3801"),
        ({"h": [{"n": 1}, {"label": "x"}]}, "42020801420312 0178"),
        ({"i": b"\x00\xff"}, "82010200ff"),
        ({"j": [0.5]}, "8a01040000003f"),
        ({"k": ["", "é"]}, "92010092 0102c3a9"),
        ({}, ""),
    ],
)
def test_known_messages(row, data):
    data = bytes.fromhex(data)
    assert wire.encoded(FIELDS, row) == data
    back = wire.decoded(FIELDS, data)
    assert wire.encoded(FIELDS, back) == data
    for k, v in row.items():
        got = back[k]
        assert got == v or (k in "ch" and [{x: y for x, y in m.items() if y is not None} for m in ([got] if k == "c" else got)] == ([v] if k == "c" else v))


def test_unknown_and_damaged_fields():
    data = wire.encoded(FIELDS, {"a": 5, "b": "x", "c": {"n": 1, "label": "y"}, "d": [1, 2]})
    less = (Field(2, "b", "string"), Field(3, "c", "message", False, LINE[:1]))
    row = wire.decoded(less, data)
    assert row["b"] == "x" and row["c"]["n"] == 1
    assert wire.decoded(FIELDS, wire.encoded(less, row)) == wire.decoded(FIELDS, data)
    # unpacked repeats, and the last of several values
    assert wire.decoded(FIELDS, bytes.fromhex("2003200408010802"))["d"] == [3, 4] and wire.decoded(FIELDS, bytes.fromhex("08010802"))["a"] == 2
    for bad in ("08", "0a05", "12ff", "0b", "08ffffffffffffffffffff01"):
        with pytest.raises(ValueError, match="byte"):
            wire.decoded(FIELDS, bytes.fromhex(bad))


def test_rows_there_and_back(spark):
    rows = [(k, -k if k % 2 else None, "é" * k, (k, None), [k, -k, 2**62], k - 3, k / 7, k % 2 == 0, [(k, "x"), (None, "")], bytes([k]), [0.5 * k], ["a", ""]) for k in range(9)] + [(None,) * 12, (9, 0, "", (None, None), [], 0, math.inf, False, [], b"", [], [])]
    kinds = "key long, a long, b string, c struct<n long, label string>, d array<long>, e long, f double, g boolean, h array<struct<n long, label string>>, i binary, j array<float>, k array<string>"
    df = spark.createDataFrame(rows, kinds)
    there = wire.encode(df, FIELDS, ["key"])
    back = wire.decode(there, FIELDS, ["key"])
    clean = lambda v: {k: clean(x) for k, x in v.items() if k != wire.UNKNOWN} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list) else v
    got = sorted((clean(r.asDict(True)) for r in back.collect()), key=repr)
    want = sorted(({k: [] if v is None and k in "dhjk" else v for k, v in r.asDict(True).items()} for r in df.collect()), key=repr)
    assert got == want
    again = wire.encode(back, FIELDS, ["key"])
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, there.collect()), key=repr)
