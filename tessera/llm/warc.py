"""Operator 9: WARC archives written from, and read back into, a chunked record table.

A payload is a run of rows (record, chunk number, bytes) of bounded size; what does not fit one WARC record goes on
in continuation records (the format's segmentation), so no step holds a whole oversized payload. Digests are carried
from chunk to chunk. Archives are gzipped WARC 1.1 files made by Spark's text writer, one record a row; each file starts
with a warcinfo record. The reader takes any WARC file of text payloads: Spark splits files at version lines, and a
parser puts together again, by the records' lengths, what a payload with such a line in it was split into.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, Scratch, partitions, shared_dir, small_batches, table

#: Payload bytes of a chunk, which is also the most that one WARC record holds.
CHUNK_BYTES = 1 << 18
#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT_BYTES = 0
#: Records of an archive file, its warcinfo among them; a gzipped file is read by one task, so files stay small.
FILE_RECORDS = 5_000
#: Bytes of payload that a task holds before it passes rows on.
HELD_BYTES = 4 << 20

CHUNKS = "page_id long, row string, url string, chunk int, offset long, data string, last boolean, payload_bytes long, payload_digest string"
CHUNKS_ARROW = pa.schema([("page_id", pa.int64()), ("row", pa.string()), ("url", pa.string()), ("chunk", pa.int32()), ("offset", pa.int64()), ("data", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
BACK_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

DATE = "2024-01-01T00:00:00Z"


def pieces(text: str, most: int) -> Iterator[bytes]:
    """UTF-8 bytes of a text in runs of at most `most` bytes that end between characters; one empty run if it's empty."""
    held, step = b"", max(1, most // 4)  # a character has at most four bytes
    for at in range(0, max(len(text), 1), step):
        more = text[at : at + step].encode()
        if len(held) + len(more) > most:
            yield held
            held = b""
        held += more
    yield held


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def chunked(most: int):
    """(page_id, url, html) to rows of the chunked record table; size and digest stand in a record's last row."""

    def passed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), CHUNKS_ARROW, strict=True)], schema=CHUNKS_ARROW)

    def run(batches: Batches) -> Batches:
        rows, size_held = [], 0
        for batch in batches:
            for page, url, html in zip(*batch.columns, strict=True):  # one payload at a time becomes a string
                sha, size, row = hashlib.sha1(), 0, uuid.uuid4().hex
                page, url, held = page.as_py(), url.as_py(), None
                for k, data in enumerate(pieces(html.as_py() or "", most)):
                    if held:
                        rows.append((*held, False, None, None))
                    held = (page, row, url, k, size, data.decode())
                    sha.update(data)
                    size += len(data)
                    size_held += len(data) + 200
                    if rows and size_held > HELD_BYTES:
                        yield passed(rows)
                        rows, size_held = [], len(data)
                rows.append((*held, True, size, base32(sha)))
        if rows:
            yield passed(rows)

    return run


def record_table(pages: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of pages (page_id, url, html); null payloads are empty. Rows with one page_id are records of their own."""
    small_batches(pages.sparkSession, 64)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(chunked(most), CHUNKS)


def with_originals(chunks: DataFrame, least: int) -> DataFrame:
    """Each record's (row, payload_bytes, payload_digest, refers_to): of equal payloads the smallest page_id is stored.

    One stored record a digest is found with map-side minima, so a payload that very many pages share moves once a
    task; null ids come after all others.
    """
    ends = chunks.where("last").select("page_id", "row", "payload_bytes", "payload_digest")
    rank = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "row")
    firsts = ends.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min(rank).alias("first"))
    same = ["payload_digest", "payload_bytes"]
    both = ends.join(firsts, same, "left").withColumn("revisit", F.coalesce(F.col("first.row") != F.col("row"), F.lit(False)))
    return both.select("row", "payload_bytes", "payload_digest", "revisit", F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to"))


def warcinfo(archive: str) -> str:
    """The record that a file starts with, but for the final line feed."""
    said = "software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = ("WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{archive}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(said)}")
    return "\r\n".join(head) + "\r\n\r\n" + said + "\r\n\r"


def with_warcinfo(archive: str):
    """Record texts with a warcinfo before the first one of every file, of FILE_RECORDS records."""

    def run(batches: Batches) -> Batches:
        n = 0
        for batch in batches:
            at, values = 0, batch.column(0)
            while at < len(values):
                if n % FILE_RECORDS == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([warcinfo(archive)])], names=["value"])
                    n += 1
                take = min(len(values) - at, FILE_RECORDS - n % FILE_RECORDS)
                yield pa.RecordBatch.from_arrays([values.slice(at, take)], names=["value"])
                at, n = at + take, n + take

    return run


def record_text(archive: str) -> F.Column:
    """A chunk row's whole WARC record, but for the final line feed, which the text writer puts."""
    end = F.lit("\r\n")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, end)
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    kind = F.when(F.col("chunk") > 0, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    first, many = F.col("chunk") == 0, (F.col("chunk") > 0) | ~F.col("last")
    data = F.when(F.col("revisit"), "").otherwise(F.col("data"))
    name = lambda chunk: F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("row"), F.lit(":"), chunk, F.lit(">"))
    none = F.lit("")
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", name(F.col("chunk").cast("string"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.lit(DATE)),
        F.when(first & F.col("payload_digest").isNotNull(), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))).otherwise(none),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("none")), F.lit(">"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(none),
        F.when(many, F.concat(line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string")), F.when(~first, line("WARC-Segment-Origin-ID", name(F.lit("0")))).otherwise(none), F.when(F.col("last"), line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"))).otherwise(none))).otherwise(none),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(data).cast("string")),
        end, data, F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, scratch: Scratch, least: int = LEAST_REVISIT_BYTES, most: int = CHUNK_BYTES) -> str:
    """Writes WARC files of pages to the folder at path; gives the id of their warcinfo, by which they are read."""
    archive = str(uuid.uuid4())
    chunks = scratch.write(record_table(pages, most), "chunks")
    found = with_originals(chunks, least).withColumnRenamed("payload_bytes", "size").withColumnRenamed("payload_digest", "digest")
    rows = chunks.drop("payload_bytes", "payload_digest").join(found, "row").withColumns({"payload_bytes": F.col("size"), "payload_digest": F.col("digest")})
    # of a revisit only its first row is a record
    rows = rows.where(~F.col("revisit") | (F.col("chunk") == 0)).withColumn("last", F.col("last") | F.col("revisit"))
    texts = rows.select(record_text(archive).alias("value")).mapInArrow(with_warcinfo(archive), "value string")
    texts.write.option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)
    scratch.drop("chunks")
    return archive


def whole_records(batches: Batches) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, payload) of pieces (file, value) of files that were split at version lines.

    A piece shorter than its record's length was split inside its payload: it goes on with the next piece of its file.
    """
    file, head, payload, need = None, None, b"", 0
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != file and need > 0:
                raise ValueError(f"{file}: the last record is cut off")
            if need > 0:  # VERSION was a part of the payload
                payload += VERSION.encode() + value
            else:
                _, _, rest = value.partition(b"\r\n")  # the version's number
                said, _, payload = rest.partition(b"\r\n\r\n")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in said.decode("utf-8", "replace").split("\r\n")) if v}
                if not head:
                    continue  # what stands before a file's first record
            file, size = name, int(head["content-length"])
            need = size - len(payload)
            if need <= 0:
                if payload[size:].strip(b"\r\n"):
                    raise ValueError(f"record {head.get('warc-record-id')}: {len(payload)} bytes where {size} are told")
                yield head, payload[:size]
    if need > 0:
        raise ValueError(f"{file}: the last record is cut off")


def parsed(batches: Batches, keep: bool = True) -> Batches:
    """Pieces of archives (file, value) that this module has written to (row, chunk, data, headers).

    keep=False: a payload in one piece is checked against its digest here and left out; only segments go on.
    """
    rows, held = [], 0
    for fields, data in whole_records(batches):
        if fields["warc-type"] == "warcinfo":
            continue
        page, row, chunk = fields["warc-record-id"][len("<urn:page:") : -1].split(":")
        refers = fields.get("warc-refers-to", "<urn:page:none>")[len("<urn:page:") : -1]
        digest, told = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(fields.get("x-payload-length", -1))
        if fields["warc-type"] == "response" and "warc-segment-number" not in fields and not keep:
            if base32(hashlib.sha1(data)) != digest:
                raise ValueError(f"record {fields['warc-record-id']}: the payload read back has another digest")
            told, data = len(data), None
        rows.append((row, int(chunk), None if page == "none" else int(page), fields["warc-type"], data, digest, told, None if refers == "none" else int(refers), int(fields.get("warc-segment-total-length", -1))))
        held += len(data or b"") + 200
        if held > HELD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PARSED_ARROW, strict=True)], schema=PARSED_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PARSED_ARROW, strict=True)], schema=PARSED_ARROW)


PARSED = "row string, chunk int, page_id long, kind string, data binary, digest string, told_bytes long, refers_to long, total long"
PARSED_ARROW = pa.schema([("row", pa.string()), ("chunk", pa.int32()), ("page_id", pa.int64()), ("kind", pa.string()), ("data", pa.binary()), ("digest", pa.string()), ("told_bytes", pa.int64()), ("refers_to", pa.int64()), ("total", pa.int64())])


#: Files are split where a record may start.
VERSION = "WARC/1."


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, value binary): the files at path, split at VERSION, in order. Gzipped files are read by one task each."""
    small_batches(spark, 64)
    return spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def read_records(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """The chunked record table of the archives at path: (row, chunk, page_id, kind, data, ...); see parsed()."""
    return pieces_of(spark, path).mapInArrow(lambda batches: parsed(batches, keep), PARSED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, date, content_type, headers map, payload binary) of the records of any WARC files at path.

    Files should be gzipped, or small enough for one task: a record's parts must stay in one task's order. A record is
    held whole; writers of very large ones use segments.
    """
    names = ["warc-record-id", "warc-type", "warc-target-uri", "warc-date", "content-type"]

    def run(batches: Batches) -> Batches:
        for head, payload in whole_records(batches):
            row = [*([head.get(n)] for n in names), [list(head.items())], [payload]]
            kinds = [*[pa.string()] * len(names), pa.map_(pa.string(), pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["record_id", "type", "uri", "date", "content_type", "headers", "payload"])

    return pieces_of(spark, path).mapInArrow(run, "record_id string, type string, uri string, date string, content_type string, headers map<string, string>, payload binary")


def folded(batches: Batches) -> Batches:
    """Chunk rows sorted by (row, chunk) to one row a record; digest and length grow chunk by chunk."""
    state: list = []

    def closed() -> tuple:
        row, chunk, page, kind, digest, told, refers, total, sha, size = state
        if kind == "revisit" or told >= 0:  # told: a payload that parsed() has checked
            return page, told, digest, kind, refers
        if base32(sha) != digest or total not in (-1, size):
            raise ValueError(f"record {row}: the payload read back has another digest or length")
        return page, size, digest, kind, None

    for batch in batches:
        rows = []
        for row, chunk, page, kind, data, digest, told, refers, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state and state[0] == row:
                if chunk != state[1] + 1:
                    raise ValueError(f"record {row}: segment {state[1] + 2} is missing")
                state[1], state[7] = chunk, total
            else:
                if state:
                    rows.append(closed())
                state[:] = [row, chunk, page, kind, digest, told, refers, total, hashlib.sha1(), 0]
            state[8].update(data or b"")
            state[9] += len(data or b"")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), BACK_ARROW, strict=True)], schema=BACK_ARROW)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(closed(), BACK_ARROW, strict=True)], schema=BACK_ARROW)


def read_archives(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, its payload checked against its digest.

    A payload in one piece is checked where it is read. The segments of others are brought together in order and folded
    chunk by chunk, whatever the payload's size. archive, the id of the warcinfo, isn't needed for reading. An archive
    without records gives no rows.
    """
    records = read_records(spark, path, keep=False)
    n = partitions(spark)
    return records.repartition(n, "row").sortWithinPartitions("row", "chunk").mapInArrow(folded, BACK)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive = write_archives(table(spark, sf_dir, "pages"), path, Scratch(spark))
    return read_archives(spark, path, archive)


SQL = {
    "op9_warc": """
with p as (select page_id, encode(coalesce(html, '')) data from pages),
d as (select page_id, octet_length(data)::bigint payload_bytes, sha1(data) h from p),
f as (select *, min(page_id) over (partition by h, payload_bytes) first from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substring(h, (i * 5) // 4 + 1, 2))::ubigint >> (3 - (i * 5) % 4)) & 31)::int, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id = first then null else first end refers_to
from f
"""
}
