"""A message queue with visibility as a streaming source: messages are claimed, redelivered if their reader dies, deleted when done.

A queue is a folder of a file system with atomic renames. A sent file of messages lies in ready/; a reader claims it by
moving it to held/<reader>/<claim>/, where it stays out of others' sight until the claim expires, and deletes it once
the batch that read it has been committed. A file's name carries how often it has been claimed. Claims are the offsets
of the stream, so a batch that is run again after a crash reads the same claims.
"""

from __future__ import annotations

import posixpath
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

MESSAGES = "msg_id long, message string, deliveries int"
#: Messages of a file: what is claimed, redelivered and deleted together.
FILE_ROWS = 10_000
#: Files that a batch claims at most; the rest waits for later batches.
FILES_A_BATCH = 64


def sent(messages: DataFrame, path: str, rows: int = FILE_ROWS) -> None:
    """Messages (msg_id, message) put into the queue at path, in files of so many rows; all of them or none."""
    messages.select("msg_id", "message").write.mode("append").option("maxRecordsPerFile", rows).parquet(f"{path}/ready")


class Folder:
    """The queue's files as one reader sees them."""

    def __init__(self, path: str, reader: str):
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.own = posixpath.join(self.root, "held", reader)

    def names(self, folder: str, kind: fs.FileType) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == kind and not f.base_name.startswith(("_", ".")))

    def files(self, folder: str) -> list[str]:
        return self.names(folder, fs.FileType.File)

    def folders(self, folder: str) -> list[str]:
        return self.names(folder, fs.FileType.Directory)

    def moved(self, source: str, target: str) -> bool:
        """False if another reader was first."""
        try:
            self.fs.move(source, target)
        except FileNotFoundError:
            return False
        return True

    def last(self) -> int:
        """The reader's newest claim, kept apart from the claims, which are deleted."""
        try:
            with self.fs.open_input_file(posixpath.join(self.own, "_last")) as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def note(self, claim: int) -> None:
        at = posixpath.join(self.own, "_last")
        with self.fs.open_output_stream(f"{at}.new") as f:
            f.write(str(claim).encode())
        self.fs.move(f"{at}.new", at)

    def release_expired(self, now: int, since: int) -> None:
        """Files of all readers' claims that have expired are ready again, but for the own ones made since, which are being
        worked on. A claim's number is its time of expiry."""
        held = posixpath.join(self.root, "held")
        for reader in self.folders(held):
            for claim in self.folders(posixpath.join(held, reader)):
                place = posixpath.join(held, reader, claim)
                if int(claim) <= now and not (posixpath.dirname(place) == self.own and int(claim) > since):
                    for name in self.files(place):
                        self.moved(posixpath.join(place, name), posixpath.join(self.root, "ready", name))
                    if not self.files(place):
                        self.drop(place)

    def claim(self, hidden: float, most: int, since: int) -> int:
        """Claims up to so many ready files until their expiry; gives the newest claim, the former one if nothing is ready."""
        now = time.time_ns()
        self.release_expired(now, since)
        before, ready = self.last(), posixpath.join(self.root, "ready")
        if not (names := self.files(ready)[:most]):
            return before
        claim = max(now + int(hidden * 1e9), before + 1)
        place = posixpath.join(self.own, f"{claim:020d}")
        self.fs.create_dir(place)
        got = [self.moved(posixpath.join(ready, name), posixpath.join(place, once_more(name))) for name in names]
        if not any(got):
            self.drop(place)
            return before
        self.note(claim)
        return claim

    def claims(self, after: int, until: int) -> list[str]:
        return [posixpath.join(self.own, c) for c in self.folders(self.own) if after < int(c) <= until]

    def drop(self, place: str) -> None:
        try:
            self.fs.delete_dir(place)
        except FileNotFoundError:  # another reader was first
            pass


def once_more(name: str) -> str:
    """A file's name after one more delivery: 3~name for the third."""
    return f"{deliveries(name) + 1}~{name.split('~', 1)[-1]}"


def deliveries(name: str) -> int:
    count, tilde, _ = name.partition("~")
    return int(count) if tilde else 0


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.reader = options["path"], options.get("reader", "reader")
        self.hidden, self.most, self.since = float(options.get("hidden", 30)), int(options.get("files", FILES_A_BATCH)), None

    def folder(self) -> Folder:
        return Folder(self.path, self.reader)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"claim": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        own = self.folder()
        if self.since is None:  # older claims are of a process that has ended
            self.since = own.last()
        return {"claim": own.claim(self.hidden, self.most, self.since)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        own = self.folder()
        return [InputPartition(posixpath.join(place, name)) for place in own.claims(start["claim"], end["claim"]) for name in own.files(place)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """A file's messages; nothing if the claim has expired since and the file is another's."""
        try:
            source = self.folder().fs.open_input_file(partition.value)
        except FileNotFoundError:
            return
        n = deliveries(posixpath.basename(partition.value))
        with source:
            for b in pq.ParquetFile(source).iter_batches(1024, columns=["msg_id", "message"]):
                yield pa.RecordBatch.from_arrays([b.column("msg_id"), b.column("message"), pa.array([n] * b.num_rows, pa.int32())], names=["msg_id", "message", "deliveries"])

    def commit(self, end: dict) -> None:
        own = self.folder()
        for place in own.claims(0, end["claim"]):
            own.drop(place)


class MessageQueue(DataSource):
    """spark.readStream.format("message_queue") with options path (a URI), reader (a name of its own for each stream), hidden
    (seconds that a claim is held) and files (claimed by a batch at most)."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema) -> QueueReader:  # noqa: N802
        return QueueReader(dict(self.options))


def received(spark: SparkSession, path: str, reader: str = "reader", hidden: float = 30, files: int = FILES_A_BATCH) -> DataFrame:
    """Messages (msg_id, message, deliveries) of the queue at path, as a stream.

    Each message is delivered at least once: again if its batch isn't committed, and to another reader once the claim has
    expired. A sink that knows msg_id (flows.write_once) lets its effect stand once.
    """
    spark.dataSource.register(MessageQueue)
    return spark.readStream.format("message_queue").options(path=path, reader=reader, hidden=hidden, files=files).load()


def reached(query: StreamingQuery) -> int:
    """The claim that a stream has got to; 0 if it has had none."""
    done = query.lastProgress
    found = done and re.search(r"[0-9]+", str(done["sources"][0]["endOffset"]))
    return int(found.group()) if found else 0


def drain(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, reader: str = "reader", hidden: float = 30, files: int = FILES_A_BATCH) -> None:
    """Hands batches of messages to sink (foreachBatch) until nothing is ready.

    Spark commits a batch to its source only when the next one starts; so what a run of the stream has done is deleted
    here, after the run. A sink that fails ends the drain; its messages stay claimed, and the next drain with the same
    checkpoint starts with them.
    """
    own, last = QueueReader({"path": path, "reader": reader}), None
    while True:
        stream = received(spark, path, reader, hidden, files).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
        claim = reached(query)
        own.commit({"claim": claim})
        if claim in (0, last) or not query.lastProgress["numInputRows"]:
            return
        last = claim
