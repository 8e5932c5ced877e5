"""The queue with visibility: delivery, crashes between read and commit, expiry, two readers, long queues."""

import tempfile

import pytest

from tessera.sources import queues
from tessera.streaming import flows

MESSAGE = '[{"user_id": 1, "word": "a"}, {"user_id": 2, "word": "b"}]'


@pytest.fixture
def place():
    return tempfile.mkdtemp(prefix="spark-")


def send(spark, place, ids, rows=2):
    queues.sent(spark.createDataFrame([(i, MESSAGE) for i in ids], "msg_id long, message string").coalesce(1), f"{place}/q", rows)


def keep(place):
    return lambda batch, _: flows.write_once(flows.drained(batch).drop("ts"), f"{place}/t", ["msg_id", "n"])


def effects(spark, place):
    return sorted((r.msg_id, r.n) for r in spark.read.parquet(f"{place}/t").collect())


def left(place):
    q = queues.Folder(f"{place}/q", "reader")
    held = f"{q.root}/held"
    return len(q.files(f"{q.root}/ready")), sum(len(q.files(f"{held}/{r}/{c}")) for r in q.folders(held) for c in q.folders(f"{held}/{r}"))


def test_messages_are_drained_in_batches_and_deleted(spark, place):
    send(spark, place, range(7))
    assert left(place) == (4, 0)
    queues.drain(spark, f"{place}/q", keep(place), f"{place}/c", files=3)
    assert effects(spark, place) == [(i, n) for i in range(7) for n in (0, 1)] and left(place) == (0, 0)
    send(spark, place, [9, 3])  # 3 is sent twice; the checkpoint goes on
    queues.drain(spark, f"{place}/q", keep(place), f"{place}/c")
    assert effects(spark, place) == sorted([(i, n) for i in range(7) for n in (0, 1)] + [(9, 0), (9, 1)]) and left(place) == (0, 0)
    queues.drain(spark, f"{place}/q", keep(place), f"{place}/c")
    assert left(place) == (0, 0)


@pytest.mark.parametrize("after_write", [False, True])
def test_death_between_read_and_commit(spark, place, after_write):
    send(spark, place, range(5))

    def dies(batch, number):
        if after_write:
            keep(place)(batch, number)
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        queues.drain(spark, f"{place}/q", dies, f"{place}/c", hidden=600)
    assert left(place) == (0, 3)
    queues.drain(spark, f"{place}/q", keep(place), f"{place}/c", hidden=600)
    assert effects(spark, place) == [(i, n) for i in range(5) for n in (0, 1)] and left(place) == (0, 0)


def test_claims_of_a_dead_reader_expire(spark, place):
    send(spark, place, range(5))
    dead = queues.QueueReader({"path": f"{place}/q", "reader": "dead", "hidden": "600", "files": "2"})
    claimed = dead.latestOffset()
    assert left(place) == (1, 2) and len(dead.partitions({"claim": 0}, claimed)) == 2
    seen = []

    def sink(batch, number):
        seen.extend((r.msg_id, r.deliveries) for r in batch.collect())
        keep(place)(batch, number)

    queues.drain(spark, f"{place}/q", sink, f"{place}/c")  # what is held isn't seen
    hidden = len(seen)
    assert hidden in (1, 2)
    held = queues.Folder(f"{place}/q", "dead")
    held.fs.move(held.claims(0, claimed["claim"])[0], f"{held.own}/{1:020d}")  # a claim's name is its expiry
    queues.drain(spark, f"{place}/q", sink, f"{place}/c")
    assert effects(spark, place) == [(i, n) for i in range(5) for n in (0, 1)] and left(place) == (0, 0)
    assert {d for _, d in seen[:hidden]} == {1} and {d for _, d in seen[hidden:]} == {2}
    assert list(dead.read(queues.InputPartition(dead.path + "/gone"))) == [] and dead.partitions({"claim": 0}, claimed) == []


def test_two_readers_share_no_message(spark, place):
    send(spark, place, range(8), 1)
    one, two = (queues.QueueReader({"path": f"{place}/q", "reader": r, "files": "3"}) for r in ("one", "two"))
    a, b = one.latestOffset(), two.latestOffset()
    ids = [{m for p in r.partitions({"claim": 0}, end) for batch in r.read(p) for m in batch.column("msg_id").to_pylist()} for r, end in ((one, a), (two, b))]
    assert len(ids[0]) == len(ids[1]) == 3 and not ids[0] & ids[1]
    more = one.latestOffset()
    assert more["claim"] > a["claim"] and one.latestOffset() == more  # nothing is ready: no new offset
    one.commit(more)
    two.commit(b)
    assert left(place) == (0, 0)


def test_an_empty_queue(spark, place):
    assert queues.QueueReader({"path": f"{place}/q"}).latestOffset() == {"claim": 0}
    queues.drain(spark, f"{place}/q", keep(place), f"{place}/c")
    assert left(place) == (0, 0)


def test_write_once_looks_up_the_partitions_of_a_batch(spark, place):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "k long, day int, v string")
    for batch in (rows, rows, rows.union(spark.createDataFrame([(3, 1, "c")], rows.schema))):
        flows.write_once(batch, f"{place}/t", ["k"], "day")
    assert sorted((r.k, r.day) for r in spark.read.parquet(f"{place}/t").collect()) == [(1, 0), (2, 1), (3, 1)]
