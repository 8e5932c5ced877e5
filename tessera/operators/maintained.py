"""Totals kept up to date by increments instead of recomputed: a materialised view as versions in a folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ANSWERS, answers, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


class View:
    """Totals by keys in a folder: sums, and latest values by a time. Each increment makes a new version.

    A version holds the totals and the ids of the increments in them, and counts once its own commit file is there, which
    is written last; so a failed increment leaves the version before, and one that comes again changes nothing. Older
    versions than the last two go. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str], latest: dict[str, str]):
        self.spark, self.path, self.keys, self.sums, self.latest = spark, path.rstrip("/"), keys, sums, latest
        jvm = spark.sparkContext._jvm
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.files = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that have been committed, in order."""
        commits = self.at("commits")
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(commits)) if self.files.exists(commits) else []

    def totals(self) -> DataFrame | None:
        """The latest version's totals; none before the first increment."""
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{done[-1]}/totals") if done else None

    def applied(self, delta: DataFrame, increment: str) -> bool:
        """Merges rows (keys, sums, latest values and their times) into the totals; false if that increment is in them."""
        done = self.versions()
        marks = self.spark.read.parquet(f"{self.path}/v{done[-1]}/increments") if done else None
        if marks is not None and not marks.where(F.col("id") == increment).isEmpty():
            return False
        times = sorted(set(self.latest.values()))
        merge = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in self.sums] + [F.max_by(c, t).alias(c) for c, t in self.latest.items()] + [F.max(t).alias(t) for t in times]
        rows = delta.select(*self.keys, *self.sums, *self.latest, *times)
        rows = rows.groupBy(*self.keys).agg(*merge)
        if done:
            rows = self.totals().unionByName(rows).groupBy(*self.keys).agg(*merge)
        new = (done[-1] if done else 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{new}/totals")
        mark = self.spark.range(1).select(F.lit(increment).alias("id"))
        (marks.union(mark) if marks is not None else mark).write.mode("overwrite").parquet(f"{self.path}/v{new}/increments")
        self.files.mkdirs(self.at("commits"))
        self.files.create(self.at(f"commits/{new}"), False).close()
        for old in done[:-1]:
            self.files.delete(self.at(f"commits/{old}"), False)
            self.files.delete(self.at(f"v{old}"), True)
        return True


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/view-{uuid.uuid4().hex}"


#: Increments that the query makes of the answers.
PARTS = 4


@query(f"""with {ANSWERS} select user_id, item, count(*) attempts, (count(*) filter (where status = 'wrong'))::bigint errors, max(event_id) last_event from answers group by all""")
def maintained_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, errors and last answers by learner and item, put together from increments, one of which comes twice."""
    a = answers(read(spark, sf_dir, "events")).select("user_id", "item", F.lit(1).cast("long").alias("attempts"), (F.col("status") == "wrong").cast("long").alias("errors"), F.col("event_id").alias("last_event"), F.col("event_id").alias("event"))
    view = View(spark, shared_folder(spark), ["user_id", "item"], ["attempts", "errors"], {"last_event": "event"})
    for k in [*range(PARTS), 1]:
        view.applied(a.where(F.pmod(F.xxhash64("event"), F.lit(PARTS)) == k), f"part {k}")
    return view.totals().select("user_id", "item", "attempts", "errors", "last_event")
