"""Structured Streaming flows: queue drain, replay protection, late data, idempotency, sessions, presence, metrics.

Each takes and returns a streaming (or static) DataFrame; event time is a timestamp column ts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANSWER = "array<struct<user_id: long, word: string, status: string, similarity: double, seconds: double, ts: timestamp>>"


def drained(batches: DataFrame) -> DataFrame:
    """Queue messages (msg_id, message: a JSON array of answers) to a row an answer, defaults for what is missing."""
    rows = batches.select("msg_id", F.posexplode(F.from_json("message", ANSWER)).alias("n", "a"))
    return rows.select("msg_id", "n", "a.user_id", F.lower(F.trim("a.word")).alias("word"), F.coalesce("a.status", F.lit("wrong")).alias("status"), F.coalesce("a.similarity", F.lit(0.0)).alias("similarity"), F.coalesce("a.seconds", F.lit(3.0)).alias("seconds"), "a.ts")


def write_once(batch: DataFrame, path: str, keys: list[str], part: str | None = None) -> None:
    """Appends the rows of a micro-batch that the table at path lacks: a redelivered batch changes nothing.

    The table may be partitioned by a column that a key always has the same value of; then only the batch's partitions are
    looked up. An append that died half-way leaves whole files, whose rows the next try finds.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        known = spark.read.parquet(path)
    except Exception as error:  # the first batch finds no table, or one without files
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    else:
        if part:
            known = known.join(batch.select(part).distinct(), part, "left_semi")
        fresh = fresh.join(known.select(*keys), keys, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(part) if part else writer).parquet(path)


def first_seen(events: DataFrame, key: str = "nonce", keep: str = "7 days") -> DataFrame:
    """Events whose key hasn't been seen within the time kept (replays are dropped)."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([key])


def accepted(events: DataFrame, received: str = "received") -> DataFrame:
    """Events with a reason if they are over 30 days old or over 10 minutes in the future; none is dropped."""
    late = F.col("ts") < F.col(received) - F.expr("interval 30 days")
    early = F.col("ts") > F.col(received) + F.expr("interval 10 minutes")
    return events.withColumn("rejected", F.when(late, "too_old").when(early, "in_future"))


def completions(events: DataFrame, keys: list[str], gap: str = "15 seconds") -> DataFrame:
    """One row a burst of equal completions: those within the gap of one another are one session window."""
    return events.withWatermark("ts", "1 minute").groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("deliveries")).select(*keys, F.col("w.start").alias("first_ts"), "deliveries")


def metrics(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts, means and approximate 95th percentiles in tumbling windows, by kind."""
    g = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", 0.95).alias("p95")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "mean", "p95")


def presence(heartbeats: DataFrame, expiry: str = "180 seconds", slide: str = "60 seconds") -> DataFrame:
    """Users seen by country in sliding windows as long as a heartbeat counts, each counted once a window."""
    seen = heartbeats.withWatermark("ts", expiry).select(F.window("ts", expiry, slide).alias("w"), "country", "user_id").dropDuplicates(["w", "country", "user_id"])
    return seen.groupBy("w", "country").agg(F.count("user_id").alias("online")).select(F.col("w.end").alias("at"), "country", "online")


def crash_clusters(crashes: DataFrame) -> DataFrame:
    """Crashes by fingerprint: first and last seen, occurrences."""
    key = F.sha2(F.concat_ws("|", "kind", F.regexp_replace("message", r"[0-9]+", "#")), 256)
    return crashes.groupBy(key.alias("fingerprint")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"))


SESSION = "session_id string, theta double, answers int, finished boolean"
SESSION_STATE = "theta double, info double, answers int"


def session_step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session's ability, answer by answer, carried in state. It ends after 15 answers, after 5 once the standard error is
    below .30, or after two hours without an answer."""
    import numpy as np

    if state.hasTimedOut:
        theta, _, answers = state.get
        state.remove()
        yield pd.DataFrame({"session_id": [key[0]], "theta": [theta], "answers": [answers], "finished": [True]})
        return
    theta, info, answers = state.get if state.exists else (0.0, 0.0, 0)
    rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for a, b, c, ok in zip(rows["a"], rows["b"], rows["c"], rows["ok"], strict=True):
        p = min(max(c + (1 - c) / (1 + np.exp(np.clip(-1.702 * a * (theta - b), -35, 35))), 1e-4), 1 - 1e-4)
        info += (1.702 * a) ** 2 * (p - c) ** 2 * (1 - p) / ((1 - c) ** 2 * p)
        step = 1.702 * a * (p - c) / (1 - c) * (float(ok) - p) / p / max(info, 1.0)
        theta = float(np.clip(theta + np.clip(step, -0.65, 0.65), -3.5, 3.5))
        answers += 1
    state.update((theta, float(info), answers))
    state.setTimeoutDuration(2 * 60 * 60 * 1000)
    yield pd.DataFrame({"session_id": [key[0]], "theta": [theta], "answers": [answers], "finished": [answers >= 15 or (answers >= 5 and info > 1 / 0.30**2)]})


def sessions(answers: DataFrame) -> DataFrame:
    """Session states after each micro-batch of answers (session_id, event_id, ts, ok, a, b, c)."""
    return answers.groupBy("session_id").applyInPandasWithState(session_step, SESSION, SESSION_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def circuit_states(calls: DataFrame) -> DataFrame:
    """Targets' state from calls (target, ts, ok, fatal): failures since the last success set the cooldown."""
    last_ok = calls.where("ok").groupBy("target").agg(F.max("ts").alias("ok_ts"))
    since = calls.join(last_ok, "target", "left").where(F.col("ok_ts").isNull() | (F.col("ts") > F.col("ok_ts")))
    f = since.where("not ok").groupBy("target").agg(F.count("*").alias("failures"), F.bool_or("fatal").alias("fatal"), F.max("ts").alias("last_failure"))
    wait = F.when(F.col("fatal"), 86_400).when(F.col("failures") >= 3, 900).when(F.col("failures") == 2, 300).when(F.col("failures") == 1, 120).otherwise(0)
    out = calls.select("target").distinct().join(f, "target", "left").withColumns({"failures": F.coalesce("failures", F.lit(0)), "fatal": F.coalesce("fatal", F.lit(False))})
    return out.select("target", "failures", wait.alias("cooldown_seconds"), (F.timestamp_seconds(F.unix_timestamp("last_failure") + wait)).alias("closed_until"))
