"""Sources: the driver's tables, and views of them that the learner analytics work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Learners' civil days are those of this zone.
ZONE = "America/Sao_Paulo"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; timestamps without zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def local_day(ts):
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def answers(events: DataFrame) -> DataFrame:
    """Answers in the event stream: user_id, event_id, ts, day, item, status (correct, almost, wrong), secs."""
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "click"), "correct").when(kind == "view", "almost").when(kind == "error", "wrong")
    found = events.withColumn("status", status).where(F.col("status").isNotNull())
    return found.select("user_id", "event_id", "ts", local_day("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("item"), "status", F.col("value").alias("secs"))


#: The same in SQL, as common table expressions that queries start with.
ANSWERS = """days as (select *, ((ts at time zone 'UTC') at time zone 'America/Sao_Paulo')::date as day_ from events),
answers as (select user_id, event_id, ts, day_ as day, regexp_extract(props, '"k": *([0-9]+)', 1)::int item,
  case when event_type in ('purchase', 'click') then 'correct' when event_type = 'view' then 'almost' else 'wrong' end status, value secs
  from days where event_type in ('purchase', 'click', 'view', 'error'))"""

LESSON_STATUS = "case when o_orderstatus = 'F' then 'done' else 'open' end"


def lessons(orders: DataFrame) -> DataFrame:
    """Orders as a learner's lessons in order of date and key: user_id, lesson, idx (from 1), done."""
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("lesson"), F.row_number().over(order).alias("idx"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_totalprice").alias("price"), "o_orderdate")


LESSONS = """lessons as (select o_custkey user_id, o_orderkey lesson, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) idx,
  o_orderstatus = 'F' done, o_totalprice price, o_orderdate from orders)"""
