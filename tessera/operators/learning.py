"""Learner analytics: streaks, daily logs, weaknesses, progression, mastery and achievements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import ANSWERS, LESSONS, answers, lessons, local_day, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def streak_table(days: DataFrame) -> DataFrame:
    """(user_id, day) to each learner's longest and current streak and number of days.

    Days in a row share day - row_number. The current streak ends yesterday or later, counted from the last day that
    anyone has; else it is 0.
    """
    days = days.distinct()
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(W.partitionBy("user_id").orderBy("day")))).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    today = days.agg(F.max("day").alias("today"))
    per_user = runs.groupBy("user_id").agg(F.max("n").alias("longest_streak"), F.max_by("n", "last").alias("last_run"), F.max("last").alias("last_day"), F.sum("n").alias("days_active"))
    now = F.when(F.col("last_day") >= F.date_sub("today", 1), F.col("last_run")).otherwise(0)
    return per_user.crossJoin(F.broadcast(today)).select("user_id", "longest_streak", now.cast("long").alias("current_streak"), "days_active", "last_day")


@query(f"""with {ANSWERS}, d as (select distinct user_id, day_ as day from days),
r as (select *, day - (row_number() over (partition by user_id order by day))::int island from d),
i as (select user_id, island, count(*) n, max(day) last_ from r group by all)
select user_id, max(n) longest_streak, (case when max(last_) >= (select max(day) from d) - 1 then max_by(n, last_) else 0 end)::bigint current_streak,
  sum(n)::bigint days_active, max(last_)::varchar last_day from i group by user_id""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return streak_table(events.select("user_id", local_day("ts").alias("day"))).withColumn("last_day", F.col("last_day").cast("string"))


@query(f"""with {ANSWERS} select user_id, item, count(*) attempts_all, count(*) filter (where status = 'wrong') wrong, count(*) filter (where status = 'almost') almost,
  round(avg(secs), 6) avg_seconds, max(ts) filter (where status = 'wrong') last_wrong from answers group by all""")
def item_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per learner and item: all attempts, wrong and almost ones, mean time, last error."""
    a = answers(read(spark, sf_dir, "events"))
    wrong = F.col("status") == "wrong"
    return a.groupBy("user_id", "item").agg(F.count("*").alias("attempts_all"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("status") == "almost").alias("almost"), F.round(F.avg("secs"), 6).alias("avg_seconds"), F.max(F.when(wrong, F.col("ts"))).cast("timestamp_ntz").alias("last_wrong"))


def weakest(a: DataFrame, k: int) -> DataFrame:
    """The k items with most errors of each learner: errors, then the latest error, then the item."""
    w = a.where("status = 'wrong'").groupBy("user_id", "item").agg(F.count("*").alias("errors"), F.max("ts").alias("last_error"))
    order = W.partitionBy("user_id").orderBy(F.desc("errors"), F.desc("last_error"), "item")
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query(f"""with {ANSWERS}, w as (select user_id, item, count(*) errors, max(ts) last_error from answers where status = 'wrong' group by all)
select user_id, item, errors, rank from (select *, row_number() over (partition by user_id order by errors desc, last_error desc, item)::int rank from w) where rank <= 5""")
def user_weakness_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakest(answers(read(spark, sf_dir, "events")), 5).select("user_id", "item", "errors", "rank")


@query(f"""with {ANSWERS}, users as (select distinct user_id from answers), items as (select distinct item from answers),
s as (select user_id, item, 1 source, count(*) n from answers where status = 'wrong' group by all
 union all select user_id, item, 2, count(*) from answers where status = 'almost' group by all
 union all select user_id, item, 4, count(*) from answers where status = 'correct' group by all
 union all select u.user_id, i.item, 3, 0 from users u, items i where not exists (select 1 from answers a where a.user_id = u.user_id and a.item = i.item)),
d as (select *, row_number() over (partition by user_id, item order by source) r from s),
t as (select user_id, item, source, row_number() over (partition by user_id order by source, n desc, item)::int rank from d where r = 1)
select user_id, item, source, rank from t where rank <= 10""")
def weakness_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten items a learner should practise: wrong ones, then almost right ones, then unseen ones, then right ones; each item once."""
    a = answers(read(spark, sf_dir, "events"))
    counted = a.groupBy("user_id", "item", F.when(F.col("status") == "wrong", 1).when(F.col("status") == "almost", 2).otherwise(4).alias("source")).agg(F.count("*").alias("n"))
    # the first seen + 10 items of the catalogue hold ten unseen ones, if there are so many: rows grow with the answers
    seen = a.select("user_id", "item").distinct()
    catalogue = seen.groupBy().agg(F.array_sort(F.collect_set("item")).alias("items"))  # one row: the catalogue, not the answers
    wanted = seen.groupBy("user_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(catalogue))
    first_items = wanted.select("user_id", F.explode(F.slice("items", F.lit(1), F.col("k").cast("int") + 10)).alias("item"))
    unseen = first_items.join(seen, ["user_id", "item"], "left_anti").select("user_id", "item", F.lit(3).alias("source"), F.lit(0).cast("long").alias("n"))
    first = counted.unionByName(unseen).groupBy("user_id", "item").agg(F.min(F.struct("source", "n")).alias("s")).select("user_id", "item", "s.source", "s.n")
    order = W.partitionBy("user_id").orderBy("source", F.desc("n"), "item")
    return first.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("user_id", "item", "source", "rank")


@query(f"""with {ANSWERS}, l as (select user_id, day, count(*) answered, count(*) filter (where status = 'correct') correct, round(sum(secs), 4) secs from answers group by all),
w as (select date_trunc('week', max(day))::date first from l),
c as (select u.user_id, (w.first + g.i)::date as day from (select distinct user_id from l) u, w, (select unnest(range(0, 7))::int i) g)
select c.user_id, c.day::varchar as day, coalesce(l.answered, 0) answered, coalesce(l.correct, 0) correct, coalesce(l.secs, 0.0) secs from c left join l on c.user_id = l.user_id and c.day = l.day""")
def daily_log_dense_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last Monday-based week, one row a learner and day, days without answers as zeros."""
    a = answers(read(spark, sf_dir, "events"))
    log = a.groupBy("user_id", "day").agg(F.count("*").alias("answered"), F.count_if(F.col("status") == "correct").alias("correct"), F.round(F.sum("secs"), 4).alias("secs"))
    first = log.agg(F.to_date(F.date_trunc("week", F.max("day"))).alias("first"))
    week = first.select(F.explode(F.sequence("first", F.date_add("first", 6))).alias("day"))
    dense = log.select("user_id").distinct().crossJoin(F.broadcast(week))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("answered", "correct", "secs")}
    return dense.join(log, ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), *(v.alias(k) for k, v in zero.items()))


@query(f"""with {ANSWERS} select user_id, count(distinct day) active_days, string_agg(distinct day::varchar, ',' order by day::varchar) days_
from answers where day > (select max(day) from answers) - 30 group by user_id""")
def activity_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with answers of the last 30, as a sorted list."""
    a = answers(read(spark, sf_dir, "events"))
    today = a.agg(F.max("day").alias("today"))
    near = a.select("user_id", "day").distinct().crossJoin(F.broadcast(today)).where(F.col("day") > F.date_sub("today", 30))
    return near.groupBy("user_id").agg(F.count("*").alias("active_days"), F.array_join(F.sort_array(F.collect_list(F.col("day").cast("string"))), ",").alias("days_"))


def frontier(l: DataFrame) -> DataFrame:
    """Progression by the furthest lesson done: those up to it are done, the next is available, the rest locked."""
    reach = F.coalesce(F.max(F.when(F.col("done"), F.col("idx"))).over(W.partitionBy("user_id")), F.lit(0))
    state = F.when(F.col("idx") <= reach, "done").when(F.col("idx") == reach + 1, "available").otherwise("locked")
    return l.select("user_id", "lesson", "idx", state.alias("state"))


@query(f"""with {LESSONS}, r as (select *, coalesce(max(case when done then idx end) over (partition by user_id), 0) reach from lessons)
select user_id, lesson, idx::int idx, case when idx <= reach then 'done' when idx = reach + 1 then 'available' else 'locked' end state from r""")
def frontier_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier(lessons(read(spark, sf_dir, "orders")))


@query(f"""with {LESSONS} select user_id, lesson, idx::int idx,
  idx = 1 or done or coalesce(lag(done) over (partition by user_id order by idx), false)
  or coalesce(bool_or(done) over (partition by user_id order by idx rows between 1 following and unbounded following), false) accessible from lessons""")
def lesson_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lesson can be opened if it is the first, is done, follows a done one, or any later one is done."""
    order = W.partitionBy("user_id").orderBy("idx")
    before = F.coalesce(F.lag("done").over(order), F.lit(False))
    later = F.coalesce(F.max("done").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(False))
    return lessons(read(spark, sf_dir, "orders")).select("user_id", "lesson", "idx", ((F.col("idx") == 1) | F.col("done") | before | later).alias("accessible"))


@query(f"""with {LESSONS}, n as (select *, lead(lesson) over (partition by user_id order by idx) next_lesson from lessons)
select user_id, lesson, next_lesson from n where done and next_lesson is not null""")
def next_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesson that each done lesson unlocks."""
    nxt = F.lead("lesson").over(W.partitionBy("user_id").orderBy("idx"))
    return lessons(read(spark, sf_dir, "orders")).withColumn("next_lesson", nxt).where("done and next_lesson is not null").select("user_id", "lesson", "next_lesson")


@query(f"""with {ANSWERS} select user_id, item, min_by(status, (ts, event_id)) first_status, min_by(event_id, (ts, event_id)) first_event, max_by(status, (ts, event_id)) last_status from answers group by all""")
def first_and_latest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(read(spark, sf_dir, "events")).withColumn("o", F.struct("ts", "event_id"))
    return a.groupBy("user_id", "item").agg(F.min_by("status", "o").alias("first_status"), F.min_by("event_id", "o").alias("first_event"), F.max_by("status", "o").alias("last_status"))


@query(f"""with {ANSWERS}, d as (select user_id, day, avg(case when status = 'correct' then 1.0 else 0.0 end) acc from answers group by all),
r as (select *, row_number() over (partition by user_id order by day desc) r from d), m as (select user_id, round(avg(acc), 6) accuracy, count(*) n from r where r <= 3 group by user_id)
select user_id, accuracy, least(greatest(5 + case when accuracy >= 0.85 then 1 when accuracy <= 0.40 then -1 else 0 end, 1), 10)::int level_ from m""")
def level_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of the last three study days and the level it leads to from level 5, one step at most."""
    a = answers(read(spark, sf_dir, "events"))
    days = a.groupBy("user_id", "day").agg(F.avg((F.col("status") == "correct").cast("double")).alias("acc"))
    last = days.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("day")))).where("r <= 3").groupBy("user_id").agg(F.round(F.avg("acc"), 6).alias("accuracy"))
    step = F.when(F.col("accuracy") >= 0.85, 1).when(F.col("accuracy") <= 0.40, -1).otherwise(0)
    return last.select("user_id", "accuracy", F.least(F.greatest(F.lit(5) + step, F.lit(1)), F.lit(10)).alias("level_"))


@query(f"""with {ANSWERS} select user_id, event_id, round(sum(secs) over (partition by user_id order by ts, event_id rows between 99 preceding and current row), 3) sum_100 from answers""")
def sliding_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total time of a learner's last 100 answers, at each answer."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return answers(read(spark, sf_dir, "events")).select("user_id", "event_id", F.round(F.sum("secs").over(w), 3).alias("sum_100"))


@query("""with totals as (select p_brand category, count(*) total from part group by 1),
got as (select c.o_custkey user_id, p_brand category, count(distinct l_partkey) mastered from lineitem join orders c on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_returnflag = 'A' group by all),
u as (select c_custkey user_id from customer)
select u.user_id, t.category, t.total, coalesce(g.mastered, 0) mastered, round(coalesce(g.mastered, 0) * 100.0 / t.total, 4) pct
from u cross join totals t left join got g on g.user_id = u.user_id and g.category = t.category""")
def category_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items mastered of each category by every learner: zeros for untouched ones."""
    part = read(spark, sf_dir, "part")
    totals = part.groupBy(F.col("p_brand").alias("category")).agg(F.count("*").alias("total"))
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_partkey")
    rows = rows.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    got = rows.groupBy(F.col("o_custkey").alias("user_id"), F.col("p_brand").alias("category")).agg(F.count_distinct("l_partkey").alias("mastered"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    dense = users.crossJoin(F.broadcast(totals)).join(got, ["user_id", "category"], "left")  # totals: a row a category
    n = F.coalesce("mastered", F.lit(0))
    return dense.select("user_id", "category", "total", n.alias("mastered"), F.round(n * 100.0 / F.col("total"), 4).alias("pct"))


@query("""select o_orderpriority chapter, count(*) lessons, count(*) filter (where o_orderstatus = 'F') completed, round(coalesce(avg(o_totalprice) filter (where o_orderstatus = 'F'), 0), 4) avg_score from orders group by 1""")
def chapter_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("chapter")).agg(F.count("*").alias("lessons"), F.count_if(done).alias("completed"), F.round(F.coalesce(F.avg(F.when(done, F.col("o_totalprice"))), F.lit(0.0)), 4).alias("avg_score"))


@query(f"""with {ANSWERS} select coalesce(round(avg(secs) filter (where status = 'none'), 4), 0) avg_none, coalesce(sum(secs) filter (where status = 'none'), 0) sum_none,
  round(coalesce(sum(secs), 0), 2) total_seconds, (sum(secs)::bigint // 3600) || 'h ' || lpad(((sum(secs)::bigint % 3600) // 60)::varchar, 2, '0') || 'm' study_time from answers""")
def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals where nothing counts as 0, and the study time as hours and minutes."""
    a = answers(read(spark, sf_dir, "events"))
    none = F.when(F.col("status") == "none", F.col("secs"))
    t = a.agg(F.coalesce(F.avg(none), F.lit(0.0)).alias("avg_none"), F.coalesce(F.sum(none), F.lit(0.0)).alias("sum_none"), F.coalesce(F.sum("secs"), F.lit(0.0)).alias("t"))
    return t.select("avg_none", "sum_none", F.round("t", 2).alias("total_seconds"), duration(F.round("t").cast("long")).alias("study_time"))


def duration(secs):
    """Whole secs as 'Hh MMm'."""
    return F.format_string("%dh %02dm", (secs / 3600).cast("long"), ((secs % 3600) / 60).cast("long"))


@query(f"""with {ANSWERS}, u as (select user_id, item from answers where status = 'correct' union select user_id, item from answers group by user_id, item having count(*) >= 3)
select user_id, count(*) learned from u group by user_id""")
def distinct_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items answered correctly or at least three times: a union of two sets."""
    a = answers(read(spark, sf_dir, "events"))
    often = a.groupBy("user_id", "item").count().where("count >= 3").select("user_id", "item")
    return a.where("status = 'correct'").select("user_id", "item").union(often).distinct().groupBy("user_id").agg(F.count("*").alias("learned"))


@query("""select r_name variant, count(distinct n_nationkey) trails, count(distinct c_custkey) chapters, count(distinct o_orderkey) lessons
from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by r_name""")
def curriculum_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct children a region has at three levels, each level counted before it is joined: no fan-out."""
    nation = read(spark, sf_dir, "nation")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("lessons"))
    per_nation = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("chapters"), F.sum("lessons").alias("lessons"))
    per_region = nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.count_distinct("n_nationkey").alias("trails"), F.sum("chapters").alias("chapters"), F.sum("lessons").alias("lessons"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return read(spark, sf_dir, "region").join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("variant"), zero("trails"), zero("chapters"), zero("lessons"))


@query("""with p as (select p_partkey id, p_type kind, p_brand class, (p_partkey * 2654435761) % 1000003 r from part),
c as (select a.id term, b.id cand, case when a.kind = b.kind and a.class = b.class then 1 when a.kind = b.kind then 2 else 3 end stage, b.r from p a join p b on a.id <> b.id and (a.kind = b.kind or a.class = b.class)),
k as (select *, row_number() over (partition by term order by stage, r, cand) n from c)
select term, string_agg(cand::varchar, ',' order by n) distractors from k where n <= 3 group by term""")
def lateral_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distractors of each term: of its kind and class, then of its kind, then of its class.

    Candidates stand in one order, so a term needs only the first four of its cell, of its kind and of its class: short
    lists by group (top four, found with a bounded window), which are joined by the group's key. No pairs are made.
    """
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("class"))
    part = part.withColumn("r", (F.col("id") * 2654435761) % 1000003)

    def firsts(keys: list[str], stage: int, most: int) -> DataFrame:
        top = part.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("r", "id"))).where(F.col("n") <= most)
        return top.groupBy(*keys).agg(F.collect_list(F.struct(F.lit(stage).alias("stage"), "r", "id", "kind", "class")).alias(f"s{stage}"))

    # of its kind there may be 4 rows in front that belong to its cell; so many more are kept
    lists = part.select("id", "kind", "class").join(firsts(["kind", "class"], 1, 4), ["kind", "class"], "left").join(firsts(["kind"], 2, 8), "kind", "left").join(firsts(["class"], 3, 8), "class", "left")
    others = F.filter(F.flatten(F.array("s1", "s2", "s3")), lambda x: (x["id"] != F.col("id")) & ((x["stage"] == 1) | ((x["stage"] == 2) & (x["class"] != F.col("class"))) | ((x["stage"] == 3) & (x["kind"] != F.col("kind")))))
    best = F.slice(F.array_sort(F.transform(others, lambda x: F.struct(x["stage"], x["r"], x["id"]))), 1, 3)
    return lists.where(F.size(best) > 0).select(F.col("id").alias("term"), F.array_join(F.transform(best, lambda x: x["id"].cast("string")), ",").alias("distractors"))


@query("""with o as (select *, max(o_orderdate) over () last_ from orders),
recent as (select distinct o_custkey from o where o_orderdate > last_ - interval 180 day)
select c_custkey user_id, n_name place, 'streak at risk' message from customer join nation on c_nationkey = n_nationkey
where c_acctbal > 0 and not exists (select 1 from recent where o_custkey = c_custkey)""")
def anti_join_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders for learners with a balance and no order in the last 180 days."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    last = orders.agg(F.max("o_orderdate").alias("last_"))
    recent = orders.crossJoin(F.broadcast(last)).where(F.col("o_orderdate") > F.col("last_") - F.expr("interval 180 days"))
    due = read(spark, sf_dir, "customer").where("c_acctbal > 0").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return due.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("place"), F.lit("streak at risk").alias("message"))


#: Achievements as (code, measure, threshold).
ACHIEVEMENTS = [
    ("xp_0", "xp", 0), ("xp_250", "xp", 250), ("xp_500", "xp", 500), ("xp_1500", "xp", 1500),
    ("streak_3", "streak", 3), ("streak_7", "streak", 7), ("streak_14", "streak", 14), ("streak_30", "streak", 30), ("streak_100", "streak", 100),
    ("chest_1", "chests", 1), ("chest_5", "chests", 5), ("chest_10", "chests", 10), ("chest_20", "chests", 20),
    ("perfect_day", "perfect", 1),
]


@query(f"""with {ANSWERS}, d as (select distinct user_id, day from answers), r as (select *, day - (row_number() over (partition by user_id order by day))::int island from d),
s as (select user_id, max(n) v from (select user_id, island, count(*) n from r group by all) group by 1),
p as (select user_id, day, bool_and(status = 'correct') ok from answers group by all),
m as (select user_id, 'xp' measure, count(*) filter (where status = 'correct') * 10 v from answers group by 1 union all select user_id, 'streak', v from s
 union all select user_id, 'chests', count(distinct item) // 10 from answers where status = 'correct' group by 1 union all select user_id, 'perfect', count(*) filter (where ok) from p group by 1),
a(code, measure, least_) as (values {", ".join(f"('{c}', '{m}', {t})" for c, m, t in ACHIEVEMENTS)})
select m.user_id, a.code from m join a using (measure) where m.v >= a.least_ and not (a.code = 'xp_0' and m.user_id % 2 = 0)""")
def achievements_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Achievements due and not granted yet (learners with even ids have the first already)."""
    a = answers(read(spark, sf_dir, "events"))
    right = F.col("status") == "correct"
    xp = a.groupBy("user_id").agg((F.count_if(right) * 10).alias("v")).withColumn("measure", F.lit("xp"))
    streak = streak_table(a.select("user_id", "day")).select("user_id", F.col("longest_streak").alias("v"), F.lit("streak").alias("measure"))
    chests = a.where(right).groupBy("user_id").agg(F.expr("count(distinct item) div 10").alias("v")).withColumn("measure", F.lit("chests"))
    perfect = a.groupBy("user_id", "day").agg(F.bool_and(right).alias("ok")).groupBy("user_id").agg(F.count_if("ok").alias("v")).withColumn("measure", F.lit("perfect"))
    rules = F.broadcast(spark.createDataFrame(ACHIEVEMENTS, "code string, measure string, least_ long"))  # a fixed list
    due = xp.unionByName(streak).unionByName(chests).unionByName(perfect).join(rules, "measure").where("v >= least_").select("user_id", "code")
    granted = a.where("user_id % 2 = 0").select("user_id", F.lit("xp_0").alias("code")).distinct()
    return due.join(granted, ["user_id", "code"], "left_anti")


@query(f"""with {LESSONS}, r as (select *, row_number() over (partition by user_id order by idx) r from lessons)
select user_id, bool_and(done) chest_open from r where r <= 2 group by user_id""")
def chest_milestone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a learner's first two lessons (or the only one) are done."""
    return lessons(read(spark, sf_dir, "orders")).where("idx <= 2").groupBy("user_id").agg(F.bool_and("done").alias("chest_open"))


#: Default difficulty of the item at each place of ten.
LADDER = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5]


@query(f"""with {LESSONS} select user_id, lesson, ([{", ".join(map(str, LADDER))}])[(idx - 1) % 10 + 1]::double difficulty from lessons""")
def difficulty_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default difficulty by the item's place modulo ten."""
    ladder = F.array(*map(F.lit, LADDER))
    return lessons(read(spark, sf_dir, "orders")).select("user_id", "lesson", F.element_at(ladder, ((F.col("idx") - 1) % 10 + 1).cast("int")).alias("difficulty"))


@query(f"""with {ANSWERS}, f as (select user_id, item, min_by(status, (ts, event_id)) s from answers group by all),
c as (select user_id, avg((s = 'correct')::int) acc, sum(case when s = 'correct' then 20 when s = 'almost' then 7 else 0 end)::bigint xp from f group by user_id)
select user_id, xp, round(acc, 6) accuracy, case when acc >= 0.9 then 'excellent' when acc >= 0.7 then 'good' else 'practise' end band from c""")
def lesson_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XP of first attempts (base 10 and 10 for a right first try, 70 % of the base if almost) and the accuracy band."""
    f = first_and_latest_attempts(spark, sf_dir)
    s = F.col("first_status")
    c = f.groupBy("user_id").agg(F.avg((s == "correct").cast("int")).alias("acc"), F.sum(F.when(s == "correct", 20).when(s == "almost", 7).otherwise(0)).alias("xp"))
    band = F.when(F.col("acc") >= 0.9, "excellent").when(F.col("acc") >= 0.7, "good").otherwise("practise")
    return c.select("user_id", "xp", F.round("acc", 6).alias("accuracy"), band.alias("band"))


@query(f"""with {ANSWERS}, x as (select user_id, event_id, ts, case when status = 'correct' then 10 when status = 'almost' then 2 else -5 end amount from answers)
select user_id, event_id, amount, sum(amount) over (partition by user_id order by ts, event_id)::bigint balance, (sum(amount) over (partition by user_id order by ts, event_id)) >= 0 accepted from x""")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balance's audit trail: what it would be after each booking, and whether that is allowed."""
    amount = F.when(F.col("status") == "correct", 10).when(F.col("status") == "almost", 2).otherwise(-5)
    x = answers(read(spark, sf_dir, "events")).withColumn("amount", amount)
    b = F.sum("amount").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return x.select("user_id", "event_id", "amount", b.alias("balance"), (b >= 0).alias("accepted"))


@query("""select conv_id, turn, last_value(text ignore nulls) over (partition by conv_id order by turn) as x, floor((turn - 1) / 5)::int session_no from (select conv_id, turn, case when role = 'user' then text end text from conversations)""")
def carry_forward_headword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last head line before it (a user's turn), and sessions of five lines."""
    head = F.when(F.col("role") == "user", F.col("text"))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(head, ignorenulls=True).over(w).alias("x"), F.floor((F.col("turn") - 1) / 5).cast("int").alias("session_no"))
