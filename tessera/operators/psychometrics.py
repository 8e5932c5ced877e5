"""Psychometrics: three-parameter item responses, ability estimates, item choice, knowledge tracing, forgetting."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import ANSWERS, answers, read

QUERIES: dict = {}
SQL: dict[str, str] = {}

D = 1.702
#: Parameters of an item without any, and the grid of the ability estimate.
DEFAULTS = {"a": 1.2, "b": 0.0, "c": 0.25}
GRID = [round(-4 + 0.2 * i, 1) for i in range(41)]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def p3pl(theta: Column, a: Column, b: Column, c: Column, bound: float = 40.0, scale: float = D) -> Column:
    """Probability of a right answer; the exponent is kept within +-bound."""
    return c + (1 - c) / (1 + F.exp(clip(-scale * a * (theta - b), -bound, bound)))


def fisher(theta: Column, a: Column, b: Column, c: Column) -> Column:
    p = clip(p3pl(theta, a, b, c), 1e-9, 1 - 1e-9)
    return (D * a) ** 2 * (p - c) ** 2 * (1 - p) / ((1 - c) ** 2 * p)


def valid_item(a: Column, b: Column, c: Column) -> Column:
    """Parameters that are finite with a > 0, -6 <= b <= 6 and 0 <= c < 1."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return finite(a) & finite(b) & finite(c) & (a > 0) & b.between(-6, 6) & (c >= 0) & (c < 1)


def items(df: DataFrame) -> DataFrame:
    """Rows with an item, with its parameters: a 1.2, c 0.25, b by the item's number."""
    return df.withColumns({"a": F.lit(1.2), "b": (F.col("item") % 41 - 20) / 10.0, "c": F.lit(0.25)})


def theta_to_level(theta: Column) -> Column:
    return F.bround((clip(theta, -3, 3) + 3) / 6 * 9 + 1).cast("int")


def level_to_theta(level: Column) -> Column:
    return F.bround((F.least(F.greatest(level, F.lit(1)), F.lit(10)) - 5.5) / 1.8, 2)


def standard_error(information: Column) -> Column:
    return F.when(information <= 1e-4, 1.5).otherwise(1 / F.sqrt(information))


ITEMS = f"""{ANSWERS}, bank as (select item, 1.2::double a, (item % 41 - 20) / 10.0::double b, 0.25::double c from (select distinct item from answers)),
resp as (select user_id, item, event_id, ts, secs, status = 'correct' ok, 1.2::double a, ((item % 41 - 20) / 10.0)::double b, 0.25::double c from answers)"""
P = "(c + (1 - c) / (1 + exp(least(greatest(-1.702 * a * ({t} - b), -40), 40))))"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(answers(read(spark, sf_dir, "events")).withColumn("ok", F.col("status") == "correct"))


@query(f"""with {ITEMS}, t(theta) as (values (-2.0::double), (0.0), (2.0)), q as (select item, theta, a, c, {P.format(t="theta")} p from (select item, a, b, c, theta from bank, t))
select item, theta, round(p, 6) p, round((1.702 * a) ** 2 * (p - c) ** 2 * (1 - p) / ((1 - c) ** 2 * p), 6) information from q""")
def irt_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and information of each item for three abilities."""
    bank = items(responses(spark, sf_dir).select("item").distinct()).withColumn("theta", F.explode(F.array(*map(F.lit, (-2.0, 0.0, 2.0)))))
    args = [F.col(x) for x in ("theta", "a", "b", "c")]
    return bank.select("item", "theta", F.round(p3pl(*args), 6).alias("p"), F.round(fisher(*args), 6).alias("information"))


@query(f"""with {ITEMS}, q as (select user_id, a, c, {P.format(t="0.0")} p from resp), i as (select user_id, sum((1.702 * a) ** 2 * (p - c) ** 2 * (1 - p) / ((1 - c) ** 2 * p)) s from q group by 1)
select user_id, round(s, 4) information, round(case when s <= 1e-4 then 1.5 else 1 / sqrt(s) end, 6) se from i""")
def test_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information of all of a learner's items at ability 0, and the standard error."""
    s = responses(spark, sf_dir).groupBy("user_id").agg(F.sum(fisher(F.lit(0.0), F.col("a"), F.col("b"), F.col("c"))).alias("s"))
    return s.select("user_id", F.round("s", 4).alias("information"), F.round(standard_error(F.col("s")), 6).alias("se"))


test_information.__test__ = False

EAP_SQL = f"""g as (select (i - 20) / 5.0::double as t from (select unnest(range(0, 41)) i)),
l as (select user_id, t, sum(ln(case when ok then greatest(p, 1e-9) else greatest(1 - p, 1e-9) end)) - t * t / 2 ll
  from (select user_id, t, ok, {P.format(t="t")} p from resp, g) group by user_id, t),
w as (select user_id, t, exp(ll - max(ll) over (partition by user_id)) w from l),
m as (select user_id, sum(w * t) / sum(w) theta, sum(w * t * t) / sum(w) tt from w group by user_id),
eap as (select user_id, round(theta, 3) theta, round(least(greatest(sqrt(greatest(tt - theta * theta, 0)), 0.05), 2.5), 3) se from m)"""


def eap(resp: DataFrame, mean: float = 0.0, sd: float = 1.0, power: float = 1.0) -> DataFrame:
    """(user_id, theta, se): posterior mean over the grid, with a normal prior and the likelihood raised to a power.

    Answers are first counted by learner and item parameters, so the grid multiplies these and not the answers.
    """
    counted = resp.groupBy("user_id", "a", "b", "c", "ok").agg(F.count("*").alias("n"))
    nodes = counted.withColumn("t", F.explode(F.array(*map(F.lit, GRID))))
    p = p3pl(F.col("t"), F.col("a"), F.col("b"), F.col("c"))
    chance = F.log(F.greatest(F.when(F.col("ok"), p).otherwise(1 - p), F.lit(1e-9)))
    ll = nodes.groupBy("user_id", "t").agg((power * F.sum(F.col("n") * chance)).alias("ll"))
    ll = ll.withColumn("ll", F.col("ll") - (F.col("t") - mean) ** 2 / (2 * sd * sd))
    w = ll.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(W.partitionBy("user_id"))))
    m = w.groupBy("user_id").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("t")).alias("wt"), F.sum(F.col("w") * F.col("t") * F.col("t")).alias("wtt"))
    theta = F.col("wt") / F.col("s")
    se = clip(F.sqrt(F.greatest(F.col("wtt") / F.col("s") - theta * theta, F.lit(0.0))), 0.05, 2.5)
    return m.select("user_id", F.round(theta, 3).alias("theta"), F.round(se, 3).alias("se"))


@query(f"with {ITEMS}, {EAP_SQL} select * from eap")
def ability_eap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eap(responses(spark, sf_dir))


#: Abilities from .. to that enter at a chapter.
CHAPTERS = [(-9.0 if i == 0 else round(-2.5 + 0.25 * i, 2), round(-2.25 + 0.25 * i, 2), i + 1) for i in range(20)] + [(2.5, 9.0, 21)]


@query(f"""with {ITEMS}, {EAP_SQL}, r(low, high, chapter) as (values {", ".join(f"({a}::double, {b}::double, {c})" for a, b, c in CHAPTERS)})
select user_id, theta, chapter, chapter > 20 advanced, round_even((least(greatest(theta, -3), 3) + 3) / 6 * 9 + 1, 0)::int level_ from eap join r on theta >= low and theta < high""")
def placement_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter and level that an ability enters at: a range join with a fixed table."""
    ranges = F.broadcast(spark.createDataFrame(CHAPTERS, "low double, high double, chapter int"))
    e = ability_eap(spark, sf_dir).join(ranges, (F.col("theta") >= F.col("low")) & (F.col("theta") < F.col("high")))
    return e.select("user_id", "theta", "chapter", (F.col("chapter") > 20).alias("advanced"), theta_to_level(F.col("theta")).alias("level_"))


@query(f"""with {ITEMS}, {EAP_SQL}, c as (select user_id, item % 10 cat, count(*) n from resp group by all),
open_ as (select e.user_id, e.theta, b.* from eap e cross join bank b where not exists (select 1 from resp r where r.user_id = e.user_id and r.item = b.item)),
s as (select o.user_id, o.item, round((1.702 * a) ** 2 * (p - c) ** 2 * (1 - p) / ((1 - c) ** 2 * p) - 0.15 * coalesce(n, 0), 6) score
  from (select *, {P.format(t="theta")} p from open_) o left join c on c.user_id = o.user_id and c.cat = o.item % 10)
select user_id, item, score from (select *, row_number() over (partition by user_id order by score desc, item) r from s) where r = 1""")
def next_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unseen item with most information, less 0.15 for each answer in its category.

    Abilities are rounded, so items are ranked once an ability and category, not once a learner. Of a category a learner
    needs one item more than they have seen of it; so rows grow with the answers, not with learners times items.
    """
    r = responses(spark, sf_dir).withColumn("cat", F.col("item") % 10)
    seen = r.select("user_id", "item", "cat").distinct()
    counts = r.groupBy("user_id", "cat").agg(F.count("*").alias("n"))
    known = seen.groupBy("user_id", "cat").agg(F.count("*").alias("k"))
    bank = items(r.select("item", "cat").distinct())
    e = eap(r).select("user_id", "theta")
    info = fisher(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    ranked = e.select("theta").distinct().crossJoin(bank).withColumn("info", info)  # abilities (8001 at most) by items
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("theta", "cat").orderBy(F.desc(F.round("info", 6)), "item"))).select("theta", "cat", "item", "info", "place")
    asked = e.crossJoin(F.broadcast(bank.select("cat").distinct())).join(known, ["user_id", "cat"], "left").join(counts, ["user_id", "cat"], "left")  # ten categories
    fresh = asked.join(ranked, ["theta", "cat"]).where(F.col("place") <= F.coalesce("k", F.lit(0)) + 1).join(seen, ["user_id", "item"], "left_anti")
    s = fresh.withColumn("score", F.round(F.col("info") - 0.15 * F.coalesce("n", F.lit(0)), 6))
    return s.groupBy("user_id").agg(F.max_by(F.struct("item", "score"), F.struct("score", -F.col("item"))).alias("b")).select("user_id", "b.item", "b.score")


@query(f"""with {ITEMS}, {EAP_SQL}, late as (select user_id from resp group by 1), base as (select user_id, ((user_id % 7) - 3) / 4.0 theta0, 0.4::double se0 from late),
z as (select e.user_id, e.theta, (e.theta - theta0) / greatest(0.05, sqrt(e.se * e.se + se0 * se0)) z from eap e join base using (user_id))
select user_id, round(z, 4) z, case when z > 1.645 then 'advance' when z < -1.645 then 'remediate' else 'confirm' end action from z""")
def checkpoint_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an ability differs from the one expected at a checkpoint, one-sided at 5 %."""
    e = ability_eap(spark, sf_dir).withColumn("theta0", (F.col("user_id") % 7 - 3) / 4.0)
    z = (F.col("theta") - F.col("theta0")) / F.greatest(F.lit(0.05), F.sqrt(F.col("se") * F.col("se") + F.lit(0.4) * F.lit(0.4)))
    return e.select("user_id", F.round(z, 4).alias("z"), F.when(z > 1.645, "advance").when(z < -1.645, "remediate").otherwise("confirm").alias("action"))


@query(f"""with {ITEMS} select user_id, count(*) filter (where ok and b >= 1.2) hard_right, count(*) filter (where not ok and b <= -1.2) easy_wrong,
  count(*) filter (where ok and b >= 1.2) >= 2 and count(*) filter (where not ok and b <= -1.2) >= 2 inconsistent from resp group by 1""")
def answer_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard items right and easy ones wrong, twice each or more."""
    hard, easy = F.count_if(F.col("ok") & (F.col("b") >= 1.2)), F.count_if(~F.col("ok") & (F.col("b") <= -1.2))
    return responses(spark, sf_dir).groupBy("user_id").agg(hard.alias("hard_right"), easy.alias("easy_wrong"), ((hard >= 2) & (easy >= 2)).alias("inconsistent"))


GUESS = "case when not ok then 0.0 else c / greatest(p, 1e-4) * (0.4 + 0.6 / (1 + exp(least(3.0 * (secs / 20 - 1.8), 700)))) end"


@query(f"""with {ITEMS}, q as (select *, {P.format(t="0.0").replace("40", "35")} p from resp), g as (select *, {GUESS} gamma from q),
f as (select *, ok and ((secs / 20 < 1.6 and b > 0.8) or gamma > 0.58) guess, greatest(6, round_even(10 + 4.0 * b, 0)) base from g)
select event_id, user_id, round(gamma, 3) gamma, guess, (case when not ok then 0 when guess then greatest(2, round_even(base * 0.25, 0)) else base end)::int xp,
  (case when not ok or guess then 0 when b >= 0.2 then 2 else 1 end)::int shells from f""")
def guess_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely a right answer was a guess, by item and time, and the reward with guesses damped."""
    r = responses(spark, sf_dir).withColumn("p", p3pl(F.lit(0.0), F.col("a"), F.col("b"), F.col("c"), 35.0)).withColumn("s", F.col("secs") / 20)
    tau = 1 / (1 + F.exp(F.least(3.0 * (F.col("s") - 1.8), F.lit(700.0))))
    gamma = F.when(~F.col("ok"), 0.0).otherwise(F.col("c") / F.greatest("p", F.lit(1e-4)) * (0.4 + 0.6 * tau))
    r = r.withColumn("gamma", gamma)
    guess = F.col("ok") & (((F.col("s") < 1.6) & (F.col("b") > 0.8)) | (F.col("gamma") > 0.58))
    base = F.greatest(F.lit(6.0), F.bround(10 + 4.0 * F.col("b")))
    xp = F.when(~F.col("ok"), 0).when(guess, F.greatest(F.lit(2.0), F.bround(base * 0.25))).otherwise(base).cast("int")
    shells = F.when(~F.col("ok") | guess, 0).when(F.col("b") >= 0.2, 2).otherwise(1)
    return r.select("event_id", "user_id", F.round("gamma", 3).alias("gamma"), guess.alias("guess"), xp.alias("xp"), shells.alias("shells"))


def folded(resp: DataFrame, start: tuple, step: Callable, schema: str) -> DataFrame:
    """A row a learner: user_id and the state that a fold of their answers in order of time ends with.

    step(state, ok, a, b, c) gives the next state. Answers are dealt by learner and sorted; a task carries one state from
    batch to batch, so a learner may have any number of answers. Schema: user_id, then the state's parts.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, start
        for part in parts:
            done = []
            for u, ok, a, b, c in zip(*(part[x].tolist() for x in ("user_id", "ok", "a", "b", "c")), strict=True):
                if u != user:
                    if user is not None:
                        done.append((user, *state))
                    user, state = u, start
                state = step(state, ok, a, b, c)
            yield pd.DataFrame(done, columns=names)
        if user is not None:
            yield pd.DataFrame([(user, *state)], columns=names)

    dealt = resp.where("user_id is not null").select("user_id", "ts", "event_id", "ok", "a", "b", "c").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return dealt.mapInPandas(run, schema)


def ability_step(state: tuple[float, float], ok: bool, a: float, b: float, c: float) -> tuple[float, float]:
    """One damped Newton step of (theta, information) after an answer."""
    theta, info = state
    p = min(max(c + (1 - c) / (1 + math.exp(min(max(-D * a * (theta - b), -35.0), 35.0))), 1e-4), 1 - 1e-4)
    c = min(max(c, 0.0), 0.95)
    info += (D * a) ** 2 * (p - c) ** 2 * (1 - p) / ((1 - c) ** 2 * p)
    grad = D * a * ((p - c) / (1 - c)) * ((float(ok) - p) / p)
    return min(max(theta + min(max(grad / max(info, 1.0), -0.65), 0.65), -3.5), 3.5), info


_PL = "least(greatest(s.c + (1 - s.c) / (1 + exp(least(greatest(-1.702 * s.a * (f.theta - s.b), -35), 35))), 1e-4), 1 - 1e-4)"


@query(f"""with recursive {ITEMS}, s as (select *, row_number() over (partition by user_id order by ts, event_id) k from resp),
f(user_id, k, theta, info) as (select distinct user_id, 0::bigint, 0.0::double, 0.0::double from resp union all
 select f.user_id, s.k, least(greatest(f.theta + least(greatest(1.702 * s.a * ((x.p - s.c) / (1 - s.c)) * ((s.ok::int - x.p) / x.p) / greatest(f.info + x.i, 1.0), -0.65), 0.65), -3.5), 3.5), f.info + x.i
 from f join s on s.user_id = f.user_id and s.k = f.k + 1, lateral (select {_PL} p) y, lateral (select y.p p, (1.702 * s.a) ** 2 * (y.p - s.c) ** 2 * (1 - y.p) / ((1 - s.c) ** 2 * y.p) i) x)
select user_id, round(max_by(theta, k), 4) theta, round(1 / sqrt(greatest(max_by(info, k), 0.1)), 4) sem from f group by 1""")
def ability_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ability updated answer by answer, as a fold over each learner's ordered answers."""
    f = folded(responses(spark, sf_dir), (0.0, 0.0), ability_step, "user_id long, theta double, info double")
    return f.select("user_id", F.round("theta", 4).alias("theta"), F.round(1 / F.sqrt(F.greatest("info", F.lit(0.1))), 4).alias("sem"))


#: Fixed values of knowledge tracing: prior, transit, guess, slip.
PRIOR, TRANSIT, GUESS_P, SLIP = 0.30, 0.15, 0.20, 0.10


def tracing_step(state: tuple[float, int, int], ok: bool, *_: float) -> tuple[float, int, int]:
    """Mastery after an answer (Bayes, then learning), exposures, and right answers in a row."""
    p, n, run = state
    p = min(max(p, 0.001), 0.999)
    seen = p * (1 - SLIP) / (p * (1 - SLIP) + (1 - p) * GUESS_P) if ok else p * SLIP / (p * SLIP + (1 - p) * (1 - GUESS_P))
    return min(max(seen + (1 - seen) * TRANSIT, 0.0), 1.0), n + 1, run + 1 if ok else 0


def mastery_state(p: Column, n: Column, run: Column) -> Column:
    return F.when(n == 0, "unknown").when((p >= 0.85) & (n >= 3) & (run >= 2), "mastered").when(p >= 0.65, "retained").when(p >= 0.40, "learning").otherwise("recognized")


_B = "(least(greatest(f.p, 0.001), 0.999))"


@query(f"""with recursive {ITEMS}, s as (select *, row_number() over (partition by user_id order by ts, event_id) k from resp),
f(user_id, k, p, run) as (select distinct user_id, 0::bigint, {PRIOR}::double, 0 from resp union all
 select f.user_id, s.k, y.o + (1 - y.o) * {TRANSIT}, case when s.ok then f.run + 1 else 0 end from f join s on s.user_id = f.user_id and s.k = f.k + 1,
 lateral (select case when s.ok then {_B} * {1 - SLIP} / ({_B} * {1 - SLIP} + (1 - {_B}) * {GUESS_P}) else {_B} * {SLIP} / ({_B} * {SLIP} + (1 - {_B}) * {1 - GUESS_P}) end o) y),
t as (select user_id, max_by(p, k) p, max(k) n, max_by(run, k) run from f group by 1)
select user_id, round(p, 5) mastery, n exposures, run::int run, case when p >= 0.85 and n >= 3 and run >= 2 then 'mastered' when p >= 0.65 then 'retained' when p >= 0.4 then 'learning' else 'recognized' end state from t""")
def bkt_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bayesian knowledge tracing over each learner's answers, and the state it leads to."""
    f = folded(responses(spark, sf_dir), (PRIOR, 0, 0), tracing_step, "user_id long, p double, n long, run int")
    p, n, run = F.col("p"), F.col("n"), F.col("run")
    return f.select("user_id", F.round(p, 5).alias("mastery"), n.alias("exposures"), run.alias("run"), mastery_state(p, n, run).alias("state"))


@query(f"""with {ITEMS}, t as (select user_id, item, max(ts) last_, avg(ok::int) acc from resp group by all), n as (select max(ts) now_ from resp),
h as (select *, greatest(0.01, date_diff('hour', last_, now_) / 24.0) ndays, case when acc >= 0.5 then least(greatest(4 * (1 + acc * 1.5), 1.0), 365.0) else greatest(1.0, 4 * 0.5) end half from t, n),
r as (select *, pow(2.0, -ndays / greatest(0.1, half)) r from h)
select user_id, item, round(r, 5) recall, r <= 0.85 due, case when ndays <= half then 'stable' when r < 0.35 then 'forgotten' when r < 0.65 and acc >= 0.85 then 'decaying' else 'stable' end state from r""")
def forgetting_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each item by the forgetting curve, whether a review is due, and what has decayed."""
    r = responses(spark, sf_dir)
    t = r.groupBy("user_id", "item").agg(F.max("ts").alias("last_"), F.avg(F.col("ok").cast("int")).alias("acc"))
    now = r.agg(F.max("ts").alias("now_"))
    hours = F.floor(F.unix_timestamp("now_") / 3600) - F.floor(F.unix_timestamp("last_") / 3600)
    t = t.crossJoin(F.broadcast(now)).withColumn("days", F.greatest(F.lit(0.01), hours / 24.0))
    t = t.withColumn("half", F.when(F.col("acc") >= 0.5, clip(4 * (1 + F.col("acc") * 1.5), 1.0, 365.0)).otherwise(2.0))
    t = t.withColumn("r", F.pow(F.lit(2.0), -F.col("days") / F.greatest(F.lit(0.1), "half")))
    state = F.when(F.col("days") <= F.col("half"), "stable").when(F.col("r") < 0.35, "forgotten").when((F.col("r") < 0.65) & (F.col("acc") >= 0.85), "decaying").otherwise("stable")
    return t.select("user_id", "item", F.round("r", 5).alias("recall"), (F.col("r") <= 0.85).alias("due"), state.alias("state"))


@query(f"""with {ITEMS}, s as (select user_id, row_number() over (partition by user_id order by ts, event_id) k, ok, secs, chr(65 + item % 4) letter from resp),
t as (select user_id, list(letter order by k) l, avg(secs) t, count(*) filter (where ok) right_ from s where k <= 10 group by 1)
select user_id, round(t, 4) mean_secs, right_, len(list_distinct(l)) = 1 one_letter, t < 20 or len(list_distinct(l)) = 1 cheating,
 case when t < 20 or len(list_distinct(l)) = 1 or right_ <= 2 then 1 when right_ = 3 then 2 when right_ = 4 then 3 when right_ = 5 then 4 else 10 end::int most_level from t""")
def placement_anticheat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten answers of a placement test: too fast, or always one letter; and the level that guessing allows."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = responses(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k <= 10").withColumn("letter", F.col("item") % 4)
    t = s.groupBy("user_id").agg(F.avg("secs").alias("t"), F.count_if("ok").alias("right_"), F.count_distinct("letter").alias("letters"))
    one, fast = F.col("letters") == 1, F.col("t") < 20
    most = F.when(fast | one | (F.col("right_") <= 2), 1).when(F.col("right_") == 3, 2).when(F.col("right_") == 4, 3).when(F.col("right_") == 5, 4).otherwise(10)
    return t.select("user_id", F.round("t", 4).alias("mean_secs"), "right_", one.alias("one_letter"), (one | fast).alias("cheating"), most.alias("most_level"))


@query(f"""with {ITEMS}, {EAP_SQL} select user_id, least(greatest(round_even((least(greatest(theta, -3), 3) + 3) / 6 * 9 + 1, 0), 1), 10)::int level_,
 round_even(cast((round_even((least(greatest(theta, -3), 3) + 3) / 6 * 9 + 1, 0) - 5.5) / 1.8 as double), 2) back from eap""")
def level_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ability to level and back."""
    level = theta_to_level(F.col("theta"))
    return ability_eap(spark, sf_dir).select("user_id", level.alias("level_"), level_to_theta(level).alias("back"))


def map_ability(group: pd.DataFrame) -> pd.DataFrame:
    """Posterior mode of one learner's ability: at most 15 damped Newton steps within +-3.5, normal prior of sd 1."""
    a, b, c, n = (group[x].to_numpy(float) for x in "abcn")
    u, theta = group["ok"].to_numpy(float), 0.0
    for k in range(15):
        p = np.clip(c + (1 - c) / (1 + np.exp(np.clip(-D * a * (theta - b), -35, 35))), 1e-4, 1 - 1e-4)
        share = (p - c) / (1 - c)
        grad = (n * D * a * share * (u - p) / p).sum() - theta
        info = (n * (D * a) ** 2 * share**2 * (1 - p) / p).sum() + 1
        step = float(np.clip(grad / max(info, 1e-6), -1, 1))
        theta = float(np.clip(theta + step, -3.5, 3.5))
        if abs(step) < 1e-4:
            break
    return pd.DataFrame({"user_id": [group["user_id"].iloc[0]], "theta": [round(theta, 3)], "se": [round(float(1 / np.sqrt(info)), 3)], "steps": [k + 1]})


#: One step of the search, from the table o to the table n; learners that are done stay as they are.
_NEWTON = """{n} as (select o.user_id, least(greatest(o.theta + s, -3.5), 3.5) theta, o.steps + 1 steps, abs(s) < 1e-4 done, o.i info from
 (select user_id, any_value(theta) theta, any_value(steps) steps, sum(g) - any_value(theta) g, sum(i) + 1 i from
  (select user_id, theta, steps, 1.702 * a * ((pp - c) / (1 - c)) * (ok::int - pp) / pp g, (1.702 * a) ** 2 * ((pp - c) / (1 - c)) ** 2 * (1 - pp) / pp i from
   (select q.user_id, q.theta, q.steps, r.a, r.c, r.ok, least(greatest(r.c + (1 - r.c) / (1 + exp(least(greatest(-1.702 * r.a * (q.theta - r.b), -35), 35))), 1e-4), 1 - 1e-4) pp from {o} q join resp r using (user_id) where not q.done))
  group by user_id) o, lateral (select least(greatest(o.g / greatest(o.i, 1e-6), -1.0), 1.0) s) union all select user_id, theta, steps, done, info from {o} where done)"""


@query(f"""with {ITEMS}, n0 as (select distinct user_id, 0.0::double theta, 0 steps, false done, 1.0::double info from resp), {", ".join(_NEWTON.format(o=f"n{k}", n=f"n{k + 1}") for k in range(15))}
select user_id, round(theta, 3) theta, round(1 / sqrt(info), 3) se, steps::int steps from n15""")
def ability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior mode of each learner's ability, by Newton's method in a grouped Arrow function.

    Answers are counted by item parameters and result first, so a group is bounded by the catalogue, not the answers.
    """
    counted = responses(spark, sf_dir).groupBy("user_id", "ok", "a", "b", "c").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").applyInPandas(map_ability, "user_id long, theta double, se double, steps int")


@query(f"""with {ITEMS}, withdrawn as (select r.event_id from resp r join (select item, avg(ok::int) p from resp group by item having count(*) >= 5 and (avg(ok::int) < 0.25 or avg(ok::int) > 0.95)) w on w.item = r.item),
g as (select (i - 20) / 5.0::double as t from (select unnest(range(0, 41)) i)),
f as (select user_id, item, min_by(ok, (ts, event_id)) ok, 1.2::double a, ((item % 41 - 20) / 10.0)::double b, 0.25::double c from resp where event_id not in (select event_id from withdrawn) group by user_id, item),
pr as (select distinct user_id, ((user_id % 5) - 2) / 2.0 as m from resp),
l as (select f.user_id, t, 0.2 * sum(ln(case when ok then greatest(p, 1e-9) else greatest(1 - p, 1e-9) end)) ll from (select user_id, t, ok, {P.format(t="t")} p from f, g) f group by all),
w as (select l.user_id, t, exp(ll - (t - m) ** 2 / (2 * 0.64) - max(ll - (t - m) ** 2 / (2 * 0.64)) over (partition by l.user_id)) w from l join pr using (user_id))
select user_id, round(sum(w * t) / sum(w), 3) theta from w group by 1""")
def lesson_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ability after lessons: first attempts, damped likelihood, the old ability as prior. Items that
    nearly all or hardly any answers get right are withdrawn."""
    r = responses(spark, sf_dir)
    share = F.avg(F.col("ok").cast("int"))
    withdrawn = r.groupBy("item").agg(F.count("*").alias("n"), share.alias("p")).where("n >= 5 and (p < 0.25 or p > 0.95)").select("item")
    r = r.join(withdrawn, "item", "left_anti")
    first = r.groupBy("user_id", "item").agg(F.min_by("ok", F.struct("ts", "event_id")).alias("ok"))
    nodes = items(first).withColumn("t", F.explode(F.array(*map(F.lit, GRID))))
    p = p3pl(F.col("t"), F.col("a"), F.col("b"), F.col("c"))
    ll = nodes.groupBy("user_id", "t").agg((0.2 * F.sum(F.log(F.greatest(F.when(F.col("ok"), p).otherwise(1 - p), F.lit(1e-9))))).alias("ll"))
    ll = ll.withColumn("ll", F.col("ll") - (F.col("t") - (F.col("user_id") % 5 - 2) / 2.0) ** 2 / (2 * 0.64))
    w = ll.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(W.partitionBy("user_id"))))
    return w.groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("t")) / F.sum("w"), 3).alias("theta"))


_HALVES = ITEMS.replace("select user_id, item, event_id, ts, secs, status = 'correct' ok", "select user_id * 2 + event_id % 2 user_id, item, event_id, ts, secs, status = 'correct' ok")


@query(f"""with {_HALVES}, {EAP_SQL}, z as (select (b.theta - a.theta) / greatest(0.05, sqrt(a.se * a.se + b.se * b.se)) z from eap a join eap b on a.user_id % 2 = 0 and b.user_id = a.user_id + 1)
select count(*) learners, round(avg((z < -1.645)::int), 6) flagged, round(avg((abs(z) > 1.645)::int), 6) changed, round(1 - (1 - avg((z < -1.645)::int)) ** 5, 6) flagged_in_five from z""")
def checkpoint_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a checkpoint flags a learner of whom nothing has changed: abilities from two halves of their own answers.

    Also the share of changes either way, and of learners that five checkpoints would flag at least once.
    """
    r = responses(spark, sf_dir).withColumn("user_id", F.struct("user_id", (F.col("event_id") % 2).alias("half")))
    e = eap(r).select("user_id.user_id", "user_id.half", "theta", "se")
    a, b = (e.where(F.col("half") == h).select("user_id", F.col("theta").alias(f"t{h}"), F.col("se").alias(f"s{h}")) for h in (0, 1))
    z = (F.col("t1") - F.col("t0")) / F.greatest(F.lit(0.05), F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")))
    low = F.avg((F.col("z") < -1.645).cast("int"))
    return a.join(b, "user_id").select(z.alias("z")).agg(F.count("*").alias("learners"), F.round(low, 6).alias("flagged"), F.round(F.avg((F.abs("z") > 1.645).cast("int")), 6).alias("changed"), F.round(1 - F.pow(1 - low, F.lit(5)), 6).alias("flagged_in_five"))


@query(f"""with {ITEMS}, {EAP_SQL}, cal as (select item, avg(ok::int) p, avg(theta) t, count(*) n from resp join eap using (user_id) group by item)
select item, n, round(p, 6) p, round(t - ln(least(greatest((least(greatest(p, 0.26), 0.99) - 0.25) / (1 - least(greatest(p, 0.26), 0.99)), 1e-4), 1e4)) / (1.702 * 1.2), 4) b from cal""")
def item_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One calibration round: abilities of learners, then each item's difficulty from its share of right answers."""
    r = responses(spark, sf_dir)
    g = r.join(eap(r), "user_id").groupBy("item").agg(F.avg(F.col("ok").cast("int")).alias("p"), F.avg("theta").alias("t"), F.count("*").alias("n"))
    p = clip(F.col("p"), 0.26, 0.99)
    return g.select("item", "n", F.round("p", 6).alias("p"), F.round(F.col("t") - F.log(clip((p - 0.25) / (1 - p), 1e-4, 1e4)) / (D * 1.2), 4).alias("b"))
