"""Item parameters from observed answers, by marginal likelihood: expectation over a grid of abilities, Newton steps an item."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .psychometrics import GRID, ITEMS, D, P, p3pl, responses
from .retrieval import checkpointed

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Priors: standard deviation of difficulties; mean and standard deviation of the logarithm of discriminations.
B_SD, A_MEAN, A_SD = 2.0, 0.2, 0.5
#: Rounds end when the log-likelihood an answer rises by less than this, or after so many.
SETTLED, ROUNDS = 1e-4, 40


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def posteriors(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, t, w, fit): each learner's posterior weights on the grid, and the logarithm of the likelihood of all their
    answers, the same in each row.

    answers (user_id, item, ok, n) are counted by kind, so a learner has at most two rows an item; items (item, a, b, c).
    """
    nodes = answers.join(items, "item").withColumn("t", F.explode(F.array(*map(F.lit, GRID))))
    p = p3pl(F.col("t"), F.col("a"), F.col("b"), F.col("c"))
    right = F.log(F.greatest(F.when(F.col("ok"), p).otherwise(1 - p), F.lit(1e-9)))
    ll = nodes.groupBy("user_id", "t").agg(F.sum(F.col("n") * right).alias("ll")).withColumn("ll", F.col("ll") - F.col("t") ** 2 / 2)
    own = W.partitionBy("user_id")  # a grid a learner
    e = ll.withColumn("top", F.max("ll").over(own)).withColumn("e", F.exp(F.col("ll") - F.col("top")))
    prior = float(np.log(np.exp(-np.array(GRID) ** 2 / 2).sum()))
    return e.withColumn("s", F.sum("e").over(own)).select("user_id", "t", (F.col("e") / F.col("s")).alias("w"), (F.col("top") + F.log("s") - prior).alias("fit"))


def expected_counts(answers: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, t, n, right): answers and right answers of an item that learners of each ability are expected to have given."""
    both = answers.join(weights, "user_id")
    return both.groupBy("item", "t").agg(F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.when(F.col("ok"), F.col("n") * F.col("w")).otherwise(0.0)).alias("right"))


def newton(t: np.ndarray, n: np.ndarray, right: np.ndarray, a: float, b: float, c: float) -> tuple[float, float]:
    """The discrimination and difficulty that expected counts and the priors make most likely: scoring steps, damped."""
    la = np.log(a)
    for _ in range(50):
        a = np.exp(la)
        z = np.clip(D * a * (t - b), -35, 35)
        s = 1 / (1 + np.exp(-z))
        p = np.clip(c + (1 - c) * s, 1e-9, 1 - 1e-9)
        slope = (1 - c) * s * (1 - s)
        score, info = (right - n * p) / (p * (1 - p)) * slope, n * slope**2 / (p * (1 - p))
        grad = np.array([(score * z).sum() - (la - A_MEAN) / A_SD**2, (-score * D * a).sum() - b / B_SD**2])
        cross = (-info * z * D * a).sum()
        fisher = np.array([[(info * z * z).sum() + A_SD**-2, cross], [cross, (info * (D * a) ** 2).sum() + B_SD**-2]])
        step = np.clip(np.linalg.solve(fisher, grad), -0.5, 0.5)
        la, b = float(np.clip(la + step[0], -2, 1.5)), float(np.clip(b + step[1], -6, 6))
        if np.abs(step).max() < 1e-7:
            break
    return float(np.exp(la)), b


def maximised(counts: DataFrame, items: DataFrame) -> DataFrame:
    """items with the parameters that counts make most likely; a group is an item's grid."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        a, b, c = (float(part[k].iloc[0]) for k in "abc")
        a, b = newton(part["t"].to_numpy(), part["n"].to_numpy(), part["right"].to_numpy(), a, b, c)
        return pd.DataFrame({"item": part["item"].iloc[:1], "a": [a], "b": [b], "c": [c]})

    kind = items.schema["item"].dataType.simpleString()
    return counts.join(items, "item").groupBy("item").applyInPandas(fit, f"item {kind}, a double, b double, c double")


def calibrated_items(answers: DataFrame, items: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> tuple[DataFrame, list[float]]:
    """Items (item, a, b, c) with a and b fitted to answers (user_id, item, ok), c as it is; and the log-likelihoods by round.

    Abilities have a standard normal prior, which fixes the scale. Answers without learner, item or verdict count for
    nothing; repeated ones count each. Items without answers keep what they had. The driver sees one number a round.
    """
    counted = answers.where("user_id is not null and item is not null and ok is not null").groupBy("user_id", "item", "ok").agg(F.count("*").alias("n"))
    counted = checkpointed(counted.join(items.select("item"), "item", "left_semi"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    fits: list[float] = []
    current = checkpointed(items.select("item", *(F.col(k).cast("double").alias(k) for k in "abc")))
    for _ in range(rounds if total else 0):
        weights = posteriors(counted, current).persist()
        fits.append(weights.where(F.col("t") == GRID[0]).agg(F.sum("fit")).first()[0])
        if len(fits) > 1 and fits[-1] - fits[-2] < settled * total:
            weights.unpersist()
            break
        fitted = maximised(expected_counts(counted, weights), current)
        current = checkpointed(fitted.unionByName(current.join(fitted.select("item"), "item", "left_anti")))
        weights.unpersist()
    return current, fits


@query(None)
def marginal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrimination and difficulty of every item, from all answers."""
    r = responses(spark, sf_dir)
    items = r.select("item", F.lit(1.2).alias("a"), F.lit(0.0).alias("b"), F.lit(0.25).alias("c")).distinct()
    fitted, _ = calibrated_items(r.select("user_id", "item", "ok"), items)
    return fitted.select("item", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query(f"""with {ITEMS}, g as (select (i - 20) / 5.0::double as t from (select unnest(range(0, 41)) i)),
l as (select user_id, t, sum(ln(case when ok then greatest(p, 1e-9) else greatest(1 - p, 1e-9) end)) - t * t / 2 ll from (select user_id, t, ok, {P.format(t="t")} p from resp, g) group by user_id, t),
w as (select user_id, t, exp(ll - max(ll) over (partition by user_id)) e from l), v as (select user_id, t, e / sum(e) over (partition by user_id) w from w),
c as (select item, t, sum(w) n, sum(case when ok then w else 0 end) r from resp join v using (user_id) group by all)
select item, round(sum(n), 3) answers, round(sum(r), 3) right_answers, round(sum(n * t) / sum(n), 4) ability, round(sum(r * t) / nullif(sum(r), 0), 4) ability_right from c group by item""")
def item_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expectation step with the items' own parameters: the abilities of those who answer an item, and of those right."""
    r = responses(spark, sf_dir)
    counted = r.groupBy("user_id", "item", "ok").agg(F.count("*").alias("n"))
    items = r.select("item", "a", "b", "c").distinct()
    c = expected_counts(counted, posteriors(counted, items))
    mean = lambda x: F.round(F.try_divide(F.sum(F.col(x) * F.col("t")), F.sum(x)), 4)
    return c.groupBy("item").agg(F.round(F.sum("n"), 3).alias("answers"), F.round(F.sum("right"), 3).alias("right_answers"), mean("n").alias("ability"), mean("right").alias("ability_right"))
