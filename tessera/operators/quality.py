"""Evidence fusion and quality metrics: calibration errors, fusion, certification, gates, votes, drift, content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


PRED = """pred as (select l.doc_id, l.quality y, d.lang, d.source, least(greatest(0.5 + ((d.n_chars % 97) - 48) / 100.0, 0.0), 1.0)::double p from labels l join documents d using (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a stand-in for a model's probability."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = F.least(F.greatest(0.5 + (F.col("n_chars") % 97 - 48) / 100.0, F.lit(0.0)), F.lit(1.0))
    return read(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "lang", "source", p.alias("p"))


@query(f"""with {PRED}, b as (select least(floor(p * 10), 9)::int bin, count(*) n, avg(p) conf, avg(y) acc, sum((p - y) ** 2) sq from pred group by 1)
select round(sum(n * abs(conf - acc)) / sum(n), 6) ece, round(max(abs(conf - acc)), 6) mce, round(sum(sq) / sum(n), 6) brier from b""")
def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error over ten equal bins (the last one closed), the largest bin's error, and the Brier score."""
    b = predictions(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.sum((F.col("p") - F.col("y")) ** 2).alias("sq"))
    off = F.abs(F.col("conf") - F.col("acc"))
    return b.agg(F.round(F.sum(F.col("n") * off) / F.sum("n"), 6).alias("ece"), F.round(F.max(off), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


@query(f"with {PRED} select least(floor(p * 10), 9)::int bin, count(*) n, round(avg(p), 6) conf, round(avg(y), 6) acc from pred group by 1")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("conf"), F.round(F.avg("y"), 6).alias("acc"))


def wilson(right: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion; 0 to 0 without trials."""
    m = F.greatest(n, F.lit(1))
    p = right / m
    centre, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = (centre - spread) / (1 + z * z / m), (centre + spread) / (1 + z * z / m)
    return F.when(n == 0, 0.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(n == 0, 0.0).otherwise(F.least(high, F.lit(1.0)))


@query(f"""with {PRED}, c as (select source, count(*) n, sum(y) k from pred group by 1), q as (select *, k / n p from c)
select source, n, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 6) low,
 round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 1), 6) high from q""")
def wilson_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = predictions(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


#: Exponents of the evidence's likelihood ratios.
SENSITIVITY = {"ocr": 1.20, "visual": 0.80, "layout": 0.85, "lexicon": 1.00, "corpus": 0.90, "morphology": 0.85, "consensus": 0.95}


def likelihood_ratio(p: Column, sensitivity: float) -> Column:
    q = F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
    return F.pow(q / (1 - q), F.lit(sensitivity))


def fused(evidence: dict[str, Column], prior: float = 0.5) -> Column:
    """Posterior of independent evidence. With poor recognition the lexical evidence counts as neutral."""
    floor, odds = evidence["ocr"] < 0.5, F.lit(prior / (1 - prior))
    for name, p in evidence.items():
        lexical = name in ("lexicon", "corpus", "morphology")
        ratio = likelihood_ratio(F.greatest(F.lit(0.40), p) if lexical else p, SENSITIVITY[name])
        odds = odds * (F.when(floor, 1.0).otherwise(ratio) if lexical else ratio)
    return odds / (1 + odds)


def temperature_scaled(p: Column, t: float) -> Column:
    return 1 / (1 + F.exp(-F.log(F.greatest(F.lit(1e-6), p) / F.greatest(F.lit(1e-6), 1 - p)) / t))


_LR = "pow(greatest(0.01, least(0.99, {p})) / (1 - greatest(0.01, least(0.99, {p}))), {s})"


@query(f"""with {PRED}, e as (select doc_id, p ocr, (doc_id % 11) / 11.0 lex, (doc_id % 7) / 7.0 cons from pred),
o as (select doc_id, ocr < 0.5 trap, {_LR.format(p="ocr", s=1.2)} * {_LR.format(p="cons", s=0.95)} * case when ocr < 0.5 then 1 else {_LR.format(p="greatest(0.4, lex)", s=1.0)} end odds from e)
select doc_id, trap, round(odds / (1 + odds), 6) posterior, round(1 / (1 + exp(-ln(greatest(1e-6, odds / (1 + odds)) / greatest(1e-6, 1 - odds / (1 + odds))) / 1.5)), 6) calibrated from o""")
def evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = predictions(spark, sf_dir).select("doc_id", F.col("p").alias("ocr"), ((F.col("doc_id") % 11) / 11.0).alias("lex"), ((F.col("doc_id") % 7) / 7.0).alias("cons"))
    post = fused({"ocr": F.col("ocr"), "consensus": F.col("cons"), "lexicon": F.col("lex")})
    return e.select("doc_id", (F.col("ocr") < 0.5).alias("trap"), F.round(post, 6).alias("posterior"), F.round(temperature_scaled(post, 1.5), 6).alias("calibrated"))


#: Weights of the confidence components.
WEIGHTS = {"ocr": 0.45, "visual": 0.15, "lexical": 0.20, "corpus": 0.10, "consensus": 0.10}


def composite(ocr: Column, visual: Column, lexical: Column, corpus: Column, consensus: Column, unchanged: Column, n_chars: Column) -> Column:
    """Weighted confidence (0 to 100) with reasons for review; unchanged noisy text gains nothing from lexical evidence."""
    trap = unchanged & (ocr < 85)
    lex, cor = F.when(trap, 0.0).otherwise(lexical), F.when(trap, 0.0).otherwise(corpus)
    w = WEIGHTS
    score = w["ocr"] * ocr + w["visual"] * visual + w["lexical"] * lex + w["corpus"] * cor + w["consensus"] * consensus
    reasons = F.array_compact(F.array(F.when(ocr < 50, "low_recognition"), F.when(n_chars < 40, "short"), F.when(trap & (ocr < 70), "unchanged_noise")))
    return F.struct(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 2).alias("score"), F.when(F.size(reasons) == 0, "approved").otherwise(F.array_join(reasons, "; ")).alias("review"))


@query("""with e as (select doc_id, n_chars, (n_chars % 101)::double o, (doc_id % 83)::double v, (doc_id % 97)::double l, doc_id % 3 = 0 u from documents), t as (select *, u and o < 85 trap from e)
select doc_id, round(least(100, greatest(0, 0.45 * o + 0.15 * v + 0.2 * case when trap then 0 else l end + 0.1 * case when trap then 0 else l end + 0.1 * 100)), 2) score,
 coalesce(nullif(concat_ws('; ', case when o < 50 then 'low_recognition' end, case when n_chars < 40 then 'short' end, case when trap and o < 70 then 'unchanged_noise' end), ''), 'approved') review from t""")
def confidence_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    c = composite((n % 101).cast("double"), (i % 83).cast("double"), (i % 97).cast("double"), (i % 97).cast("double"), F.lit(100.0), i % 3 == 0, n)
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.score", "c.review")


@query("""with e as (select doc_id, (n_chars % 13)::double cer, (n_chars % 23)::double wer, (60 + doc_id % 41)::double conf from documents)
select doc_id, case when cer <= 2 and wer <= 5 and conf >= 90 then 'gold' when cer <= 6 and wer <= 12 and conf >= 75 then 'silver' else 'bronze' end tier,
 (cer > 2)::int + (wer > 5)::int + (conf < 90)::int reasons from e""")
def certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of a page by error rates and confidence, with the number of reasons against the best one."""
    i, n = F.col("doc_id"), F.col("n_chars")
    cer, wer, conf = n % 13, n % 23, 60 + i % 41
    reasons = F.array_compact(F.array(F.when(cer > 2, "cer"), F.when(wer > 5, "wer"), F.when(conf < 90, "confidence")))
    tier = F.when(F.size(reasons) == 0, "gold").when((cer <= 6) & (wer <= 12) & (conf >= 75), "silver").otherwise("bronze")
    return read(spark, sf_dir, "documents").select("doc_id", tier.alias("tier"), F.size(reasons).alias("reasons"))


@query("""with r as (select lang, avg(n_chars % 13) filter (where doc_id % 2 = 0) a, avg(n_chars % 13) filter (where doc_id % 2 = 1) b from documents group by lang)
select lang, round(a, 6) before, round(b, 6) after, coalesce(b > a + 0.1, false) blocked from r""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate run against the one before: blocked where the error grew by more than the tolerance."""
    e, even = F.col("n_chars") % 13, F.col("doc_id") % 2 == 0
    r = read(spark, sf_dir, "documents").groupBy("lang").agg(F.avg(F.when(even, e)).alias("a"), F.avg(F.when(~even, e)).alias("b"))
    return r.select("lang", F.round("a", 6).alias("before"), F.round("b", 6).alias("after"), F.coalesce(F.col("b") > F.col("a") + 0.1, F.lit(False)).alias("blocked"))


@query("""with v as (select l_orderkey k, l_returnflag c, sum(100 - round(l_discount * 100)::bigint)::bigint w from lineitem group by all)
select k, max_by(c, (w, c)) winner, count(*) candidates, round(max(w)::double / sum(w)::double, 4) share from v group by k""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' confidences summed, in whole hundredths, so that no order of adding matters; the largest wins, ties by name."""
    v = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("c")).agg(F.sum(100 - F.round(F.col("l_discount") * 100).cast("long")).alias("w"))
    return v.groupBy("k").agg(F.max_by("c", F.struct("w", "c")).alias("winner"), F.count("*").alias("candidates"), F.round(F.max("w") / F.sum("w"), 4).alias("share"))


@query("""with a as (select doc_id f, md5(coalesce("text", '')) h from documents), b as (select doc_id + 5 f, md5(coalesce("text", '')) h from documents union all select doc_id, 'x' from documents where doc_id < 5)
select coalesce(a.f, b.f) f, case when a.f is null then 'added' when b.f is null then 'removed' when a.h <> b.h then 'modified' else 'verified' end state from a full join b on a.f = b.f""")
def dataset_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots' manifests compared by a full outer join; in the second one every document has moved on by five."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("f"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    a = d.withColumnRenamed("h", "ha")
    b = d.select((F.col("f") + 5).alias("f"), F.col("h").alias("hb")).unionByName(d.where("f < 5").select("f", F.lit("x").alias("hb")))
    state = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "modified").otherwise("verified")
    return a.join(b, "f", "full_outer").select("f", state.alias("state"))


@query("""with w as (select doc_id, doc_id // 20 chapter, unnest(list_distinct(string_split(lower(regexp_replace(coalesce("text", ''), '[^\\p{L}]+', ' ', 'g')), ' '))) t from documents),
k as (select chapter, t from w where length(t) > 2 group by all), taught as (select t, min(chapter) first from k where chapter % 2 = 0 group by t)
select k.chapter, count(*) tested, count(*) filter (where taught.first is null or taught.first > k.chapter) untaught from k left join taught on taught.t = k.t where k.chapter % 2 = 1 group by 1""")
def taught_before_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words tested in odd chapters that no even chapter up to them has taught: first chapters by word, then one join."""
    clean = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " "))
    w = read(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("chapter"), F.explode(F.array_distinct(F.split(clean, " "))).alias("t"))
    k = w.where(F.length("t") > 2).distinct()
    taught = k.where("chapter % 2 = 0").groupBy("t").agg(F.min("chapter").alias("first"))
    tested = k.where("chapter % 2 = 1").join(taught, "t", "left")
    return tested.groupBy("chapter").agg(F.count("*").alias("tested"), F.count_if(F.col("first").isNull() | (F.col("first") > F.col("chapter"))).alias("untaught"))


@query("""with c as (select p_brand variant, count(*) n from part group by 1) select max(n) most, min(n) least_, round(max(n) / min(n), 6) ratio, max(n) / min(n) > 2.5 unequal from c""")
def variant_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    most, least = F.max("n"), F.min("n")
    return c.agg(most.alias("most"), least.alias("least_"), F.round(most / least, 6).alias("ratio"), (most / least > 2.5).alias("unequal"))


@query("""select p_partkey, concat_ws(',', case when p_size < 5 then 'few_options' end, case when p_retailprice < 950 then 'cheap' end, case when length(p_name) < 10 then 'short_name' end, case when p_brand is null then 'no_brand' end) errors from part""")
def item_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural errors of each item, as a list."""
    e = F.array_compact(F.array(F.when(F.col("p_size") < 5, "few_options"), F.when(F.col("p_retailprice") < 950, "cheap"), F.when(F.length("p_name") < 10, "short_name"), F.when(F.col("p_brand").isNull(), "no_brand")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(e, ",").alias("errors"))


@query("""select event_type, count(*) n, count(*) filter (where regexp_extract(props, '"k": *([0-9]+)', 1) <> '') valid, max(regexp_extract(props, '"k": *([0-9]+)', 1)::int) most from events group by 1""")
def json_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads parsed permissively against a schema; those that don't fit have a null."""
    e = read(spark, sf_dir, "events").withColumn("j", F.from_json("props", "k int", {"mode": "PERMISSIVE"}))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("j.k").isNotNull()).alias("valid"), F.max("j.k").alias("most"))


def options(right: Column, distractors: Column) -> Column:
    """Four options: the right one and three distinct other ones, cleaned; fewer if there aren't enough."""
    clean = F.filter(F.transform(distractors, lambda d: F.trim(d)), lambda d: (d != "") & (d != F.trim(right)))
    return F.concat(F.array(F.trim(right)), F.slice(F.array_distinct(clean), F.lit(1), F.lit(3)))


def rotated(xs: Column, by: Column) -> Column:
    """A rotation by 1 to n - 1 places: no element stays where it was."""
    n = F.size(xs)
    k = by % F.greatest(n - 1, F.lit(1)) + 1
    return F.when(n < 2, xs).otherwise(F.concat(F.slice(xs, k + 1, n), F.slice(xs, F.lit(1), k)))


def restored(shown: Column, by: Column, n: Column) -> Column:
    """The place before rotated() of an element shown at a place (from 0)."""
    return F.when(n < 2, shown).otherwise((shown + by % F.greatest(n - 1, F.lit(1)) + 1) % n)


@query("""select p_partkey, list_aggregate(list_transform(range(0, 4), lambda i: ([p_brand, p_type, p_name, 'none'])[((i + p_partkey % 3 + 1) % 4) + 1]), 'string_agg', '|') shown, ((p_partkey % 4 + p_partkey % 3 + 1) % 4)::int place from part""")
def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options rotated so that none keeps its place, and where the one shown at a place came from."""
    xs = F.array("p_brand", "p_type", "p_name", F.lit("none"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(rotated(xs, F.col("p_partkey").cast("int")), "|").alias("shown"), restored((F.col("p_partkey") % 4).cast("int"), F.col("p_partkey").cast("int"), F.lit(4)).alias("place"))


@query("""select l_orderkey k, count(*) attempts, max(l_quantity) best, min(l_linenumber) filter (where l_quantity >= 45) first_good from lineitem group by k""")
def best_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of the attempts at a region, and the first that is good enough to stop at."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("attempts"), F.max("l_quantity").alias("best"), F.min(F.when(F.col("l_quantity") >= 45, F.col("l_linenumber"))).alias("first_good"))
