"""Rollups and signals: confidence summaries, telemetry, item parameters from text, composite scores, votes, streams as batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import queues, sinks
from ..sources.tables import ANSWERS, answers, read
from ..streaming import flows
from .lexicon import PREFIXES, SUFFIXES
from .maintained import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- confidence

#: Lower ends of the confidence buckets.
BUCKETS = [(94.0, "excellent"), (85.0, "good"), (70.0, "moderate"), (50.0, "low")]


def confidence_bucket(x: Column) -> Column:
    out = F.lit("critical")
    for least, name in reversed(BUCKETS):
        out = F.when(x >= least, name).otherwise(out)
    return out


_BUCKET = "case when {x} >= 94 then 'excellent' when {x} >= 85 then 'good' when {x} >= 70 then 'moderate' when {x} >= 50 then 'low' else 'critical' end"


@query(f"""with c as (select doc_id, (doc_id % 101)::double a, least(100.0, doc_id % 101 + n_chars % 9)::double b from documents), s as (select count(*) total, round(avg(a), 4) mean_before, round(avg(b), 4) mean_after, round(avg(b - a), 4) mean_gain,
 round(100.0 * count(*) filter (where b >= 85) / count(*), 4) above_85, round(100.0 * count(*) filter (where b >= 94) / count(*), 4) above_94 from c),
d as (select {_BUCKET.format(x="b")} bucket, count(*) after, count(*) filter (where {_BUCKET.format(x="a")} = {_BUCKET.format(x="b")}) unmoved from c group by 1) select * from d, s""")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence before and after: means, gain, shares above thresholds, and the distribution after."""
    c = read(spark, sf_dir, "documents").select((F.col("doc_id") % 101).cast("double").alias("a"), F.least(F.lit(100.0), F.col("doc_id") % 101 + F.col("n_chars") % 9).alias("b"))
    share = lambda least: F.round(100.0 * F.count_if(F.col("b") >= least) / F.count("*"), 4)
    s = c.agg(F.count("*").alias("total"), F.round(F.avg("a"), 4).alias("mean_before"), F.round(F.avg("b"), 4).alias("mean_after"), F.round(F.avg(F.col("b") - F.col("a")), 4).alias("mean_gain"), share(85).alias("above_85"), share(94).alias("above_94"))
    d = c.groupBy(confidence_bucket(F.col("b")).alias("bucket")).agg(F.count("*").alias("after"), F.count_if(confidence_bucket(F.col("a")) == confidence_bucket(F.col("b"))).alias("unmoved"))
    return d.crossJoin(F.broadcast(s))  # one row


@query("""with e as (select doc_id, (n_chars % 101)::double o, (doc_id % 11) / 10.0::double g, case when length(trim(coalesce("text", ''), ' ')) < 80 then 30.0 else 85.0 end::double s from documents),
c as (select *, 0.55 * o + 0.25 * (g * 100) + 0.2 * s c from e) select doc_id, round(greatest(0.0, least(100.0, case when s < 50 or c < 75 then least(c, 84.0) else c end)), 2)::double composite, s < 50 or c < 75 needs_review from c""")
def composite_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition .55, agreement .25 and sanity .20; what fails is reviewed and gets 84 at most."""
    s = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 80, 30.0).otherwise(85.0)
    e = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 101).cast("double").alias("o"), ((F.col("doc_id") % 11) / 10.0).alias("g"), s.alias("s"))
    e = e.withColumn("c", 0.55 * F.col("o") + 0.25 * (F.col("g") * 100) + 0.2 * F.col("s"))
    review = (F.col("s") < 50) | (F.col("c") < 75)
    c = F.when(review, F.least("c", F.lit(84.0))).otherwise(F.col("c"))
    return e.select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 2).alias("composite"), review.alias("needs_review"))


# Fixed values of the quality index: 60 points up to the tenth percentile, 40 to the ninetieth, the steps for skew, the routes.
def piecewise(x: Column, p10: Column, p90: Column) -> Column:
    """0 to 60 below p10, 60 to 100 up to p90, 100 beyond."""
    below, between = F.greatest(F.lit(0.0), x / F.greatest(p10, F.lit(1.0)) * 60.0), 60.0 + (x - p10) / (p90 - p10) * 40.0
    return F.when(x >= p90, 100.0).when(x <= p10, below).otherwise(between)


_PIECE = "(case when {x} >= {q}90 then 100.0 when {x} <= {q}10 then greatest(0.0, {x} / greatest({q}10, 1.0) * 60.0) else 60.0 + ({x} - {q}10) / ({q}90 - {q}10) * 40.0 end)::double"


@query(f"""with m as (select doc_id, n_chars::double a, (length(coalesce("text", '')) - length(replace(coalesce("text", ''), ' ', '')))::double b, abs(doc_id % 13 - 6) / 1.0::double k from documents),
q as (select quantile_cont(a, 0.1) a10, quantile_cont(a, 0.9) a90, quantile_cont(b, 0.1) b10, quantile_cont(b, 0.9) b90 from m),
s as (select doc_id, round(0.45 * {_PIECE.format(x="a", q="a")} + 0.35 * {_PIECE.format(x="b", q="b")} + 0.2 * (case when k <= 0.4 then 100.0 when k <= 2.0 then 95.0 - (k - 0.4) * 5.0 when k <= 5.0 then 85.0 - (k - 2.0) * 5.0 else greatest(50.0, 70.0 - (k - 5.0) * 3.0) end)::double, 2)::double quality from m, q)
select doc_id, quality, case when quality >= 90 then 'fast' when quality >= 75 then 'standard' when quality >= 60 then 'strong' when quality >= 45 then 'attention' else 'review' end route from s""")
def quality_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's quality from two measures, scaled by their tenth and ninetieth percentiles, and a skew; and its route."""
    t = F.coalesce("text", F.lit(""))
    m = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), (F.length(t) - F.length(F.replace(t, F.lit(" ")))).cast("double").alias("b"), F.abs(F.col("doc_id") % 13 - 6).cast("double").alias("k"))
    q = m.agg(*(F.expr(f"percentile({c}, 0.{p}D)").alias(f"{c}{p}0") for c in "ab" for p in (1, 9)))
    k = F.col("k")
    skew = F.when(k <= 0.4, 100.0).when(k <= 2.0, 95.0 - (k - 0.4) * 5.0).when(k <= 5.0, 85.0 - (k - 2.0) * 5.0).otherwise(F.greatest(F.lit(50.0), 70.0 - (k - 5.0) * 3.0))
    s = m.crossJoin(F.broadcast(q)).select("doc_id", F.round(0.45 * piecewise(F.col("a"), F.col("a10"), F.col("a90")) + 0.35 * piecewise(F.col("b"), F.col("b10"), F.col("b90")) + 0.2 * skew, 2).alias("quality"))
    r = F.col("quality")
    return s.withColumn("route", F.when(r >= 90, "fast").when(r >= 75, "standard").when(r >= 60, "strong").when(r >= 45, "attention").otherwise("review"))


# ---- totals


@query("""select count(*) total, count(distinct p_name) lemmas, count(*) filter (where p_size > 40) flagged, count(distinct p_brand) pages, round(avg((p_type in ('SMALL', 'LARGE') and p_size > 5)::int) * 100, 4) provenance from part""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a lexicon: entries, unique lemmas, flagged ones, pages, and the share with provenance."""
    with_source = F.col("p_type").isin("SMALL", "LARGE") & (F.col("p_size") > 5)
    return read(spark, sf_dir, "part").agg(F.count("*").alias("total"), F.count_distinct("p_name").alias("lemmas"), F.count_if(F.col("p_size") > 40).alias("flagged"), F.count_distinct("p_brand").alias("pages"), F.round(F.avg(with_source.cast("int")) * 100, 4).alias("provenance"))


@query("""select lang, count(*) units, round(avg((source is not null and n_chars > 0)::int) * 100, 4) coverage, count(*) filter (where n_chars >= 500) passed, count(*) filter (where not coalesce(n_chars >= 500, false)) rejected from documents group by lang""")
def unit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by language: the share with provenance, and how many pass and fail a check."""
    ok = F.coalesce(F.col("n_chars") >= 500, F.lit(False))
    traced = (F.col("source").isNotNull() & (F.col("n_chars") > 0)).cast("int")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("units"), F.round(F.avg(traced) * 100, 4).alias("coverage"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("rejected"))


@query("""select date_trunc('month', o_orderdate)::date::varchar snapshot, count(*) files, round(sum(o_totalprice), 2) size_, round(min(o_totalprice), 2) smallest from orders group by 1""")
def snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sizes of each snapshot."""
    month = F.to_date(F.date_trunc("month", "o_orderdate")).cast("string")
    return read(spark, sf_dir, "orders").groupBy(month.alias("snapshot")).agg(F.count("*").alias("files"), F.round(F.sum("o_totalprice"), 2).alias("size_"), F.round(F.min("o_totalprice"), 2).alias("smallest"))


@query(f"""with {ANSWERS}, p as (select user_id, avg((status = 'correct')::int) x1, avg(case status when 'correct' then 1.0 when 'almost' then 0.5 else 0.0 end) x2 from answers group by 1)
select count(*) n, round(avg(x1), 6) mean_first, round(avg(x2), 6) mean_second, round(stddev_pop(x1), 6) sd_first, round(covar_samp(x1, x2), 6) covariance, round(corr(x1, x2), 6) correlation from p""")
def paired_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, deviation and sample covariance of two estimates of the same learners."""
    s = F.col("status")
    p = answers(read(spark, sf_dir, "events")).groupBy("user_id").agg(F.avg((s == "correct").cast("int")).alias("first"), F.avg(F.when(s == "correct", 1.0).when(s == "almost", 0.5).otherwise(0.0)).alias("second"))
    return p.agg(F.count("*").alias("n"), F.round(F.avg("first"), 6).alias("mean_first"), F.round(F.avg("second"), 6).alias("mean_second"), F.round(F.stddev_pop("first"), 6).alias("sd_first"), F.round(F.covar_samp("first", "second"), 6).alias("covariance"), F.round(F.corr("first", "second"), 6).alias("correlation"))


@query("""with q as (select p_brand category, p_partkey, p_type expected, max(p_type) over (partition by p_name) found, p_size % 6 = 0 uncertain from part)
select category, count(*) n, round(avg((expected = found)::int) * 100, 4) recall_at_1, round(avg((expected = found and not uncertain)::int) * 100, 4) exact, round(avg((not uncertain or expected <> found)::int) * 100, 4) faithful from q group by category""")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries: how often the first hit is right, exactly so, and how often uncertainty was rightly declared."""
    found = F.max("p_type").over(W.partitionBy("p_name"))
    q = read(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), (F.col("p_type") == found).alias("hit"), (F.col("p_size") % 6 == 0).alias("unsure"))
    share = lambda x: F.round(F.avg(x.cast("int")) * 100, 4)
    hit, unsure = F.col("hit"), F.col("unsure")
    return q.groupBy("category").agg(F.count("*").alias("n"), share(hit).alias("recall_at_1"), share(hit & ~unsure).alias("exact"), share(~unsure | ~hit).alias("faithful"))


@query(f"""with {ANSWERS}, s as (select user_id, item % 8 skill, avg((status = 'correct')::int) m from answers group by all), w as (select user_id, item % 8 skill, count(*) n, string_agg(item::varchar, ',' order by item, event_id) items from answers where status = 'wrong' group by all)
select s.user_id, round(sum(m) / 8, 6) mastery, max(e.errors) errors, max(e.items) failed from s left join (select user_id, string_agg('d' || skill || ':' || n, ';' order by skill) errors, string_agg(items, ';' order by skill) items from w group by 1) e on e.user_id = s.user_id group by s.user_id""")
def skill_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a learner's eight skills (none practised: 0), errors by domain, and the items failed."""
    a = answers(read(spark, sf_dir, "events")).withColumn("skill", F.col("item") % 8)
    s = a.groupBy("user_id", "skill").agg(F.avg((F.col("status") == "correct").cast("int")).alias("m")).groupBy("user_id").agg(F.round(F.sum("m") / 8, 6).alias("mastery"))
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "event_id"))), lambda x: x["item"].cast("string")), ",")
    w = a.where("status = 'wrong'").groupBy("user_id", "skill").agg(F.count("*").alias("n"), failed.alias("items"))
    rows = F.array_sort(F.collect_list(F.struct("skill", "n", "items")))
    e = w.groupBy("user_id").agg(rows.alias("r")).select("user_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("d"), x["skill"].cast("string"), F.lit(":"), x["n"].cast("string"))), ";").alias("errors"), F.array_join(F.transform("r", lambda x: x["items"]), ";").alias("failed"))
    return s.join(e, "user_id", "left")


@query("""with f as (select user_id, ts, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) r from events),
l as (select user_id, list_sort(list(value) filter (where r <= 50)) l, avg(value) mean, avg((value > 16.6)::int) dropped, count(*) frames from f group by 1)
select user_id, frames, round(mean, 4) mean_ms, round(dropped * 100, 4) dropped_pct, round(least(60.0, greatest(1.0, 1000.0 / mean)), 4)::double fps, l[floor((len(l) - 1) * 0.95)::int + 1] p95, case when least(60.0, greatest(1.0, 1000.0 / mean)) >= 58 then 'flagship' when least(60.0, greatest(1.0, 1000.0 / mean)) >= 45 then 'high' when least(60.0, greatest(1.0, 1000.0 / mean)) >= 30 then 'mid' else 'low' end device from l""")
def frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by user: mean time, share over 16.6 ms, rate, the 95th percentile (nearest rank) of the last fifty, device class."""
    f = read(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    l = f.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= 50, F.col("value")))).alias("l"), F.avg("value").alias("mean"), F.avg((F.col("value") > 16.6).cast("int")).alias("dropped"), F.count("*").alias("frames"))
    fps = F.least(F.lit(60.0), F.greatest(F.lit(1.0), 1000.0 / F.col("mean")))
    p95 = F.element_at("l", F.floor((F.size("l") - 1) * 0.95).cast("int") + 1)
    return l.select("user_id", "frames", F.round("mean", 4).alias("mean_ms"), F.round(F.col("dropped") * 100, 4).alias("dropped_pct"), F.round(fps, 4).alias("fps"), p95.alias("p95"), F.when(fps >= 58, "flagship").when(fps >= 45, "high").when(fps >= 30, "mid").otherwise("low").alias("device"))


@query("""with l as (select conv_id, turn, generate_subscripts(s, 1) - 1 line, unnest(s) t from (select conv_id, turn, string_split(coalesce("text", ''), chr(10)) s from conversations)),
w as (select conv_id, turn, line, generate_subscripts(x, 1) - 1 pos, unnest(x) word from (select *, string_split(t, ' ') x from l)), c as (select *, 100 - (length(word) * 7 + pos) % 61 conf from w where word <> '')
select conv_id, turn, line::int line, string_agg(word, ' ' order by pos) text, round(avg(conf), 4) mean_conf, min(conf)::int least_conf from c group by all""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words put together to lines by page, block and line, with the mean and least confidence of a line."""
    l = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    w = l.select("conv_id", "turn", "line", F.posexplode(F.split("t", " ")).alias("pos", "word")).where("word <> ''").withColumn("conf", 100 - (F.length("word") * 7 + F.col("pos")) % 61)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return w.groupBy("conv_id", "turn", "line").agg(text.alias("text"), F.round(F.avg("conf"), 4).alias("mean_conf"), F.min("conf").alias("least_conf"))


_STATS = [("chars", 'length(coalesce("text", \'\'))', F.length), ("words", "len(string_split(coalesce(\"text\", ''), ' '))", lambda t: F.size(F.split(t, " "))), ("lines", "len(string_split(coalesce(\"text\", ''), chr(10)))", lambda t: F.size(F.split(t, "\n")))]


@query("select coalesce(source, 'none') source, count(*) documents, count(distinct lang) langs, count(distinct md5(\"text\")) texts, " + ", ".join(f"round(avg({x}), 4) mean_{n}, min({x}) least_{n}, max({x}) most_{n}, sum({x})::bigint total_{n}, round(stddev_pop({x}), 4) sd_{n}" for n, x, _ in _STATS) + " from documents group by 1")
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nineteen metrics of each source, as a metrics table has them."""
    t = F.coalesce("text", F.lit(""))
    d = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "lang", F.md5("text").alias("h"), *(f(t).cast("long").alias(n) for n, _, f in _STATS))
    measures = [m for n, _, _ in _STATS for m in (F.round(F.avg(n), 4).alias(f"mean_{n}"), F.min(n).alias(f"least_{n}"), F.max(n).alias(f"most_{n}"), F.sum(n).alias(f"total_{n}"), F.round(F.stddev_pop(n), 4).alias(f"sd_{n}"))]
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("langs"), F.count_distinct("h").alias("texts"), *measures)


# ---- exports as text


def xml_text(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


_XML = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""with t as (select conv_id, turn, role, {_XML.format(x='''coalesce("text", '')''')} x from conversations)
select conv_id, '<Page ID="p' || conv_id || '">' || string_agg('<TextLine ID="l' || turn || '"><String CONTENT="' || x || '"/></TextLine>', '' order by turn) || '</Page>' alto,
 '<Page>' || string_agg('<TextRegion id="r' || turn || '"><TextEquiv><Unicode>' || x || '</Unicode></TextEquiv></TextRegion>', '' order by turn) || '</Page>' page,
 '<p>' || string_agg('<span class="' || case when length(x) < 40 then 'low' else 'high' end || '">' || x || '</span>', ' ' order by turn) || '</p>' html from t group by conv_id""")
def layout_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their lines in two XML layouts, and as HTML that marks unsure lines."""
    x = xml_text(F.coalesce("text", F.lit("")))
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))).alias("l"))
    n = lambda r: r["turn"].cast("string")
    alto = F.array_join(F.transform("l", lambda r: F.concat(F.lit('<TextLine ID="l'), n(r), F.lit('"><String CONTENT="'), r["x"], F.lit('"/></TextLine>'))), "")
    page = F.array_join(F.transform("l", lambda r: F.concat(F.lit('<TextRegion id="r'), n(r), F.lit('"><TextEquiv><Unicode>'), r["x"], F.lit("</Unicode></TextEquiv></TextRegion>"))), "")
    html = F.array_join(F.transform("l", lambda r: F.concat(F.lit('<span class="'), F.when(F.length(r["x"]) < 40, "low").otherwise("high"), F.lit('">'), r["x"], F.lit("</span>"))), " ")
    return t.select("conv_id", F.concat(F.lit('<Page ID="p'), F.col("conv_id").cast("string"), F.lit('">'), alto, F.lit("</Page>")).alias("alto"), F.concat(F.lit("<Page>"), page, F.lit("</Page>")).alias("page"), F.concat(F.lit("<p>"), html, F.lit("</p>")).alias("html"))


# ---- item parameters

@query("""select o_orderkey, case when contains(lower(o_orderpriority), 'high') then 1.5 when contains(lower(o_orderpriority), 'medium') then 0.0 else -1.5 end::double theta0, (-2.5 + (o_orderkey % 20) * 5 / 19.0)::double difficulty from orders""")
def declared_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ability that a learner declares, and a chapter's difficulty on its line."""
    p = F.lower("o_orderpriority")
    theta = F.when(F.contains(p, F.lit("high")), 1.5).when(F.contains(p, F.lit("medium")), 0.0).otherwise(-1.5)
    return read(spark, sf_dir, "orders").select("o_orderkey", theta.alias("theta0"), (-2.5 + (F.col("o_orderkey") % 20) * 5 / 19.0).alias("difficulty"))


# Fixed values of the difficulty scale: the word length and the marks that count as usual and as full, what a prefix and a
# suffix add and at most, the weights of length, clauses, affixes and category, and the limits.
USUAL_LENGTH, LENGTH_SCALE, FULL_MARKS = 4.5, 3.0, 3.0
PREFIX_ADDS, SUFFIX_ADDS, AFFIXES_MOST = 0.30, 0.35, 2.0
LENGTH_WEIGHT, CLAUSE_WEIGHT, AFFIX_WEIGHT, CATEGORY_WEIGHT = 0.7, 0.5, 0.8, 0.9
LOWEST, HIGHEST = -3.0, 3.0


def observed_weights(answered: DataFrame, items: DataFrame) -> DataFrame:
    """(category, weight): the log-odds of a wrong answer in each category of items (item, category), within two either way.

    One answer of each kind is added, so a category without answers weighs nothing; so does a category that isn't there.
    """
    wrong = F.sum(F.when(F.col("status") == "wrong", 1).otherwise(0))
    counts = items.join(answered.groupBy("item").agg(F.count("*").alias("n"), wrong.alias("w")), "item", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    odds = F.log((F.col("w") + 1) / (F.col("n") - F.col("w") + 1))
    return counts.select("category", F.least(F.greatest(odds, F.lit(-2.0)), F.lit(2.0)).alias("weight"))


def text_features(text: Column, prefixes: list[str], suffixes: list[str]) -> dict[str, Column]:
    """How far the mean word is from a usual one, how full of marks a text is, and what its words' affixes add."""
    whole = F.coalesce(text, F.lit(""))
    count = F.regexp_count(whole, F.lit(r"\S+"))
    letters = F.length(F.regexp_replace(whole, r"\s+", ""))
    front = F.regexp_count(whole, F.lit(rf"(?i)(?<!\S)(?:{'|'.join(prefixes)})"))
    back = F.regexp_count(whole, F.lit(rf"(?i)(?:{'|'.join(suffixes)})(?!\S)"))
    return {
        "words": count,
        "length": (letters / F.greatest(count, F.lit(1)) - USUAL_LENGTH) / LENGTH_SCALE,
        "clauses": F.least(F.regexp_count(whole, F.lit("[,;:()\u2014-]")) / FULL_MARKS, F.lit(1.0)),
        "affixes": F.least(front * PREFIX_ADDS + back * SUFFIX_ADDS, F.lit(AFFIXES_MOST)),
    }


def text_difficulty(text: Column, weight: Column, prefixes: list[str] = PREFIXES, suffixes: list[str] = SUFFIXES) -> Column:
    """Difficulty of an item from its text and its category's weight, within the limits of the scale; 0 without words."""
    f = text_features(text, prefixes, suffixes)
    total = f["length"] * LENGTH_WEIGHT + f["clauses"] * CLAUSE_WEIGHT + f["affixes"] * AFFIX_WEIGHT + F.coalesce(weight, F.lit(0.0)) * CATEGORY_WEIGHT
    return F.when(f["words"] == 0, 0.0).otherwise(F.greatest(F.lit(LOWEST), F.least(total, F.lit(HIGHEST))))


_AFFIXES = f"""(len(list_filter(w, lambda x: regexp_matches(x, '^({'|'.join(PREFIXES)})', 'i'))) * {PREFIX_ADDS} + len(list_filter(w, lambda x: regexp_matches(x, '({'|'.join(SUFFIXES)})$', 'i'))) * {SUFFIX_ADDS})"""


@query(f"""with {ANSWERS}, o as (select p_type, least(greatest(ln((count(*) filter (where status = 'wrong') + 1) / (count(status) - count(*) filter (where status = 'wrong') + 1)), -2.0), 2.0) c from part left join answers on item = p_partkey group by 1),
w as (select p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') w, coalesce(c, 0) c from part left join o using (p_type)), k as (select *, [1, 1, len(w)] l from w)
select p_partkey, round(least(greatest((list_sum(list_transform(w, lambda x: length(x))) / len(w) - 4.5) / 3.0 * 0.7 + least({_AFFIXES}, 2.0) * 0.8 + c * 0.9, -3.0), 3.0), 6)::double b,
 round(greatest(0.6, least(2.2, 1.4 - least(list_var_pop(l) * 0.1, 0.5) + case when list_var_pop(l) < 1 then 0.2 else 0 end)), 6)::double a from k""")
def inferred_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty and discrimination of items: from their texts and how often their categories are answered wrong; even
    options discriminate better."""
    part = read(spark, sf_dir, "part")
    weights = observed_weights(answers(read(spark, sf_dir, "events")), part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category")))
    sizes = F.array(F.lit(1), F.lit(1), F.size(T.words(F.col("p_name"))))
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x) / F.size(sizes)
    p = part.join(weights, F.col("p_type") == F.col("category"), "left").select("p_partkey", text_difficulty(F.col("p_name"), F.col("weight")).alias("b"), sizes.alias("s"), mean.alias("m"))
    var = F.aggregate(F.transform("s", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda s, x: s + x) / F.size("s")
    a = 1.4 - F.least(var * 0.1, F.lit(0.5)) + F.when(var < 1, 0.2).otherwise(0.0)
    return p.select("p_partkey", F.round("b", 6).alias("b"), F.round(F.greatest(F.lit(0.6), F.least(F.lit(2.2), a)), 6).alias("a"))


def hashed_grams(text: Column) -> Column:
    """The text and its trigrams as numbers of 64 places: a hashed embedding, sparse."""
    t = F.lower(F.trim(text))
    size = F.greatest(F.length(t) - 2, F.lit(1))
    grams = F.concat(F.array(t), F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(t, i, F.lit(3))))
    return F.transform(grams, lambda g: F.conv(F.substring(F.md5(g), 1, 2), 16, 10).cast("int") % 64)


@query("""with g as (select p_partkey, list_transform(list_concat([p_name], list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substring(p_name, i, 3))), lambda x: (('0x' || substring(md5(x), 1, 2))::int) % 64) h from part),
c as (select p_partkey, i, count(*) n from (select p_partkey, unnest(h) i from g) group by all), n as (select p_partkey, sqrt(sum(n * n)) norm from c group by 1),
d as (select a.p_partkey, sum(a.n * b.n) dot from c a join c b on b.p_partkey = a.p_partkey + 1 and b.i = a.i group by 1)
select x.p_partkey, round(coalesce(dot, 0) / (x.norm * y.norm), 6) likeness, round(greatest(0.08, least(0.35, 0.25 * (1 - (coalesce(dot, 0) / (x.norm * y.norm) - 0.4) * 0.5))), 6) c from n x join n y on y.p_partkey = x.p_partkey + 1 left join d on d.p_partkey = x.p_partkey""")
def inferred_guessing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of hashed trigram vectors of an answer and a distractor (the next item), and the guessing that gives."""
    g = read(spark, sf_dir, "part").select("p_partkey", F.explode(hashed_grams(F.col("p_name"))).alias("i")).groupBy("p_partkey", "i").agg(F.count("*").alias("n"))
    norm = g.groupBy("p_partkey").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    following = g.select((F.col("p_partkey") - 1).alias("p_partkey"), "i", F.col("n").alias("m"))
    dot = g.join(following, ["p_partkey", "i"]).groupBy("p_partkey").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    both = norm.join(norm.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("norm").alias("next")), "p_partkey").join(dot, "p_partkey", "left")
    cos = F.coalesce("dot", F.lit(0)) / (F.col("norm") * F.col("next"))
    return both.select("p_partkey", F.round(cos, 6).alias("likeness"), F.round(F.greatest(F.lit(0.08), F.least(F.lit(0.35), 0.25 * (1 - (cos - 0.4) * 0.5))), 6).alias("c"))


# ---- votes and learned corrections


@query("""with v as (select l_orderkey k, lower(trim(l_returnflag, ' ')) t, sum(100 - round(l_discount * 100)::bigint)::bigint w, count(*) n from lineitem group by all)
select k, max_by(t, (n, w, t)) winner, round(max(n)::double / sum(n)::double, 6) agreement, max(n) = sum(n) unanimous from v group by k""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several hypotheses of one thing: the one that most agree on (then by confidence), and how many do."""
    t = F.lower(F.trim("l_returnflag"))
    v = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), t.alias("t")).agg(F.sum(100 - F.round(F.col("l_discount") * 100).cast("long")).alias("w"), F.count("*").alias("n"))
    return v.groupBy("k").agg(F.max_by("t", F.struct("n", "w", "t")).alias("winner"), F.round(F.max("n") / F.sum("n"), 6).alias("agreement"), (F.max("n") == F.sum("n")).alias("unanimous"))


@query("""with c as (select p_name token, p_brand correction, count(*) confirmations, max(p_partkey) last_ from part group by all), l as (select token, arg_max(correction, last_) latest, sum(confirmations)::bigint seen, max(confirmations) most from c group by 1)
select token, latest, seen, seen >= 3 whitelisted, most * 2 > seen agreed from l""")
def learned_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections that reviewers confirmed: the latest wins, and words with three confirmations or more are whitelisted."""
    c = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("token"), F.col("p_brand").alias("correction")).agg(F.count("*").alias("confirmations"), F.max("p_partkey").alias("last_"))
    l = c.groupBy("token").agg(F.max_by("correction", "last_").alias("latest"), F.sum("confirmations").alias("seen"), F.max("confirmations").alias("most"))
    return l.select("token", "latest", "seen", (F.col("seen") >= 3).alias("whitelisted"), (F.col("most") * 2 > F.col("seen")).alias("agreed"))


# ---- the streaming flows over a whole table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


@query("""with m as (select user_id msg_id, (row_number() over (partition by user_id order by event_id) - 1)::int n, event_type, value from events) select msg_id, n, msg_id user_id, event_type word, 'wrong' status, 0.0::double similarity, coalesce(value, 3.0)::double "seconds" from m""")
def drained_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a queue (a user's events as a JSON array) to a row an answer, with defaults for what is missing."""
    one = F.struct("event_id", F.col("user_id"), F.concat(F.lit(" "), F.upper("event_type")).alias("word"), F.col("value").alias("seconds"))
    m = _events(spark, sf_dir).groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("message"))
    return flows.drained(m.withColumnRenamed("user_id", "msg_id")).drop("ts")


#: Answers of a message that a client sends.
ANSWERS_A_MESSAGE = 50


@query(f"""with m as (select event_id // {ANSWERS_A_MESSAGE} msg_id, event_id, user_id, event_type word, value from events where event_id is not null)
select msg_id, (row_number() over (partition by msg_id order by event_id, user_id, word, value) - 1)::int n, user_id, word, 'wrong' status, coalesce(value, 3.0)::double "seconds" from m""")
def queued_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent as messages to a queue with visibility and drained from it by a stream into a table, each answer once."""
    one = F.struct("event_id", F.col("user_id"), F.lower("event_type").alias("word"), F.col("value").alias("seconds"))
    m = _events(spark, sf_dir).where("event_id is not null").groupBy(F.floor(F.col("event_id") / ANSWERS_A_MESSAGE).cast("long").alias("msg_id"))
    folder = shared_folder(spark)
    queues.sent(m.agg(F.to_json(F.array_sort(F.collect_list(one))).alias("message")), f"{folder}/queue")

    def kept(batch: DataFrame, _: int) -> None:
        rows = flows.drained(batch).withColumn("block", F.pmod("msg_id", F.lit(16)).cast("int")).drop("ts", "similarity")
        flows.write_once(rows, f"{folder}/answers", ["msg_id", "n"], "block")

    queues.drain(spark, f"{folder}/queue", kept, f"{folder}/checkpoint", hidden=600)
    return spark.read.schema("msg_id long, n int, user_id long, word string, status string, seconds double").parquet(f"{folder}/answers").drop("block")


@query("""with n as (select max(ts) now_ from events) select event_id, case when ts < now_ - interval 10 day - interval 30 day + interval 25 day then 'too_old' when ts > now_ - interval 1 day + interval 10 minute then 'in_future' end rejected from events, n""")
def accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events received at one time: those too old, or too far ahead, have the reason."""
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now_"))
    shifted = e.crossJoin(F.broadcast(now)).withColumn("received", F.col("now_") - F.expr("interval 1 day"))
    old = shifted.withColumn("ts", F.when(F.col("ts") < F.col("now_") - F.expr("interval 15 days"), F.col("ts") - F.expr("interval 60 days")).otherwise(F.col("ts")))
    return flows.accepted(old).select("event_id", "rejected")


@query("""with e as (select user_id, event_type, ts, lag(ts) over (partition by user_id, event_type order by ts) before from events), s as (select *, sum((before is null or ts - before >= interval 6 hour)::int) over (partition by user_id, event_type order by ts, before) g from e)
select user_id, event_type, min(ts) first_ts, count(*) deliveries from s group by user_id, event_type, g""")
def completed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of equal events (within six hours of one another) as one completion each."""
    out = flows.completions(_events(spark, sf_dir), ["user_id", "event_type"], "6 hours")
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))


@query("""select time_bucket(interval 1 hour, ts) window_start, time_bucket(interval 1 hour, ts) + interval 1 hour window_end, event_type, count(*) n, round(avg(value), 6) mean from events group by all""")
def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and means by kind."""
    m = flows.metrics(_events(spark, sf_dir), "1 hour")
    return m.select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""with w as (select user_id, event_type country, unnest([time_bucket(interval 12 hour, ts) + interval 12 hour, time_bucket(interval 12 hour, ts) + interval 24 hour]) "at" from events) select "at", country, count(distinct user_id) online from w group by all""")
def presence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users present in sliding windows of a day every twelve hours, by kind."""
    beats = _events(spark, sf_dir).select("ts", "user_id", F.col("event_type").alias("country"))
    return flows.presence(beats, "24 hours", "12 hours").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""select sha256(event_type || '|' || regexp_replace(event_type || ' of user ' || user_id, '[0-9]+', '#', 'g')) fingerprint, min(ts) first_seen, max(ts) last_seen, count(*) occurrences from events group by 1""")
def crash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crashes that differ in numbers alone, as one group."""
    c = _events(spark, sf_dir).select("ts", F.col("event_type").alias("kind"), F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("message"))
    return flows.crash_clusters(c).select("fingerprint", *(F.col(x).cast("timestamp_ntz").alias(x) for x in ("first_seen", "last_seen")), "occurrences")


@query("""with c as (select user_id target, ts, event_type not in ('error', 'view') ok, value < 1 fatal from events), o as (select target, max(ts) ok_ts from c where ok group by 1),
f as (select c.target, count(*) failures, bool_or(fatal) fatal, max(ts) last_ from c left join o using (target) where not ok and (ok_ts is null or ts > ok_ts) group by 1), t as (select distinct target from c)
select t.target, coalesce(failures, 0) failures, (case when coalesce(fatal, false) then 86400 when failures >= 3 then 900 when failures = 2 then 300 when failures = 1 then 120 else 0 end)::int cooldown_seconds,
 date_trunc('second', last_) + to_seconds(case when coalesce(fatal, false) then 86400 when failures >= 3 then 900 when failures = 2 then 300 when failures = 1 then 120 else 0 end) closed_until from t left join f using (target)""")
def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets' circuit states by their failures since the last success."""
    c = _events(spark, sf_dir).select(F.col("user_id").alias("target"), "ts", (~F.col("event_type").isin("error", "view")).alias("ok"), (F.col("value") < 1).alias("fatal"))
    return flows.circuit_states(c).withColumn("closed_until", F.col("closed_until").cast("timestamp_ntz"))


@query("""select user_id target, count(*) filter (where event_type not in ('error', 'view')) successes, count(*) filter (where event_type = 'error') fatal, count(*) filter (where event_type = 'view') transient, round(avg(value) filter (where event_type not in ('error', 'view')), 6) mean_latency from events group by 1""")
def target_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by target: successes, fatal and passing failures, mean latency of the successes."""
    k = F.col("event_type")
    ok = ~k.isin("error", "view")
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("target")).agg(F.count_if(ok).alias("successes"), F.count_if(k == "error").alias("fatal"), F.count_if(k == "view").alias("transient"), F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean_latency"))


@query("""select event_id, (floor(epoch(ts))::bigint // 1800) bucket, greatest(0.1, coalesce(value, 3.0))::double "seconds" from events""")
def half_hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half hour of an event, and its time with a floor and a default."""
    e = _events(spark, sf_dir)
    return e.select("event_id", F.floor(F.unix_timestamp("ts") / 1800).alias("bucket"), F.greatest(F.lit(0.1), F.coalesce("value", F.lit(3.0))).alias("seconds"))


@query("""with n as (select max(ts) now_ from events), q as (select event_id, user_id, ts read_at from events where event_id % 3 = 0 union all select event_id, user_id, null from events where event_id % 3 <> 0)
select event_id, user_id from q, n where read_at is null or read_at + interval 600 minute <= now_ order by event_id limit 50""")
def readable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty messages of a queue that no reader holds: never read, or read longer ago than their time of invisibility."""
    e = _events(spark, sf_dir)
    q = e.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"))
    return sinks.readable(q, e.agg(F.max("ts").alias("now_")), "600 minutes").orderBy("event_id").limit(50).select("event_id", "user_id")


@query("""with b as (select c_custkey k, c_acctbal v from customer union all select o_custkey, 1.0 from orders) select k, round(sum(v), 2) total from b group by k""")
def additive_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances with every order's booking added."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("total"))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("total"))
    return sinks.upserted(c, rows, ["k"], ["total"]).select("k", F.round("total", 2).alias("total"))
