"""Corpus curation: sanity, categories, duplicates, chunks, score distributions, inverted index and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read
from . import retrieval

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Near duplicates: words of a shingle, and the similarity from which two texts are alike, in hundredths.
SHINGLE, ALIKE = 5, 80

#: Categories in order, each with the words that give it.
CATEGORIES = [
    ("licence", r"licen[sc]e|copyright|public domain"),
    ("contact", r"[a-z0-9._]+@[a-z0-9.]+|https?://"),
    ("table", r"\|"),
    ("numeric", r"[0-9]{4,}"),
    ("junk", r"[#=*]{4,}"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query("""with r as (select doc_id, lower(coalesce("text", '')) t from documents)
select doc_id, case when regexp_matches(t, 'licen[sc]e|copyright|public domain') then 'licence' when regexp_matches(t, '[a-z0-9._]+@[a-z0-9.]+|https?://') then 'contact'
 when regexp_matches(t, '\\|') then 'table' when regexp_matches(t, '[0-9]{4,}') then 'numeric' when regexp_matches(t, '[#=*]{4,}') then 'junk' else 'general' end category from r""")
def categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching category of each document."""
    return documents(spark, sf_dir).select("doc_id", T.categorise(F.col("text"), CATEGORIES, "general").alias("category"))


@query("""with r as (select doc_id, trim(coalesce("text", ''), ' ') t from documents)
select doc_id, case when length(t) < 40 then 'too_short' when len(regexp_extract_all(t, '\\.{4,}')) >= 2 then 'dotted_leaders'
 when len(regexp_extract_all(t, '[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\v\\.,;:!?\\-''"()\\[\\]/«»–—]')) / greatest(length(t), 1) > 0.18 then 'odd_characters' else 'rest' end reason from r""")
def sanity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the checks that SQL can also make a document fails first."""
    t = F.trim(F.coalesce("text", F.lit("")))
    leaders = F.size(F.regexp_extract_all(t, F.lit(r"\.{4,}"), 0)) >= 2
    odd = F.regexp_count(t, F.lit(T.STRANGE)) / F.greatest(F.length(t), F.lit(1)) > 0.18
    return documents(spark, sf_dir).select("doc_id", F.when(F.length(t) < 40, "too_short").when(leaders, "dotted_leaders").when(odd, "odd_characters").otherwise("rest").alias("reason"))


_ODD = """[^\\p{L}\\p{N}_ \\t\\n\\x0B\\r\\f\\.,;:!?\\-''"()\\[\\]/«»–—]"""
#: SQL has no back-references: a run of one character is sought for each character that a text has.
_RUN = "len(list_filter(list_distinct(string_split({t}, '')), lambda c: {ok} and contains({t}, repeat(c, {n})))) > 0"
_RUNS = "list_sum(list_transform(list_filter(list_distinct(string_split({t}, '')), lambda c: not regexp_matches(c, '[ \\t\\n\\x0B\\r\\f]') and contains({t}, repeat(c, 5))), lambda c: len(regexp_extract_all({t}, regexp_escape(c) || '{{5,}}'))))"


@query(f"""with r as (select doc_id, trim(coalesce("text", ''), ' ') t, coalesce("text", '') x from documents),
m as (select *, regexp_extract_all(t, '\\.{{4,}}|(?:\\.[ \\t\\n\\x0B\\r\\f]*){{5,}}') leaders, len(regexp_extract_all(t, '{_ODD}')) / greatest(length(t), 1) odd, len(regexp_extract_all(x, '{_ODD}')) / greatest(length(x), 1) odd_x,
 list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\r\\f]+'), lambda w: length(w) >= 3) words, len(regexp_extract_all(x, '[\\p{{L}}''-]')) letters, len(regexp_extract_all(lower(x), '[{T.VOWELS}]')) vowels from r),
q as (select *, letters / greatest(length(x), 1) alpha, vowels / greatest(letters, 1) vowel, len(list_filter(words, lambda w: not regexp_matches(lower(w), '[{T.VOWELS}]'))) / greatest(len(words), 1) vowelless from m)
select doc_id, case when length(t) < 40 then 'too_short' when len(leaders) >= 2 or coalesce(list_sum(list_transform(leaders, lambda l: length(l))), 0) > 30 then 'dotted_leaders' when odd > 0.18 then 'odd_characters'
  when {_RUN.format(t="t", n=6, ok="not regexp_matches(c, '[ \\t\\n\\x0B\\r\\f]')")} then 'repeated_run' when len(words) >= 5 and vowelless > 0.35 then 'no_vowels' else 'sound' end reason,
 (case when length(trim(x, ' ')) < 80 then 30.0 when regexp_matches(x, '\\.{{6,}}') then 50.0 when alpha < 0.45 then 40.0 when vowel < 0.18 then 35.0
  when {_RUN.format(t="x", n=6, ok="regexp_matches(c, '[\\p{L}\\p{N}_]')")} then 45.0 else round(least(100.0, 70.0 + alpha * 20.0 + vowel * 10.0), 2) end)::double score,
 odd_x > 0.12 or coalesce({_RUNS.format(t="x")}, 0) > 1 garbled from q""")
def sanity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sanity checks: reason, score and whether the text is garbled."""
    x = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.sanity_reason(x).alias("reason"), T.sanity_score(x).alias("score"), T.garbled(x).alias("garbled"))


@query("""with h as (select doc_id, sha256(regexp_replace(lower(trim(coalesce("text", ''), ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) h from documents)
select h content_hash, count(*) copies, min(doc_id) first_id from h group by h having count(*) > 1""")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, with their first document."""
    h = documents(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""with h as (select sha256(regexp_replace(lower(trim(coalesce("text", ''), ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) h from documents)
select (count(*) - count(distinct h))::bigint duplicates, count(*) total from h""")
def exact_dup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beyond the first of each text."""
    return documents(spark, sf_dir).select(T.content_hash(F.col("text")).alias("h")).groupBy("h").count().agg(F.sum(F.col("count") - 1).alias("duplicates"), F.sum("count").alias("total"))


def shingled_classes(docs: DataFrame) -> DataFrame:
    """(rep, n, grams): a row a distinct text, with the hashes of its word shingles."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+", " "))
    reps = docs.select("doc_id", clean.alias("t")).where("t <> ''").groupBy("t").agg(F.min("doc_id").alias("rep"))

    def make(w: Column) -> Column:
        size = F.size(w) - (SHINGLE - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))
        return F.when(size < 1, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array_distinct(runs))

    grams = T.bound(F.split("t", " "), make)
    return reps.select("rep", grams.alias("grams")).withColumn("n", F.size("grams"))


def near_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, similarity): alike texts, as pairs of the first documents of distinct texts.

    Exact: a text's rarest n - ceil(0.8 n) + 1 shingles hold one that any alike text has among its own, so candidates
    come from an equi-join on these alone; sets are then intersected. Shingles of one text only never join.
    """
    sets = shingled_classes(docs)
    grams = sets.select("rep", "n", F.explode("grams").alias("g"))
    shared = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ranked = grams.join(shared, "g", "left").withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "g")))
    first = ranked.where((F.col("df") > 1) & (F.col("r") <= F.col("n") - F.ceil(F.col("n") * ALIKE / 100) + 1)).select("rep", "n", "g")
    a, b = (first.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), "g") for x in "ab")
    pairs = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.col("na") * 100 >= F.col("nb") * ALIKE) & (F.col("nb") * 100 >= F.col("na") * ALIKE)).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    sized = full.select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb") - both).alias("union_"))
    return sized.where(F.col("both") * 100 >= F.col("union_") * ALIKE).select("a", "b", F.round(F.col("both") / F.col("union_"), 6).alias("similarity"))


_SETS = f"""d as (select doc_id, trim(regexp_replace(lower(coalesce("text", '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') t from documents),
c as (select t, min(doc_id) rep from d where t <> '' group by t), w as (select rep, string_split(t, ' ') w from c),
s as (select rep, case when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) end g from w),
u as (select rep, len(g) n, unnest(g) g from s),
p as (select a.rep a, b.rep b, a.n na, b.n nb, count(*) nboth from u a join u b on a.g = b.g and a.rep < b.rep group by all)"""


@query(f"with {_SETS} select a, b, round(nboth / (na + nb - nboth), 6) similarity from p where nboth * 100 >= (na + nb - nboth) * {ALIKE}")
def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(documents(spark, sf_dir))


def first_kept(pairs: DataFrame) -> DataFrame:
    """(b): the texts of alike pairs (a < b) that go when texts are taken in order and each is held against kept ones only.

    A round settles who has a kept earlier one (it goes) and whose earlier ones are all gone (it stays), until all are.
    """
    spark = pairs.sparkSession
    pairs = retrieval.checkpointed(pairs.select("a", "b"))
    gone, stays = spark.createDataFrame([], "b long"), retrieval.checkpointed(pairs.select(F.col("a").alias("k")).distinct().join(pairs.select(F.col("b").alias("k")), "k", "left_anti"))
    while True:
        fresh_gone = pairs.join(stays, pairs.a == stays.k, "left_semi").select("b").distinct().join(gone, "b", "left_anti")
        now_gone = retrieval.checkpointed(gone.unionByName(fresh_gone))
        open_ = pairs.join(now_gone, "b", "left_anti").join(stays.withColumnRenamed("k", "b"), "b", "left_anti")
        waits = open_.join(now_gone.withColumnRenamed("b", "a"), "a", "left_anti").select("b").distinct()
        fresh_stays = open_.select("b").distinct().join(waits, "b", "left_anti").withColumnRenamed("b", "k")
        now_stays = retrieval.checkpointed(stays.unionByName(fresh_stays))
        settled = now_gone.count() + now_stays.count()
        if settled == gone.count() + stays.count():
            return now_gone
        gone, stays = now_gone, now_stays


@query(f"""with recursive {_SETS}, l as (select a, b from p where nboth * 100 >= (na + nb - nboth) * {ALIKE}), nb as (select b, list(a) before, row_number() over (order by b) k from l group by b),
r(k, gone) as (select 0::bigint, []::bigint[] union all select r.k + 1, case when len(list_filter(nb.before, lambda x: not list_contains(r.gone, x))) > 0 then list_append(r.gone, nb.b) else r.gone end from r join nb on nb.k = r.k + 1),
g as (select gone from r order by k desc limit 1) select c.rep doc_id, (select count(*) from l where l.b = c.rep) earlier, not list_contains((from g), c.rep) kept from c""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts in order of their ids; one that is like an earlier kept one is not kept."""
    docs = documents(spark, sf_dir)
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+", " "))
    reps = docs.select("doc_id", clean.alias("t")).where("t <> ''").groupBy("t").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    pairs = retrieval.checkpointed(near_pairs(docs).select("a", "b"))
    earlier = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.count("*").alias("earlier"))
    gone = first_kept(pairs).select(F.col("b").alias("doc_id"), F.lit(True).alias("gone"))
    out = reps.join(earlier, "doc_id", "left").join(gone, "doc_id", "left")
    return out.select("doc_id", F.coalesce("earlier", F.lit(0)).alias("earlier"), F.col("gone").isNull().alias("kept"))


@query("""select lang, count(*) n, round(avg(n_chars), 4) mean, round(stddev_pop(n_chars), 4) sd, min(n_chars) least_, round(quantile_cont(n_chars, 0.25), 4) p25, round(quantile_cont(n_chars, 0.5), 4) p50,
 round(quantile_cont(n_chars, 0.75), 4) p75, round(quantile_cont(n_chars, 0.9), 4) p90, max(n_chars) most from documents group by lang""")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, population deviation and interpolated percentiles of lengths, by language."""
    x = F.col("n_chars")
    p = {f"p{int(q * 100)}": F.round(F.expr(f"percentile(n_chars, {q}D)"), 4).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)}
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("sd"), F.min(x).alias("least_"), *p.values(), F.max(x).alias("most"))


@query("""with b as (select coalesce(source, 'none') source, case when n_chars < 200 then 'short' when n_chars < 2000 then 'middle' else 'long' end bucket from documents)
select source, count(*) filter (where bucket = 'short') short, count(*) filter (where bucket = 'middle') middle, count(*) filter (where bucket = 'long') long from b group by source""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and length bucket, buckets as columns."""
    bucket = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    p = documents(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("source"), bucket.alias("bucket")).groupBy("source").pivot("bucket", ["short", "middle", "long"]).count()
    return p.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("short", "middle", "long")))


@query("""with f as (select source, lang, avg(n_chars) m from documents group by all) select case when m < 2000 then 'low' when m < 3000 then 'middle' else 'high' end bucket, count(*) groups_ from f group by 1""")
def two_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by source and language, then how many groups have which mean."""
    f = documents(spark, sf_dir).groupBy("source", "lang").agg(F.avg("n_chars").alias("m"))
    return f.groupBy(F.when(F.col("m") < 2000, "low").when(F.col("m") < 3000, "middle").otherwise("high").alias("bucket")).agg(F.count("*").alias("groups_"))


@query("""with r as (select coalesce(lang, 'none') lang, coalesce(source, 'none') source from documents) select lang, source, count(*) n from r group by all""")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


TOKENS = """tok as (select doc_id, lang, source, unnest(list_filter(regexp_split_to_array(lower(coalesce("text", '')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 3)) token from documents)"""


def tokens(docs: DataFrame) -> DataFrame:
    """A row a word of more than three letters or digits."""
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    return docs.select("doc_id", "lang", "source", F.explode(F.filter(parts, lambda t: F.length(t) > 3)).alias("token"))


@query(f"with {TOKENS} select token, count(*) occurrences, count(distinct doc_id) documents, count(distinct source) sources from tok group by token")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words: occurrences, documents, sources.

    A document is one row, so a word's first place in it stands for the document: no grouping by document is needed.
    Words are summed by source, with map-side sums, then over all sources.
    """
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    words = F.array_sort(F.filter(parts, lambda t: F.length(t) > 3))
    first = T.bound(words, lambda w: F.transform(w, lambda t, i: F.struct(t.alias("token"), F.when((i > 0) & (F.get(w, i - 1) == t), 0).otherwise(1).alias("first"))))
    rows = documents(spark, sf_dir).select("source", F.explode(first).alias("t")).select("source", "t.token", "t.first")
    by_source = rows.groupBy("token", "source").agg(F.count("*").alias("n"), F.sum("first").alias("d"))
    return by_source.groupBy("token").agg(F.sum("n").alias("occurrences"), F.sum("d").alias("documents"), F.count("source").alias("sources"))


@query(f"""with {TOKENS}, c as (select token, count(distinct source) sources, string_agg(distinct lang, ',' order by lang) langs from tok group by token)
select token, sources, langs, case when sources >= 3 then 'several' when sources = 2 then 'two' else 'single' end status, case when sources >= 3 then 0.15 when sources = 2 then 0.08 else 0.0 end::double boost, sources >= 2 approved from c""")
def source_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many independent sources have a word, and the confidence that gives."""
    distinct = tokens(documents(spark, sf_dir)).select("token", "source", "lang").distinct()
    c = distinct.groupBy("token").agg(F.count_distinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))
    n = F.col("sources")
    return c.select("token", "sources", "langs", F.when(n >= 3, "several").when(n == 2, "two").otherwise("single").alias("status"), F.when(n >= 3, 0.15).when(n == 2, 0.08).otherwise(0.0).alias("boost"), (n >= 2).alias("approved"))


@query(f"with {TOKENS}, c as (select lang, token, count(*) n from tok group by all), t as (select *, sum(n) over (partition by lang) total from c) select lang, token, n, round(n / total, 6) share from t where n >= 3 and total >= 5 and n / total > 0.005")
def magnet_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that take a large share of their language's corpus."""
    c = tokens(documents(spark, sf_dir)).groupBy("lang", "token").agg(F.count("*").alias("n"))
    t = c.withColumn("total", F.sum("n").over(W.partitionBy("lang")))
    share = F.col("n") / F.col("total")
    return t.where((F.col("n") >= 3) & (F.col("total") >= 5) & (share > 0.005)).select("lang", "token", "n", F.round(share, 6).alias("share"))


@query("""select doc_id, strpos("text", 'License') pos, substring("text", greatest(strpos("text", 'License') - 40, 1), 40 + 7 + 40) snippet from documents where contains("text", 'License')""")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a phrase stands first, with what is around it."""
    pos = F.instr("text", F.lit("License"))
    found = documents(spark, sf_dir).where(F.contains("text", F.lit("License")))
    return found.select("doc_id", pos.cast("long").alias("pos"), F.substring(F.col("text"), F.greatest(pos - 40, F.lit(1)), F.lit(87)).alias("snippet"))


@query("""with recursive s0 as (select doc_id, list_filter(flatten(list_transform(string_split(regexp_replace(coalesce("text", ''), '([.!?])[ \\t\\n\\x0B\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda p: regexp_split_to_array(p, '\\n[ \\t\\n\\x0B\\r\\f]*\\n'))), lambda u: trim(u, ' ') <> '') u from documents),
s as (select doc_id, generate_subscripts(u, 1) k, unnest(u) u from s0),
r(doc_id, k, now_, last_, out_) as (select doc_id, k, u, u, null::varchar from s where k = 1 union all
 select s.doc_id, s.k, case when length(now_) + 1 + length(s.u) <= 700 then now_ || ' ' || s.u when length(last_) < 200 and length(last_) + 1 + length(s.u) <= 700 then last_ || ' ' || s.u else s.u end, s.u, case when length(now_) + 1 + length(s.u) <= 700 then null else now_ end
 from r join s on s.doc_id = r.doc_id and s.k = r.k + 1),
c as (select doc_id, k, out_ chunk from r where out_ is not null union all select doc_id, max(k) + 1, arg_max(now_, k) from r group by doc_id)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int chunk_index, length(chunk)::int n, sha256(regexp_replace(lower(trim(chunk, ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) content_hash from c""")
def linguistic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into chunks of at most 700 characters, a short last sentence repeated; with hashes and places."""
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(T.packed_chunks(T.sentences(F.col("text")), 700, 200)).alias("chunk_index", "chunk"))
    return d.select("doc_id", "chunk_index", F.length("chunk").alias("n"), T.content_hash(F.col("chunk")).alias("content_hash"))


@query("""select coalesce(source, 'none') source, count(*) filter (where contains(lower("text"), 'the ')) the, count(*) filter (where contains(lower("text"), ' de ')) de from documents group by 1""")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return documents(spark, sf_dir).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count_if(F.contains(t, F.lit("the "))).alias("the"), F.count_if(F.contains(t, F.lit(" de "))).alias("de"))


@query("""with q as (select a.p_partkey a, b.p_partkey b, a.p_name x, b.p_name y from part a join part b on b.p_partkey = a.p_partkey + 1)
select a, b, round(len(list_intersect(gx, gy)) / greatest(len(list_distinct(list_concat(gx, gy))), 1), 6) trigram, levenshtein(lower(x), lower(y)) distance
from (select *, list_distinct(list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substring(lower(x), i, 3))) gx, list_distinct(list_transform(range(1, greatest(length(y) - 1, 1)), lambda i: substring(lower(y), i, 3))) gy from q)""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring catalogue names: trigram similarity and edit distance."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    a = part.select(F.col("p_partkey").alias("a"), F.col("name").alias("x"))
    q = a.join(part.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("name").alias("y")), "a")
    return q.select("a", "b", F.round(T.jaccard(T.ngrams(F.col("x"), 3), T.ngrams(F.col("y"), 3)), 6).alias("trigram"), F.levenshtein("x", "y").alias("distance"))
