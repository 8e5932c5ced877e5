"""Content operators: imports, validation, JSON, review lists, pairs and positions, samples, notifications, audit trails."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import ANSWERS, answers, read
from . import matching

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- validation


def answer_map_equal(keys: Column, values: Column, truth: Column) -> Column:
    """Whether given pairs are the truth (a map): the same keys, none twice, each with its value."""
    unique = F.size(keys) == F.size(F.array_distinct(keys))
    right = F.forall(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.coalesce(F.get(F.filter(F.map_values(F.map_filter(truth, lambda k, v: k == p["k"])), lambda v: v.isNotNull()), F.lit(0)) == p["v"], F.lit(False)))
    return unique & (F.size(keys) == F.size(F.map_keys(truth))) & right


@query("""select p_partkey, p_size % 5 <> 0 and p_size % 7 <> 0 as equal, case when p_size % 5 = 0 then 2 else 3 end keys_ from part""")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching exercises: given pairs against the right ones (some have a key twice, some a wrong value)."""
    third = F.when(F.col("p_size") % 5 == 0, "b").otherwise("c")
    keys = F.array(F.lit("a"), F.lit("b"), third)
    values = F.array("p_brand", F.when(F.col("p_size") % 7 == 0, "wrong").otherwise(F.col("p_type")), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")))
    truth = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type"), F.lit("c"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", answer_map_equal(keys, values, truth).alias("equal"), F.size(F.array_distinct(keys)).alias("keys_"))


@query("""select p_partkey, concat_ws(',', case when p_size % 12 not between 1 and 10 then 'level' end, case when p_size % 9 = 0 then 'options' end, case when p_size % 11 = 0 then 'answer' end) errors,
 case when p_type in ('ECONOMY', 'STANDARD', 'PROMO') then p_type else 'GENERAL' end category, case lower(trim(p_brand, ' ')) when 'brand#1' then 'first' when 'brand#2' then 'second' else lower(trim(p_brand, ' ')) end variant,
 coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int), 0) brand_no from part""")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict checks of a payload (level 1 to 10, four options, the answer among them), and names brought to known ones."""
    size = F.col("p_size")
    level = size % 12
    options = F.array("p_brand", "p_type", "p_name", F.when(size % 9 == 0, "").otherwise("none"))
    answer = F.when(size % 11 == 0, "elsewhere").otherwise(F.col("p_type"))
    errors = F.array(F.when(~level.between(1, 10), "level"), F.when(F.size(F.filter(options, lambda o: o != "")) != 4, "options"), F.when(~F.array_contains(options, answer), "answer"))
    category = F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO"), F.col("p_type")).otherwise("GENERAL")
    name = F.lower(F.trim("p_brand"))
    variant = F.when(name == "brand#1", "first").when(name == "brand#2", "second").otherwise(name)
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int)"), F.lit(0))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_compact(errors), ",").alias("errors"), category.alias("category"), variant.alias("variant"), number.alias("brand_no"))


@query("""with b as (select distinct unnest(string_split(p_name, ' ')) w from part where p_size <= 2), t as (select p_partkey, unnest(list_filter(string_split(p_name || ' ' || lower(p_type) || ' of', ' '), lambda x: length(x) > 2)) w from part)
select p_partkey, bool_and(b.w is not null) in_bank, count(*) filter (where b.w is null) missing from t left join b on b.w = t.w group by p_partkey""")
def tokens_in_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all words of more than two letters are in the bank of what has been taught (names of small items)."""
    p = read(spark, sf_dir, "part")
    bank = p.where("p_size <= 2").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().withColumn("known", F.lit(True))
    words = F.filter(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("of")), " "), lambda x: F.length(x) > 2)
    t = p.select("p_partkey", F.explode(words).alias("w")).join(bank, "w", "left")
    return t.groupBy("p_partkey").agg(F.bool_and(F.col("known").isNotNull()).alias("in_bank"), F.count_if(F.col("known").isNull()).alias("missing"))


# ---- JSON


def tolerant_json(text: Column, schema: str) -> Column:
    """A struct parsed from what a model wrote: what stands from the first brace to the last, without trailing commas."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)


@query("""select event_id, case when event_id % 4 = 3 then null else regexp_extract(props, '"k": *([0-9]+)', 1)::int end k from events""")
def tolerant_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with prose around them, a trailing comma, or nothing to parse."""
    p, n = F.col("props"), F.col("event_id") % 4
    said = F.when(n == 0, p).when(n == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```"))).when(n == 2, F.regexp_replace(p, r"\}$", ",}")).otherwise("no object here")
    return read(spark, sf_dir, "events").select("event_id", tolerant_json(said, "k int")["k"].alias("k"))


@query("""select p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || ',"type":"' || p_type || '"}') surface from part""")
def surface_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of an item's canonical JSON: keys in order, no blanks."""
    canonical = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    return read(spark, sf_dir, "part").select("p_partkey", F.sha2(canonical, 256).alias("surface"))


@query("""select r_name, '[' || coalesce(string_agg('{"id":' || n_nationkey || ',"name":"' || n_name || '"}', ',' order by n_nationkey), '') || ']' nations from region left join nation on n_regionkey = r_regionkey group by r_name""")
def children_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children as a JSON array of objects, in the order of their numbers."""
    n = read(spark, sf_dir, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("o"))
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("o")).alias("os"))
    r = read(spark, sf_dir, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select("r_name", F.coalesce(F.to_json("os"), F.lit("[]")).alias("nations"))


# ---- imports


@query("""with s as (select l_partkey exercise, l_linenumber version, l_quantity q, l_orderkey o, l_suppkey s, l_extendedprice e from lineitem)
select exercise, version, arg_max(q, (o, s, q, e)) quantity, count(*) imports from s group by all""")
def imported_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as nested JSON (an order's exercises with their versions), unnested and upserted by exercise and version:
    the latest chapter's entry stays."""
    rows = read(spark, sf_dir, "lineitem")
    version = F.struct(F.col("l_linenumber").alias("version"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))
    chapters = rows.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(version).alias("versions")).groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("exercise"), "versions"))).alias("chapter"))
    schema = "array<struct<exercise: long, versions: array<struct<version: int, s: long, q: double, e: double>>>>"
    x = chapters.select(F.col("l_orderkey").alias("o"), F.explode(F.from_json("chapter", schema)).alias("x")).select("o", "x.exercise", F.explode("x.versions").alias("v"))
    return x.select("exercise", "v.version", F.col("v.q").alias("q"), F.struct("o", "v.s", "v.q", "v.e").alias("at")).groupBy("exercise", "version").agg(F.max_by("q", "at").alias("quantity"), F.count("*").alias("imports"))


@query("""with n as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) k from customer) select c_nationkey variant, ((k - 1) // 200)::int batch, count(*) n, min(c_custkey) first_, max(c_custkey) last_ from n group by all""")
def import_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant's rows in batches of two hundred."""
    k = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    n = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("variant"), F.floor((k - 1) / 200).cast("int").alias("batch"))
    return n.groupBy("variant", "batch").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_"), F.max("c_custkey").alias("last_"))


# ---- filters and lists


@query("""select doc_id, lang, n_chars from documents where coalesce(n_chars, 0) < 500 and lang in ('en', 'de') order by n_chars desc, doc_id limit 20 offset 5""")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the review list: status and flag filtered, sorted, offset and limited."""
    d = read(spark, sf_dir, "documents").where((F.coalesce("n_chars", F.lit(0)) < 500) & F.col("lang").isin("en", "de"))
    return d.orderBy(F.desc("n_chars"), "doc_id").offset(5).limit(20).select("doc_id", "lang", "n_chars")


@query("""select doc_id, source from documents where not (coalesce(lang, '') = 'fr' and n_chars < 1000) and not (coalesce(source, '') like '%src1%')""")
def cleaned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delete of a category and of a metadata pattern leaves."""
    gone = ((F.coalesce("lang", F.lit("")) == "fr") & (F.col("n_chars") < 1000)) | F.coalesce("source", F.lit("")).like("%src1%")
    return read(spark, sf_dir, "documents").where(~F.coalesce(gone, F.lit(False))).select("doc_id", "source")


@query("""select p_partkey, case when regexp_matches(p_name, '^(small|large|hot)\\b') then 'size' when regexp_matches(p_name, '^(red|blue|green)\\b') then 'colour' else 'other' end class from part""")
def prefix_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items classified by what their name starts with."""
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", F.when(n.rlike(r"^(small|large|hot)\b"), "size").when(n.rlike(r"^(red|blue|green)\b"), "colour").otherwise("other").alias("class"))


@query("""with k as (select distinct lower(trim(s_name, ' ')) k from supplier where s_acctbal > 5000), c as (select c_mktsegment, replace(lower(c_name), 'customer', 'supplier') k from customer)
select c_mktsegment segment, count(*) filter (where k in (from k)) kept, count(*) filter (where k not in (from k)) deleted from c group by 1""")
def protected_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run: how many rows of each segment a delete would keep, by a list of protected names, and how many not."""
    kept = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.lower(F.trim("s_name")).alias("k")).distinct().withColumn("protected", F.lit(True))
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")).alias("k"))
    p = F.col("protected").isNotNull()
    return c.join(kept, "k", "left").groupBy("segment").agg(F.count_if(p).alias("kept"), F.count_if(~p).alias("deleted"))


@query("""with x as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) select user_id, event_type, event_id, r = 1 equipped from x""")
def equipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's items of one type the latest is equipped, all others are not."""
    r = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (r == 1).alias("equipped"))


@query("""select doc_id from documents order by md5('7:' || doc_id) limit 25""")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five rows at random, by a seeded hash of the id."""
    return read(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))).limit(25)


@query("""with n as (select count(*) n from documents) select doc_id from documents order by doc_id limit 10 offset (select (n * 37 // 100) from n)""")
def random_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows from an offset that a seed gives."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy("doc_id").offset(d.count() * 37 // 100).limit(10)


# ---- joins by key, name and position


@query("""select doc_id, lang || '::' || doc_id key, item_id is not null has_truth, coalesce(length(b."text"), 0) truth_chars from documents d left join benchmark b on 'en::' || item_id = d.lang || '::' || d.doc_id""")
def pages_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined with their ground truth by name and page number."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", F.col("lang"), F.col("doc_id").cast("string")).alias("k"), F.concat("lang", F.lit("::"), F.col("doc_id").cast("string")).alias("key"))
    b = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("en::"), F.col("item_id").cast("string")).alias("key"), F.length("text").alias("c"))
    return d.join(b, "key", "left").select("doc_id", "key", F.col("c").isNotNull().alias("has_truth"), F.coalesce("c", F.lit(0)).cast("long").alias("truth_chars"))


@query("""with h as (select lower(p_type) name, min(p_partkey) id from part group by 1), e as (select p_partkey, p_name, h.id exact from part left join h on h.name = lower(p_name)),
r as (select e.p_partkey, min(h.id) found from e join h on contains(e.p_name, h.name) where e.exact is null group by 1)
select e.p_partkey, coalesce(e.exact, r.found) id, case when e.exact is not null then 'exact' when r.found is not null then 'contained' else 'none' end how from e left join r using (p_partkey)""")
def historical_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's historical entry by its name, else by one whose name stands anywhere in it."""
    p = read(spark, sf_dir, "part")
    h = p.groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    pages = p.select("p_partkey", F.lower("p_name").alias("lower_name"), "p_name")
    exact = pages.join(h.withColumnsRenamed({"name": "lower_name", "id": "exact"}), "lower_name", "left")
    left = exact.where("exact is null")
    names = left.select(F.col("p_name").alias("key"), F.col("p_name").alias("text")).distinct()
    held = matching.held_patterns(names, h.select(F.col("name").alias("pattern"))).select(F.col("key").alias("p_name"), F.col("pattern").alias("name"))
    words = left.join(held, "p_name").join(h, "name").groupBy("p_partkey").agg(F.min("id").alias("found"))
    out = exact.join(words, "p_partkey", "left")
    return out.select("p_partkey", F.coalesce("exact", "found").alias("id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("found").isNotNull(), "contained").otherwise("none").alias("how"))


_G = "list_distinct(list_transform(range(1, greatest(length({x}) - 2, 0) + 1), lambda i: substring({x}, i, 3)))"


@query(f"""with t as (select p_brand v, p_name s, row_number() over (partition by p_brand order by p_partkey) k from part), f as (select v, s, try_cast(substring(v, 7) as int) no from t where k <= 30),
p as (select a.v a, b.v b, {_G.format(x="a.s")} x, {_G.format(x="b.s")} y from f a join f b on b.no = a.no + 1)
select a, b, count(*) pairs, round(avg((len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) > 0.85)::int), 6) alike from p group by a, b""")
def variant_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty statements of each variant against those of the next: the share of pairs that are nearly the same.

    Thirty a variant are the operator's own sample, so a pair of variants has at most 900 pairs.
    """
    k = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    f = read(spark, sf_dir, "part").select(F.col("p_brand").alias("v"), F.col("p_name").alias("s"), k.alias("k"), F.expr("try_cast(substring(p_brand, 7) as int)").alias("no")).where("k <= 30").withColumn("g", T.ngrams(F.col("s"), 3))
    a, b = f.select(F.col("v").alias("a"), F.col("no").alias("n"), F.col("g").alias("x")), f.select(F.col("v").alias("b"), (F.col("no") - 1).alias("n"), F.col("g").alias("y"))
    p = a.join(b, "n")
    return p.groupBy("a", "b").agg(F.count("*").alias("pairs"), F.round(F.avg((T.jaccard(F.col("x"), F.col("y")) > 0.85).cast("int")), 6).alias("alike"))


@query("""with t as (select n_regionkey r, n_name slot, row_number() over (partition by n_regionkey order by n_nationkey) k from nation), s as (select distinct c_mktsegment chapter, c_nationkey % 5 r from customer),
c as (select r, chapter, row_number() over (partition by r order by chapter) k from s) select t.r region, t.slot, t.k::int position, c.chapter from t left join c on c.r = t.r and c.k = t.k""")
def slots_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's slots and its chapters put together by their position."""
    t = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("slot"), F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("position"))
    s = read(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("region"), F.col("c_mktsegment").alias("chapter")).distinct()
    c = s.withColumn("position", F.row_number().over(W.partitionBy("region").orderBy("chapter")))
    return t.join(c, ["region", "position"], "left").select("region", "slot", "position", "chapter")


# ---- choices over learners


@query(f"""with {ANSWERS}, s as (select user_id, item, max(ts) last_ from answers group by all), asked as (select distinct user_id, item // 10 exercise from s), v as (select distinct item version, item // 10 exercise, (item % 41 - 20) / 10.0::double b from answers),
c as (select a.user_id, a.exercise, v.version, s.last_, abs(v.b - (a.user_id % 7 - 3) / 2.0::double) gap from asked a join v using (exercise) left join s on s.user_id = a.user_id and s.item = v.version),
r as (select *, row_number() over (partition by user_id, exercise order by last_ is not null, case when last_ is null then gap end, last_, version) k from c) select user_id, exercise, version, last_ is null unseen from r where k = 1""")
def version_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each exercise that a learner gets: an unseen one nearest to their ability, else the one seen longest ago."""
    s = answers(read(spark, sf_dir, "events")).groupBy("user_id", "item").agg(F.max("ts").alias("last_"))
    asked = s.select("user_id", F.expr("item div 10").alias("exercise")).distinct()
    v = s.select(F.col("item").alias("version")).distinct().select("version", F.expr("version div 10").alias("exercise"), ((F.col("version") % 41 - 20) / 10.0).alias("b"))
    c = asked.join(v, "exercise").join(s.withColumnRenamed("item", "version"), ["user_id", "version"], "left").withColumn("gap", F.abs(F.col("b") - (F.col("user_id") % 7 - 3) / 2.0))
    order = W.partitionBy("user_id", "exercise").orderBy(F.col("last_").isNotNull(), F.when(F.col("last_").isNull(), F.col("gap")), "last_", "version")
    return c.withColumn("k", F.row_number().over(order)).where("k = 1").select("user_id", "exercise", "version", F.col("last_").isNull().alias("unseen"))


@query(f"""with {ANSWERS}, o as (select item, (item % 41 - 20) / 10.0::double b, user_id from (select distinct user_id, item from answers)),
p as (select *, 0.25 + 0.75 / (1 + exp(-1.702 * ((user_id % 7 - 3) / 2.0::double - b))) p from o), r as (select *, round(1 - abs(p - 0.75), 6) fit from p)
select user_id, item, fit::double fit, k::int k from (select *, row_number() over (partition by user_id order by fit desc, item) k from r) where k <= 3""")
def suitable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three of a learner's items nearest to a success rate of .75."""
    o = answers(read(spark, sf_dir, "events")).select("user_id", "item").distinct()
    p = 0.25 + 0.75 / (1 + F.exp(-1.702 * ((F.col("user_id") % 7 - 3) / 2.0 - (F.col("item") % 41 - 20) / 10.0)))
    r = o.withColumn("fit", F.round(1 - F.abs(p - 0.75), 6))
    return r.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("fit"), "item"))).where("k <= 3")


@query(f"""with {ANSWERS}, r as (select user_id, item, row_number() over (partition by user_id, item % 4 order by item) k from (select distinct user_id, item from answers)) select user_id, item, item % 4 theme, ((k - 1) // 5)::int session from r""")
def thematic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learner's items in sessions of five of one theme."""
    o = answers(read(spark, sf_dir, "events")).select("user_id", "item").distinct().withColumn("theme", F.col("item") % 4)
    k = F.row_number().over(W.partitionBy("user_id", "theme").orderBy("item"))
    return o.select("user_id", "item", "theme", F.floor((k - 1) / 5).cast("int").alias("session"))


@query("""with m as (select s_nationkey model, avg(case when s_acctbal > 0 then s_acctbal end) latency from supplier group by 1), a as (select c_nationkey n, count(*) filter (where c_acctbal > 8000) rare from customer group by 1)
select model, round(latency, 4) latency, (row_number() over (order by latency asc nulls last, model))::int place, coalesce(rare, 0) rare, (row_number() over (order by coalesce(rare, 0), model))::int rarity from m left join a on n = model""")
def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by latency, those without any last; and by how rare their achievement is. A row a nation, so one order is small."""
    m = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.avg(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))).alias("l"))
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("model")).agg(F.count_if(F.col("c_acctbal") > 8000).alias("rare"))
    j = m.join(a, "model", "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("l"), "model"))
    return j.select("model", F.round("l", 4).alias("latency"), place.alias("place"), "rare", F.row_number().over(W.orderBy("rare", "model")).alias("rarity"))


def beams(lines: DataFrame, width: int) -> DataFrame:
    """(key, best, score): of candidates (key, place, text, score) a place, the sequence with the largest sum.

    At each place only so many of the best sequences go on; texts decide ties. A key's places and candidates are few.
    """
    places = lines.groupBy("key", "place").agg(F.collect_list(F.struct("score", "text")).alias("c")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("ps"))
    start = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit("").alias("t")))

    def step(acc: Column, p: Column) -> Column:
        grown = F.flatten(F.transform(acc, lambda b: F.transform(p["c"], lambda c: F.struct((b["s"] + c["score"]).alias("s"), F.concat(b["t"], c["text"]).alias("t")))))
        ordered = F.array_sort(grown, lambda x, y: F.when(x["s"] != y["s"], F.signum(y["s"] - x["s"]).cast("int")).otherwise(F.when(x["t"] < y["t"], -1).when(x["t"] > y["t"], 1).otherwise(0)))
        return F.slice(F.array_distinct(ordered), 1, width)

    best = F.element_at(F.aggregate("ps", start, step), 1)
    return places.select("key", best["t"].alias("best"), best["s"].alias("score"))


@query("""with recursive c as (select l_orderkey k, l_linenumber p, l_returnflag t, max((l_discount * 100)::bigint) s from lineitem group by all), o as (select k, p, row_number() over (partition by k order by p) i from (select distinct k, p from c)),
b(k, i, t, s) as (select distinct k, 0::bigint, '', 0::bigint from c union all select b.k, b.i + 1, b.t || c.t, b.s + c.s from b join o on o.k = b.k and o.i = b.i + 1 join c on c.k = b.k and c.p = o.p),
e as (select k, max(i) i from o group by k) select b.k "key", arg_max(t, (s, [-unicode(x) for x in string_split(t, '')])) best, max(s) score from b join e on e.k = b.k and e.i = b.i group by b.k""")
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sequence of flags of each order, by a beam of three."""
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("text")).agg(F.max(F.round(F.col("l_discount") * 100).cast("long")).alias("score"))
    return beams(c, 3)


# ---- logs


def chained(rows: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """(key, entries, head): a hash chain over each key's payloads in order, sha256(payload : hash before), from 'genesis'.

    Rows are dealt by key and sorted; a task carries one hash from row to row, so a key may have any number of rows. A null
    key is a chain of its own, and a null payload counts as empty. Keys stay longs all the way, however large.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        at, head, n, kind = None, "genesis", 0, pa.int64()

        def ended(chains: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c[0] for c in chains], kind), pa.array([c[1] for c in chains], pa.int64()), pa.array([c[2] for c in chains], pa.string())], [key, "entries", "head"])

        for batch in batches:
            kind, chains = batch.schema.field(key).type, []
            for k, p in zip(batch.column(key).to_pylist(), batch.column("__payload").to_pylist(), strict=True):
                if n and k != at:
                    chains.append((at, n, head))
                    head, n = "genesis", 0
                at, head, n = k, hashlib.sha256(f"{p}:{head}".encode()).hexdigest(), n + 1
            yield ended(chains)
        if n:
            yield ended([(at, n, head)])

    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    dealt = rows.select(key, text.alias("__payload"), *(c for c in order if c != key)).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, f"`{key}` {kind}, entries long, head string")


@query("""with l as (select user_id, list(event_type || event_id order by ts, event_id) p from events group by 1) select user_id, len(p) entries, list_reduce(list_prepend('genesis', p), lambda h, x: sha256(x || ':' || h)) head from l""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each user's hash chain of events."""
    e = read(spark, sf_dir, "events").withColumn("payload", F.concat("event_type", F.col("event_id").cast("string")))
    return chained(e, "user_id", ["ts", "event_id"], "payload")


@query("""with s as (select (event_id % 97) item, event_id, case event_type when 'error' then 'quarantined' when 'view' then 'reviewed' else 'published' end status from events)
select item, arg_max(status, event_id) status, count(*) changes, count(*) filter (where status = 'quarantined') quarantines, max(event_id) filter (where status = 'quarantined') last_quarantine from s group by item""")
def quarantine_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's present status from its log, with its history of quarantines."""
    kind = F.col("event_type")
    s = read(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("item"), "event_id", F.when(kind == "error", "quarantined").when(kind == "view", "reviewed").otherwise("published").alias("status"))
    q = F.col("status") == "quarantined"
    return s.groupBy("item").agg(F.max_by("status", "event_id").alias("status"), F.count("*").alias("changes"), F.count_if(q).alias("quarantines"), F.max(F.when(q, F.col("event_id"))).alias("last_quarantine"))


@query(f"""with {ANSWERS}, f as (select user_id, day, item, arg_min(status, (ts, event_id)) status, count(*) deliveries from answers group by all)
select user_id, day::varchar as day, count(*) items, count(*) filter (where status = 'correct') correct, sum(case status when 'correct' then 20 when 'almost' then 7 else 0 end)::bigint xp, (sum(deliveries) - count(*))::bigint repeated from f group by all""")
def synced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions synced in one batch: answers in order of their own time, an item once, repeats counted."""
    a = answers(read(spark, sf_dir, "events"))
    f = a.groupBy("user_id", "day", "item").agg(F.min_by("status", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("deliveries"))
    xp = F.when(F.col("status") == "correct", 20).when(F.col("status") == "almost", 7).otherwise(0)
    return f.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("items"), F.count_if(F.col("status") == "correct").alias("correct"), F.sum(xp).alias("xp"), (F.sum("deliveries") - F.count("*")).alias("repeated"))


@query("""with n as (select max(ts) now_ from events), last_ as (select user_id, max(ts) filter (where event_type = 'purchase') sent, max(ts) seen from events group by 1)
select user_id, 'new content' message from last_, n where seen > now_ - interval 3 day and (sent is null or sent < now_ - interval 6 day)""")
def content_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who hears of new content: active of late, and not told within six days."""
    e = read(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("sent"), F.max("ts").alias("seen"))
    due = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now_")))).where((F.col("seen") > F.col("now_") - F.expr("interval 3 days")) & (F.col("sent").isNull() | (F.col("sent") < F.col("now_") - F.expr("interval 6 days"))))
    return due.select("user_id", F.lit("new content").alias("message"))


@query(f"""with {ANSWERS}, w as (select user_id, item, count(*) filter (where status = 'wrong') errors, count(*) n from answers group by all),
r as (select user_id, item, case when errors >= 2 then 1 when errors = 1 then 2 when n = 1 then 3 else 4 end source, errors, row_number() over (partition by user_id order by case when errors >= 2 then 1 when errors = 1 then 2 when n = 1 then 3 else 4 end, errors desc, item) k from w)
select user_id, k::int question, item, source, (item + 7) % 100 d1, (item + 31) % 100 d2, (item + 53) % 100 d3 from r where k <= 5""")
def assembled_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five questions a learner, from four sources of falling need (often wrong, once wrong, seen once, the rest), with distractors."""
    w = answers(read(spark, sf_dir, "events")).groupBy("user_id", "item").agg(F.count_if(F.col("status") == "wrong").alias("errors"), F.count("*").alias("n"))
    source = F.when(F.col("errors") >= 2, 1).when(F.col("errors") == 1, 2).when(F.col("n") == 1, 3).otherwise(4)
    k = F.row_number().over(W.partitionBy("user_id").orderBy("source", F.desc("errors"), "item"))
    d = [((F.col("item") + by) % 100).alias(f"d{i}") for i, by in enumerate((7, 31, 53), 1)]
    return w.withColumn("source", source).withColumn("question", k).where("question <= 5").select("user_id", "question", "item", "source", *d)
