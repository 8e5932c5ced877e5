"""The function library as queries: normalisers, verdicts, similarities, gates, signatures, and small table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks, wire
from ..sources.tables import read
from . import psychometrics, quality, retrieval

QUERIES: dict = {}
SQL: dict[str, str] = {}

KEY = b"a key of the tests"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): each item's name and the next item's."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


_PAIRS = "np as (select x.p_partkey id, x.p_name a, y.p_name b from part x join part y on y.p_partkey = x.p_partkey + 1)"
_UNACCENT = "translate(lower(trim(coalesce({x}, ''), ' ')), '" + T.ACCENTED + "', '" + T.PLAIN + "')"


@query(f"""select conv_id, turn, {_UNACCENT.format(x='"text"')} plain, translate(lower(trim(coalesce("text", ''), ' ')), 'îŷ''’‘`´', 'iy') search,
 trim(regexp_replace(lower(coalesce("text", '')), '[.,;:!?"()\\[\\]«»]', '', 'g'), ' ') token from conversations""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text without case and diacritics, as it is searched for, and as a token with diacritics."""
    x = F.col("text")
    return turns(spark, sf_dir).select("conv_id", "turn", T.unaccent(x).alias("plain"), T.search_form(x).alias("search"), T.normal_token(x).alias("token"))


_EDGE = """[\\s.,!?:;"''`´~^]+"""


@query(f"""with e as (select conv_id, turn, regexp_replace(coalesce("text", ''), '^{_EDGE}|{_EDGE}$', '', 'g') t from conversations),
n as (select conv_id, turn, strip_accents(translate(lower(t), '’‘ʻʼ`´′ç', '''''''''''''''s')) answer from e) select conv_id, turn, answer, replace(replace(answer, '''', ''), '-', '') bare from n""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they are compared: with and without glottal marks."""
    x = F.col("text")
    return turns(spark, sf_dir).select("conv_id", "turn", T.normal_answer(x).alias("answer"), T.normal_answer(x, False).alias("bare"))


@query(f"""with {_PAIRS}, d as (select *, levenshtein(a, b) d, greatest(length(a), length(b), 1) most from np)
select id, case when a = b then 'correct' when (d <= 1 and most >= 4) or (d <= 2 and most >= 6) then 'almost' else 'wrong' end verdict, (case when a = b then 1.0 else round(1 - d / most, 6) end)::double similarity, d::int distance from d""")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names judged as answers to the next one."""
    v = T.fuzzy_verdict(F.col("a"), F.col("b"), F.col("a"), F.col("b"))
    return name_pairs(spark, sf_dir).select("id", v.alias("v")).select("id", "v.verdict", F.round("v.similarity", 6).alias("similarity"), "v.distance")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({x}) - {k}, 0) + 1), lambda i: substring({x}, i, {n})))"


def _sql_grams(x: str, n: int) -> str:
    return _GRAMS.format(x=x, k=n - 1, n=n)


def _sql_jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1))"


_PADDED = "list_distinct(flatten(list_transform(string_split(lower({x}), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(f"""with {_PAIRS}, s as (select id, {_sql_jaccard(_PADDED.format(x="a"), _PADDED.format(x="b"))} tri, {_sql_jaccard(_sql_grams("a", 2), _sql_grams("b", 2))} bi,
 {_sql_jaccard(_sql_grams("a", 1), _sql_grams("b", 1))} chars, {_sql_jaccard("string_split(a, ' ')", "string_split(b, ' ')")} words from np)
select id, round(tri, 6) trigram, case when tri >= 0.9 then 'correct' when tri >= 0.65 then 'almost' else 'wrong' end verdict, round(bi, 6) bigram, round(chars, 6) letters, round(words, 6) words from s""")
def name_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of neighbouring names by padded trigrams (with a verdict), bigrams, letters and words."""
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, sf_dir).select(
        "id",
        F.round(T.trigram_similarity(a, b), 6).alias("trigram"),
        T.trigram_verdict(a, b).alias("verdict"),
        F.round(T.jaccard(T.ngrams(a, 2), T.ngrams(b, 2)), 6).alias("bigram"),
        F.round(T.jaccard(T.char_set(a), T.char_set(b)), 6).alias("letters"),
        F.round(T.jaccard(T.words(a), T.words(b)), 6).alias("words"),
    )


def agreement(a: Column, b: Column, confidence_a: Column, confidence_b: Column) -> Column:
    """Two engines' readings: share of words in common, and whose to take (the surer one's; the first's on a tie)."""
    return F.struct(T.jaccard(T.words(F.lower(a)), T.words(F.lower(b))).alias("agreement"), F.when(confidence_b > confidence_a, "second").otherwise("first").alias("winner"))


@query(f"""with {_PAIRS} select id, round({_sql_jaccard("string_split(lower(a), ' ')", "string_split(lower(b), ' ')")}, 6) agreement, case when length(b) > length(a) then 'second' else 'first' end winner from np""")
def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings compared, and the one to take (a longer name stands for a surer one)."""
    v = agreement(F.col("a"), F.col("b"), F.length("a"), F.length("b"))
    return name_pairs(spark, sf_dir).select("id", v.alias("v")).select("id", F.round("v.agreement", 6).alias("agreement"), "v.winner")


@query("""with g as (select p_partkey, string_split(p_name, ' ') given, [string_split(p_name, ' ')[1], p_type, p_brand] right_ from part)
select p_partkey, len(list_filter(range(1, 4), lambda i: lower(coalesce(given[i], '')) = lower(right_[i]))) correct, 3 gaps from g""")
def gap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with several gaps: how many are right; missing answers are wrong."""
    w = F.split("p_name", " ")
    right = F.array(F.get(w, F.lit(0)), "p_type", "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", T.gap_verdicts(w, right).cast("long").alias("correct"), F.size(right).alias("gaps"))


_WORDS = """list_filter(regexp_split_to_array(trim(coalesce({x}, ''), ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"""


@query(f"""with w as (select conv_id, turn, {_WORDS.format(x='lower("text")')} w from conversations)
select conv_id, turn, len(w) words, case when len(w) < 3 then len(list_distinct(w)) else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) end shingles from w""")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct three-word shingles of each turn."""
    x = F.coalesce("text", F.lit(""))
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(T.words(F.lower(x))).cast("long").alias("words"), F.size(T.word_shingles(x)).cast("long").alias("shingles"))


_ALPHA = "array_to_string(list_transform(string_split({x}, ' '), lambda w: chr((64 + list_position(list_concat(string_split(a, ' '), string_split(b, ' ')), w))::int)), '')"


@query(f"""with {_PAIRS} select id, round(least(1.0, levenshtein(a, b) / greatest(length(b), 1)), 6)::double cer, round(least(1.0, levenshtein({_ALPHA.format(x="a")}, {_ALPHA.format(x="b")}) / len(string_split(b, ' '))), 6)::double wer,
 round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(a, ' '))), 6) "precision", round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(string_split(b, ' '))), 6) recall from np""")
def reading_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and word error rates, precision and recall of a reading against the truth."""
    a, b = F.col("a"), F.col("b")
    pr = T.token_precision_recall(a, b)
    rows = name_pairs(spark, sf_dir).select("id", T.character_error_rate(a, b).alias("c"), T.word_error_rate(a, b).alias("w"), pr.alias("pr"))
    return rows.select("id", F.round("c", 6).alias("cer"), F.round("w", 6).alias("wer"), F.round("pr.precision", 6).alias("precision"), F.round("pr.recall", 6).alias("recall"))


@query(f"""with {_PAIRS}, e as (select n_name nation, levenshtein(a, b) / greatest(length(b), 1) cer from np join supplier on s_suppkey = id % 10 join nation on n_nationkey = s_nationkey)
select nation, count(*) n, round(avg(least(cer, 1.0)), 6) mean_cer, round(max(least(cer, 1.0)), 6)::double worst from e group by nation""")
def errors_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates by category: number, mean and worst."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    e = name_pairs(spark, sf_dir).withColumn("cer", T.character_error_rate(F.col("a"), F.col("b"))).join(s, F.col("id") % 10 == F.col("s_suppkey"))
    return e.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(F.max("cer"), 6).alias("worst"))


@query()
def name_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global and local alignments of neighbouring names."""
    a, b = F.col("a"), F.col("b")
    g, l = T.alignment(a, b), T.alignment(a, b, local=True)
    return name_pairs(spark, sf_dir).select("id", g.alias("g"), l.alias("l")).select("id", F.col("g.first").alias("first"), F.col("g.second").alias("second"), F.col("g.score").alias("score"), F.col("l.first").alias("local_first"), F.col("l.score").alias("local_score"))


_TOK = """tok as (select conv_id, turn, generate_subscripts(w, 1) n, unnest(w) token from (select conv_id, turn, string_split(coalesce("text", ''), ' ') w from conversations))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("n", "token")).withColumn("n", F.col("n") + 1)


@query(f"""with {_TOK}, r as (select *, case when regexp_matches(token, '^[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}$') then 'date' when regexp_matches(token, '^[0-9.,]+$') then 'number'
 when length(token) >= 2 and regexp_matches(token, '^M*(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') then 'roman' when regexp_matches(token, '^\\p{{Lu}}\\p{{Ll}}+$') then 'name' when length(token) < 2 then 'low_confidence' end reason from tok)
select coalesce(reason, 'open') reason, count(*) n, min(token) least_ from r group by 1""")
def protected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that must not be corrected, by reason (a single letter stands for too little confidence)."""
    reason = T.protected(F.col("token"), F.when(F.length("token") < 2, 0.5).otherwise(0.9))
    return tokens(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("open")).alias("reason")).agg(F.count("*").alias("n"), F.min("token").alias("least_"))


@query(f"""with {_TOK}, d as (select distinct token from tok where token <> '') select token, case when token = lower(token) then lower('Éxample') when token = upper(token) then upper('Éxample')
 when substring(token, 1, 1) = upper(substring(token, 1, 1)) then 'Éxample' else 'Éxample' end recased from d""")
def recased_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement in the case of the token it replaces."""
    d = tokens(spark, sf_dir).where("token <> ''").select("token").distinct()
    return d.select("token", T.keep_case(F.col("token"), F.lit("Éxample")).alias("recased"))


@query("""with s as (select doc_id, coalesce("text", '') before, replace(coalesce("text", ''), '1', 'l') after, n_chars % 10 x, n_chars % 7 y from documents)
select doc_id, md5(case when y < x or regexp_extract_all(before, '[0-9]+') <> regexp_extract_all(after, '[0-9]+') then before else after end) kept_md5 from s""")
def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of the text taken back where confidence fell or a number changed."""
    before = F.coalesce("text", F.lit(""))
    kept = T.rollback(before, F.replace(before, F.lit("1"), F.lit("l")), F.col("n_chars") % 10, F.col("n_chars") % 7)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(kept).alias("kept_md5"))


#: Replacements in order, as a phonetic spelling has them.
SOUNDS = [("ph", "f"), ("th", "t"), ("ch", "x"), ("qu", "k"), ("ss", "s")]


@query("""with r as (select conv_id, turn, replace(replace(replace(replace(replace(lower(coalesce("text", '')), 'ph', 'f'), 'th', 't'), 'ch', 'x'), 'qu', 'k'), 'ss', 's') sound from conversations)
select conv_id, turn, sound, regexp_matches(lower(coalesce("text", '')), 'ignore (all |any )?(previous|prior|above) (instructions|rules)|system prompt|you are now|</?(system|assistant)>|disregard .{0,40}instructions') injection from r join conversations using (conv_id, turn)""")
def sounds_and_injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phonetic form by ordered replacements, and whether the text tries to change instructions."""
    return turns(spark, sf_dir).select("conv_id", "turn", T.fold_replacements(F.lower(F.coalesce("text", F.lit(""))), SOUNDS).alias("sound"), T.injection(F.col("text")).alias("injection"))


@query(f"""with {_PAIRS}, s as (select id, replace(replace(replace(replace(replace(a, 'ph', 'f'), 'th', 't'), 'ch', 'x'), 'qu', 'k'), 'ss', 's') x, replace(replace(replace(replace(replace(b, 'ph', 'f'), 'th', 't'), 'ch', 'x'), 'qu', 'k'), 'ss', 's') y from np)
select id, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) likeness from s""")
def phonetic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of the names' phonetic forms."""
    a, b = (T.fold_replacements(F.col(c), SOUNDS) for c in "ab")
    return name_pairs(spark, sf_dir).select("id", F.round(T.edit_similarity(a, b), 6).alias("likeness"))


@query("""select conv_id, turn, array_to_string(list_transform(string_split(coalesce("text", ''), chr(10)), lambda x: reverse(x)), chr(10)) turned from conversations""")
def turned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line reversed."""
    return turns(spark, sf_dir).select("conv_id", "turn", T.reversed_lines(F.coalesce("text", F.lit(""))).alias("turned"))


@query("""with h as (select p_partkey, list_reduce(list_prepend(0::bigint, list_transform(range(1, length(p_name) + 1), lambda i: unicode(substring(p_name, i, 1))::bigint)), lambda h, u: (h * 31 + u) & 2147483647) h from part)
select p_partkey, h % 100 bucket, h % 100 < 20 rolled_out from h""")
def experiment_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's bucket of a hundred, and whether a rollout to 20 % has it."""
    bucket = T.rolling_hash(F.col("p_name"), 100)
    return read(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket")).withColumn("rolled_out", F.col("bucket") < 20)


def _pad(byte: int) -> str:
    return "".join(f"\\x{a ^ byte:02X}" for a in KEY.ljust(64, b"\0"))


_HMAC = f"sha256('{_pad(0x5C)}'::blob || unhex(sha256('{_pad(0x36)}'::blob || encode(c_name))))"


@query(f"""select c_custkey, substring({_HMAC}, 1, 24) pseudonym, c_name || '.' || {_HMAC} token, true valid from customer""")
def signed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms and signed tokens, which are then checked."""
    name = F.col("c_name")
    rows = read(spark, sf_dir, "customer").select("c_custkey", T.pseudonym(name, KEY).alias("pseudonym"), T.signed(name, KEY).alias("token"))
    return rows.withColumn("valid", T.signature_valid(F.col("token"), KEY))


@query("""select o_orderkey, ceil(year(o_orderdate) / 100)::int "century", (year(o_orderdate) // 1)::int year_ from orders""")
def order_centuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.century(y).alias("century"), y.alias("year_"))


@query("""select c_custkey, array_to_string(list_filter(['Email', 'name', 'segment'], lambda k: lower(k) not in ('email', 'phone')), ',') kept from customer""")
def telemetry_without_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without denied keys, whatever their case."""
    payload = F.create_map(F.lit("Email"), F.lit("x@y"), F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.map_keys(sinks.without_keys(payload, ["email", "Phone"]))), ",").alias("kept"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25) / 3 > 0 and (l_quantity - 25) / 4 between -6 and 6 and l_discount * 20 < 1 valid from lineitem""")
def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item parameters that are in their domain."""
    q = F.col("l_quantity") - 25
    ok = psychometrics.valid_item(q / 3, q / 4, F.col("l_discount") * 20)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ok.alias("valid"))


@query("""select event_id from events where regexp_extract(props, '"k": *([0-9]+)', 1) = '69'""")
def found_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose JSON has a value under a key."""
    return sinks.by_metadata(read(spark, sf_dir, "events").withColumnRenamed("props", "metadata"), "k", "69").select("event_id")


@query("""select event_id, regexp_extract(props, '"k": *([0-9]+)', 1)::int k, props metadata from events""")
def all_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's metadata, with a field of it parsed out."""
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.col("props").alias("metadata"))


@query("""select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def unfinished_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of work that no checkpoint has."""
    units = read(spark, sf_dir, "orders").select("o_orderkey")
    done = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return sinks.unfinished(units, done, ["o_orderkey"])


@query("""select n_name, g.chapter::int chapter, 'open' status from nation, (select unnest(range(1, 21)) chapter) g""")
def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty chapters of each variant."""
    return sinks.work_queue(read(spark, sf_dir, "nation").select("n_name"), 20)


@query("""with s as (select o_custkey world, o_orderkey version, o_orderpriority content, o_orderdate created_at from orders) select world, arg_max(version, (created_at, version)) version, arg_max(content, (created_at, version)) content from s group by world""")
def published_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of each world."""
    o = read(spark, sf_dir, "orders")
    return sinks.published(o.select(F.col("o_custkey").alias("world"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("content"), F.struct("o_orderdate", "o_orderkey").alias("created_at")))


@query("""select event_id, user_id, value from events order by ts desc, event_id desc limit 25""")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rows of a log."""
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "value")


@query("""with d as (select p_partkey, p_type right_, list_filter([p_brand, p_name, p_type, ' ', p_brand], lambda x: trim(x, ' ') <> '' and x <> p_type) c from part)
select p_partkey, array_to_string(list_concat([right_], [c[1], c[2]]), '|') options, 3::bigint n from d""")
def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of an item: the right one and distinct others."""
    o = quality.options(F.col("p_type"), F.array("p_brand", "p_name", "p_type", F.lit(" "), "p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(o, "|").alias("options"), F.size(o).cast("long").alias("n"))


_BOX = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 x, l_suppkey % 50 y, l_quantity w from lineitem)"


@query(f"""with o as (select *, greatest(least(x + w, 40) - greatest(x, 10), 0) * greatest(least(y + w, 40) - greatest(y, 10), 0) common from {_BOX})
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(common / (w * w + 900 - common), 6) iou, x >= 0 and y >= 0 and x + w <= 60 and y + w <= 60 inside from o""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of boxes with a region, and whether they are inside a viewport."""
    x, y, w = F.col("l_partkey") % 50, F.col("l_suppkey") % 50, F.col("l_quantity")
    a = {"x1": x, "y1": y, "x2": x + w, "y2": y + w}
    b = {"x1": F.lit(10), "y1": F.lit(10), "x2": F.lit(40), "y2": F.lit(40)}
    inside = (x >= 0) & (y >= 0) & (x + w <= 60) & (y + w <= 60)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(retrieval.iou(a, b), 6).alias("iou"), inside.alias("inside"))


@query("""select distinct l_partkey % 41 item, round(0.2 + 0.8 / (1 + exp(-1.7 * 1.2 * (0.5 - (l_partkey % 41 - 20) / 10.0::double))), 6)::double p from lineitem""")
def client_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's item response: scaling 1.7, guessing .20."""
    item = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 41).alias("item")).distinct()
    p = psychometrics.p3pl(F.lit(0.5), F.lit(1.2), (F.col("item") - 20) / 10.0, F.lit(0.2), scale=1.7)
    return item.select("item", F.round(p, 6).alias("p"))


# ---- messages

EVENT_FIELDS = (wire.Field(1, "event_id", "int"), wire.Field(2, "user_id", "int"), wire.Field(3, "event_type", "string"), wire.Field(4, "value", "double"), wire.Field(5, "props", "string"))
_VAR = "coalesce(1 + (length(bin({x})) + 6) // 7, 0)"
_TXT = "coalesce(1 + (length(bin(strlen({x}))) + 6) // 7 + strlen({x}), 0)"


@query(f"""select event_id, ({_VAR.format(x="event_id")} + {_VAR.format(x="user_id")} + {_TXT.format(x="event_type")} + case when value is null then 0 else 9 end + {_TXT.format(x="props")})::bigint bytes, true same from events""")
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tagged binary messages: the bytes of each, and whether it reads back as it was."""
    names = [f.name for f in EVENT_FIELDS]
    e = read(spark, sf_dir, "events").select(*names).withColumn("k", F.struct(*names))
    back = wire.decode(wire.encode(e, EVENT_FIELDS, ["k"]).withColumn("k", F.struct("k", F.octet_length("message").cast("long").alias("bytes"))), EVENT_FIELDS, ["k"])
    return back.select("k.k.event_id", "k.bytes", F.col("k.k").eqNullSafe(F.struct(*names)).alias("same"))
