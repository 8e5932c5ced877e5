"""Lexical operators: spell correction, morphology, lexicon probability, dictionary entries, search, term evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Documents from which a word's spelling is trusted, whatever the lexicon says.
TRUSTED_DOCS = 9
#: Affixes that a morphological parse knows, in order of preference.
PREFIXES = ["re", "un", "in", "de", "pre", "con"]
SUFFIXES = ["s", "es", "ed", "ing", "er", "ly", "en", "e"]
#: Weights of the four levels of a word's probability.
LEVELS = {"frequency": 0.20, "sources": 0.35, "variant": 0.20, "morphology": 0.25}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def plain_words(text: Column) -> Column:
    """Runs of a to z of the text without case and diacritics."""
    return F.filter(F.split(T.unaccent(text), "[^a-z]+"), lambda w: w != "")


def _sql_words(column: str) -> str:
    return f"""list_filter(string_split_regex(translate(lower(trim(coalesce({column}, ''), ' ')), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z]+'), lambda x: x <> '')"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, uses): the words of the benchmark texts of three letters or more, with the number of texts that have them."""
    words = F.explode(F.array_distinct(plain_words(F.col("text"))))
    return read(spark, sf_dir, "benchmark").select(words.alias("term")).where(F.length("term") > 2).groupBy("term").agg(F.count("*").alias("uses"))


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, doc_id, lang, source): the distinct words of each document."""
    words = F.explode(F.array_distinct(plain_words(F.col("text"))))
    return read(spark, sf_dir, "documents").select(words.alias("word"), "doc_id", "lang", "source")


_LEX = f"""lex as (select term, count(*) uses from (select unnest(list_distinct({_sql_words('"text"')})) term from benchmark) where length(term) > 2 group by term),
cw as (select unnest(list_distinct({_sql_words('"text"')})) word, doc_id, lang, source from documents)"""


# ---- spell correction


def allowed_distance(word: Column) -> Column:
    """Edits that a word may be corrected by: none up to 3 letters, 1 up to 5, else 2."""
    return F.when(F.length(word) <= 3, 0).when(F.length(word) <= 5, 1).otherwise(2)


def deletions(word: Column, most: int = 2) -> Column:
    """The word and what is left of it with up to so many letters deleted."""

    def one_less(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    out = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, one_less)))
        out = F.array_union(out, level)
    return out


#: Words of more letters are compared by pieces, not by deletions, whose number grows with the square of the length.
SHORT_WORD = 12


def pieces(term: Column) -> Column:
    """The thirds of a term, each with the term's length and its own number: (length, third, piece)."""
    n = F.length(term)

    def third(k: Column) -> Column:
        start, end = F.floor(n * k / 3), F.floor(n * (k + 1) / 3)
        return F.struct(n.alias("length"), k.alias("third"), F.substr(term, (start + 1).cast("int"), (end - start).cast("int")).alias("piece"))

    return F.transform(F.sequence(F.lit(0), F.lit(2)), third)


def possible_pieces(word: Column) -> Column:
    """Thirds that terms within two edits of a word may have in common with it: of two edits one third at least is spared,
    and moved by two places at most. Some 75 a word, whatever its length."""
    n = F.length(word)

    def third(length: Column, k: Column, moved: Column) -> Column:
        start, end = F.floor(length * k / 3), F.floor(length * (k + 1) / 3)
        at = start + moved
        fits = (at >= 0) & (at + end - start <= n)
        return F.when(fits, F.struct(length.alias("length"), k.alias("third"), F.substr(word, (at + 1).cast("int"), (end - start).cast("int")).alias("piece")))

    thirds = lambda length, k: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda moved: third(length, k, moved))
    every = F.transform(F.sequence(n - 2, n + 2), lambda length: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: thirds(length, k))))
    return F.array_distinct(F.filter(F.flatten(every), lambda x: x.isNotNull()))


def corrections(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, corrected, distance): for each word the nearest term of a lexicon (term, uses) within its allowed distance.

    Two words within two edits share what is left of both after two deletions at most, so candidates of short words come
    from an equi-join on deletions; those of longer ones share a third, at nearly the same place, and come from an equi-join
    on thirds. Each candidate is then measured. Ties go to the term with more uses, then by spelling. The rows of a join are
    some ten to a hundred a word, whatever its length and the size of the lexicon.
    """
    asked = words.select("word", allowed_distance(F.col("word")).alias("allowed")).where("allowed > 0")
    near = F.length("word") <= SHORT_WORD
    known = terms.select("term", "uses")
    left = asked.where(near).withColumn("key", F.explode(deletions(F.col("word"))))
    right = known.where(F.length("term") <= SHORT_WORD + 2).withColumn("key", F.explode(deletions(F.col("term"))))
    longer = asked.where(~near).withColumn("key", F.explode(possible_pieces(F.col("word"))))
    parts = known.where(F.length("term") >= SHORT_WORD - 1).withColumn("key", F.explode(pieces(F.col("term"))))
    pairs = left.join(right, "key").drop("key").union(longer.join(parts, "key").drop("key")).select("word", "allowed", "term", "uses").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("word", "term", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("allowed")))
    best = F.min_by(F.struct("term", "distance"), F.struct("distance", -F.col("uses"), "term"))
    return pairs.groupBy("word").agg(best.alias("b")).select("word", F.col("b.term").alias("corrected"), F.col("b.distance").alias("distance"))


ROMAN = "^[ivxlcdm]+$"


def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, docs, decision, corrected, distance) of every word of the corpus; see spelling_decisions."""
    lex = lexicon(spark, sf_dir)
    words = corpus_words(spark, sf_dir).groupBy("word").agg(F.count_distinct("doc_id").alias("docs"))
    known = words.join(lex.select(F.col("term").alias("word"), F.lit(True).alias("known")), "word", "left")
    w = F.col("word")
    open_ = known.where(F.col("known").isNull() & ~w.rlike(ROMAN) & (F.col("docs") < TRUSTED_DOCS)).select("word")
    out = known.join(corrections(open_, lex), "word", "left")
    found, off = F.col("corrected").isNotNull(), F.abs(F.length("corrected") - F.length("word")) >= 2
    decision = F.when(F.col("known"), "known").when(w.rlike(ROMAN), "number").when(F.col("docs") >= TRUSTED_DOCS, "trusted").when(F.length(w) <= 3, "too_short").when(~found, "no_candidate").when(off, "size_differs").otherwise("corrected")
    applied = decision == "corrected"
    return out.select("word", "docs", decision.alias("decision"), F.when(applied, F.col("corrected")).alias("corrected"), F.when(applied, F.col("distance")).alias("distance"))


_SPELL = f"""{_LEX}, w as (select word, count(distinct doc_id) docs from cw group by word),
o as (select w.word, case when length(word) <= 5 then 1 else 2 end allowed from w where not exists (select 1 from lex where term = w.word) and not regexp_full_match(word, '[ivxlcdm]+') and docs < {TRUSTED_DOCS} and length(word) > 3),
p as (select word, term, uses, levenshtein(word, term) d, allowed from o join lex on abs(length(word) - length(term)) <= allowed where levenshtein(word, term) <= allowed),
b as (select word, arg_min(term, (d, -uses, term)) term, min(d) d from p group by word),
spell as (select w.word, docs, case when l.term is not null then 'known' when regexp_full_match(w.word, '[ivxlcdm]+') then 'number' when docs >= {TRUSTED_DOCS} then 'trusted' when length(w.word) <= 3 then 'too_short'
  when b.term is null then 'no_candidate' when abs(length(b.term) - length(w.word)) >= 2 then 'size_differs' else 'corrected' end decision, b.term t, b.d d from w left join lex l on l.term = w.word left join b on b.word = w.word),
spelling as (select word, docs, decision, case when decision = 'corrected' then t end corrected, case when decision = 'corrected' then d end::int distance from spell)"""


@query(f"with {_SPELL} select * from spelling")
def spelling_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each word: known, a roman number, trusted by its spread, too short, without a candidate, with one of
    too different a length, or corrected by the nearest term."""
    return spelling(spark, sf_dir)


@query(f"""with {_SPELL}, u as (select doc_id, generate_subscripts(w, 1) n, unnest(w) word from (select doc_id, {_sql_words('"text"')} w from documents))
select doc_id, count(*) words, count(corrected) corrections, md5(string_agg(coalesce(corrected, u.word), ' ' order by n)) text_md5 from u left join spelling s on s.word = u.word group by doc_id""")
def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as their words, each corrected where the lexicon has a better one: counts and a digest of the new text."""
    fixed = spelling(spark, sf_dir).where("decision = 'corrected'").select("word", "corrected")
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(plain_words(F.col("text"))).alias("n", "word"))
    joined = words.join(fixed, "word", "left").select("doc_id", F.struct("n", F.coalesce("corrected", "word").alias("w")).alias("p"), F.col("corrected").isNotNull().cast("int").alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"]), " ")
    return joined.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("c").alias("corrections"), F.md5(text).alias("text_md5"))


@query(f"""with {_SPELL}, c as (select corrected target, count(*) n from spelling where corrected is not null group by 1), t as (select *, (sum(n) over ())::bigint total from c)
select target, n, round(n / total, 6) share, total >= 5 and n / total > 0.2 and n >= 3 magnet from t""")
def correction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term is the target of a correction, and which draw suspiciously many."""
    c = spelling(spark, sf_dir).where("corrected is not null").groupBy(F.col("corrected").alias("target")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return c.crossJoin(F.broadcast(total)).select("target", "n", F.round(share, 6).alias("share"), ((F.col("total") >= 5) & (share > 0.2) & (F.col("n") >= 3)).alias("magnet"))


# ---- morphology


def analyses(words: DataFrame, stems: DataFrame) -> DataFrame:
    """(word, rule, prefix, stem, suffix, bonus): each word's best decomposition into affixes and a known stem (term).

    In order: the word is a stem; prefix and stem; stem and suffix; both. Affixes in their listed order. Words are
    exploded to their possible stems, which are joined with the known ones.
    """
    w = F.col("word")
    none = F.lit("")

    def option(rank: int, prefix: str, suffix: str) -> Column:
        size = len(prefix) + len(suffix)
        fits = F.startswith(w, F.lit(prefix)) & F.endswith(w, F.lit(suffix)) & (F.length(w) > size + 1)
        stem = F.substring(w, F.lit(len(prefix) + 1), F.length(w) - size)
        return F.when(fits, F.struct(F.lit(rank).alias("rank"), F.lit(prefix).alias("prefix"), stem.alias("stem"), F.lit(suffix).alias("suffix")))

    pairs = [("", ""), *((p, "") for p in PREFIXES), *(("", s) for s in SUFFIXES), *((p, s) for p in PREFIXES for s in SUFFIXES)]
    options = F.array_compact(F.array(*(option(k, p, s) for k, (p, s) in enumerate(pairs))))
    tried = words.select("word", F.explode(options).alias("o")).select("word", "o.*").join(stems.select(F.col("term").alias("stem")), "stem")
    best = tried.groupBy("word").agg(F.min_by(F.struct("prefix", "stem", "suffix"), "rank").alias("b"), F.min("rank").alias("rank"))
    rank = F.col("rank")
    bounds = (0, len(PREFIXES), len(PREFIXES) + len(SUFFIXES))
    rule = F.when(rank <= bounds[0], "stem").when(rank <= bounds[1], "prefix").when(rank <= bounds[2], "suffix").otherwise("circumfix")
    bonus = F.when(rank <= bounds[0], 0.15).when(rank <= bounds[2], 0.20).otherwise(0.25)
    found = best.select("word", rule.alias("rule"), F.col("b.prefix").alias("prefix"), F.col("b.stem").alias("stem"), F.col("b.suffix").alias("suffix"), bonus.alias("bonus"))
    out = words.join(found, "word", "left")
    return out.select("word", F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("prefix", none).alias("prefix"), F.coalesce("stem", "word").alias("stem"), F.coalesce("suffix", none).alias("suffix"), F.coalesce("bonus", F.lit(0.0)).alias("bonus"))


_PAIRS = [("", ""), *((p, "") for p in PREFIXES), *(("", s) for s in SUFFIXES), *((p, s) for p in PREFIXES for s in SUFFIXES)]
_MORPH = f"""{_LEX}, dw as (select distinct word from cw), af(rank, prefix, suffix) as (values {", ".join(f"({k}, '{p}', '{s}')" for k, (p, s) in enumerate(_PAIRS))}),
an as (select word, rank, prefix, suffix, term stem from dw join af on starts_with(word, prefix) and ends_with(word, suffix) and length(word) > length(prefix) + length(suffix) + 1
  join lex on term = substring(word, length(prefix) + 1, length(word) - length(prefix) - length(suffix))),
ab as (select word, min(rank) rank, arg_min(prefix, rank) prefix, arg_min(stem, rank) stem, arg_min(suffix, rank) suffix from an group by word),
morph as (select dw.word, case when rank is null then 'none' when rank = 0 then 'stem' when rank <= {len(PREFIXES)} then 'prefix' when rank <= {len(PREFIXES) + len(SUFFIXES)} then 'suffix' else 'circumfix' end rule,
  coalesce(prefix, '') prefix, coalesce(stem, dw.word) stem, coalesce(suffix, '') suffix,
  (case when rank is null then 0 when rank = 0 then 0.15 when rank <= {len(PREFIXES) + len(SUFFIXES)} then 0.2 else 0.25 end)::double bonus from dw left join ab on ab.word = dw.word)"""


@query(f"with {_MORPH} select * from morph")
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus parsed into prefix, stem of the lexicon, and suffix."""
    return analyses(corpus_words(spark, sf_dir).select("word").distinct(), lexicon(spark, sf_dir))


def _alternatives(affixes: list[str]) -> str:
    return "|".join(sorted(affixes, key=lambda a: (-len(a), a)))


def stripped(word: Column) -> tuple[Column, Column]:
    """(root, affixes) without a lexicon: at most one prefix, then two suffixes, the longest first, while three letters
    or more are left."""
    front, back = f"^({_alternatives(PREFIXES)})(?=.{{3}})", f"^.{{3,}}?({_alternatives(SUFFIXES)})$"
    prefix = F.regexp_extract(word, front, 1)
    less = F.regexp_replace(word, front, "")
    cut = lambda w: F.substring(w, F.lit(1), F.length(w) - F.length(F.regexp_extract(w, back, 1)))
    first, second = F.regexp_extract(less, back, 1), F.regexp_extract(cut(less), back, 1)
    said = [F.when(prefix != "", F.concat(prefix, F.lit("-"))), *(F.when(x != "", F.concat(F.lit("-"), x)) for x in (first, second))]
    return cut(cut(less)), F.array_compact(F.array(*said))


def _sql_strip(root: str, affixes: list[str], front: bool, what: str) -> str:
    """A CASE over affixes: what is left of root, or the affix taken."""
    out = []
    for a in sorted(affixes, key=lambda a: (-len(a), tuple(-ord(c) for c in a))):
        fits = f"{'starts_with' if front else 'ends_with'}({root}, '{a}') and length({root}) >= {len(a) + 3}"
        rest = f"substring({root}, {len(a) + 1})" if front else f"left({root}, length({root}) - {len(a)})"
        said = f"{a}-" if front else f"-{a}"
        out.append(f"when {fits} then {rest if what == 'rest' else repr(said)}")
    return f"case {' '.join(out)} {f'else {root}' if what == 'rest' else ''} end"


_STRIP = f"""{_LEX}, s0 as (select distinct term word from lex), s1 as (select word, {_sql_strip("word", PREFIXES, True, "rest")} r1, {_sql_strip("word", PREFIXES, True, "affix")} a1 from s0),
s2 as (select *, {_sql_strip("r1", SUFFIXES, False, "rest")} r2, {_sql_strip("r1", SUFFIXES, False, "affix")} a2 from s1),
s3 as (select *, {_sql_strip("r2", SUFFIXES, False, "rest")} r3, {_sql_strip("r2", SUFFIXES, False, "affix")} a3 from s2),
strip as (select word, r3 root, list_filter([a1, a2, a3], lambda x: x is not null) affixes from s3)"""


@query(f"with {_STRIP} select word, root, array_to_string(affixes, ' ') affixes from strip")
def stripped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the lexicon without affixes, found by stripping alone."""
    root, affixes = stripped(F.col("word"))
    return lexicon(spark, sf_dir).select(F.col("term").alias("word")).select("word", root.alias("root"), F.array_join(affixes, " ").alias("affixes"))


@query(f"""with {_STRIP}, n as (select *, row_number() over (order by word) i from strip), p as (select a.word a, b.word b, a.root ra, b.root rb, a.affixes fa, b.affixes fb from n a join n b on b.i = a.i + 1)
select a, b, round(case when ra = rb then 0.7 + 0.3 * case when len(fa) + len(fb) = 0 then 1 else len(list_intersect(fa, fb)) / len(list_distinct(list_concat(fa, fb))) end
 else 0.4 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) end, 6)::double similarity from p""")
def morphological_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring terms: of one root .70 and .30 of their affixes' share in common, else .40 of the edit similarity."""
    root, affixes = stripped(F.col("a"))
    terms = lexicon(spark, sf_dir).select(F.col("term").alias("a"))
    parsed = terms.select("a", root.alias("ra"), affixes.alias("fa"))
    # a lexicon's next term by spelling, found by ranges that one total order is cut into
    order = W.orderBy("a")
    pairs = parsed.select("a", "ra", "fa", F.lead(F.struct(F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("fa").alias("fb"))).over(order).alias("n")).where("n is not null").select("a", "ra", "fa", "n.*")
    union = F.size(F.array_union("fa", "fb"))
    shared = F.when(F.size("fa") + F.size("fb") == 0, 1.0).otherwise(F.size(F.array_intersect("fa", "fb")) / F.greatest(union, F.lit(1)))
    return pairs.select("a", "b", F.round(F.when(F.col("ra") == F.col("rb"), 0.7 + 0.3 * shared).otherwise(0.4 * T.edit_similarity(F.col("a"), F.col("b"))), 6).alias("similarity"))


@query(f"""with {_MORPH}, t as (select count(distinct source) sources from documents), f as (select word, count(distinct doc_id) docs, count(distinct source) sources from cw group by word),
v as (select word, max(n) / sum(n) share, arg_max(lang, (n, lang)) lang from (select word, lang, count(*) n from cw where lang is not null group by all) group by word),
q as (select f.word, f.docs, least(1.0, (f.docs + 1) / 10.0) freq, f.sources / t.sources hist, coalesce(v.share, 0.1) var, v.lang, case m.rule when 'stem' then 0.95 when 'none' then 0.0 else 0.85 end mor
 from f cross join t join morph m on m.word = f.word left join v on v.word = f.word)
select word, docs, lang, round(hist, 6) sources, round(var, 6) variant, mor::double morphology, round(0.2::double * freq::double + 0.35::double * hist + 0.2::double * var + 0.25::double * mor::double, 6) probability from q""")
def lexicon_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's probability at four levels: documents that have it, sources that do, its share in one language, morphology."""
    words = corpus_words(spark, sf_dir)
    total = read(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("all_sources"))
    seen = words.groupBy("word").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("n_sources"))
    by_lang = words.where("lang is not null").groupBy("word", "lang").agg(F.count("*").alias("n")).groupBy("word").agg((F.max("n") / F.sum("n")).alias("share"), F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    m = analyses(words.select("word").distinct(), lexicon(spark, sf_dir)).select("word", F.when(F.col("rule") == "stem", 0.95).when(F.col("rule") == "none", 0.0).otherwise(0.85).alias("morphology"))
    q = seen.join(m, "word").join(by_lang, "word", "left").crossJoin(F.broadcast(total))
    freq, hist, var = F.least(F.lit(1.0), (F.col("docs") + 1) / 10.0), F.col("n_sources") / F.col("all_sources"), F.coalesce("share", F.lit(0.1))
    p = LEVELS["frequency"] * freq + LEVELS["sources"] * hist + LEVELS["variant"] * var + LEVELS["morphology"] * F.col("morphology")
    return q.select("word", "docs", "lang", F.round(hist, 6).alias("sources"), F.round(var, 6).alias("variant"), "morphology", F.round(p, 6).alias("probability"))


# ---- dictionary entries

#: A line that starts an entry: a headword, its class between commas or in brackets, or a bare colon or dash.
ENTRY = r"^([A-Za-zÀ-ÿ][0-9A-Za-z_À-ÿ'-]{0,30})\s*(?:,\s*([a-z]{1,6}\.)|\(([^)]+)\)|[:—–-]\s)\s*(.*)$"
#: Words that look like headwords and introduce examples or notes.
NOT_HEADWORDS = ["ex", "exemplo", "nota", "obs", "observacao", "observação", "veja", "v"]
#: Longest chunk of an entry.
ENTRY_CHARS = 1500


def entry_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, headword, class): lines of documents that aren't blank; headword where one starts an entry."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw")).select("doc_id", "line", F.trim("raw").alias("text")).where("text <> ''")
    part = lambda k: F.regexp_extract("text", ENTRY, k)
    starts = F.col("text").rlike(ENTRY) & ~F.lower(part(1)).isin(NOT_HEADWORDS)
    return lines.select("doc_id", "line", "text", F.when(starts, part(1)).alias("headword"), F.when(starts, F.concat(part(2), part(3))).alias("class"))


_RE = ENTRY.replace("'", "''")
_ENTRY = f"""ln as (select doc_id, (generate_subscripts(l, 1) - 1)::int line, trim(unnest(l), ' ') t from (select doc_id, string_split(coalesce("text", ''), chr(10)) l from documents)),
el as (select doc_id, line, t, regexp_matches(t, '{_RE}') and lower(regexp_extract(t, '{_RE}', 1)) not in ({", ".join(f"'{w}'" for w in NOT_HEADWORDS)}) starts from ln where t <> ''),
ent as (select doc_id, line, t, case when starts then regexp_extract(t, '{_RE}', 1) end headword, case when starts then regexp_extract(t, '{_RE}', 2) || regexp_extract(t, '{_RE}', 3) end class_ from el),
grp as (select *, (count(headword) over (partition by doc_id order by line))::int entry from ent),
entries as (select doc_id, entry, coalesce(max(headword), 'general') headword, coalesce(max(class_), '') class_, count(*) lines_, string_agg(t, chr(10) order by line) body from grp group by doc_id, entry)"""


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, entry, headword, class_, lines_, body): lines up to the next headword, joined; 0: what stands before any."""
    before = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    numbered = entry_lines(docs).withColumn("entry", F.count("headword").over(before).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return numbered.groupBy("doc_id", "entry").agg(F.coalesce(F.max("headword"), F.lit("general")).alias("headword"), F.coalesce(F.max("class"), F.lit("")).alias("class_"), F.count("*").alias("lines_"), body.alias("body"))


@query(f"with {_ENTRY} select doc_id, entry, headword, class_, lines_, md5(body) body_md5 from entries")
def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into dictionary entries by their headwords, with class and number of lines."""
    return entries(read(spark, sf_dir, "documents")).select("doc_id", "entry", "headword", "class_", "lines_", F.md5("body").alias("body_md5"))


@query(f"""with {_ENTRY}, c as (select doc_id, entry, headword, class_, body, ceil(length(body) / {ENTRY_CHARS}.0)::int parts from entries),
k as (select doc_id, entry, headword, class_, parts, generate_subscripts(range(0, parts), 1)::int part, body from c)
select doc_id, entry, part, case when parts = 1 then body else '[' || headword || case when class_ <> '' then ' (' || class_ || ')' else '' end || ' - part ' || part || ']' || chr(10) || substring(body, (part - 1) * {ENTRY_CHARS} + 1, {ENTRY_CHARS}) end chunk from k""")
def dictionary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as chunks of bounded length; each part of a longer one starts with its headword, class and number."""
    e = entries(read(spark, sf_dir, "documents")).withColumn("parts", F.ceil(F.length("body") / ENTRY_CHARS).cast("int"))
    k = e.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    name = F.concat(F.lit("["), "headword", F.when(F.col("class_") != "", F.concat(F.lit(" ("), "class_", F.lit(")"))).otherwise(""), F.lit(" - part "), F.col("part").cast("string"), F.lit("]\n"))
    piece = F.substring(F.col("body"), (F.col("part") - 1) * ENTRY_CHARS + 1, F.lit(ENTRY_CHARS))
    return k.select("doc_id", "entry", "part", F.when(F.col("parts") == 1, F.col("body")).otherwise(F.concat(name, piece)).alias("chunk"))


def suspicions(lemma: Column, definition: Column) -> Column:
    """What looks wrong about an entry, as an array of flags."""
    return F.array_compact(
        F.array(
            F.when(lemma.rlike("[0-9]"), "digit_in_lemma"),
            F.when(lemma.rlike(r"[#$%*_+=<>{}]"), "symbol_in_lemma"),
            F.when((F.length(lemma) < 2) & ~lemma.isin("y", "a", "e", "o", "u", "i"), "lone_letter"),
            F.when(F.contains(F.substring(definition, 1, 20), F.lit("?")), "question_mark"),
            F.when(F.length(F.trim(definition)) < 5, "cut_definition"),
        )
    )


@query("""with l as (select conv_id, turn, split_part(coalesce("text", ''), ' ', 1) lemma, substring(coalesce("text", ''), length(split_part(coalesce("text", ''), ' ', 1)) + 2) def from conversations)
select conv_id, turn, regexp_replace(lemma, '[¹²³⁴⁵?!.,]', '', 'g') lemma, concat_ws(',', case when regexp_matches(lemma, '[0-9]') then 'digit_in_lemma' end, case when regexp_matches(lemma, '[#$%*_+=<>{}]') then 'symbol_in_lemma' end,
 case when length(lemma) < 2 and lemma not in ('y', 'a', 'e', 'o', 'u', 'i') then 'lone_letter' end, case when contains(substring(def, 1, 20), '?') then 'question_mark' end, case when length(trim(def, ' ')) < 5 then 'cut_definition' end) flags from l""")
def entry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as entries (a lemma, then its definition): the lemma without marks, and what looks wrong."""
    t = F.coalesce("text", F.lit(""))
    lemma = F.element_at(F.split(t, " "), 1)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", lemma.alias("raw"), F.substring(t, F.length(lemma) + 2, F.length(t)).alias("def"))
    return rows.select("conv_id", "turn", F.regexp_replace("raw", "[¹²³⁴⁵?!.,]", "").alias("lemma"), F.array_join(suspicions(F.col("raw"), F.col("def")), ",").alias("flags"))


@query("""with s as (select p_partkey, string_split(p_name, ' ') w from part) select p_partkey, w[1] headword, array_to_string(w[2:], '|') variants, len(w) - 1 n from s""")
def headword_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's first word as headword, the others as its variants."""
    w = F.split("p_name", " ")
    return read(spark, sf_dir, "part").select("p_partkey", F.element_at(w, 1).alias("headword"), F.array_join(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), "|").alias("variants"), (F.size(w) - 1).cast("long").alias("n"))


#: Strings that show a page was scanned upside down: mirrored letters in runs.
TURNED = ["ʇ", "ǝ", "ɐ", "dn ", "D44)", "d44)"]


@query("""select doc_id, {} upside_down, "text" is not null and length(trim("text", ' ')) >= 120 digital from documents""".format(" or ".join(f"""contains(coalesce("text", ''), '{m}')""" for m in TURNED)))
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's own text serves (120 characters or more), and whether it looks scanned upside down."""
    t = F.coalesce("text", F.lit(""))
    turned = reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in TURNED))
    return read(spark, sf_dir, "documents").select("doc_id", turned.alias("upside_down"), (F.length(F.trim(t)) >= 120).alias("digital"))


# ---- search and evidence


def search(catalog: DataFrame, asked: str, kind: str | None = None, brand: str | None = None, size: int | None = None) -> DataFrame:
    """(id, label, score, axis) of a catalogue (id, label, other, root, kind, brand, size), by the first axis that matches.

    Axes in order: the label, the other name (times .95), the root (.85). Filters that are null take everything.
    """
    rows = catalog
    for name, value in (("kind", kind), ("brand", brand)):
        if value:
            rows = rows.where(F.contains(F.lower(name), F.lit(value.lower())))
    if size is not None:
        rows = rows.where(F.col("size").isNull() | (F.col("size") == size))
    q = F.lit(asked)
    rows = rows.withColumns({"by_label": T.text_score(q, F.lower("label")), "by_other": T.text_score(q, F.lower("other"))})
    axis = F.when(F.col("by_label") >= 0.5, "lexical").when(F.col("by_other") >= 0.5, "translation").when(F.col("root") == q, "root")
    score = F.when(F.col("by_label") >= 0.5, F.col("by_label")).when(F.col("by_other") >= 0.5, F.col("by_other") * 0.95).otherwise(0.85)
    return rows.select("id", "label", F.round(score, 6).alias("score"), axis.alias("axis")).where("axis is not null")


_SCORE = "case when {x} = 'small' then 1.0 when starts_with({x}, 'small') then 0.92 when contains({x}, 'small') then 0.78 else 0.7 * greatest(0, 1 - levenshtein('small', {x}) / greatest(5, length({x}), 1)) end"


@query(f"""with c as (select p_partkey id, p_name label, lower(p_type) other, string_split(p_name, ' ')[2] root, p_brand brand from part where contains(lower(p_brand), 'brand#1')),
s as (select *, {_SCORE.format(x="lower(label)")} a, {_SCORE.format(x="other")} b from c), r as (select id, label, round((case when a >= 0.5 then a when b >= 0.5 then b * 0.95 else 0.85 end)::double, 6) score, case when a >= 0.5 then 'lexical' when b >= 0.5 then 'translation' when root = 'small' then 'root' end axis from s),
d as (select *, row_number() over (partition by label order by score desc, id) k from r where axis is not null) select id, label, score, axis from d where k = 1 order by score desc, label limit 50""")
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best hits for a word over several axes among some brands; of one label the best."""
    catalog = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.lower("p_type").alias("other"), F.get(F.split("p_name", " "), F.lit(1)).alias("root"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    hits = search(catalog, "small", brand="Brand#1")
    best = W.partitionBy("label").orderBy(F.desc("score"), "id")
    return hits.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k").orderBy(F.desc("score"), "label").limit(50)


@query("""select p_partkey, p_name from part where contains(lower(p_type), 'large') and contains(lower(p_brand), 'brand#2') and (p_size is null or p_size <= 25)""")
def multi_axis_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a kind, a brand and a size, an unknown size passing."""
    p = read(spark, sf_dir, "part")
    return p.where(F.contains(F.lower("p_type"), F.lit("large")) & F.contains(F.lower("p_brand"), F.lit("brand#2")) & (F.col("p_size").isNull() | (F.col("p_size") <= 25))).select("p_partkey", "p_name")


#: Keywords of a source's name and the authority they give; anything else has OTHER_AUTHORITY.
AUTHORITY = [(["src1", "src2"], 1.0), (["src3", "src4", "src5"], 0.95)]
OTHER_AUTHORITY = 0.30


@query("""select doc_id, (case when contains(lower(coalesce(source, '')), 'src1') or contains(lower(coalesce(source, '')), 'src2') then 1.0
 when contains(lower(coalesce(source, '')), 'src3') or contains(lower(coalesce(source, '')), 'src4') or contains(lower(coalesce(source, '')), 'src5') then 0.95 else 0.3 end)::double authority from documents""")
def source_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's authority by keywords in its name."""
    name = F.lower(F.coalesce("source", F.lit("")))
    tier = F.lit(OTHER_AUTHORITY)
    for keys, weight in reversed(AUTHORITY):
        tier = F.when(reduce(lambda a, b: a | b, (F.contains(name, F.lit(k)) for k in keys)), weight).otherwise(tier)
    return read(spark, sf_dir, "documents").select("doc_id", tier.alias("authority"))


@query(f"""with {_LEX}, l as (select term from lex), h as (select term, count(distinct doc_id) docs, count(distinct source) sources, min(doc_id) first_doc from cw join l on word = term group by term),
t as (select term from l), x as (select a.term, count(*) together from t a join cw c on c.word = a.term join cw d on d.doc_id = c.doc_id and d.word = 'the' group by 1)
select t.term, coalesce(h.docs, 0) docs, coalesce(h.sources, 0) sources, h.first_doc, case when h.sources >= 3 then 'validated' when h.docs > 0 then 'single_evidence' else 'none' end verdict, coalesce(x.together, 0) together
from t left join h on h.term = t.term left join x on x.term = t.term""")
def term_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each term of the lexicon its evidence in the corpus, a verdict, and in how many documents it stands with a given word."""
    words = corpus_words(spark, sf_dir)
    terms = lexicon(spark, sf_dir).select("term")
    context = words.where("word = 'the'").select("doc_id").distinct().withColumn("with_it", F.lit(1))
    found = words.join(terms, words.word == F.col("term")).join(context, "doc_id", "left")
    g = found.groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc"), F.coalesce(F.sum("with_it"), F.lit(0)).alias("together"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("docs", "sources", "together")}
    out = terms.join(g, "term", "left").withColumns(zero)
    return out.select("term", "docs", "sources", "first_doc", F.when(F.col("sources") >= 3, "validated").when(F.col("docs") > 0, "single_evidence").otherwise("none").alias("verdict"), "together")
