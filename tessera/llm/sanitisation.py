"""Operator 12: personal data found by patterns, and words that reveal it by their co-occurrence in the corpus (native:
DataFrame functions only).

A word reveals an entity (an address or number) if, by the texts that hold both, whoever reads the word learns the entity:
what is left to learn, -log2 P(entity | word), is at most GENERALISED bits, while the word tells at least TOLD bits,
log2 P(entity | word) / P(entity). Copies of a text must not make its words revealing, so both must meet in CONTEXTS
different texts, counted by effect: the square of the number of texts over the sum of squares of the numbers by signature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The kinds' patterns, with possessive repeats and starts that keep failing searches of long texts linear.
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What texts that a pattern may match have in common, cheaper to look for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WORD, BETWEEN = r"[\p{L}\p{M}\p{N}]+", r"[^\p{L}\p{M}\p{N}]+"
#: Words on each side of an entity, out of so many characters; letters that a word has at least.
NEAR, REACH, SHORTEST = 5, 100, 3
CONTEXTS, TOLD, GENERALISED, REMOVED = 3, 3.0, 1.0, 0.25
#: Tables of at most so many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 100_000


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_sums(df: DataFrame, lengths: dict[str, str]) -> DataFrame:
    """df with arrays of the running sums of arrays of numbers: {name of the sums: name of the array}.

    By blocks of the square root of an array's length, as a slice costs the length of what it is taken from: sums inside
    blocks, and of the blocks before.
    """

    def blocks(c: str) -> Column:
        size = F.ceil(F.sqrt(F.size(c))).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / size).cast("int") - 1), lambda b: F.slice(c, b * size + 1, size))
        return F.when(F.size(c) > 0, each).otherwise(F.array().cast("array<array<int>>"))

    def before(values: Column) -> Column:
        return F.transform(values, lambda _, b: sum_of(F.slice(values, F.lit(1), b)))

    def inside(block: Column, start: Column) -> Column:
        return F.transform(block, lambda _, i: start + sum_of(F.slice(block, F.lit(1), i + 1)))

    df = df.withColumns({f"__b_{n}": blocks(c) for n, c in lengths.items()}).withColumns({f"__t_{n}": F.transform(f"__b_{n}", sum_of) for n in lengths})
    df = df.withColumns({f"__s_{n}": before(F.col(f"__t_{n}")) for n in lengths})
    return df.withColumns({n: F.flatten(F.zip_with(f"__b_{n}", f"__s_{n}", inside)) for n in lengths}).drop(*(f"__{x}_{n}" for n in lengths for x in "bts"))


def placed(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with arrays of (start, end, found), in characters, for patterns {name: (pattern, rows it's looked for in)}."""
    none = F.array().cast("array<string>")

    def lengths(n: str) -> Column:
        return F.zip_with(f"__m_{n}", F.slice(f"__p_{n}", F.lit(1), F.size(f"__m_{n}")), lambda m, p: F.length(m) + F.length(p))

    def spans(n: str) -> Column:
        return F.zip_with(f"__m_{n}", f"__e_{n}", lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("found")))

    df = df.withColumns({f"__m_{n}": F.when(where, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, (p, where) in patterns.items()})
    df = df.withColumns({f"__p_{n}": F.when(F.size(f"__m_{n}") > 0, F.split(text, p, -1)).otherwise(none) for n, (p, _) in patterns.items()})
    df = running_sums(df.withColumns({f"__n_{n}": lengths(n) for n in patterns}), {f"__e_{n}": f"__n_{n}" for n in patterns})
    return df.withColumns({n: spans(n) for n in patterns}).drop(*(f"__{x}_{n}" for n in patterns for x in "mpne"))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(turned: Column) -> Column:
    """Whether 19 digits, last first, pass Luhn's check."""
    places = (F.translate(F.substring(turned, k + 1, 1), "0123456789", "0246813579" if k % 2 else "0123456789") for k in range(19))
    return reduce(lambda a, b: a + b, (p.cast("int") for p in places)) % 10 == 0


def valid(kind: str, spans: Column) -> Column:
    """Of spans (start, end, found) those that keep the rule of their kind."""
    if kind == "email":
        return spans
    if kind == "ip":

        def small(part: Column) -> Column:
            least = F.ltrim(part, F.lit("0"))
            return (F.length(least) < 3) | ((F.length(least) == 3) & (least <= "255"))

        return F.filter(spans, lambda s: F.forall(F.split(s["found"], r"\."), small))
    lo, hi = (14, 19) if kind == "card" else (10, 15)
    named = lambda s, d: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), d.alias("digits"))
    counted = F.filter(F.transform(spans, lambda s: named(s, digits(s["found"]))), lambda s: F.length(s["digits"]).between(lo, hi))
    if kind == "card":
        counted = F.filter(F.transform(counted, lambda s: named(s, F.rpad(F.reverse(s["digits"]), 19, "0"))), lambda s: luhn(s["digits"]))
    return F.transform(counted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def with_base(docs: DataFrame, text: str = "__text") -> DataFrame:
    """docs with (__email, __ip, __card, __phone): the spans (start, end, found) of each kind."""
    df = placed(docs, text, {f"__{k}": (PATTERNS[k], F.contains(F.col(text), F.lit("@")) if k == "email" else F.col(text).rlike(HINTS[k])) for k in KINDS})
    return df.withColumns({f"__{k}": valid(k, F.col(f"__{k}")) for k in KINDS})


#: All kinds at once, without emails right behind one another: where another kind ends, an email may not start anew.
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS).replace(r"|\G", "")


def kind_of(found: Column) -> Column:
    """The kind of a match of ANY."""
    return F.when(F.contains(found, F.lit("@")), "email").when(F.startswith(found, F.lit("+")), "phone").when(F.contains(found, F.lit(".")), "ip").otherwise("card")


def entities(docs: DataFrame) -> DataFrame:
    """(signature, mentions) of texts (__text) that have entities; a mention is (entity, words), the words near it.

    The signature is the least hash of two words that follow each other, as copies of a text mostly share it.
    """
    df = docs.where(hinted("__text")).select("__text").withColumn("m", F.regexp_extract_all("__text", F.lit(ANY), F.lit(0))).where(F.size("m") > 0)
    df = df.withColumn("p", F.transform(F.split("__text", ANY, -1), folded))

    def words(side: Column) -> Column:
        return F.filter(F.split(side, BETWEEN), lambda w: F.length(w) >= SHORTEST)

    def last(p: Column) -> Column:
        return words(F.when(F.length(p) > REACH, F.regexp_replace(F.right(p, F.lit(REACH)), f"^{WORD}", "")).otherwise(p))

    def first(p: Column) -> Column:
        return F.slice(words(F.when(F.length(p) > REACH, F.regexp_replace(F.left(p, F.lit(REACH)), rf"{WORD}\z", "")).otherwise(p)), 1, NEAR)

    df = df.withColumns({"before": F.transform(F.transform("p", last), lambda w: F.slice(w, F.greatest(F.size(w) - NEAR + 1, F.lit(1)), NEAR)), "after": F.transform("p", first)})
    # zipped, not looked up by index: an expression inside a lambda would run once an element
    sides = F.arrays_zip("m", F.slice("before", F.lit(1), F.size("m")).alias("before"), F.slice("after", F.lit(2), F.size("m")).alias("after"))
    df = df.withColumn("sides", sides)
    df = df.withColumn("all", F.transform("sides", lambda x: F.struct(F.array_distinct(F.concat(x["before"], x["after"])).alias("start"), F.lit(0).alias("end"), x["m"].alias("found"))))

    def mentions(kind: str) -> Column:
        name = lambda found: F.concat(F.lit(f"{kind}:"), F.lower(found) if kind in ("email", "ip") else digits(found))
        return F.transform(valid(kind, F.filter("all", lambda x: kind_of(x["found"]) == kind)), lambda s: F.struct(name(s["found"]).alias("entity"), s["start"].alias("words")))

    said = F.filter(F.split(F.concat_ws(" ", "p"), BETWEEN), lambda w: w != "")
    df = df.withColumns({"mentions": F.concat(*(mentions(k) for k in KINDS)), "w": said}).where(F.size("mentions") > 0)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.xxhash64(a, b))
    return df.select(F.when(F.size("w") > 1, F.array_min(pairs)).otherwise(F.xxhash64(F.array_join("w", " "))).alias("signature"), "mentions")


def hinted(text: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(text).rlike(HINTS[k]) for k in KINDS))


def folded(text: Column) -> Column:
    """Lower case, with one form of sigma: the other depends on what follows."""
    return F.translate(F.lower(text), "ς", "σ")


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has few rows; it is counted, as nothing else bounds it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def revealing(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(term, action) of the words of texts (__text) that reveal an entity: action is general or removed; and (k, term) of
    the texts, by digest, that have words which come near entities often enough.
    """
    held = scratch.write(entities(docs), "entities")
    near = held.select("signature", F.explode(F.array_distinct(F.flatten(F.transform("mentions", lambda m: F.transform(m["words"], lambda w: F.struct(m["entity"].alias("entity"), w.alias("term"))))))).alias("x"))
    near = near.groupBy("x.entity", "x.term", "signature").agg(F.count("*").alias("c")).groupBy("entity", "term")
    near = near.agg(F.sum("c").alias("both"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
    near = scratch.write(near.where(F.col("both").cast("double") * F.col("both") >= CONTEXTS * F.col("squares")), "near")
    owners = held.select(F.explode(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("held"))
    terms = bounded(scratch.write(near.select("term").distinct(), "terms"))
    plain = F.when(hinted("__text"), F.array_join(F.split("__text", ANY, -1), " ")).otherwise(F.col("__text"))
    words = docs.select(F.unhex(F.md5("__text")).alias("k"), F.explode(F.array_distinct(F.split(folded(plain), BETWEEN))).alias("term")).where(F.length("term") >= SHORTEST)
    hits = scratch.write(words.join(terms, "term"), "hits")
    counted = near.join(hits.groupBy("term").agg(F.count("*").alias("having")), "term").join(owners, "entity").crossJoin(F.broadcast(docs.agg(F.count("*").alias("texts"))))  # one row
    left = -F.log2(F.col("both") / F.col("having"))
    told = F.log2(F.col("both").cast("double") * F.col("texts") / (F.col("having").cast("double") * F.col("held")))
    found = counted.where((left <= GENERALISED) & (told >= TOLD)).groupBy("term").agg(F.min(left).alias("left"))
    return found.select("term", F.when(F.col("left") <= REMOVED, "removed").otherwise("general").alias("action")), hits


def with_terms(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (with the base spans) with (__terms): spans (start, end, found, action) of revealing words outside base spans."""
    found, hits = revealing(docs, scratch)
    by_text = hits.distinct().join(bounded(scratch.write(found, "revealing")), "term").groupBy(F.col("k").alias("__k"))
    by_text = bounded(scratch.write(by_text.agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("__actions")), "texts"))
    scratch.drop("entities", "near", "terms", "hits", "revealing")
    df = docs.withColumn("__k0", F.unhex(F.md5("__text"))).join(by_text, F.col("__k0") == F.col("__k"), "left").drop("__k0", "__k")
    df = placed(df, "__text", {"__terms": (WORD, F.col("__actions").isNotNull())})
    acted = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["found"].alias("found"), F.element_at("__actions", folded(w["found"])).alias("action"))
    named = F.transform(F.filter("__terms", lambda w: F.map_contains_key("__actions", folded(w["found"]))), acted)
    bare = F.concat(*(F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    df = df.withColumns({"__terms": F.when(F.col("__actions").isNotNull(), named).otherwise(F.array().cast("array<struct<start:int,end:int,found:string,action:string>>")), "__bare": bare})
    free = F.filter("__terms", lambda w: ~F.exists("__bare", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    return df.withColumn("__terms", free).drop("__actions", "__bare")


def listed(kinds: dict[str, Column]) -> Column:
    """kind:start:end of spans by start, then in the order of the kinds, joined by commas."""
    numbered = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    every = F.array_sort(F.concat(*(F.transform(spans, numbered(i)) for i, spans in enumerate(kinds.values()))))
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """docs (__text, ...) with (__email, __ip, __card, __phone, __terms): spans (start, end, found, ...) in characters, ends
    exclusive."""
    return with_terms(with_base(docs), Scratch(docs.sparkSession))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of documents, a row a row.

    spans also lists the words that reveal entities, as kinds general and removed, after the base kinds. A null text counts
    as empty and has no spans; null and repeated ids and repeated rows stay; columns beside doc_id and text are not looked
    at. Equal texts have equal spans. A text must fit into one cell; its work grows with its length. An empty table gives
    no rows.
    """
    df = found_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")))
    base = {k: F.col(f"__{k}") for k in KINDS}
    done = lambda action: F.filter("__terms", lambda t: t["action"] == action)
    kept = {a: done(a) for a in ("general", "removed")}
    df = df.withColumns({f"n_{k}": F.size(c).cast("long") for k, c in base.items()} | {"base_sha256": F.sha2(listed(base), 256), "spans": listed(base | kept)})
    return df.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with the text cleaned: base spans become [email] and so on; revealing words become [name] (upper case), [code]
    (with a digit) or [word], or go. Of overlapping spans the first counts, of those that start together the longest.

    Rows, other columns of any name and nulls stay as they are.
    """
    df = found_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce("text", F.lit("")).alias("__text")))
    span = lambda by: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), by(s).alias("by"))
    word = lambda t: F.when(t["action"] == "removed", "").when(t["found"].rlike(r"\p{N}"), "[code]").when(t["found"].rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    mark = lambda k: lambda s: F.lit(f"[{k}]")
    every = F.concat(*(F.transform(f"__{k}", span(mark(k))) for k in KINDS), F.transform("__terms", span(word)))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,by:string>>").alias("kept"))
    added = lambda a, s: F.struct((-s["end"]).alias("at"), F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["by"].alias("by")))).alias("kept"))
    df = df.withColumn("__all", F.array_sort(every))
    df = df.withColumn("__kept", F.aggregate("__all", nothing, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(added(a, s)))["kept"])
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("__kept", F.greatest(i, F.lit(1)))["end"])
    pieces = F.transform("__kept", lambda s, i: F.concat(F.substr("__text", before(i) + 1, s["start"] - before(i)), s["by"]))
    rest = F.substr("__text", F.element_at("__kept", -1)["end"] + 1)
    text = F.when(F.size("__kept") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("__row")["text"])
    return df.select(F.col("__row").withField("text", text).alias("r")).select("r.*")


def op12_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
