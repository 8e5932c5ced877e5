"""Operator 10: mixing sources to target weights by hierarchical budgeting (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

#: Integer target weights by domain and by language; any other name, and every source, weighs 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
#: The registered query asks for this share of the corpus, in hundredths, over at most EPOCHS epochs of a leaf.
SHARE, EPOCHS, SEED = 60, 2, 17
#: Leading hex digits of the order key by which a leaf's running sum is built in two steps.
BUCKET_HEX = 3
#: A tree of at most so many leaves is sent to every task; a larger one is joined by shuffling.
BROADCAST_LEAVES = 50_000

TREE = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """A source's domain: the number in its name modulo 4."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(digits == "", F.lit(0)).otherwise(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int)") % 4))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tree_columns(docs: DataFrame) -> list[Column]:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [domain_of(F.col("source")).alias("domain"), blank("lang").alias("lang"), blank("source").alias("source")]


def weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in sorted(weights.items()):
        out = F.when(F.col(name) == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of siblings: proportional to w, none over its cap, what a full one leaves going to the others.

    nodes: (*parent, name, w, cap, parent_budget). Siblings are taken by cap / w; one is full while its share of what
    is left reaches its cap. Whole tokens: shares are rounded down, so a budget is never exceeded.
    """
    order = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    nodes = nodes.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("used"), F.sum("w").over(after).alias("w_left"), F.row_number().over(order).alias("i"))
    nodes = nodes.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("parent_budget") - F.col("used")))
    family = W.partitionBy(*parent)
    nodes = nodes.withColumn("first_open", F.min(F.when(~F.col("full"), F.col("i"))).over(family))
    nodes = nodes.withColumn("open_used", F.max(F.when(F.col("i") == F.col("first_open"), F.col("used"))).over(family)).withColumn("open_w", F.max(F.when(F.col("i") == F.col("first_open"), F.col("w_left"))).over(family))
    is_full = F.col("first_open").isNull() | (F.col("i") < F.col("first_open"))
    share = F.expr("(w * (parent_budget - open_used)) div open_w")
    return nodes.withColumn("budget", F.when(is_full, F.col("cap")).otherwise(share)).drop("used", "w_left", "i", "full", "first_open", "open_used", "open_w")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, supply) with cap and budget.

    A node's cap is the sum of its leaves' supply times epochs, so a shortage inside a node is first made up by
    siblings there; only what the whole node can't supply goes to the node's own siblings.
    """
    leaves = leaves.withColumn("cap", F.col("supply") * epochs)
    total = leaves.agg(budget.alias("parent_budget"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(total)  # total is one row
    domains = fill(domains.withColumn("root", F.lit(0)).withColumn("w", weight("domain", DOMAIN_WEIGHTS)), ["root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains.select("domain", F.col("budget").alias("parent_budget")), "domain")
    langs = fill(langs.withColumn("w", weight("lang", LANG_WEIGHTS)), ["domain"], "lang")
    below = leaves.join(langs.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"])
    return fill(below.withColumn("w", F.lit(1).cast("long")), ["domain", "lang"], "source").select(*TREE, "supply", "budget")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else df


def order_key(seed: int, done: str = "epochs_done") -> Column:
    """Place of a document in an epoch of its leaf: md5 of seed, epoch and doc_id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(done).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def cutoffs(counted: DataFrame, scratch: Scratch, budget: Column, epochs: int, seed: int) -> DataFrame:
    """Each leaf's (supply, budget, epochs_done, cutoff) for counted (doc_id, domain, lang, source, n_tokens).

    A leaf's budget is so many whole epochs and a prefix of the next one, in that epoch's order: documents whose
    running token sum stays within what is left. cutoff is the order key of the last of them (null: none). The
    running sum is built from sums by leading digits of the key; only the bucket at the boundary is summed by row.
    """
    supply = counted.groupBy(*TREE).agg(F.sum("n_tokens").alias("supply"))
    leaves = leaf_budgets(supply, budget, epochs)
    leaves = leaves.withColumn("epochs_done", F.when(F.col("supply") > 0, F.expr("budget div greatest(supply, 1)")).otherwise(F.lit(0)))
    leaves = scratch.write(leaves.withColumn("rest", F.col("budget") - F.col("epochs_done") * F.col("supply")), "leaves")
    keyed = counted.join(small(leaves), TREE).where(F.col("rest") > 0).withColumn("key", order_key(seed)).withColumn("bucket", F.substring("key", 1, BUCKET_HEX))
    sums = keyed.groupBy(*TREE, "rest", "bucket").agg(F.sum("n_tokens").alias("n"), F.max("key").alias("last"))
    run = W.partitionBy(*TREE).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(run)).withColumn("base", F.col("upto") - F.col("n"))
    # buckets that are wholly in, and the one bucket where the sum passes what is left
    whole = sums.where(F.col("upto") <= F.col("rest")).groupBy(*TREE).agg(F.max("last").alias("whole_last"))
    edge = sums.where((F.col("base") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select(*TREE, "bucket", "base")
    rows = keyed.join(small(edge), [*TREE, "bucket"])
    within = W.partitionBy(*TREE).orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    part = rows.withColumn("upto", F.col("base") + F.sum("n_tokens").over(within)).where(F.col("upto") <= F.col("rest")).groupBy(*TREE).agg(F.max("key").alias("part_last"))
    return leaves.join(whole, TREE, "left").join(part, TREE, "left").select(*TREE, "supply", "budget", "epochs_done", F.greatest("whole_last", "part_last").alias("cutoff"))


def mix(docs: DataFrame, share: int, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(counted, leaves): documents' token counts and places in the tree, and each leaf's cutoffs().

    Null texts count 0 tokens; null languages and sources are the empty name. Rows with equal ids are taken or left
    together. An empty table gives no leaves. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(docs.select("doc_id", *tree_columns(docs), words(F.col("text")).alias("n_tokens")), "counted")
    asked = F.expr(f"(coalesce(sum(supply), 0L) * {share}) div 100")
    leaves = scratch.write(cutoffs(counted, scratch, asked, epochs, seed), "cutoffs")
    return counted, leaves


def copies(seed: int, done: str = "epochs_done", cutoff: str = "cutoff") -> Column:
    """How many times a row joined with its leaf is taken."""
    return (F.col(done) + F.coalesce((order_key(seed, done) <= F.col(cutoff)).cast("long"), F.lit(0))).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, leaves = mix(table(spark, sf_dir, "documents"), SHARE, EPOCHS, SEED)
    return counted.join(small(leaves), TREE).select("doc_id", *TREE, "n_tokens", copies(SEED).alias("copies"), F.col("budget").alias("leaf_budget"))


def select_documents(docs: DataFrame, share: int, seed: int = SEED) -> DataFrame:
    """The rows of docs that one epoch of the mix takes, unchanged."""
    _, leaves = mix(docs, share, 1, seed)
    placed = docs.withColumns({f"__{c}": col for c, col in zip(TREE, tree_columns(docs), strict=True)})
    cut = small(leaves.select(*(F.col(c).alias(f"__{c}") for c in (*TREE, "epochs_done", "cutoff"))))
    return placed.join(cut, [f"__{c}" for c in TREE]).where(copies(seed, "__epochs_done", "__cutoff") > 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def _sql_fill(src: str, parent: str, name: str, out: str) -> str:
    return f"""
{out}_a as (select *, coalesce(sum(cap) over (partition by {parent} order by cap / w, {name} rows between unbounded preceding and 1 preceding), 0)::bigint used,
  (sum(w) over (partition by {parent} order by cap / w, {name} rows between current row and unbounded following))::bigint w_left,
  row_number() over (partition by {parent} order by cap / w, {name}) i from {src}),
{out}_b as (select *, cap * w_left <= w * (parent_budget - used) as isfull from {out}_a),
{out}_c as (select *, min(case when not isfull then i end) over (partition by {parent}) first_open from {out}_b),
{out}_d as (select *, max(case when i = first_open then used end) over (partition by {parent}) open_used,
  max(case when i = first_open then w_left end) over (partition by {parent}) open_w from {out}_c),
{out} as (select * exclude (used, w_left, i, isfull, first_open, open_used, open_w),
  case when first_open is null or i < first_open then cap else (w * (parent_budget - open_used)) // open_w end budget from {out}_d)"""


def _sql_weight(name: str, weights: dict[str, int]) -> str:
    return "(case " + " ".join(f"when {name} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end)::bigint"


SQL = {
    "op10_mixing": f"""
with c as (select doc_id, 'd' || (case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 0
    else regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1)::int % 4 end) as "domain", coalesce(lang, '') lang, coalesce(source, '') source,
    len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+'))::bigint n_tokens from documents),
leaves as (select "domain", lang, source, sum(n_tokens)::bigint supply, (sum(n_tokens) * {EPOCHS})::bigint cap from c group by all),
t as (select (sum(supply) * {SHARE} // 100)::bigint parent_budget from leaves),
d0 as (select "domain", sum(cap)::bigint cap, any_value(parent_budget) parent_budget, {_sql_weight('"domain"', DOMAIN_WEIGHTS)} w, 0 root from leaves, t group by "domain"),
{_sql_fill("d0", "root", '"domain"', "dd")},
l0 as (select l."domain", l.lang, sum(l.cap)::bigint cap, any_value(dd.budget) parent_budget, {_sql_weight("l.lang", LANG_WEIGHTS)} w from leaves l join dd on l."domain" = dd."domain" group by l."domain", l.lang),
{_sql_fill("l0", '"domain"', "lang", "ll")},
s0 as (select l.*, ll.budget parent_budget, 1::bigint w from leaves l join ll on l."domain" = ll."domain" and l.lang = ll.lang),
{_sql_fill("s0", '"domain", lang', "source", "ss")},
e as (select *, case when supply > 0 then budget // greatest(supply, 1) else 0 end epochs_done from ss),
k as (select c.*, e.budget, e.epochs_done, e.budget - e.epochs_done * e.supply rest,
  md5('{SEED}:' || e.epochs_done || ':' || coalesce(doc_id::varchar, '')) k from c join e using ("domain", lang, source)),
r as (select *, sum(n_tokens) over (partition by "domain", lang, source order by k) upto from k)
select doc_id, "domain", lang, source, n_tokens, (epochs_done + (rest > 0 and upto <= rest)::int)::bigint copies, budget leaf_budget from r
"""
}
