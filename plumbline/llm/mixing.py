"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain - language - source. A budget of tokens goes down it: every node deals
its budget to its children by weight, none gets more than it can give (its tokens times
the epochs allowed), and what a child cannot take goes to its siblings by their weights. A
node's own limit is the sum of its children's, so only what all siblings together cannot
take is dealt anew further up. Every leaf then gives its quota as a prefix of seeded
epochs: whole epochs first, then, in the order of a seeded hash, texts until the rest of
the quota is used up; the last text may give only some of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

LEVELS = ["domain", "lang", "source"]
#: Texts of a leaf share buckets of their hash, so that a prefix of a large leaf needs no task with all of it.
BUCKET_ROWS, BUCKET_BITS = 256, 16


@dataclass
class Plan:
    """Target weights by level (others have `other`), share of all tokens to take, epochs allowed, seed."""

    domain: dict[str, float] = field(default_factory=lambda: {"d0": 5.0, "d1": 3.0, "d2": 2.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0})
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.6
    epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The documents have no domain column: sources are dealt to three by the number in their name."""
    number = F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).cast("int")
    return F.coalesce(F.concat(F.lit("d"), (number % 3).cast("string")), F.lit("none"))


def token_count(text: Column) -> Column:
    """Words: runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, plan: Plan) -> Column:
    named = getattr(plan, level)
    out = F.lit(float(plan.other))
    for k, v in named.items():
        out = F.when(F.col(level) == k, float(v)).otherwise(out)
    return out


def deal(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes(parent..., level, weight, cap, budget of the parent) -> with quota, whole tokens.

    Children in the order of cap / weight: as long as a child's part of what is left
    reaches its cap, it gets the cap; the others share the rest by weight. Single tokens
    that rounding leaves go to the largest fractions. Children with no weight get nothing.
    """
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    by = w.orderBy(F.col("cap") / F.col("weight"), level)
    n = nodes.where("weight > 0")
    left = F.col("budget") - (F.sum("cap").over(by) - F.col("cap"))
    open_weight = F.sum("weight").over(w) - (F.sum("weight").over(by) - F.col("weight"))
    n = n.withColumn("full", left * F.col("weight") >= F.col("cap") * open_weight)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(w)
    shared = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(w)
    n = n.withColumn("exact", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("budget") - taken) * F.col("weight") / shared))
    n = n.withColumn("base", F.least(F.floor("exact"), F.col("cap")).cast("long"))
    spare = F.least("budget", F.sum("cap").over(w)) - F.sum("base").over(w)
    n = n.withColumn("spare", spare).withColumn("place", F.row_number().over(w.orderBy(F.col("base") >= F.col("cap"), F.desc(F.round(F.col("exact") - F.col("base"), 6)), level)))
    return n.withColumn("quota", F.col("base") + F.when((F.col("place") <= F.col("spare")) & (F.col("base") < F.col("cap")), 1).otherwise(0)).drop("full", "exact", "base", "spare", "place")


def quotas(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves(domain, lang, source, tokens, rows) -> with quota. The tables are those of the tree's nodes."""
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * plan.share).cast("long").alias("budget"))
    budget = None
    for depth, level in enumerate(LEVELS):
        keys = LEVELS[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, plan))
        nodes = nodes.crossJoin(F.broadcast(total)) if budget is None else nodes.join(budget, LEVELS[:depth])  # total is one row
        budget = deal(nodes, LEVELS[:depth], level).select(*keys, F.col("quota").alias("budget"))
    return leaves.join(budget.withColumnRenamed("budget", "quota"), LEVELS).drop("cap")


def selection(docs: DataFrame, plan: Plan | None = None, apart: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens and take_tokens: a row per text and epoch it is in.

    Null languages and sources are children of their own, named `none`; null and empty texts
    have no tokens and are never taken; repeated rows count and are taken as often as they
    occur. Texts with equal hashes go by id, then by number of tokens. Other columns are
    not read. With apart, a column of docs that tells rows of one id apart, it comes along as
    `apart`, and rows without an id are drawn by it.
    """
    plan = plan or Plan()
    more = [] if apart is None else ["apart"]
    unnamed = F.lit("none") if apart is None else F.concat(F.lit("none:"), F.col("apart").cast("string"))
    source = F.col("source").cast("string")
    rows = docs.select("doc_id", domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("lang"), F.coalesce(source, F.lit("none")).alias("source"), token_count(F.col("text").cast("string")).alias("n_tokens"), *([] if apart is None else [apart.alias("apart")]))
    rows = stored(rows.where("n_tokens > 0"))
    leaves = quotas(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), plan)
    bits = F.least(F.lit(BUCKET_BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / BUCKET_ROWS)))).cast("int")
    leaves = stored(leaves.select(*LEVELS, F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest"), bits.alias("bits")))
    order = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), unnamed)).cast("binary"))
    rows = rows.join(leaves, LEVELS).withColumn("order", order)
    rows = rows.withColumn("bucket", F.expr("cast(conv(substring(order, 1, 8), 16, 10) as bigint) div cast(pow(2, 32 - bits) as bigint)"))
    keys = [*LEVELS, "bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("of_rest"))
    upto = F.sum("in_bucket").over(W.partitionBy(*LEVELS).orderBy("bucket"))  # at most 2^BUCKET_BITS rows of a leaf
    cuts = stored(sums.withColumn("before", upto - F.col("in_bucket")).where("before < of_rest").select(*keys, "in_bucket", "before"))
    within = rows.join(cuts, keys, "left").withColumn("whole_bucket", F.col("before") + F.col("in_bucket") <= F.col("rest"))
    taken = within.where("whole_bucket").withColumn("take", F.col("n_tokens"))
    cut = within.where("not whole_bucket")  # one bucket of each leaf
    start = F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("order", "doc_id", "n_tokens", *more).rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens") + F.col("before")
    cut = cut.withColumn("start", start).withColumn("take", F.least("n_tokens", F.greatest(F.lit(0), F.col("rest") - F.col("start")))).drop("start")
    out = ["doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens", *more]
    partial = taken.unionByName(cut).where("take > 0").select("doc_id", *LEVELS, F.col("whole").alias("epoch"), "n_tokens", F.col("take").alias("take_tokens"), *more)
    full = rows.where("whole > 0").select("doc_id", *LEVELS, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"), *more)
    return full.unionByName(partial).select(*out)


def mixed(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of docs that one epoch takes, whole texts (also the last of a leaf).

    A row is known by id and text, so rows of one id, or of none, are drawn each for itself;
    only rows equal in both stay together, which may take more than the budget.
    """
    apart = F.xxhash64(F.col("text").cast("string"))
    ids = selection(docs, plan, apart).select(F.col("doc_id").alias("__taken"), F.col("apart").alias("__apart")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__taken")) & (apart == F.col("__apart")), "left_semi")
