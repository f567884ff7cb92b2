"""URL filters: rules first, then trust and distrust spread over the links between hosts.

A rule is a host and the beginning of a path; it fits the host and all its subdomains, and
the longest that fits decides. Pages without a rule are judged by their host: personalised
PageRank runs forward over the host edges from the hosts that have allowed pages, and
backward from those that have blocked ones (a host that links to a distrusted host is
distrusted). A host is blocked when its distrust is over THRESHOLD of both together.

Host edges are the links of the pages (relative links stay on the host) and, in both
directions, the step from a host to a parent domain that has pages too. Edges are counted
once for a pair of hosts, each weighing its share of the links of its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

#: The rules of the registered query (verdict, rule).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DAMPING, THRESHOLD = 0.85, 0.5
ROUNDS = 10  # between two tests of convergence
TOLERANCE = 1e-6  # the largest share of a score that may still change in a round


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to / ? # or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.coalesce(lowered(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. For lists that fit one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked last, so it wins
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(host, path, ...) with rule and by_rule, from a table of rules(verdict, rule) of any length.

    A host meets the rules of its own name and of its parent domains by an equi-join; of those whose
    path fits, the longest counts (of equals the one that sorts last).
    """
    parts = F.split("rule", "/", 2)
    r = rules.select("verdict", "rule", parts[0].alias("r_host"), F.concat(F.lit("/"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("r_path"))
    names = F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> array_join(slice(split(host, '\\.'), i, size(split(host, '\\.'))), '.'))")
    asked = pages.select("host", "path").distinct().withColumn("r_host", F.explode(names))
    fits = asked.join(r, "r_host").where(F.expr("startswith(path, r_path)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("x"))
    return pages.join(best.select("host", "path", "x.rule", F.col("x.verdict").alias("by_rule")), ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> src, dst, links between different hosts, and between hosts and parent domains."""
    hrefs = F.expr(r"""regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["\']?([^"\'\\s>]+)', 1)""")
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(hrefs).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    links = links.select("src", host_of(link).alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").count()
    hosts = pages.where("host <> ''").select("host").distinct()
    parts = F.split("host", r"\.")
    above = F.explode(F.expr(r"transform(sequence(2, greatest(size(parts), 2)), i -> array_join(slice(parts, i, size(parts)), '.'))"))
    steps = hosts.withColumn("parts", parts).where("size(parts) > 1").select("host", above.alias("parent")).where("parent <> '' and parent <> host")
    kin = steps.join(hosts.withColumnRenamed("host", "parent"), "parent")
    kin = kin.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(kin.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    both = links.unionByName(kin.withColumn("count", F.lit(1).cast("long")))
    return both.groupBy("src", "dst").agg(F.sum("count").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """edges(src, dst, links), seeds(host, trust, distrust: each sums to 1 or is all 0) -> host, trust, distrust.

    Trust moves from src to dst by src's share of links, distrust from dst to src by dst's.
    A round is one join on the host and one sum; it is written to the shared folder. Every
    `rounds` rounds the last two are compared, and it ends once no host is new and no score
    has changed by more than `tolerance` of itself, so that far hosts are as settled as near.
    What reaches hosts without a way on starts again at the seeds: that multiplies all scores
    of a kind alike, so each kind is brought to the sum 1 at the end.
    """
    forward = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
    backward = edges.groupBy("dst").agg(F.sum("links").alias("in_links"))
    e = edges.join(forward, "src").join(backward, "dst")
    none = F.lit(0.0)
    moves = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("links") / F.col("out_links")).alias("t"), none.alias("d"))
    moves = stored(moves.unionByName(e.select(F.col("dst").alias("from"), F.col("src").alias("to"), none.alias("t"), (F.col("links") / F.col("in_links")).alias("d"))))
    rank = stored(seeds.select("host", "trust", "distrust"))
    base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    moved = lambda c: F.abs(F.col(f"after.{c}") - F.coalesce(f"before.{c}", F.lit(0.0))) > tolerance * F.col(f"after.{c}")
    unsettled = True
    while unsettled:
        for i in range(rounds):
            sent = moves.join(rank, moves["from"] == rank["host"]).select(F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"), (F.col("d") * F.col("distrust") * damping).alias("distrust"))
            after = stored(sent.unionByName(base).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
            if i == rounds - 1:
                pairs = after.alias("after").join(rank.alias("before"), "host", "left")
                unsettled = not pairs.where(F.col("before.trust").isNull() | moved("trust") | moved("distrust")).isEmpty()
            drop(rank)
            rank = after
    total = F.broadcast(rank.agg(F.sum("trust").alias("all_t"), F.sum("distrust").alias("all_d")))  # one row
    share = lambda c, whole: F.when(F.col(whole) > 0, F.col(c) / F.col(whole)).otherwise(0.0).alias(c)
    return rank.join(total).select("host", share("trust", "all_t"), share("distrust", "all_d"))


def judged(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. rules: a list, or a table(verdict, rule) of any length.

    Null or unparsable urls have an empty host and path; a null html has no links; pages
    that neither a rule nor their host's scores concern (also those with an empty host) are
    allowed, as is a host with equal trust and distrust. Repeated rows come out as often
    and count as often in the seeds. Other columns are not read.
    """
    url = F.col("url").cast("string")
    named = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    if isinstance(rules, DataFrame):
        named = with_rules(named, rules)
    else:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        named = named.withColumn("rule", rule).withColumn("by_rule", verdict)
    rows = stored(named.drop("html"))
    counts = rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b"))
    total = F.broadcast(counts.agg(F.greatest(F.sum("a"), F.lit(1)).alias("all_a"), F.greatest(F.sum("b"), F.lit(1)).alias("all_b")))  # one row
    seeds = stored(counts.crossJoin(total).select("host", (F.col("a") / F.col("all_a")).alias("trust"), (F.col("b") / F.col("all_b")).alias("distrust")))
    scores = spread(stored(host_edges(named.select("host", "html"))), seeds)
    # What is left of the walk, TOLERANCE / (1 - DAMPING) of a score, must not part equals.
    over = THRESHOLD * (1 + 2 * TOLERANCE / (1 - DAMPING))
    blocked = scores.where(F.col("distrust") > over * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("by_host"))
    out = rows.join(stored(blocked), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))
