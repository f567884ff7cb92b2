"""Back-tests without the case itself, graded retrieval metrics, gates, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leave_one_out_median(rows: DataFrame, key: str, value: str, least: int = 5) -> DataFrame:
    """rows with loo: the median of the group's other values, null with fewer than `least` others.

    Only the values around the middle matter. They are read off a histogram of the (whole)
    values, so the work is linear and no task sorts a group's rows.
    """
    hist = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("w"))
    w = W.partitionBy(key)
    hist = hist.withColumn("upto", F.sum("w").over(w.orderBy(value))).withColumn("n", F.sum("w").over(w))
    half = F.floor(F.col("n") / 2)
    at = [F.min(F.when(F.col("upto") >= half + i, F.col(value))).alias(f"v{i}") for i in range(3)]
    mid = hist.groupBy(key, "n").agg(*at)
    x = F.col(value)
    without = lambda i: F.when(x <= F.col(f"v{i}"), F.col(f"v{i + 1}")).otherwise(F.col(f"v{i}"))
    loo = F.when(F.col("n") % 2 == 0, without(0)).otherwise((without(0) + without(1)) / 2)
    return rows.join(mid, key, "left").withColumn("loo", F.when((F.col("n") - 1 >= least) & x.isNotNull(), loo)).drop("v0", "v1", "v2")


def error_metrics(rows: DataFrame, keys: list[str], actual: str, estimate: str, lo: str, hi: str, baseline: str | None = None) -> DataFrame:
    """cases, answered, coverage, MdAPE, MAPE, PPE10/20 (strict), hit rate of the range, signed median bias; all in shares.

    With baseline also its MdAPE and PPE20, on the cases that were answered.
    """
    answered = F.col(estimate).isNotNull()
    off = lambda c: F.abs(F.col(c) - F.col(actual)) / F.col(actual)
    signed = (F.col(estimate) - F.col(actual)) / F.col(actual)
    rate = lambda c: F.avg(F.when(answered, c.cast("int")))
    r = lambda c: F.round(c, 4)
    middle = lambda c: r(F.percentile(F.round(c, 6), F.lit(0.5)))
    err = off(estimate)
    out = [F.count("*").alias("cases"), F.count(estimate).alias("answered"), r(F.count(estimate) / F.count("*")).alias("coverage"), middle(err).alias("mdape"), r(F.avg(err)).alias("mape"), r(rate(err < 0.10)).alias("ppe10"), r(rate(err < 0.20)).alias("ppe20"), r(rate(F.col(actual).between(F.col(lo), F.col(hi)))).alias("hit_rate"), middle(signed).alias("bias")]
    if baseline is not None:
        base = F.when(answered, off(baseline))
        out += [middle(base).alias("baseline_mdape"), r(F.avg((base < 0.20).cast("int"))).alias("baseline_ppe20")]
    return rows.groupBy(*keys).agg(*out)


# Reasons that make a judged comparable marginal rather than wrong.
MARGINAL = ["recorte_p", "outlier_estadistico"]
RELEVANT = 2
#: What a component's metric has to reach.
OBJECTIVES = {("extraccion", "exactitud"): 0.92, ("curaduria", "recall"): 0.90, ("curaduria", "precision"): 0.90, ("dedup", "precision"): 0.95}


def grade(included: Column, reason: Column) -> Column:
    """2 in, 1 out for a statistical reason, 0 otherwise."""
    marginal = reason.startswith(MARGINAL[0]) | reason.startswith(MARGINAL[1])
    return F.when(included, RELEVANT).when(marginal, 1).otherwise(0)


def graded_metrics(rankings: DataFrame, judged: DataFrame, keys: list[str], query: str, doc: str, k: int = 25, depth: int = 30) -> DataFrame:
    """keys, query: ndcg@k, recall@depth, reciprocal rank, bpref, discarded@depth, judged@k and returned.

    rankings(keys, query, doc, pos from 1), judged(query, doc, grade 0-2). Relevant is grade 2.
    All but the last three are over the condensed list, i.e. without unjudged documents;
    discarded is the share of grades under 2 among the judged of the first `depth`.
    """
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    ideal = judged.withColumn("ipos", F.row_number().over(W.partitionBy(query).orderBy(F.desc("grade"), doc)))
    ideal = ideal.groupBy(query).agg(F.sum(F.when(F.col("ipos") <= k, gain(F.col("grade"), F.col("ipos")))).alias("idcg"), F.count_if(F.col("grade") == RELEVANT).alias("n_rel"))
    upto = W.partitionBy(*keys, query).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    g = F.col("grade")
    c = rankings.join(judged, [query, doc], "left").withColumn("cpos", F.when(g.isNotNull(), F.count("grade").over(upto)))
    c = c.withColumn("non_above", F.count_if(g == 0).over(upto)).join(ideal, query, "left")
    relevant = g == RELEVANT
    pref = F.when(relevant, 1 - F.least("non_above", "n_rel") / F.col("n_rel"))
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return c.groupBy(*keys, query).agg(
        r(F.try_divide(F.sum(F.when(F.col("cpos") <= k, gain(g, F.col("cpos")))), F.first("idcg"))).alias("ndcg"),
        r(F.try_divide(F.count_if(relevant & (F.col("cpos") <= depth)), F.first("n_rel"))).alias("recall"),
        r(F.max(F.when(relevant, 1.0 / F.col("cpos")))).alias("mrr"),
        r(F.try_divide(F.sum(pref), F.first("n_rel"))).alias("bpref"),
        r(F.try_divide(F.count_if((g < RELEVANT) & (F.col("pos") <= depth)), F.count_if(g.isNotNull() & (F.col("pos") <= depth)))).alias("discarded"),
        r(F.try_divide(F.count_if(g.isNotNull() & (F.col("pos") <= k)), F.count_if(F.col("pos") <= k))).alias("judged"),
        F.count("*").alias("returned"),
    )


def ablation(metrics: DataFrame, systems: list[str], measures: list[str]) -> DataFrame:
    """A row for each system that was measured: queries and the mean of each measure, in the order of the list."""
    place = F.array_position(F.array(*[F.lit(x) for x in systems]), F.col("system"))
    out = metrics.groupBy("system").agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 5).alias(m) for m in measures])
    return out.withColumn("place", place.cast("int")).where("place > 0")


def paired(metrics: DataFrame, query: str, value: str, a: str, b: str) -> DataFrame:
    """query and delta: b's value less a's, for the queries that both systems have."""
    of = lambda s, n: metrics.where(F.col("system") == s).select(query, F.col(value).alias(n))
    return of(a, "x").join(of(b, "y"), query).select(query, (F.col("y") - F.col("x")).alias("delta"))


def bootstrap(rows: DataFrame, value: str, resamples: int = 1000, seed: int = 11) -> DataFrame:
    """Mean of per-query values with a 95 % interval: n, mean, lo, hi.

    A resample draws n values with replacement: draw i of resample b takes the value whose
    place (by value) is a hash of (seed, b, i). Values are met by an equi-join on that place,
    so neither a task nor the driver holds all of them; lo and hi are the entries at
    floor(.025 n) and floor(.975 n) - 1 of the sorted means.
    """
    data = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    counted = data.groupBy("x").agg(F.count("*").alias("w"))  # equal values share a place range
    bucket = F.floor(F.col("x") * 1024)
    inside = W.partitionBy("bucket").orderBy("x")
    counted = counted.withColumn("bucket", bucket).withColumn("inside", F.sum("w").over(inside))
    before = counted.groupBy("bucket").agg(F.sum("w").alias("bw")).withColumn("before", F.sum("bw").over(W.orderBy("bucket")) - F.col("bw"))  # a row for each bucket
    placed = counted.join(before, "bucket").select("x", (F.col("before") + F.col("inside") - F.col("w")).alias("first"), "w")
    placed = placed.select("x", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("w") - 1)).alias("place"))
    total = data.agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    draws = placed.select("place").join(F.broadcast(total.select("n"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))  # the broadcast is one row
    draws = draws.select("b", F.pmod(F.xxhash64(F.lit(seed), "b", "place"), F.col("n")).alias("place"))
    means = draws.join(placed, "place").groupBy("b").agg(F.avg("x").alias("m"))
    sorted_ = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # an entry for each resample
    at = lambda p: F.round(F.element_at("m", F.lit(p)), 6)
    return total.join(sorted_).select("n", F.round("mean", 6).alias("mean"), at(int(0.025 * resamples) + 1).alias("lo"), at(int(0.975 * resamples)).alias("hi"))


def gate(history: DataFrame, keys: list[str], at: str, value: str, size: str, tiebreak: str, noise: float = 0.02, objectives: DataFrame | None = None) -> DataFrame:
    """Latest run of each key against the median of the five before it, of an even number the mean of the middle two.

    The band is the larger of their range and `noise`; under three earlier runs or with a
    changed case count there is no verdict. objectives(keys, objective): adds below, true
    where the latest value is under its objective; keys without a run have verdict `unmeasured`.
    """
    w = W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tiebreak))
    last = history.withColumn("__n", F.row_number().over(w)).where("__n <= 6")
    old = F.col("__n") > 1
    out = last.groupBy(*keys).agg(F.max(F.when(~old, F.col(value))).alias("now"), F.round(F.percentile(F.when(old, F.col(value)), F.lit(0.5)), 9).alias("median"), (F.max(F.when(old, F.col(value))) - F.min(F.when(old, F.col(value)))).alias("spread"), F.count_if(old).alias("earlier"), F.count_distinct(size).alias("sizes"))
    band = F.greatest("spread", F.lit(noise))
    verdict = F.when((F.col("earlier") < 3) | (F.col("sizes") > 1), "none").when(F.col("now") < F.col("median") - band, "worse").otherwise("ok")
    if objectives is None:
        return out.withColumn("verdict", verdict)
    out = out.withColumn("measured", F.lit(True)).join(objectives, keys, "full_outer")
    return out.withColumn("verdict", F.when(F.col("measured").isNull(), "unmeasured").otherwise(verdict)).withColumn("below", F.col("now") < F.col("objective")).drop("measured")


def last_runs(history: DataFrame, keys: list[str], at: str, tiebreak: str, value: str, runs: int = 5) -> DataFrame:
    """keys, runs, lower_median and spread (largest less smallest) of each key's last runs."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tiebreak)))
    last = history.withColumn("__n", place).where(F.col("__n") <= runs)
    values = F.sort_array(F.collect_list(value))  # of at most `runs` rows
    out = last.groupBy(*keys).agg(F.count("*").alias("runs"), values.alias("v"))
    lower = F.get("v", F.floor((F.size("v") - 1) / 2).cast("int"))
    return out.select(*keys, "runs", lower.alias("lower_median"), (F.array_max("v") - F.array_min("v")).alias("spread"))


def large_groups(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of the groups that have `least` of them or more."""
    large = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    return rows.join(large, key, "left_semi")


def golden_gate(verdicts: DataFrame) -> DataFrame:
    """One row over the verdicts of gate() with objectives: measured, worse, below, and passed.

    Nothing measured is not a pass.
    """
    out = verdicts.agg(F.count_if(F.col("verdict") != "unmeasured").alias("measured"), F.count_if(F.col("verdict") == "worse").alias("worse"), F.count_if(F.coalesce("below", F.lit(False))).alias("below"))
    return out.withColumn("passed", (F.col("measured") > 0) & (F.col("worse") == 0) & (F.col("below") == 0))


def mdape_gate(runs: DataFrame, keys: list[str], at: str, tiebreak: str, mdape: str, baseline: str, cases: str, most: float = 0.02, least: int = 50) -> DataFrame:
    """runs with verdict: too_few cases, worse than the run before by over `most`, worse_than_baseline, first, or ok."""
    before = F.lag(mdape).over(W.partitionBy(*keys).orderBy(at, tiebreak))
    out = runs.withColumn("previous", before)
    verdict = F.when(F.col(cases) < least, "too_few").when(F.col(mdape) > F.col("previous") + most, "worse").when(F.col(mdape) >= F.col(baseline), "worse_than_baseline").when(F.col("previous").isNull(), "first").otherwise("ok")
    return out.withColumn("verdict", verdict)


# What a back-test has to reach.
SUCCESS = {"mdape": 0.15, "ppe20": 0.65, "coverage": 0.70, "bias": 0.03}


def success(metrics: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row of checks: baseline beaten, MdAPE, PPE20, coverage and bias within SUCCESS, and calibrated: the MdAPE does
    not fall from ALTA to MEDIA to BAJA (levels without an answer are passed over).

    metrics: one row with mdape, ppe20, coverage, bias, baseline_mdape; calibration: confidence, mdape.
    """
    level = lambda name: F.max(F.when(F.col("confidence") == name, F.col("mdape")))
    c = calibration.agg(level("ALTA").alias("a"), level("MEDIA").alias("m"), level("BAJA").alias("b"))
    rises = lambda x, y: F.coalesce(F.col(x) <= F.col(y), F.lit(True))
    sure = lambda check: F.coalesce(check, F.lit(False))
    return metrics.join(c).select(
        sure(F.col("mdape") < F.col("baseline_mdape")).alias("beats_baseline"),
        sure(F.col("mdape") <= SUCCESS["mdape"]).alias("mdape_ok"),
        sure(F.col("ppe20") >= SUCCESS["ppe20"]).alias("ppe20_ok"),
        sure(F.col("coverage") >= SUCCESS["coverage"]).alias("coverage_ok"),
        sure(F.abs("bias") < SUCCESS["bias"]).alias("bias_ok"),
        (rises("a", "m") & rises("m", "b") & rises("a", "b")).alias("calibrated"),
    )


def rates(rows: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """keys, n and the share of each flag among the rows where it applies (is not null), with four digits."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("int")), 4).alias(f) for f in flags])


def field_outcomes(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, hit, hallucination, omission, error, both_absent of extracted against expected values.

    rows: expected_<field>, got_<field> as text, skip array<string> (fields not to judge; null: none).
    A value where none is expected is a hallucination, none where one is expected an omission.
    """
    pair = [F.struct(F.lit(f).alias("field"), F.col(f"expected_{f}").alias("e"), F.col(f"got_{f}").alias("g")) for f in fields]
    long = rows.select(F.coalesce("skip", F.array().cast("array<string>")).alias("skip"), F.explode(F.array(*pair)).alias("x")).where(~F.array_contains("skip", F.col("x.field"))).select("x.*")
    e, g = F.col("e"), F.col("g")
    return long.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(e == g).alias("hit"), F.count_if(e.isNull() & g.isNotNull()).alias("hallucination"),
        F.count_if(e.isNotNull() & g.isNull()).alias("omission"), F.count_if(e != g).alias("error"), F.count_if(e.isNull() & g.isNull()).alias("both_absent"),
    )


def in_ranking_order(ranking: DataFrame, pool: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The first k documents of each query's ranking that are in the pool and not the query itself, places closed up."""
    inside = ranking.join(pool.select(doc).distinct(), doc, "left_semi").where(F.col(query) != F.col(doc))
    return inside.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("pos", doc))).where(F.col("place") <= k)


def past_queries(reports: DataFrame, judged: DataFrame, least: int = 5) -> DataFrame:
    """report_id, area_id, n: finished reports with enough judgements, read as queries.

    reports(report_id, status, area_id), judged(report_id, listing_id, area_id): a report without
    an area gets that of most of its comparables (of equals the one of the smallest listing);
    without any it is no query.
    """
    done = reports.where(F.col("status").isin("SUCCEEDED", "INSUFFICIENT_DATA"))
    counts = judged.groupBy("report_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    by_area = judged.where("area_id is not null").groupBy("report_id", "area_id").agg(F.count("*").alias("c"), F.min("listing_id").alias("seen"))
    mode = by_area.groupBy("report_id").agg(F.min(F.struct((-F.col("c")).alias("minus"), "seen", "area_id")).alias("m")).select("report_id", F.col("m.area_id").alias("mode"))
    out = done.join(counts, "report_id").join(mode, "report_id", "left")
    return out.select("report_id", F.coalesce("area_id", "mode").alias("area_id"), "n").where("area_id is not null")


def judge_unseen(pool: DataFrame, kept: DataFrame, keys: list[str], verdicts: DataFrame, failed: DataFrame) -> DataFrame:
    """The stored judgements with those of the pool's unseen documents; a query with any failed batch adds none.

    pool(query, doc), kept(query, doc, grade), verdicts(query, doc, included, reason), failed(query).
    """
    query = keys[0]
    unseen = pool.join(kept, keys, "left_anti").join(failed.select(query).distinct(), query, "left_anti")
    new = unseen.join(verdicts, keys).select(*keys, grade(F.col("included"), F.col("reason")).alias("grade"))
    return kept.select(*keys, "grade").unionByName(new)
