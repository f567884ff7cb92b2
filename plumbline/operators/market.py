"""Area metrics: stock, dispersion, price drops, time on market, coverage, index comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENOUGH, FEW = 20, 5  # usable listings for OK and JUSTO
ALERT, GATE = 0.15, 0.7


def stock(rows: DataFrame, key: str, unit: str) -> DataFrame:
    """Rows (also those without a unit price), median of the whole unit prices and MAD / median."""
    counted = rows.groupBy(key, unit).agg(F.count("*").alias("w"))  # one row for each distinct price
    middle = counted.groupBy(key).agg(F.sum("w").alias("n"), F.round(F.percentile(unit, F.lit(0.5), F.col("w")), 6).alias("median"))
    both = counted.join(middle, key)
    return both.groupBy(key, "n", "median").agg(F.percentile(F.abs(F.col(unit) - F.col("median")), F.lit(0.5), F.col("w")).alias("mad")).select(key, "n", "median", F.round(F.col("mad") / F.col("median"), 3).alias("dispersion"))


def price_drops(history: DataFrame, keys: list[str], as_of: Column, tiebreak: str, days: int = 90) -> DataFrame:
    """One row: series with two prices or more in the last days, how many fell, share in % and mean fall in % (1 decimal).

    Of prices at one time the one with the smaller tiebreak is the earlier."""
    recent = history.where((F.col("ts") >= F.date_sub(as_of, days)) & F.col("price").isNotNull())
    ends = recent.groupBy(*keys).agg(F.min_by("price", F.struct("ts", tiebreak)).alias("first"), F.max_by("price", F.struct("ts", tiebreak)).alias("last"), F.count("*").alias("n")).where("n > 1")
    fall = F.when(F.col("last") < F.col("first"), (F.col("first") - F.col("last")) / F.col("first") * 100)
    return ends.agg(F.count("*").alias("series"), F.count(fall).alias("dropped"), F.round(F.try_divide(F.count(fall) * 100.0, F.count("*")), 1).alias("dropped_pct"), F.round(F.avg(fall), 1).alias("mean_drop_pct"))


def days_on_market(rows: DataFrame, key: str) -> DataFrame:
    """Floor of the median of non-negative days."""
    return rows.where("days >= 0").groupBy(key).agg(F.floor(F.percentile("days", F.lit(0.5))).cast("long").alias("median_days"), F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, period: str, value: str, tiebreak: list[str]) -> DataFrame:
    """The value of the last period for each key; of equal periods the largest tiebreak."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(period, *tiebreak)).alias(value), F.max(period).alias(period))


def coverage(rows: DataFrame, key: str, unit: str, index: DataFrame, source: str | None = None) -> DataFrame:
    """Per key: all, usable, median, official index, deviation, state, alert; with source also a map of its counts. index: key, official."""
    measures = [F.count("*").alias("actives"), F.count(unit).alias("usable"), F.bround(F.percentile(unit, F.lit(0.5)), 0).alias("median")]
    own = rows.groupBy(key).agg(*measures)
    if source is not None:
        by = rows.groupBy(key, source).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("by_source"))
        own = own.join(by, key)
    out = own.join(index, key, "left").withColumn("deviation", F.round(F.try_divide(F.col("median") - F.col("official"), F.col("official")), 4))
    state = F.when(F.col("usable") >= ENOUGH, "OK").when(F.col("usable") >= FEW, "JUSTO").otherwise("INSUFICIENTE")
    return out.withColumn("state", state).withColumn("alert", F.coalesce(F.abs("deviation") > ALERT, F.lit(False)))


def source_health(runs: DataFrame, keys: list[str], at: str, cost: str, run: str, as_of: Column) -> DataFrame:
    """Per source: its last run, number of runs, all cost and that of the month of as_of (nulls count 0)."""
    this_month = F.trunc(F.col(at).cast("date"), "month") == F.trunc(as_of, "month")
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return runs.groupBy(*keys).agg(F.max(at).alias("last_at"), F.max_by(run, F.struct(at, run)).alias("last_run"), F.count("*").alias("runs"), total(F.col(cost)).alias("cost"), total(F.when(this_month, F.col(cost))).alias("month_cost"))
