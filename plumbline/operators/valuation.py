"""Robust valuation of any number of subjects at once, in grouped DataFrame steps.

Unit prices are rounded to whole units before any statistic, so exact percentiles keep one
counter for each distinct price of a group, however many comparables it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.config import AMENITIES, DEFAULT, Config


def ladder(value: Column, bands: tuple, default: float = 1.0) -> Column:
    """The coefficient of the first band whose limit the value does not exceed; null and beyond: default."""
    out = F.lit(default)
    for limit, coef in reversed(bands):
        out = F.when(value <= limit, coef).otherwise(out)
    return F.coalesce(F.when(value.isNotNull(), out), F.lit(default))


def lookup(value: Column, table: dict) -> Column:
    out = F.lit(1.0)
    for name, coef in table.items():
        out = F.when(value == name, coef).otherwise(out)
    return out


def floor_coef(floor: Column, elevator: Column, cfg: Config) -> Column:
    """High without a lift (only if that is known) before high with a view."""
    return F.when((floor >= cfg.high_floor) & (elevator == F.lit(False)), cfg.no_elevator).when(floor >= cfg.view_floor, cfg.view).otherwise(1.0)


def full_amenities(amenities: Column, wanted: list[str] = AMENITIES) -> Column:
    """At least three of the wanted ones, upper or lower case; unknown is not full."""
    return F.coalesce(F.size(F.array_intersect(F.transform(amenities, F.lower), F.array(*[F.lit(a) for a in wanted]))) >= 3, F.lit(False))


def own_coefficients(prefix: str, cfg: Config = DEFAULT) -> Column:
    """The coefficients of a comparable (no prefix) or of its subject, in the engine's order. A column `own` with the prefix
    that holds them spares adjusted() to take them for each pair."""
    c = lambda n: F.col(prefix + n)
    return F.array(lookup(c("condition"), cfg.condition), ladder(c("age_years"), cfg.age_years), lookup(c("orientation"), cfg.orientation), floor_coef(c("floor_number"), c("has_elevator"), cfg), F.when(full_amenities(c("amenities")), cfg.full_amenities).otherwise(1.0))


def relative_coefficient(comp: Column, subject: Column, cfg: Config = DEFAULT) -> Column:
    """The product of own_coefficients() that takes a comparable to its subject; what is unknown is neutral."""
    total = F.lit(1.0)
    for i in range(5):
        total = total * (comp[i] / subject[i])
    return total * ladder(F.col("days"), cfg.listing_age)


def raw_unit_price(cfg: Config = DEFAULT) -> Column:
    """(price - parking) / surface in USD, null unless positive."""
    value = F.try_divide(F.col("price") - cfg.parking * F.col("parking"), F.nullif(F.col("surface"), F.lit(0.0)))
    return F.when((F.col("currency") == "USD") & (value > 0), value)


def adjusted(comps: DataFrame, cfg: Config = DEFAULT, prefix: str = "subject_") -> DataFrame:
    """comps with raw_m2, coef, reason (why it is out, null if it is in) and adj_m2 (whole units)."""
    lo, hi = cfg.unit_price
    own = lambda p: F.col(p + "own") if p + "own" in comps.columns else own_coefficients(p, cfg)
    out = comps.withColumn("raw_m2", raw_unit_price(cfg)).withColumn("coef", F.round(relative_coefficient(own(""), own(prefix), cfg), 8))
    reason = F.when(F.col("raw_m2").isNull(), "sin_precio_o_superficie_en_usd").when(~F.col("raw_m2").between(lo, hi), "usd_m2_fuera_de_rango").when(~F.col("coef").between(cfg.least_adjustment, cfg.most_adjustment), "ajuste_excede_el_tope")
    return out.withColumn("reason", reason).withColumn("adj_m2", F.when(F.col("reason").isNull(), F.round(F.round(F.col("raw_m2") / F.col("coef"), 6), 0)))


def trimmed(rows: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Rows beyond the trim percentiles of their group get the reason `recorte_p5_p95`, in groups of trim_from or more."""
    # Percentiles leave out the nulls, i.e. the rows that have a reason.
    cut = rows.groupBy(*keys).agg(F.count("adj_m2").alias("n_before"), F.percentile("adj_m2", F.array(F.lit(cfg.trim), F.lit(1 - cfg.trim))).alias("cut"))
    cut = cut.where(F.col("n_before") >= cfg.trim_from).select(*keys, F.round(F.col("cut")[0], 6).alias("cut_lo"), F.round(F.col("cut")[1], 6).alias("cut_hi"))
    out = rows.join(cut, keys, "left")
    beyond = F.col("reason").isNull() & ~F.coalesce(F.col("adj_m2").between(F.col("cut_lo"), F.col("cut_hi")), F.lit(True))
    return out.withColumn("reason", F.when(beyond, f"recorte_p{100 * cfg.trim:g}_p{100 - 100 * cfg.trim:g}").otherwise(F.col("reason"))).drop("cut_lo", "cut_hi")


def statistics(rows: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Per group, over the rows without a reason and within the trim percentiles: n, median, dispersion
    (MAD / median), winsorised quartiles.

    The rows become a histogram, an entry for each distinct price of a group: whole numbers
    within the plausible range, so a group's entries are bounded however many rows it has. All
    percentiles are taken over entries with their frequency.
    """
    r = lambda c: F.round(c, 6)
    at = lambda v, *ps: F.percentile(v, F.array(*[F.lit(p) for p in ps]), F.col("w"))
    # adj_m2 is null where a row has a reason, and percentiles leave nulls out. Rows that fall out later
    # become null too, not filtered: every step then reads the one histogram, whose shuffle is reused.
    h = rows.groupBy(*keys, "adj_m2").agg(F.count("*").alias("w"))
    counted = lambda v: F.sum(F.when(F.col(v).isNotNull(), F.col("w")))
    cut = h.groupBy(*keys).agg(counted("adj_m2").alias("n0"), at("adj_m2", cfg.trim, 1 - cfg.trim).alias("cut"))
    kept = (F.col("n0") < cfg.trim_from) | F.col("adj_m2").between(r(F.col("cut")[0]), r(F.col("cut")[1]))
    v = h.join(cut, keys).select(*keys, F.when(kept, F.col("adj_m2")).alias("v"), "w")
    mid = v.groupBy(*keys).agg(counted("v").alias("n"), at("v", 0.5, *cfg.winsor).alias("q"))
    mid = mid.select(*keys, "n", *[r(F.col("q")[i]).alias(c) for i, c in enumerate(("median", "w_lo", "w_hi"))])
    clip = F.when(F.col("v").isNotNull(), F.least(F.greatest("v", "w_lo"), F.col("w_hi")))
    out = v.join(mid, keys).groupBy(*keys, "n", "median").agg(F.percentile(F.abs(F.col("v") - F.col("median")), F.lit(0.5), F.col("w")).alias("mad"), at(clip, 0.5, *cfg.band).alias("q"))
    out = out.where("n > 0").select(*keys, "n", "median", F.bround(F.round(F.col("mad") / F.col("median"), 12), 4).alias("dispersion"), *[r(F.col("q")[i]).alias(c) for i, c in enumerate(("w_median", "p_lo", "p_hi"))])
    return out


def few_statistics(groups: DataFrame, values: str, cfg: Config = DEFAULT) -> DataFrame:
    """groups with the columns of statistics(), from a sorted array of each group's adj_m2 without nulls: for groups of few rows."""
    r = lambda c: F.round(c, 6)

    def once(rows: DataFrame, **columns: Column) -> DataFrame:
        """Generated, so that a lambda finds the columns made, not their expressions to take for each element."""
        return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")).select(*rows.columns, "__once.*")

    def at(name: str, p: float) -> Column:
        """The percentile as Spark's own takes it; null without values."""
        place = (F.size(name) - 1) * F.lit(p)
        lo, hi = F.floor(place), F.ceil(place)
        x, y = F.get(F.col(name), lo.cast("int")), F.get(F.col(name), hi.cast("int"))
        return F.when(F.size(name) > 0, F.when(x == y, x).otherwise((hi - place) * x + (place - lo) * y))

    out = once(groups, cut_lo=r(at(values, cfg.trim)), cut_hi=r(at(values, 1 - cfg.trim)))
    kept = F.filter(values, lambda x: x.between(F.col("cut_lo"), F.col("cut_hi")))
    out = once(out, v=F.when(F.size(values) < cfg.trim_from, F.col(values)).otherwise(kept))
    out = once(out, n=F.size("v").cast("long"), median=r(at("v", 0.5)), w_lo=r(at("v", cfg.winsor[0])), w_hi=r(at("v", cfg.winsor[1])))
    off, clipped = F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("median")))), F.transform("v", lambda x: F.least(F.greatest(x, F.col("w_lo")), F.col("w_hi")))
    out = once(out, off=off, clipped=clipped)
    return out.withColumns({"dispersion": F.bround(F.round(at("off", 0.5) / F.col("median"), 12), 4), "w_median": r(at("clipped", 0.5)), "p_lo": r(at("clipped", cfg.band[0])), "p_hi": r(at("clipped", cfg.band[1]))})


def confidence(n: Column, dispersion: Column, days: Column, step: Column, complete: Column, manual_share: Column, cfg: Config = DEFAULT) -> Column:
    """The weighted score of 0 to 1, with three digits; the thresholds are held against it as it is then."""
    w = cfg.weights
    by_count = F.when(n >= 12, 1.0).when(n >= 8, 0.7).otherwise(0.3)
    by_dispersion = F.when(dispersion.isNull(), 0.5).when(dispersion < 0.10, 1.0).when(dispersion >= 0.25, 0.0).otherwise((0.25 - dispersion) / 0.15)
    fresh = F.when(days.isNull(), 0.6).when(days < 30, 1.0).when(days >= 120, 0.2).otherwise(F.bround((120 - days) / 90, 3))
    relaxed = F.greatest(F.lit(0.2), 1 - 0.2 * step)
    score = w["count"] * by_count + w["dispersion"] * by_dispersion + w["freshness"] * fresh + w["relaxation"] * relaxed + w["completeness"] * complete
    return F.bround(F.round(F.when(manual_share > 0.5, score * 0.85).otherwise(score), 9), 3)


def value(comps: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """One row for each subject: keys, n_found, n_used, status, unit price, range, closing range, score, confidence.

    comps: keys, the comparables' columns, the subject's with prefix subject_ (surface,
    parking, condition, age_years, ..., step). Freshness and the manual share are over all
    comparables, the rest over those used. Too few comparables or no surface of the
    subject: a status and nulls.
    """
    rows = adjusted(comps, cfg)
    return _valued(rows.groupBy(*keys).agg(*_whole()).join(statistics(rows, keys, cfg), keys, "left").withColumn("n", F.coalesce("n", F.lit(0))), keys, cfg)


def valued_few(rows: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """value() of rows that adjusted() has been over, for groups that are known to be small (a case's k comparables).

    A group's prices are one array, so the rows are aggregated once and nothing is joined.
    """
    out = rows.groupBy(*keys).agg(*_whole(), F.sort_array(F.collect_list("adj_m2")).alias("values"))
    return _valued(few_statistics(out, "values", cfg), keys, cfg)


def _whole() -> list[Column]:
    """What value() takes over all comparables of a group."""
    subject = [F.first(c).alias(c) for c in ("subject_surface", "subject_parking", "subject_step", "subject_complete")]
    return [F.count("*").alias("n_found"), F.median("days").alias("days"), F.avg(F.col("manual").cast("int")).alias("manual_share"), *subject]


def _valued(out: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """From the statistics of groups to their values."""
    status = F.when(F.col("subject_surface").isNull() | (F.col("subject_surface") <= 0), "sin_superficie_sujeto").when(F.col("n") < cfg.least_comparables, "pocos_comparables").otherwise("ok")
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    size, extra = F.round("subject_surface", 1), cfg.parking * F.col("subject_parking")
    unit = lambda c: F.round(F.round(F.col(c), 6), 0)
    total = lambda c: F.round(unit(c) * size + extra, 1)
    whole_units = lambda c: F.round(F.round(c, 4), 0)
    score = confidence(F.col("n"), F.col("dispersion"), F.col("days"), F.col("subject_step"), F.col("subject_complete"), F.col("manual_share"), cfg)
    out = out.withColumns({"mid": total("w_median"), "lo0": total("p_lo"), "hi0": total("p_hi"), "score": score})
    level = F.when(F.col("score") >= cfg.high, "ALTA").when(F.col("score") >= cfg.medium, "MEDIA").otherwise("BAJA")
    # A range narrower than least_width and the calibrated error is one of that width around mid.
    floor = F.greatest(F.col("mid") * cfg.least_width / 2, F.col("mid") * cfg.half_width)
    narrow = (F.col("mid") > 0) & ((F.col("hi0") - F.col("lo0")) / 2 < floor)
    out = out.withColumns({
        "low0": whole_units(F.when(narrow, F.col("mid") - floor).otherwise(F.col("lo0"))),
        "high0": whole_units(F.when(narrow, F.col("mid") + floor).otherwise(F.col("hi0"))),
        "value_mid": whole_units(F.col("mid")), "confidence": level,
    })
    # At low confidence half as wide again, around the value.
    half = (F.col("high0") - F.col("low0")) / 2 * 1.5
    low = F.when(F.col("confidence") == "BAJA", whole_units(F.col("value_mid") - half)).otherwise(F.col("low0"))
    high = F.when(F.col("confidence") == "BAJA", whole_units(F.col("value_mid") + half)).otherwise(F.col("high0"))
    closing = [whole_units(F.col("value_mid") * c) for c in cfg.closing]
    shown = {"unit_price": unit("w_median"), "value_low": low, "value_mid": F.col("value_mid"), "value_high": high, "closing_low": closing[0], "closing_high": closing[1], "dispersion": F.col("dispersion"), "score": F.col("score"), "confidence": F.col("confidence")}
    return out.select(*keys, "n_found", F.col("n").alias("n_used"), "status", *[F.when(ok, c).alias(n) for n, c in shown.items()])


def detail(comps: DataFrame, keys: list[str], upstream: Column, raw: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Every comparable of a report with included and the first reason why it is not.

    upstream: the reason of a step before the engine (null: it went in); such rows show their
    raw unit price (raw) and no adjusted one, and count in no statistic.
    """
    marked = comps.withColumn("__upstream", upstream).withColumn("__raw", F.round(raw, 0))
    inside = trimmed(adjusted(marked.where("__upstream is null"), cfg), keys, cfg)
    inside = inside.withColumn("raw_m2", F.round("raw_m2", 0)).withColumn("adj_m2", F.when(F.col("raw_m2").isNotNull(), F.col("adj_m2"))).drop("__upstream", "__raw", "coef")
    outside = marked.where("__upstream is not null").withColumn("reason", F.col("__upstream")).withColumn("raw_m2", F.col("__raw")).drop("__upstream", "__raw")
    return inside.unionByName(outside, allowMissingColumns=True).withColumn("included", F.col("reason").isNull())
