"""Queries of the valuation engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import rules
from plumbline.operators import valuation as v

from .base import Registry
from .surrogates import LISTINGS_SQL, listings

R = Registry()
SUBJECT = {"surface": 25.0, "parking": 1, "condition": "muy_bueno", "age_years": 20, "orientation": "lateral", "floor_number": 2, "has_elevator": True, "step": 1, "complete": 0.75}


def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings as comparables of one subject; an area is a report."""
    return listings(spark, sf_dir).withColumns({f"subject_{k}": F.lit(x) for k, x in SUBJECT.items()} | {"subject_amenities": F.array(F.lit("SUM"))})


def _own_sql(p: str) -> list[str]:
    """The coefficients of a comparable (no prefix) or its subject, in the engine's order."""
    return [
        f"(CASE {p}condition WHEN 'a_estrenar' THEN 1.15::DOUBLE WHEN 'excelente' THEN 1.08 WHEN 'bueno' THEN 0.94 WHEN 'a_refaccionar' THEN 0.82 ELSE 1.0 END)",
        f"(CASE WHEN {p}age_years IS NULL THEN 1.0::DOUBLE WHEN {p}age_years <= 5 THEN 1.06 WHEN {p}age_years <= 15 THEN 1.0 WHEN {p}age_years <= 30 THEN 0.96 WHEN {p}age_years <= 50 THEN 0.92 WHEN {p}age_years <= 999 THEN 0.90 ELSE 1.0 END)",
        f"(CASE {p}orientation WHEN 'frente' THEN 1.03::DOUBLE WHEN 'contrafrente' THEN 0.98 WHEN 'interno' THEN 0.93 ELSE 1.0 END)",
        f"(CASE WHEN {p}floor_number >= 3 AND {p}has_elevator = false THEN 0.88::DOUBLE WHEN {p}floor_number >= 8 THEN 1.04 ELSE 1.0 END)",
        f"(CASE WHEN len(list_intersect(list_transform({p}amenities, lambda a: lower(a)), ['gimnasio', 'pileta', 'seguridad', 'sum'])) >= 3 THEN 1.05::DOUBLE ELSE 1.0 END)",
    ]


def engine_sql(source: str, key: str) -> str:
    """CTEs adj0 to valued over source (comparables with subject columns); a key is a report."""
    product = " * ".join(f"({a} / {b})" for a, b in zip(_own_sql(""), _own_sql("subject_"), strict=True))
    return f"""adj0 AS (SELECT *, CASE WHEN currency = 'USD' AND (price - 12000.0 * parking) / nullif(surface, 0) > 0 THEN (price - 12000.0 * parking) / nullif(surface, 0) END AS raw_m2,
  round({product} * (CASE WHEN days IS NULL OR days <= 90 THEN 1.0::DOUBLE WHEN days <= 999 THEN 0.97 ELSE 1.0 END), 8) AS coef FROM {source}),
adj1 AS (SELECT *, CASE WHEN raw_m2 IS NULL THEN 'sin_precio_o_superficie_en_usd' WHEN NOT raw_m2 BETWEEN 300 AND 12000 THEN 'usd_m2_fuera_de_rango' WHEN NOT coef BETWEEN 0.75 AND 1.25 THEN 'ajuste_excede_el_tope' END AS reason FROM adj0),
adj AS (SELECT *, CASE WHEN reason IS NULL THEN round(round(raw_m2 / coef, 6), 0) END AS adj_m2 FROM adj1),
cut AS (SELECT {key}, round(quantile_cont(adj_m2, 0.05), 6) AS cut_lo, round(quantile_cont(adj_m2, 0.95), 6) AS cut_hi FROM adj WHERE reason IS NULL GROUP BY {key} HAVING count(*) >= 8),
trim AS (SELECT adj.* EXCLUDE (reason), CASE WHEN reason IS NULL AND NOT coalesce(adj_m2 BETWEEN cut_lo AND cut_hi, true) THEN 'recorte_p5_p95' ELSE reason END AS reason FROM adj LEFT JOIN cut USING ({key})),
q AS (SELECT {key}, count(*) AS n, round(quantile_cont(adj_m2, 0.5), 6) AS med, round(quantile_cont(adj_m2, 0.1), 6) AS w_lo, round(quantile_cont(adj_m2, 0.9), 6) AS w_hi FROM trim WHERE reason IS NULL GROUP BY {key}),
st AS (SELECT t.{key}, n, med, round_even(round(quantile_cont(abs(adj_m2 - med), 0.5) / med, 12), 4) AS dispersion,
  round(quantile_cont(least(greatest(adj_m2, w_lo), w_hi), 0.5), 6) AS w_median, round(quantile_cont(least(greatest(adj_m2, w_lo), w_hi), 0.25), 6) AS p_lo, round(quantile_cont(least(greatest(adj_m2, w_lo), w_hi), 0.75), 6) AS p_hi
  FROM trim t JOIN q USING ({key}) WHERE t.reason IS NULL GROUP BY t.{key}, n, med)"""


def valued_sql(key: str) -> str:
    """CTEs after engine_sql(): valued has a row for each report."""
    return f"""whole AS (SELECT {key}, count(*) AS n_found, median(days) AS days, avg(manual::INT) AS manual_share, any_value(round(subject_surface, 1)) AS size, 12000.0 * any_value(subject_parking) AS extra, any_value(subject_step) AS step, any_value(subject_complete) AS complete FROM trim GROUP BY {key}),
s AS (SELECT *, coalesce(n, 0) AS n_used, CASE WHEN size IS NULL OR size <= 0 THEN 'sin_superficie_sujeto' WHEN coalesce(n, 0) < 5 THEN 'pocos_comparables' ELSE 'ok' END AS status,
  round(round(w_median, 0) * size + extra, 1) AS mid, round(round(p_lo, 0) * size + extra, 1) AS lo0, round(round(p_hi, 0) * size + extra, 1) AS hi0,
  round_even(round((0.35 * (CASE WHEN n >= 12 THEN 1.0::DOUBLE WHEN n >= 8 THEN 0.7 ELSE 0.3 END) + 0.30 * (CASE WHEN dispersion IS NULL THEN 0.5::DOUBLE WHEN dispersion < 0.10 THEN 1.0 WHEN dispersion >= 0.25 THEN 0.0 ELSE (0.25 - dispersion) / 0.15 END)
  + 0.15 * (CASE WHEN days IS NULL THEN 0.6::DOUBLE WHEN days < 30 THEN 1.0 WHEN days >= 120 THEN 0.2 ELSE round_even((120 - days) / 90, 3) END) + 0.10 * greatest(0.2, 1 - 0.2 * step)::DOUBLE + 0.10 * complete::DOUBLE) * (CASE WHEN manual_share > 0.5 THEN 0.85::DOUBLE ELSE 1.0 END), 9), 3) AS score
  FROM whole LEFT JOIN st USING ({key})),
f AS (SELECT *, greatest(mid * 0.08 / 2, mid * 0.2) AS least_half, CASE WHEN score >= 0.75 THEN 'ALTA' WHEN score >= 0.5 THEN 'MEDIA' ELSE 'BAJA' END AS level FROM s),
e AS (SELECT *, round(round(mid, 4), 0) AS v, round(round(CASE WHEN mid > 0 AND (hi0 - lo0) / 2 < least_half THEN mid - least_half ELSE lo0 END, 4), 0) AS lo, round(round(CASE WHEN mid > 0 AND (hi0 - lo0) / 2 < least_half THEN mid + least_half ELSE hi0 END, 4), 0) AS hi FROM f),
valued AS (SELECT {key}, n_found, n_used, status, CASE WHEN status = 'ok' THEN round(w_median, 0) END AS unit_price,
  CASE WHEN status = 'ok' THEN CASE WHEN level = 'BAJA' THEN round(round(v - (hi - lo) / 2 * 1.5, 4), 0) ELSE lo END END AS value_low, CASE WHEN status = 'ok' THEN v END AS value_mid,
  CASE WHEN status = 'ok' THEN CASE WHEN level = 'BAJA' THEN round(round(v + (hi - lo) / 2 * 1.5, 4), 0) ELSE hi END END AS value_high,
  CASE WHEN status = 'ok' THEN round(round(v * 0.85, 4), 0) END AS closing_low, CASE WHEN status = 'ok' THEN round(round(v * 0.95, 4), 0) END AS closing_high,
  CASE WHEN status = 'ok' THEN dispersion END AS dispersion, CASE WHEN status = 'ok' THEN score END AS score, CASE WHEN status = 'ok' THEN level END AS confidence FROM e)"""


ADJUSTED_SQL = LISTINGS_SQL + """, comps AS (SELECT *, 25.0::DOUBLE AS subject_surface, 1 AS subject_parking, 'muy_bueno' AS subject_condition, 20 AS subject_age_years, 'lateral' AS subject_orientation, 2 AS subject_floor_number,
  true AS subject_has_elevator, ['SUM'] AS subject_amenities, 1 AS subject_step, 0.75 AS subject_complete FROM listings), """ + engine_sql("comps", "area_id")


@R.query("WITH " + ADJUSTED_SQL + ", " + valued_sql("area_id") + " SELECT * FROM valued")
def robust_valuation_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.value(comparables(spark, sf_dir), ["area_id"])


@R.query("WITH " + ADJUSTED_SQL + " SELECT area_id, condition, coalesce(reason, 'used') AS outcome, count(*) AS n, round(sum(coef), 4) AS coef_sum, sum(adj_m2) AS adj_sum FROM adj GROUP BY ALL")
def adjustment_coefficients_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.adjusted(comparables(spark, sf_dir))
    return rows.groupBy("area_id", "condition", F.coalesce("reason", F.lit("used")).alias("outcome")).agg(F.count("*").alias("n"), F.round(F.sum("coef"), 4).alias("coef_sum"), F.sum("adj_m2").alias("adj_sum"))


@R.query("WITH " + ADJUSTED_SQL + " SELECT listing_id, area_id, reason, adj_m2 FROM trim")
def trim_and_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparable keeps its first reason; the used ones have none."""
    rows = v.trimmed(v.adjusted(comparables(spark, sf_dir)), ["area_id"])
    return rows.select("listing_id", "area_id", "reason", "adj_m2")


@R.query("WITH " + ADJUSTED_SQL + " SELECT area_id, n, med AS median, dispersion, w_median, p_lo, p_hi FROM st")
def winsorised_range_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.statistics(v.adjusted(comparables(spark, sf_dir)), ["area_id"])


UPSTREAM_SQL = "CASE WHEN price IS NULL OR price = 0 THEN 'sin_precio' WHEN currency = 'ARS' THEN 'precio_en_ars' WHEN days > 180 THEN 'aviso_vencido' END"


@R.query("WITH " + ADJUSTED_SQL.replace("FROM listings), adj0", f", {UPSTREAM_SQL} AS upstream FROM listings), inside AS (SELECT * FROM comps WHERE upstream IS NULL), adj0").replace("AS coef FROM comps)", "AS coef FROM inside)") + """
SELECT listing_id, area_id, reason IS NULL AS included, reason, round(raw_m2, 0) AS raw_m2, CASE WHEN raw_m2 IS NOT NULL THEN adj_m2 END AS adj_m2 FROM trim
UNION ALL SELECT listing_id, area_id, false, upstream, round(CASE WHEN currency = 'USD' AND surface > 0 THEN price / surface END, 0), NULL FROM comps WHERE upstream IS NOT NULL""")
def valuation_detail_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went in, and what an earlier step had left out, in one table."""
    upstream = rules.first_reason([("sin_precio", F.col("price").isNull() | (F.col("price") == 0)), ("precio_en_ars", F.col("currency") == "ARS"), ("aviso_vencido", F.col("days") > 180)])
    raw = F.when((F.col("currency") == "USD") & (F.col("surface") > 0), F.col("price") / F.col("surface"))
    return v.detail(comparables(spark, sf_dir), ["area_id"], upstream, raw).select("listing_id", "area_id", "included", "reason", "raw_m2", "adj_m2")


QUERIES, ORACLES = R.queries, R.oracles
