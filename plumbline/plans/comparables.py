"""Queries over filters, ladders, rules, market metrics and back-tests, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.config import RUNGS
from plumbline.operators import evaluation as ev
from plumbline.operators import lookup
from plumbline.operators import market as mk
from plumbline.operators import retrieval as rt
from plumbline.operators import rules
from plumbline.operators import valuation as v
from plumbline.tables import stored

from .base import Registry
from .spanish import lexical_sql
from .surrogates import AREAS_SQL, AS_OF, LISTINGS_SQL, areas, joined, listings, made, table
from .valuation import engine_sql, valued_sql

R = Registry()
HARD_SQL = "active AND operation = 'SALE' AND currency = 'USD' AND NOT price_on_request AND price IS NOT NULL"

CANON_SQL = LISTINGS_SQL + f""", canon AS (SELECT *, CASE order_id % 5 WHEN 0 THEN listing_id WHEN 1 THEN 'other' END AS canonical_id,
  CASE WHEN order_id % 17 = 0 THEN ' ' ELSE 'Calle ' || (order_id % 100) END AS address,
  round_even(CASE WHEN currency = 'USD' AND surface > 0 THEN price / surface END, 0) AS unit, DATE '{AS_OF}' AS as_of FROM listings)"""


def unit_price(currency: Column, surface: Column, price: Column) -> Column:
    return F.bround(F.when((currency == "USD") & (surface > 0), price / surface), 0)


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("order_id")
    return listings(spark, sf_dir).withColumns({
        "canonical_id": F.when(o % 5 == 0, F.col("listing_id")).when(o % 5 == 1, "other"),
        "address": F.when(o % 17 == 0, " ").otherwise(F.concat(F.lit("Calle "), (o % 100).cast("string"))),
        "unit": unit_price(F.col("currency"), F.col("surface"), F.col("price")),
    })


@R.query("WITH " + CANON_SQL + """ SELECT listing_id, area_id, surface, rooms FROM canon WHERE active AND operation = 'SALE' AND currency = 'USD' AND NOT price_on_request AND price IS NOT NULL AND last_seen > as_of - 365
AND (canonical_id IS NULL OR canonical_id = listing_id) AND (surface IS NULL OR surface BETWEEN 14 AND 26) AND (rooms IS NULL OR rooms BETWEEN 2 AND 4)""")
def hard_filter_nullable_ranges(spark, sf_dir):
    rows = rt.hard_filter(canon(spark, sf_dir), AS_OF, 365)
    fits = rt.unknown_or_between(F.col("surface"), F.lit(14.0), F.lit(26.0)) & rt.unknown_or_between(F.col("rooms"), F.lit(2), F.lit(4))
    return rows.where(fits).select("listing_id", "area_id", "surface", "rooms")


@R.query("WITH " + CANON_SQL + " SELECT listing_id FROM canon WHERE list_contains(quality_flags, 'ficha_completa') AND NOT list_contains(quality_flags, 'surface_total_only')")
def flag_membership(spark, sf_dir):
    flags = F.col("quality_flags")
    return canon(spark, sf_dir).where(rt.flagged("ficha_completa", flags) & ~rt.flagged("surface_total_only", flags)).select("listing_id")


DISTANCE_SQL = "CAST(floor(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))) AS BIGINT)"
REACH_SQL = AREAS_SQL + f""", far AS (SELECT a.area_id, b.area_id AS other, {DISTANCE_SQL} AS metres FROM areas a JOIN areas b ON a.lat IS NOT NULL AND b.lat IS NOT NULL),
reach AS (SELECT area_id, other, metres, CASE WHEN area_id = other THEN 'self' WHEN metres <= 3500 THEN 'near' ELSE 'wide' END AS scope FROM far WHERE metres <= 7000 UNION ALL SELECT area_id, area_id, 0, 'self' FROM areas WHERE lat IS NULL)"""


@R.query("WITH " + REACH_SQL + " SELECT * FROM reach")
def area_scopes(spark, sf_dir):
    """Which areas each scope of the relaxation reaches."""
    return lookup.scopes(areas(spark, sf_dir), "area_id")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("subject_id"), n.alias("s_area"), (n % 20 + 15).cast("double").alias("s_surface"), (n % 4 + 1).alias("s_rooms"))


STEPS_SQL = " ".join(
    f"WHEN (surface IS NULL OR surface BETWEEN s_surface * (1 - {s}::DOUBLE) AND s_surface * (1 + {s}::DOUBLE)) AND (rooms IS NULL OR rooms BETWEEN s_rooms - {r} AND s_rooms + {r}) AND last_seen > as_of - {d}"
    + (" AND is_near" if scope == "near" else "") + (" AND detailed" if detail else "") + f" THEN {i}"
    for i, (s, d, scope, r, detail) in enumerate(RUNGS)
)


def ladder_sql(cap: int) -> str:
    """CTEs up to ranked(subject_id, listing_id, step, used_step, place)."""
    return "WITH " + CANON_SQL + ", " + REACH_SQL + f""", pairs AS (SELECT n_nationkey AS subject_id, n_nationkey % 20 + 15::DOUBLE AS s_surface, n_nationkey % 4 + 1 AS s_rooms, canon.*, scope <> 'wide' AS is_near, list_contains(quality_flags, 'ficha_completa') AS detailed
  FROM nation JOIN reach ON reach.area_id = n_nationkey JOIN canon ON canon.area_id = reach.other WHERE {HARD_SQL} AND last_seen > as_of - 180 AND (canonical_id IS NULL OR canonical_id = listing_id)),
st AS (SELECT *, CASE {STEPS_SQL} END AS step FROM pairs),
counts AS (SELECT subject_id, {", ".join(f"least(count(*) FILTER (step <= {i}), {cap}) AS n{i}" for i in range(5))} FROM st WHERE step IS NOT NULL GROUP BY subject_id),
used AS (SELECT subject_id, CASE {" ".join(f"WHEN n{i} >= 25 THEN {i}" for i in range(5))} {" ".join(f"WHEN n{i} = greatest(n0, n1, n2, n3, n4) THEN {i}" for i in range(5))} END AS used_step FROM counts),
ranked AS (SELECT subject_id, listing_id, step, used_step, row_number() OVER (PARTITION BY subject_id ORDER BY last_seen DESC, listing_id) AS place FROM st JOIN used USING (subject_id) WHERE step <= used_step)"""


def ladder_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rt.hard_filter(canon(spark, sf_dir), AS_OF, 180).withColumn("detailed", rt.flagged("ficha_completa", F.col("quality_flags")))
    rows = rows.select("listing_id", "area_id", "surface", "rooms", "last_seen", "detailed")
    return rt.in_scope(subjects(spark, sf_dir), rows, lookup.scopes(areas(spark, sf_dir), "area_id"))


@R.query(ladder_sql(60) + " SELECT * FROM ranked WHERE place <= 60")
def relaxation_ladder(spark, sf_dir):
    return rt.ladder(ladder_pairs(spark, sf_dir), "subject_id", RUNGS, AS_OF, 25, 60).select("subject_id", "listing_id", "step", "used_step", "place")


WANTED = ["excelentes pisos al frente, con piletas", "muy buenos, al contrafrente; gimnasio y seguridad", "a estrenar, internos, con pileta y gimnasios", "para refaccionar, laterales"]
WANTED_SQL = "(SELECT n_nationkey AS q, " + "CASE n_nationkey % 4 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WANTED)) + " END || ' ' || n_name AS text FROM nation)"


@R.query(ladder_sql(5000) + ", pool AS (SELECT * FROM ranked WHERE place <= 5000), "
  + lexical_sql(WANTED_SQL, "(SELECT listing_id AS d, concat_ws(' ', kind, replace(condition, '_', ' '), orientation, array_to_string(amenities, ', '), n_name) AS text FROM canon JOIN nation ON n_nationkey = area_id WHERE listing_id IN (SELECT listing_id FROM pool))")
  + """, o AS (SELECT pool.*, r / (r + 1) AS score, row_number() OVER (PARTITION BY subject_id ORDER BY coalesce(round_even(r / (r + 1), 9), -1) DESC, place) AS new_place FROM pool LEFT JOIN lx ON q = subject_id AND d = listing_id)
SELECT subject_id, listing_id, new_place, round_even(score, 4) AS score FROM o WHERE new_place <= 60""")  # fmt: skip
def semantic_ladder(spark, sf_dir):
    """The ladder's pool of up to 5,000, ordered by the cover density of the subject's words in the listings' texts; unscored ones follow by recency."""
    pool = rt.ladder(ladder_pairs(spark, sf_dir), "subject_id", RUNGS, AS_OF, 25, 5000)
    pairs = pool.select(F.col("subject_id").alias("q"), F.col("listing_id").alias("d"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    wanted = F.element_at(F.array(*[F.lit(w) for w in WANTED]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    queries = n.select(F.col("n_nationkey").alias("q"), F.concat_ws(" ", wanted, "n_name").alias("text"))
    said = F.concat_ws(" ", "kind", F.replace(F.col("condition"), F.lit("_"), F.lit(" ")), "orientation", F.array_join("amenities", ", "), "n_name")
    rows = canon(spark, sf_dir).join(pairs.select(F.col("d").alias("listing_id")).distinct(), "listing_id", "left_semi").join(n, F.col("area_id") == F.col("n_nationkey"))
    index = rt.postings(rows.select(F.col("listing_id").alias("d"), F.lit(0).alias("chunk"), said.alias("text")), rt.query_terms(queries))
    scores = rt.lexical_scores(queries, index, pairs).select(F.col("q").alias("subject_id"), F.col("d").alias("listing_id"), F.bround("score", 9).alias("score"))
    return rt.by_score(pool, scores, "subject_id").select("subject_id", "listing_id", "new_place", "score")


@R.query("WITH " + CANON_SQL + """ SELECT listing_id, coalesce(condition, nullif(kind, 'PROMO')) AS condition, coalesce(rooms, TRY_CAST(nullif(regexp_extract(kind, '[0-9]+'), '') AS INT)) AS rooms,
coalesce(surface, CASE WHEN order_id % 2 = 0 THEN 20.0 WHEN order_id % 3 = 0 THEN 31.5 END) AS surface, CASE WHEN order_id % 10 >= 7 THEN age_years END AS age_years, last_seen - published AS days_published FROM canon""")
def candidate_projection_fallback(spark, sf_dir):
    """Features first, the side-car's text next; a feature of low confidence is not used."""
    o = F.col("order_id")
    raw = F.create_map(
        F.lit("condition"), F.when(F.col("kind") == "PROMO", " ").otherwise(F.col("kind")), F.lit("rooms"), F.regexp_extract("kind", "[0-9]+", 0),
        F.lit("surface_total"), F.when(o % 2 == 0, "20").otherwise("unknown"), F.lit("surface_weighted"), F.when(o % 3 == 0, "31.5").otherwise(""),
    )
    return rt.candidates(canon(spark, sf_dir).withColumns({"raw": raw, "confidence": (o % 10) / 10.0}))


@R.query("""WITH h AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, count(*) AS runs, quantile_disc(value, 0.5) AS lower_median, max(value) - min(value) AS spread FROM h WHERE n <= 5 GROUP BY ALL""")
def last_runs_lower_median(spark, sf_dir):
    """What a quality page shows: the lower median of the last five runs and their range."""
    return ev.last_runs(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "value")


@R.query("WITH " + CANON_SQL + ", n AS (SELECT area_id, count(*) AS n FROM canon WHERE unit BETWEEN 300 AND 12000 GROUP BY area_id HAVING count(*) >= 40) SELECT listing_id, area_id FROM canon JOIN n USING (area_id) WHERE unit BETWEEN 300 AND 12000")
def cases_of_large_areas(spark, sf_dir):
    """Only areas with 40 listings or more give cases."""
    return ev.large_groups(canon(spark, sf_dir).where("unit between 300 and 12000"), "area_id", 40).select("listing_id", "area_id")


DISCARD_SQL = """CASE WHEN price IS NULL THEN 'sin_precio' WHEN currency <> 'USD' THEN 'precio_no_usd' WHEN surface IS NULL THEN 'sin_superficie' WHEN NOT surface BETWEEN 15 AND 2000 THEN 'superficie_implausible'
WHEN address IS NULL OR trim(address) = '' THEN 'sin_direccion' WHEN NOT price / surface BETWEEN 300 AND 12000 THEN 'usd_m2_fuera_de_rango' END"""
CURATION_SQL = """CASE WHEN price IS NULL OR price = 0 THEN 'sin_precio' WHEN currency = 'ARS' THEN 'precio_en_ars' WHEN surface IS NULL OR surface < 15 THEN 'sin_superficie' WHEN NOT price / surface BETWEEN 300 AND 12000 THEN 'usd_m2_fuera_de_rango'
WHEN days > 180 THEN 'aviso_vencido' WHEN upper(trim(address)) IN ('CALLE 42', 'CALLE AL 42') THEN 'auto_referencia' WHEN canonical_id IS NOT NULL AND canonical_id <> listing_id THEN 'duplicado_de_cluster' END"""


@R.query("WITH " + CANON_SQL + f" SELECT source, coalesce({DISCARD_SQL}, 'accepted') AS reason, count(*) AS n FROM canon GROUP BY ALL")
def discard_reason_histogram(spark, sf_dir):
    return canon(spark, sf_dir).withColumn("reason", F.coalesce(rules.ingest_discard(), F.lit("accepted"))).groupBy("source", "reason").agg(F.count("*").alias("n"))


@R.query("WITH " + CANON_SQL + f" SELECT listing_id, {CURATION_SQL} AS reason FROM canon")
def curation_rules_first_match(spark, sf_dir):
    return canon(spark, sf_dir).select("listing_id", rules.curation(F.lit("Calle al 42, ")).alias("reason"))


@R.query("WITH " + CANON_SQL + """, m AS (SELECT area_id, count(*) AS n, round(quantile_cont(unit, 0.5), 6) AS median FROM canon GROUP BY area_id)
SELECT area_id, n, median, round(quantile_cont(abs(unit - median), 0.5) / median, 3) AS dispersion FROM canon JOIN m USING (area_id) GROUP BY area_id, n, median""")
def stock_dispersion_by_area(spark, sf_dir):
    return mk.stock(canon(spark, sf_dir), "area_id", "unit")


@R.query("""WITH h AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND value IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
f AS (SELECT CASE WHEN last < first THEN (first - last) / first * 100 END AS fall FROM h)
SELECT count(*) AS series, count(fall) AS dropped, round(count(fall) * 100.0 / count(*), 1) AS dropped_pct, round(avg(fall), 1) AS mean_drop_pct FROM f""")
def price_drops_90d(spark, sf_dir):
    history = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.col("value").alias("price"))
    return mk.price_drops(history, ["user_id", "event_type"], F.lit("2024-04-10").cast("date"), "event_id", 90)


@R.query("WITH " + CANON_SQL + " SELECT area_id, CAST(floor(quantile_cont(days, 0.5)) AS BIGINT) AS median_days, count(*) AS n FROM canon WHERE days >= 0 GROUP BY area_id")
def time_on_market_floor_median(spark, sf_dir):
    return mk.days_on_market(canon(spark, sf_dir), "area_id")


INDEX_SQL = """idx0 AS (SELECT c_nationkey AS area_id, c_custkey % 24 AS period, c_custkey, round(c_acctbal, 2) AS official FROM customer),
idx AS (SELECT area_id, arg_max(official, period * 10000000 + c_custkey) AS official, max(period) AS period FROM idx0 GROUP BY area_id)"""


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area_id"), (F.col("c_custkey") % 24).alias("period"), "c_custkey", F.round("c_acctbal", 2).alias("official"))


@R.query("WITH " + INDEX_SQL + " SELECT * FROM idx")
def latest_index_per_area(spark, sf_dir):
    return mk.latest(index_rows(spark, sf_dir), "area_id", "period", "official", ["c_custkey"])


COVERAGE_SQL = "WITH " + CANON_SQL + ", " + INDEX_SQL + """, own AS (SELECT area_id, count(*) AS actives, count(unit) AS usable, round_even(quantile_cont(unit, 0.5), 0) AS median FROM canon GROUP BY area_id),
c AS (SELECT area_id, actives, usable, median, official, round((median - official) / nullif(official, 0), 4) AS deviation, CASE WHEN usable >= 20 THEN 'OK' WHEN usable >= 5 THEN 'JUSTO' ELSE 'INSUFICIENTE' END AS state FROM own LEFT JOIN idx USING (area_id))"""


@R.query(COVERAGE_SQL + """, n AS (SELECT area_id, source, count(*) AS n FROM canon GROUP BY ALL), b AS (SELECT area_id, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source FROM n GROUP BY area_id)
SELECT c.*, by_source, coalesce(abs(deviation) > 0.15, false) AS alert FROM c JOIN b USING (area_id)""")
def area_coverage_vs_index(spark, sf_dir):
    official = mk.latest(index_rows(spark, sf_dir), "area_id", "period", "official", ["c_custkey"]).select("area_id", "official")
    out = mk.coverage(canon(spark, sf_dir), "area_id", "unit", official, "source")
    pairs = F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("by_source", F.array_join(pairs, ","))


@R.query(COVERAGE_SQL + " SELECT count(*) AS areas, round(avg((state <> 'INSUFICIENTE')::INT), 4) AS share, avg((state <> 'INSUFICIENTE')::INT) >= 0.7 AS passed, count(*) FILTER (actives >= 40) AS large FROM c")
def unit_price_coverage_gate(spark, sf_dir):
    enough = F.avg((F.col("state") != "INSUFICIENTE").cast("int"))
    return area_coverage_vs_index(spark, sf_dir).agg(F.count("*").alias("areas"), F.round(enough, 4).alias("share"), (enough >= mk.GATE).alias("passed"), F.count_if(F.col("actives") >= 40).alias("large"))


@R.query("WITH " + CANON_SQL + ", " + INDEX_SQL + """, m AS (SELECT area_id, round(quantile_cont(unit, 0.5), 6) AS median FROM canon GROUP BY area_id)
SELECT area_id, median, official, CASE WHEN official <> 0 THEN round((median - official) / official * 100, 1) END AS bias_pct FROM m LEFT JOIN idx USING (area_id)""")
def area_bias_against_index(spark, sf_dir):
    official = mk.latest(index_rows(spark, sf_dir), "area_id", "period", "official", ["c_custkey"]).select("area_id", "official")
    own = mk.stock(canon(spark, sf_dir), "area_id", "unit").select("area_id", "median")
    return own.join(official, "area_id", "left").withColumn("bias_pct", F.when(F.col("official") != 0, F.round((F.col("median") - F.col("official")) / F.col("official") * 100, 1)))


@R.query("WITH " + CANON_SQL + """, u AS (SELECT listing_id, area_id, unit FROM canon WHERE unit BETWEEN 300 AND 12000),
p AS (SELECT a.listing_id, quantile_cont(b.unit, 0.5) AS loo, count(*) AS n FROM u a JOIN u b ON a.area_id = b.area_id AND a.listing_id <> b.listing_id GROUP BY a.listing_id)
SELECT u.listing_id, u.area_id, u.unit, CASE WHEN n >= 5 THEN loo END AS loo FROM u LEFT JOIN p USING (listing_id)""")
def leave_one_out_baseline(spark, sf_dir):
    """Every row is a case and in the pool of the others."""
    rows = canon(spark, sf_dir).where("unit between 300 and 12000")
    return ev.leave_one_out_median(rows, "area_id", "unit").select("listing_id", "area_id", "unit", "loo")


CASES_SQL = """cases AS (SELECT * FROM canon WHERE order_id % 20 = 0 AND unit BETWEEN 300 AND 12000),
near AS (SELECT c.listing_id AS case_id, c.price AS case_price, c.unit AS case_unit, c.area_id AS case_area, c.surface AS subject_surface, c.parking AS subject_parking, c.condition AS subject_condition, c.age_years AS subject_age_years, c.orientation AS subject_orientation,
    c.floor_number AS subject_floor_number, c.has_elevator AS subject_has_elevator, c.amenities AS subject_amenities, 0 AS subject_step,
    ((c.condition IS NOT NULL)::INT + (c.orientation IS NOT NULL)::INT + (c.age_years IS NOT NULL)::INT + (c.floor_number IS NOT NULL)::INT) / 4 AS subject_complete,
    b.*, b.listing_id AS ref_id, row_number() OVER (PARTITION BY c.listing_id ORDER BY abs(b.surface - c.surface), b.listing_id) AS pos
  FROM cases c JOIN canon b ON c.area_id = b.area_id AND c.listing_id <> b.listing_id AND b.surface BETWEEN c.surface * 0.7::DOUBLE AND c.surface * 1.3::DOUBLE AND (b.rooms IS NULL OR c.rooms IS NULL OR abs(b.rooms - c.rooms) <= 1) WHERE b.unit BETWEEN 300 AND 12000),
top AS (SELECT * FROM near WHERE pos <= 25)"""
SUBJECT_COLUMNS = ["surface", "parking", "condition", "age_years", "orientation", "floor_number", "has_elevator", "amenities"]


#: What listings of a back-test are made of. The parts of an id take less room than the id.
MADE_OF = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "p_size", "s_nationkey"]


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listings with a unit price from 300 to 12,000 are made of. Cases, their pool and the medians all read it, so it is joined
    once and stored, and the joins' shuffle files can go."""
    c = made()
    # The unit price's own conditions; all but the currency are asked before any join.
    unit = F.bround(F.try_divide(c["price"], c["surface"]), 0)
    return stored(joined(spark, sf_dir).where((c["surface"] > 0) & unit.between(300, 12000) & (c["currency"] == "USD")).select(*MADE_OF), release=True)


def columns_of_usable() -> dict[str, Column]:
    """The columns of a listing, of rows of usable()."""
    price, surface = F.col("l_extendedprice"), F.col("l_quantity")  # neither is left out in them
    return made() | {"price": price, "surface": surface, "currency": F.lit("USD"), "unit": unit_price(F.lit("USD"), surface, price)}


def case_pairs(rows: DataFrame, unknown: tuple[str, ...] = ()) -> DataFrame:
    """Cases of usable() with their comparables, ready for the engine: subject columns of the case, those of the comparable.

    The engine's coefficients are taken once for each case and comparable, not for each pair. Of the
    comparables nothing is known in the columns `unknown`.
    """
    c = columns_of_usable()
    known = sum((c[n].isNotNull().cast("int") for n in ("condition", "orientation", "age_years", "floor_number")), F.lit(0)) / 4
    cases = rows.where("l_orderkey % 20 = 0").select(
        c["listing_id"].alias("case_id"), c["area_id"].alias("area_id"), c["surface"].alias("c_surface"), c["rooms"].alias("c_rooms"),
        *[c[n].alias(f"subject_{n}") for n in SUBJECT_COLUMNS], F.lit(0).alias("subject_step"), known.alias("subject_complete"),
    )
    cases = cases.withColumn("subject_own", v.own_coefficients("subject_")).drop(*[f"subject_{n}" for n in SUBJECT_COLUMNS[2:]])
    few = rt.first_of_cells(rows.select("*", c["listing_id"].alias("ref_id"), *[c[n].alias(n) for n in ("area_id", "surface", "rooms")]), 25)
    pool = stored(few).select("ref_id", "area_id", "surface", "rooms", *[c[n].alias(n) for n in ("price", "currency", "days", "manual", *SUBJECT_COLUMNS[1:])])
    pool = pool.withColumns({n: F.lit(None).cast(pool.schema[n].dataType) for n in unknown}).withColumn("own", v.own_coefficients("")).drop(*SUBJECT_COLUMNS[2:])
    return rt.closest_by_surface(cases, pool, 25)


@R.query("WITH " + CANON_SQL + ", " + CASES_SQL + " SELECT case_id, ref_id, pos FROM top")
def comparable_topk(spark, sf_dir):
    return case_pairs(usable(spark, sf_dir)).select("case_id", "ref_id", "pos")


BACKTEST_SQL = "WITH " + CANON_SQL + ", " + CASES_SQL + ", " + engine_sql("top", "case_id") + ", " + valued_sql("case_id") + """,
pool AS (SELECT listing_id, area_id, unit FROM canon WHERE unit BETWEEN 300 AND 12000),
loo AS (SELECT a.listing_id AS case_id, CASE WHEN count(*) >= 5 THEN quantile_cont(b.unit, 0.5) END AS loo FROM cases a JOIN pool b ON a.area_id = b.area_id AND a.listing_id <> b.listing_id GROUP BY a.listing_id),
b AS (SELECT c.listing_id AS case_id, c.area_id, c.price AS case_price, coalesce(status, 'sin_comparables') AS status, confidence, value_mid AS est, value_low AS lo, value_high AS hi, loo * c.surface AS baseline FROM cases c LEFT JOIN valued ON valued.case_id = c.listing_id LEFT JOIN loo ON loo.case_id = c.listing_id)"""
METRICS_SQL = """count(*) AS cases, count(est) AS answered, round(count(est) / count(*), 4) AS coverage, round(quantile_cont(round(abs(est - case_price) / case_price, 6), 0.5), 4) AS mdape, round(avg(abs(est - case_price) / case_price), 4) AS mape,
round(avg(CASE WHEN est IS NOT NULL THEN (abs(est - case_price) / case_price < 0.1)::INT END), 4) AS ppe10, round(avg(CASE WHEN est IS NOT NULL THEN (abs(est - case_price) / case_price < 0.2)::INT END), 4) AS ppe20,
round(avg(CASE WHEN est IS NOT NULL THEN (case_price BETWEEN lo AND hi)::INT END), 4) AS hit_rate, round(quantile_cont(round((est - case_price) / case_price, 6), 0.5), 4) AS bias,
round(quantile_cont(CASE WHEN est IS NOT NULL THEN round(abs(baseline - case_price) / case_price, 6) END, 0.5), 4) AS baseline_mdape, round(avg(CASE WHEN est IS NOT NULL AND baseline IS NOT NULL THEN (abs(baseline - case_price) / case_price < 0.2)::INT END), 4) AS baseline_ppe20"""


def backtest(spark: SparkSession, sf_dir: str, unknown: tuple[str, ...] = ()) -> DataFrame:
    """Every case valued by the engine from its comparables, beside the leave-one-out median of its area.

    Of the comparables nothing is known in the columns `unknown`.
    """
    rows = usable(spark, sf_dir)
    valued = v.valued_few(v.adjusted(case_pairs(rows, unknown)), ["case_id"]).withColumnRenamed("case_id", "listing_id")
    c = columns_of_usable()
    shown = rows.select(*[c[n].alias(n) for n in ("listing_id", "order_id", "area_id", "surface", "price", "unit")])
    cases = ev.leave_one_out_median(shown, "area_id", "unit").where("order_id % 20 = 0")
    out = cases.join(valued, "listing_id", "left")
    return out.select(F.col("listing_id").alias("case_id"), "area_id", F.col("price").alias("case_price"), F.coalesce("status", F.lit("sin_comparables")).alias("status"), "confidence", F.col("value_mid").alias("est"), F.col("value_low").alias("lo"), F.col("value_high").alias("hi"), (F.col("loo") * F.col("surface")).alias("baseline"))


@R.query(BACKTEST_SQL + " SELECT case_id, status, est, lo, hi, round(baseline, 4) AS baseline FROM b")
def backtest_cases(spark, sf_dir):
    return backtest(spark, sf_dir).select("case_id", "status", "est", "lo", "hi", F.round("baseline", 4).alias("baseline"))


@R.query(BACKTEST_SQL + f" SELECT area_id, {METRICS_SQL} FROM b GROUP BY area_id HAVING count(*) >= 5")
def backtest_metrics(spark, sf_dir):
    return ev.error_metrics(backtest(spark, sf_dir), ["area_id"], "case_price", "est", "lo", "hi", "baseline").where("cases >= 5")


CALIBRATION_SQL = f"""cal AS (SELECT confidence, {METRICS_SQL} FROM b WHERE confidence IS NOT NULL GROUP BY confidence), overall AS (SELECT {METRICS_SQL} FROM b)"""


@R.query(BACKTEST_SQL + ", " + CALIBRATION_SQL + " SELECT * FROM cal")
def calibration_by_confidence(spark, sf_dir):
    return ev.error_metrics(backtest(spark, sf_dir).where("confidence is not null"), ["confidence"], "case_price", "est", "lo", "hi", "baseline")


@R.query(BACKTEST_SQL + ", " + CALIBRATION_SQL + """, l AS (SELECT max(mdape) FILTER (confidence = 'ALTA') AS a, max(mdape) FILTER (confidence = 'MEDIA') AS m, max(mdape) FILTER (confidence = 'BAJA') AS z FROM cal)
SELECT coalesce(mdape < baseline_mdape, false) AS beats_baseline, coalesce(mdape <= 0.15, false) AS mdape_ok, coalesce(ppe20 >= 0.65, false) AS ppe20_ok, coalesce(coverage >= 0.7, false) AS coverage_ok, coalesce(abs(bias) < 0.03, false) AS bias_ok,
coalesce(a <= m, true) AND coalesce(m <= z, true) AND coalesce(a <= z, true) AS calibrated FROM overall, l""")
def backtest_success(spark, sf_dir):
    """Is the baseline beaten, are the marks reached, does more confidence mean less error?"""
    cases = backtest(spark, sf_dir)
    whole = ev.error_metrics(cases, [], "case_price", "est", "lo", "hi", "baseline")
    return ev.success(whole, ev.error_metrics(cases.where("confidence is not null"), ["confidence"], "case_price", "est", "lo", "hi", "baseline"))


@R.query(BACKTEST_SQL.replace("SELECT * FROM near WHERE pos <= 25", "SELECT * REPLACE (NULL::VARCHAR AS condition, NULL::VARCHAR AS orientation, NULL::BOOLEAN AS has_elevator, NULL::INT AS floor_number) FROM near WHERE pos <= 25") + f" SELECT {METRICS_SQL} FROM b")
def backtest_without_features(spark, sf_dir):
    """The second run of a pair: the same cases and comparables, of which nothing is known that was read from texts."""
    cases = backtest(spark, sf_dir, ("condition", "orientation", "has_elevator", "floor_number"))
    return ev.error_metrics(cases, [], "case_price", "est", "lo", "hi", "baseline")


@R.query("WITH " + CANON_SQL + " SELECT listing_id, concat_ws(',', CASE WHEN condition IS NULL THEN 'condition' END, CASE WHEN age_years IS NULL THEN 'age_years' END, CASE WHEN orientation IS NULL THEN 'orientation' END, CASE WHEN has_elevator IS NULL THEN 'has_elevator' END) AS missing FROM canon WHERE (order_id % 5 = 0 OR source = 's1') AND contains(lower(address), 'calle 1')")
def explorer_missing_fields(spark, sf_dir):
    rows = canon(spark, sf_dir).where(((F.col("order_id") % 5 == 0) | (F.col("source") == "s1")) & F.col("address").ilike("%calle 1%"))
    return rows.select("listing_id", rules.missing_fields(["condition", "age_years", "orientation", "has_elevator"]).alias("missing"))


@R.query("WITH " + CANON_SQL + """ SELECT 'surface_positive' AS rule, count(*) FILTER (NOT surface > 10) AS n FROM canon UNION ALL SELECT 'rooms_range', count(*) FILTER (NOT rooms BETWEEN 1 AND 4) FROM canon
UNION ALL SELECT 'currency_known', count(*) FILTER (NOT currency IN ('USD', 'ARS')) FROM canon UNION ALL SELECT 'seen_after_published', count(*) FILTER (NOT last_seen >= published) FROM canon""")
def constraint_violations(spark, sf_dir):
    return rules.violations(canon(spark, sf_dir), {"surface_positive": F.col("surface") > 10, "rooms_range": F.col("rooms").between(1, 4), "currency_known": F.col("currency").isin("USD", "ARS"), "seen_after_published": F.col("last_seen") >= F.col("published")})


@R.query("SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 0) ORDER BY ts DESC, event_id DESC LIMIT 26")
def keyset_page(spark, sf_dir):
    return rt.page(table(spark, sf_dir, "events"), "ts", "event_id", 25, ("2024-01-20 00:00:00", 0)).select("event_id", "ts")


@R.query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_clusters_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@R.query("SELECT c_nationkey AS area_id, count(*) AS n, sum(c_acctbal) AS balance FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c_nationkey")
def semi_join_scope(spark, sf_dir):
    scope = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    return table(spark, sf_dir, "customer").join(scope, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").groupBy(F.col("c_nationkey").alias("area_id")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@R.query("WITH " + CANON_SQL + " SELECT area_id, n FROM (SELECT area_id, count(*) AS n FROM canon WHERE active GROUP BY area_id) ORDER BY n DESC, area_id LIMIT 3")
def top_areas_by_actives(spark, sf_dir):
    return canon(spark, sf_dir).where("active").groupBy("area_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area_id").limit(3)


@R.query("WITH " + CANON_SQL + ", " + CASES_SQL + ", " + engine_sql("top", "case_id") + " SELECT case_id, ref_id, reason IS NULL AS included, row_number() OVER (PARTITION BY case_id ORDER BY reason IS NOT NULL, adj_m2 NULLS LAST, ref_id) AS place FROM trim")
def ranked_comparable_table(spark, sf_dir):
    """A report's table: what counts first, by adjusted price; prices that are not known come last."""
    rows = v.trimmed(v.adjusted(case_pairs(usable(spark, sf_dir))).select("case_id", "ref_id", "reason", "adj_m2").repartition("case_id"), ["case_id"])
    place = F.row_number().over(W.partitionBy("case_id").orderBy(F.col("reason").isNotNull(), F.asc_nulls_last("adj_m2"), "ref_id"))
    return rows.select("case_id", "ref_id", F.col("reason").isNull().alias("included"), place.alias("place"))


@R.query("""SELECT user_id, event_type, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_run, count(*) AS runs, round(coalesce(sum(value), 0), 2) AS cost, round(coalesce(sum(value) FILTER (date_trunc('month', ts) = DATE '2024-01-01'), 0), 2) AS month_cost FROM events GROUP BY ALL""")
def source_health_and_cost(spark, sf_dir):
    return mk.source_health(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", "event_id", F.lit("2024-01-20").cast("date"))


@R.query("""SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 2 AS limited FROM events""")
def sliding_window_limiter(spark, sf_dir):
    """More than two events of a user within the hour up to each one."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return e.select("user_id", "event_id", "ts", (F.count("*").over(w) > 2).alias("limited"))


STATUS_SQL = "CASE event_id % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'SUCCEEDED' ELSE 'FAILED' END"


@R.query(f"SELECT event_id, CASE WHEN {STATUS_SQL} IN ('RUNNING', 'QUEUED') AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR THEN 'FAILED' ELSE {STATUS_SQL} END AS status, CASE WHEN {STATUS_SQL} IN ('RUNNING', 'QUEUED') AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR THEN 'ABANDONADO' END AS error FROM events")
def stuck_reports(spark, sf_dir):
    """Events in the role of reports; what runs or waits for over an hour has been given up."""
    n = F.col("event_id") % 4
    status = F.when(n == 0, "RUNNING").when(n == 1, "QUEUED").when(n == 2, "SUCCEEDED").otherwise("FAILED")
    gone = rules.abandoned(F.col("status"), F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    e = table(spark, sf_dir, "events").withColumn("status", status)
    return e.select("event_id", F.when(gone, "FAILED").otherwise(F.col("status")).alias("status"), F.when(gone, "ABANDONADO").alias("error"))


EXPLORED_SQL = CANON_SQL + """, seen AS (SELECT canon.*, CASE order_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'mine' ELSE 'other' END AS org_id, kind AS description, CASE WHEN rooms IS NOT NULL THEN 'v1' END AS features_version, order_id % 7 = 0 AS needs_review FROM canon)"""


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("order_id")
    return canon(spark, sf_dir).withColumns({"org_id": F.when(o % 3 == 1, "mine").when(o % 3 == 2, "other"), "description": F.col("kind"), "features_version": F.when(F.col("rooms").isNotNull(), "v1"), "needs_review": o % 7 == 0})


@R.query("WITH " + EXPLORED_SQL + " SELECT listing_id FROM seen WHERE (org_id IS NULL OR org_id = 'mine') AND source = 's1' AND (contains(lower(address), 'promo') OR contains(lower(description), 'promo')) AND features_version IS NULL UNION ALL SELECT listing_id FROM seen WHERE (org_id IS NULL OR org_id = 'mine') AND area_id = 3 AND needs_review")
def explorer_filters(spark, sf_dir):
    rows = explored(spark, sf_dir)
    return rules.explorer(rows, "mine", source="s1", text="promo", without_features=True).select("listing_id").unionByName(rules.explorer(rows, "mine", area=3, needs_review=True).select("listing_id"))


@R.query("WITH " + EXPLORED_SQL + " SELECT listing_id FROM seen WHERE active AND operation = 'SALE' AND trim(description) <> '' AND (canonical_id IS NULL OR canonical_id = listing_id) AND coalesce(features_version, '') <> 'v1'")
def extraction_backlog(spark, sf_dir):
    rows = explored(spark, sf_dir)
    features = rows.where("features_version is not null").select("listing_id", F.col("features_version").alias("extractor_version"))
    return rules.backlog(rows, features, "v1").select("listing_id")


REPORTS_SQL = """SELECT o_orderkey AS report_id, o_orderdate AS created_at, o_custkey AS subject_id, c_nationkey AS area_id, n_name AS area FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 8 <> 0"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the role of reports, customers in that of subjects: inner, then left to the areas with a centre."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("status"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("area_id"))
    n = areas(spark, sf_dir).where("lat is not null").select("area_id", F.col("n_name").alias("area"))
    return o.join(c, "subject_id").join(n, "area_id", "left")


@R.query(REPORTS_SQL + " WHERE o_orderstatus = 'O' AND o_custkey % 10 = 3")
def report_list(spark, sf_dir):
    """A tenant's reports of one status with subject and area."""
    return reports(spark, sf_dir).where("status = 'O' and subject_id % 10 = 3").select("report_id", "created_at", "subject_id", "area_id", "area")


@R.query("WITH " + CANON_SQL + f", r AS ({REPORTS_SQL}) SELECT report_id, listing_id, source, area FROM r JOIN canon ON order_id = report_id WHERE subject_id % 10 = 3")
def report_comparables(spark, sf_dir):
    """Comparables with their listings, of the tenant's own reports only."""
    own = reports(spark, sf_dir).where("subject_id % 10 = 3").select("report_id", "area")
    return own.join(canon(spark, sf_dir).select("listing_id", "source", F.col("order_id").alias("report_id")), "report_id").select("report_id", "listing_id", "source", "area")


@R.query("WITH " + CANON_SQL + """, f AS (SELECT listing_id, condition, orientation FROM canon WHERE order_id % 3 = 0), c AS (SELECT DISTINCT order_id AS cluster_id, min(listing_id) AS canonical FROM canon WHERE order_id % 4 = 0 GROUP BY order_id)
SELECT l.listing_id, f.condition, f.orientation, c.canonical IS NULL OR c.canonical = l.listing_id AS eligible, n_name AS area FROM canon l LEFT JOIN f USING (listing_id) LEFT JOIN c ON c.cluster_id = l.order_id LEFT JOIN nation ON n_nationkey = l.area_id AND n_nationkey % 8 <> 0""")
def listings_with_features_and_cluster(spark, sf_dir):
    """Listings, each kept whether or not it has features, a cluster or a named area."""
    rows = canon(spark, sf_dir)
    features = rows.where("order_id % 3 = 0").select("listing_id", "condition", "orientation")
    clusters = rows.where("order_id % 4 = 0").groupBy("order_id").agg(F.min("listing_id").alias("canonical"))
    named = areas(spark, sf_dir).where("lat is not null").select("area_id", F.col("n_name").alias("area"))
    eligible = F.col("canonical").isNull() | (F.col("canonical") == F.col("listing_id"))
    return rows.select("listing_id", "order_id", "area_id").join(features, "listing_id", "left").join(clusters, "order_id", "left").join(named, "area_id", "left").select("listing_id", "condition", "orientation", eligible.alias("eligible"), "area")


@R.query("SELECT s_nationkey AS area_id, count(*) AS snapshots, count(DISTINCT l_suppkey) AS listings, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey")
def snapshots_by_area(spark, sf_dir):
    """Price snapshots joined to their listings."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    rows = li.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("area_id")), "s_suppkey")
    return rows.groupBy("area_id").agg(F.count("*").alias("snapshots"), F.count_distinct("s_suppkey").alias("listings"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


QUERIES, ORACLES = R.queries, R.oracles
