"""The driver's tables in the shape of listings, areas and price histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that the queries take as today; no operator reads the clock.
AS_OF = "2001-11-05"
AMENITIES_HELD = ["Pileta", "gimnasio", "SUM", "seguridad"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what their listings are made of. Orders come first: what listings are filtered by is known
    after them, so a filter leaves fewer rows to the joins with parts and suppliers."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    df = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    return df.join(supplier, li.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for each line item; recodes put nulls where the engine's rules need them."""
    return joined(spark, sf_dir).select(*[c.alias(n) for n, c in made().items()])


def made() -> dict[str, Column]:
    """The columns of a listing, of rows of joined()."""
    code = lambda c, names: F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))
    cents = F.round(F.col("l_extendedprice") * 100, 0).cast("long").cast("string")
    return {
        "listing_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), cents),
        "order_id": F.col("l_orderkey"),
        "area_id": F.col("s_nationkey"),
        "region_id": F.col("n_regionkey"),
        "source": F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")),
        "price": F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") == 0), None).otherwise(F.col("l_extendedprice")),
        "currency": F.when(F.col("o_orderpriority").startswith("5"), "ARS").otherwise("USD"),
        "surface": F.when(F.col("l_tax") == 0.08, None).otherwise(F.col("l_quantity")),
        "rooms": F.when(F.col("p_size") % 11 == 0, None).otherwise(F.col("p_size") % 6).cast("int"),
        "condition": code(F.col("p_size") % 6, [None, "a_estrenar", "excelente", "muy_bueno", "bueno", "a_refaccionar"]),
        "age_years": F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_partkey") % 70).cast("int"),
        "orientation": code(F.col("l_suppkey") % 5, ["frente", "lateral", "contrafrente", "interno", None]),
        "floor_number": (F.col("l_partkey") % 12).cast("int"),
        "has_elevator": F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False),
        "amenities": F.slice(F.array(*[F.lit(a) for a in AMENITIES_HELD]), F.lit(1), (F.col("l_partkey") % 5).cast("int")),
        "parking": F.when(F.col("l_linenumber") >= 6, 1).otherwise(0),
        "days": F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 13 == 0, None).otherwise((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 240).cast("int"),
        "last_seen": F.col("l_shipdate").cast("date"),
        "published": F.col("o_orderdate").cast("date"),
        "manual": (F.col("l_returnflag") == "R"),
        "active": (F.col("l_linestatus") == "O"),
        "kind": F.col("p_type"),
        "operation": F.when(F.col("l_linenumber") == 5, "RENT").otherwise("SALE"),
        "price_on_request": (F.col("l_quantity") == 13),
        "quality_flags": F.array_compact(F.array(F.when(F.col("l_tax") == 0.08, "surface_total_only"), F.when(F.col("p_size") % 6 != 0, "ficha_completa"))),
    }


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas on a grid of about 2 km; those divisible by 8 have no known centre."""
    n = F.col("n_nationkey")
    known = n % 8 != 0
    return table(spark, sf_dir, "nation").select(n.alias("area_id"), "n_name", F.when(known, -34.60 + (n % 5) * 0.02).alias("lat"), F.when(known, -58.40 + F.floor(n / 5) * 0.022).alias("lng"))


LISTINGS_SQL = """listings AS (
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100, 0) AS BIGINT)) AS listing_id,
  l_orderkey AS order_id, s_nationkey AS area_id, n_regionkey AS region_id, 's' || (l_suppkey % 4) AS source,
  CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'ARS' ELSE 'USD' END AS currency,
  CASE WHEN l_tax = 0.08::DOUBLE THEN NULL ELSE l_quantity END AS surface,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 6 END AS rooms,
  CASE p_size % 6 WHEN 1 THEN 'a_estrenar' WHEN 2 THEN 'excelente' WHEN 3 THEN 'muy_bueno' WHEN 4 THEN 'bueno' WHEN 5 THEN 'a_refaccionar' END AS condition,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 70 END AS age_years,
  CASE l_suppkey % 5 WHEN 0 THEN 'frente' WHEN 1 THEN 'lateral' WHEN 2 THEN 'contrafrente' WHEN 3 THEN 'interno' END AS orientation,
  l_partkey % 12 AS floor_number,
  CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_elevator,
  list_slice(['Pileta', 'gimnasio', 'SUM', 'seguridad'], 1, CAST(l_partkey % 5 AS INT)) AS amenities,
  CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END AS parking,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 = 0 THEN NULL ELSE (l_orderkey * 7 + l_linenumber) % 240 END AS days,
  CAST(l_shipdate AS DATE) AS last_seen, CAST(o_orderdate AS DATE) AS published,
  l_returnflag = 'R' AS manual, l_linestatus = 'O' AS active, p_type AS kind,
  CASE WHEN l_linenumber = 5 THEN 'RENT' ELSE 'SALE' END AS operation, l_quantity = 13 AS price_on_request,
  list_filter([CASE WHEN l_tax = 0.08::DOUBLE THEN 'surface_total_only' END, CASE WHEN p_size % 6 <> 0 THEN 'ficha_completa' END], lambda f: f IS NOT NULL) AS quality_flags
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey)"""

AREAS_SQL = """areas AS (SELECT n_nationkey AS area_id, n_name, CASE WHEN n_nationkey % 8 <> 0 THEN -34.60::DOUBLE + (n_nationkey % 5) * 0.02::DOUBLE END AS lat, CASE WHEN n_nationkey % 8 <> 0 THEN -58.40::DOUBLE + (n_nationkey // 5) * 0.022::DOUBLE END AS lng FROM nation)"""
