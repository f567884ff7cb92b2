"""Listing feeds: discovery, all-string reading of CSV, JSON and JSONL, sniffing, parsing, routing.

Paths are listed and read by Spark, so any file system that the cluster has will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.config import DEFAULT, Config
from plumbline.functions.text import fold, key
from plumbline.operators.changes import chunk_ids, content_hash, first_in_batch
from plumbline.operators.rules import ingest_discard

#: File formats from the preferred on, columns that make a file a listing file.
FORMATS = ["csv", "jsonl", "json"]
REQUIRED, ONE_OF = ["portal_property_id"], ["url", "canonical_url"]
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd"]
#: The sources of portals, the words for condition and orientation, and what the side-car calls an attribute.
PORTALS = {"mercadolibre": "MELI", "meli": "MELI", "properati": "PROPERATI"}
CONDITIONS = {"a estrenar": "a_estrenar", "estrenar": "a_estrenar", "excelente": "excelente", "muy bueno": "muy_bueno", "bueno": "bueno", "a refaccionar": "a_refaccionar", "a reciclar": "a_refaccionar", "refaccionar": "a_refaccionar"}
ORIENTATIONS = ["frente", "contrafrente", "lateral", "interno"]
SIDECAR = {
    "surface_total": "surface_total", "surface_covered": "surface_covered", "surface_semi": "surface_semi", "surface_uncovered": "surface_uncovered", "rooms": "rooms", "bedrooms": "bedrooms", "bathrooms": "bathrooms",
    "parking": "parking_spaces", "age_years": "age_years", "orientation": "orientation", "condition": "condition", "expenses_ars": "expenses_ars", "publisher": "publisher", "surface": "surface_weighted",
}
#: What makes a listing another one when it changes.
HASHED = ["source_id", "price", "currency", "surface", "rooms", "bedrooms", "bathrooms", "parking", "age_years", "orientation", "condition", "expenses_ars", "address", "published"]
#: The words of an external inventory.
KINDS = {k: k for k in ("departamento", "casa", "ph", "local", "oficina", "cochera", "terreno", "galpon")} | {"depto": "departamento"}
OPERATIONS = {"sale": "SALE", "venta": "SALE", "rent": "RENT", "alquiler": "RENT"}
#: First months of the quarters, words of the open-data index.
QUARTERS = {"PRIMERO": 1, "SEGUNDO": 4, "TERCERO": 7, "CUARTO": 10}
CARD = [
    "portal", "portal_property_id", "url", "canonical_url", "title", "description", "publisher_name", "price", "currency", "expenses", "expenses_currency", "address", "neighborhood", "covered_area", "semi_covered_area", "total_area",
    "rooms", "bedrooms", "bathrooms", "age", "condition", "orientation", "floor", "amenities", "parking_count", "publication_date", "detail_fetched", "raw_data",
]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, stem, format, digest of the files to ingest: the preferred format of each stem in a folder, no `_failures`.

    A file's content is hashed as one value, so files of up to 2 GB can be ingested."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(name, r"^(.*)\.([^.]+)$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("format"), F.sha2("content", 256).alias("digest"))
    files = files.where(F.col("format").isin(FORMATS) & ~F.col("stem").contains("_failures"))
    rank = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    return files.withColumn("n", F.row_number().over(W.partitionBy("folder", "stem").orderBy(rank, "path"))).where("n = 1").drop("n")


def unseen(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose content no run with status OK or PARTIAL has had."""
    return files.join(log.where(F.col("status").isin("OK", "PARTIAL")), "digest", "left_anti")


def read_rows(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """All-string rows with file name and line order; nested values as JSON text, nulls as empty strings."""
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("escape", '"').csv(paths)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    else:
        df = spark.read.option("multiLine", kind == "json").option("primitivesAsString", True).option("mode", "PERMISSIVE").json(paths)
    nested = (T.StructType, T.ArrayType, T.MapType)
    text = [F.coalesce(F.to_json(c) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields for c in [f"`{f.name}`"]]
    return df.select(*text, F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__line"))


def is_listing_file(columns: list[str]) -> bool:
    return all(c in columns for c in REQUIRED) and any(c in columns for c in ONE_OF)


def decimal(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def comma_decimal(text: Column) -> Column:
    return decimal(F.replace(text, F.lit(","), F.lit(".")))


def whole(text: Column) -> Column:
    """Cut off, junk and empty are null."""
    return decimal(text).try_cast("int")


def truth(text: Column) -> Column:
    """true, 1, si, yes and false, 0, no in any case; anything else is null."""
    t = F.lower(F.trim(fold(text)))
    return F.when(t.isin("true", "1", "si", "yes"), True).when(t.isin("false", "0", "no"), False)


def word(text: Column, words: list[str]) -> Column:
    """The word in lower case if it is one of the vocabulary's, else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(words), t)


def date(text: Column, as_of: Column) -> Column:
    """Three formats on the first ten characters; days after as_of are null."""
    tried = F.coalesce(*[F.try_to_timestamp(F.substring(text, 1, 10), F.lit(f)).cast("date") for f in DATE_FORMATS])
    return F.when(tried <= as_of, tried)


def weighted_surface(covered: Column, semi: Column, uncovered: Column, total: Column) -> Column:
    """Covered and half of the rest; without parts the rest is total - covered; no covered: the total."""
    rest = F.coalesce(semi, F.lit(0.0)) + F.coalesce(uncovered, F.lit(0.0))
    rest = F.when((rest == 0) & (total > covered), total - covered).otherwise(rest)
    return F.when(covered > 0, covered + rest / 2).otherwise(total)


def portal_of(portal: Column, file: Column, portals: dict[str, str] = PORTALS) -> Column:
    """The source of a portal's name, else of the beginning of the file's name, else null."""
    by_name = mapped(portal, portals)
    name = F.lower(F.regexp_extract(file, r"([^/]*)$", 1))
    out = by_name
    for prefix, source in portals.items():
        out = F.coalesce(out, F.when(name.startswith(prefix), source))
    return out


def cards(rows: DataFrame, as_of: str, portals: dict[str, str] = PORTALS) -> DataFrame:
    """Typed listings; of rows with one key in the batch the first.

    Rows without an id or url are dropped. `condition` holds two vocabularies: what is a
    condition goes there, what is an orientation goes there, the rest nowhere. Expenses count in
    pesos only. Rows of no known portal have source `unknown`.
    """
    have = {c: F.col(c) if c in rows.columns else F.lit("") for c in CARD}
    text = lambda c: F.nullif(F.trim(have[c]), F.lit(""))
    covered, semi, total = (decimal(have[c]) for c in ("covered_area", "semi_covered_area", "total_area"))
    known = F.array(*[F.lit(o) for o in ORIENTATIONS])
    orientation = F.coalesce(*[F.when(F.array_contains(known, F.lower(text(c))), F.lower(text(c))) for c in ("condition", "orientation")])
    only_total = covered.isNull() & total.isNotNull()
    detailed = F.coalesce(F.lower(text("detail_fetched")) == "true", F.lit(False))
    out = rows.select(
        F.coalesce(portal_of(have["portal"], F.col("__file"), portals), F.lit("unknown")).alias("source"),
        F.trim(have["portal_property_id"]).alias("source_id"),
        F.coalesce(text("canonical_url"), text("url")).alias("url"),
        *[text(c).alias(n) for c, n in (("title", "title"), ("description", "description"), ("publisher_name", "publisher"), ("neighborhood", "area_label"), ("floor", "floor"), ("amenities", "amenities"))],
        decimal(have["price"]).alias("price"),
        F.upper(F.trim(have["currency"])).alias("currency"),
        F.when(F.upper(text("expenses_currency")) == "ARS", decimal(have["expenses"])).alias("expenses_ars"),
        text("address").alias("address"),
        covered.alias("surface_covered"), semi.alias("surface_semi"), total.alias("surface_total"),
        weighted_surface(covered, semi, F.lit(None).cast("double"), total).alias("surface"),
        only_total.alias("only_total_surface"),
        whole(have["rooms"]).alias("rooms"), whole(have["bedrooms"]).alias("bedrooms"), whole(have["bathrooms"]).alias("bathrooms"), whole(have["age"]).alias("age_years"),
        F.coalesce(whole(have["parking_count"]), F.lit(0)).alias("parking"),
        mapped(have["condition"], CONDITIONS).alias("condition"),
        orientation.alias("orientation"),
        date(have["publication_date"], F.lit(as_of).cast("date")).alias("published"),
        F.array_compact(F.array(F.when(only_total, "surface_total_only"), F.when(detailed, "ficha_completa"))).alias("quality_flags"),
        F.when(F.try_parse_json(have["raw_data"]).isNotNull(), have["raw_data"]).otherwise(F.when(text("raw_data").isNotNull(), F.to_json(F.struct(F.substring(have["raw_data"], 1, 500).alias("raw_data_no_parseable"))))).alias("raw_data"),
        "__file",
        "__line",
    ).where((F.col("source_id") != "") & F.col("url").isNotNull())
    out = first_in_batch(out, ["source", "source_id"], [F.col("__file"), F.col("__line")])
    return out.withColumn("content_hash", content_hash(HASHED)).withColumn("raw", sidecar({c: to for c, to in SIDECAR.items() if c in out.columns}))


def sidecar(names: dict[str, str]) -> Column:
    """A map of the known attributes as text under the names of the contract; unknown ones are left out."""
    pairs = [F.struct(F.lit(to).alias("k"), F.col(c).cast("string").alias("v")) for c, to in names.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()))


def scan(spark: SparkSession, files: list[tuple[str, str]], as_of: str) -> tuple[DataFrame | None, list[dict]]:
    """Cards of all files and a row for each file: path, status (OK, FOREIGN, ERROR), error. files: (path, format).

    A file that cannot be read or is no listing file does not stop the others. Only its header
    or first records are read here; the rows are read by Spark with the result.
    """
    rows, log = None, []
    for path, kind in files:
        try:
            raw = read_rows(spark, [path], kind)
            if not is_listing_file(raw.columns):
                log.append({"path": path, "status": "FOREIGN", "error": None})
                continue
        except (AnalysisException, PySparkException) as e:
            log.append({"path": path, "status": "ERROR", "error": str(e).splitlines()[0]})
            continue
        rows = raw if rows is None else rows.unionByName(raw, allowMissingColumns=True)
        log.append({"path": path, "status": "OK", "error": None})
    if rows is None:
        return None, log
    text = [c for c in rows.columns if not c.startswith("__")]
    return cards(rows.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text}), as_of), log


def route(listings: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Accepted listings, and the number of rows for each reason and file."""
    marked = listings.withColumn("reason", ingest_discard(cfg))
    return marked.where("reason is null").drop("reason"), marked.groupBy("__file", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def price_index(spark: SparkSession, path: str, areas: DataFrame) -> DataFrame:
    """Open-data index: `;` separated, no null or non-positive price, known areas only, quarter to month, rooms from text,
    group `todos` by default. areas: key, id (lookup.alias_index())."""
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    quarter = whole(F.col("trimestre"))
    rooms = F.nullif(F.regexp_extract(F.coalesce("ambientes", F.lit("")), "^([0-9]+)", 1), F.lit("")).cast("int")
    out = df.select(key(F.col("barrio")).alias("key"), F.when(quarter.between(1, 4), F.make_date(whole(F.col("año")), quarter * 3 - 2, F.lit(1))).alias("period"), rooms.alias("rooms"), F.coalesce(F.nullif(F.lower(F.trim("estado")), F.lit("")), F.lit("todos")).alias("condition_group"), comma_decimal(F.col("precio_prom")).alias("usd_m2"))
    out = out.where((F.col("usd_m2") > 0) & F.col("period").isNotNull())
    return out.join(areas, "key").select(F.col("id").alias("area_id"), "period", "rooms", "condition_group", "usd_m2")


def historical(spark: SparkSession, path: str, year: int, areas: DataFrame) -> DataFrame:
    """Open-data sales of a year: comma decimals, own plausible range, known areas only, rooms 1 to 20, first month of the
    quarter, an id made of the year and content, first row of an id, not active. areas: key, id."""
    df = spark.read.option("header", True).csv(path).withColumn("__line", F.monotonically_increasing_id())
    size, total, unit = (comma_decimal(F.col(c)) for c in ("PropiedadS", "Dolares", "DolaresM2"))
    rooms = whole(F.replace(F.col("Ambientes"), F.lit(","), F.lit(".")))
    quarters = F.create_map(*[F.lit(x) for pair in QUARTERS.items() for x in pair])
    month = F.coalesce(F.element_at(quarters, F.upper(F.trim("Trimestre"))), F.lit(1))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("Direccion", "PropiedadS", "Dolares", "Trimestre", "Barrio")]
    out = df.where(size.between(15, 1000) & (total != 0) & (unit.isNull() | (unit == 0) | unit.between(200, 20000))).select(
        F.concat(F.lit(f"{year}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)).alias("source_id"),
        F.nullif(F.trim("Direccion"), F.lit("")).alias("address"), key(F.col("Barrio")).alias("key"), size.alias("surface"), total.alias("price"), F.when(rooms.between(1, 20), rooms).alias("rooms"),
        F.make_date(F.lit(year), month, F.lit(1)).alias("published"), F.lit(False).alias("active"), "__line",
    )
    out = out.join(areas, "key").drop("key").withColumnRenamed("id", "area_id")
    return out.withColumn("n", F.row_number().over(W.partitionBy("source_id").orderBy("__line"))).where("n = 1").drop("n", "__line")


def inventory(rows: DataFrame) -> DataFrame:
    """Rows of an external inventory in the engine's words; rows without an id are dropped, unknown words are null."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    currency = F.upper(text("currency"))
    out = rows.select(
        text("source_id").alias("source_id"), text("address_raw").alias("address"), text("neighborhood_label").alias("area_label"), mapped(F.col("property_type"), KINDS).alias("kind"), mapped(F.col("operation"), OPERATIONS).alias("operation"),
        whole(text("rooms")).alias("rooms"), decimal(text("surface_total")).alias("surface_total"), decimal(text("surface_covered")).alias("surface_covered"), decimal(text("price")).alias("price"), F.when(currency.isin("USD", "ARS"), currency).alias("currency"), F.col("published").cast("boolean").alias("published"),
    )
    return out.where("source_id is not null")


def write_reports(df: DataFrame, path: str, key: str = "report_id") -> None:
    """Replace the partitions of the reports in df, leave the others; for comparables, events and artifacts alike."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_pair(listings: DataFrame, features: DataFrame, keys: list[str], path: str) -> None:
    """Append listings and their features under one id each, made from the key: written again, the ids are the same."""
    for name, rows in (("listings", listings), ("features", features)):
        chunk_ids(rows, keys, "listing_id").write.mode("append").parquet(f"{path}/{name}")


def stored_judgements(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """The judgements of one query from a store that is partitioned by it; None before the first."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows.where(F.col("query") == query)


def new_index_rows(index: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows whose key is absent; unknown parts of a key are equal to each other."""
    other = have.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return index.join(other, same, "left_anti")


def external(spark: SparkSession, url: str, relation: str, **options: str) -> DataFrame:
    """A view of an external database; partition it with partitionColumn, lowerBound, upperBound, numPartitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=relation, **options).load()


def mapped(value: Column, vocabulary: dict[str, str]) -> Column:
    """The vocabulary's word for a folded lower-case value, null for any other."""
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    return F.element_at(table, F.lower(F.trim(fold(value))))


def golden(rows: DataFrame) -> DataFrame:
    """Reviewed cases (absent means reviewed), stratum `azar` by default."""
    return rows.where(F.coalesce(F.col("revisado"), F.lit(True))).withColumn("estrato", F.coalesce("estrato", F.lit("azar")))
