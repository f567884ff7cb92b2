"""Ordered rules: the first that applies is the reason. Also constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.config import DEFAULT, Config
from plumbline.functions.text import address_key


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, applies in reversed(rules):
        out = F.when(F.coalesce(applies, F.lit(False)), name).otherwise(out)
    return out


def ingest_discard(cfg: Config = DEFAULT) -> Column:
    """At the entrance, in the order of the contract."""
    unit = F.try_divide(F.col("price"), F.nullif(F.col("surface"), F.lit(0.0)))
    return first_reason([
        ("sin_precio", F.col("price").isNull()),
        ("precio_no_usd", F.col("currency") != "USD"),
        ("sin_superficie", F.col("surface").isNull()),
        ("superficie_implausible", ~F.col("surface").between(*cfg.surface)),
        ("sin_direccion", F.col("address").isNull() | (F.trim("address") == "")),
        ("usd_m2_fuera_de_rango", ~unit.between(*cfg.unit_price)),
    ])


def curation(subject_address: Column, cfg: Config = DEFAULT) -> Column:
    """Before anything is paid for: null or zero prices first, unknown days pass."""
    unit = F.try_divide(F.col("price"), F.nullif(F.col("surface"), F.lit(0.0)))
    return first_reason([
        ("sin_precio", F.col("price").isNull() | (F.col("price") == 0)),
        ("precio_en_ars", F.col("currency") == "ARS"),
        ("sin_superficie", F.col("surface").isNull() | (F.col("surface") < cfg.surface[0])),
        ("usd_m2_fuera_de_rango", ~unit.between(*cfg.unit_price)),
        ("aviso_vencido", F.col("days") > cfg.most_days),
        ("auto_referencia", (address_key(F.col("address")) != "") & (address_key(F.col("address")) == address_key(subject_address))),
        ("duplicado_de_cluster", F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("listing_id"))),
    ])


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and n: rows for which a rule is false (unknown is no violation), every rule with a row."""
    counted = rows.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules]
    return counted.select(F.explode(F.array(*pairs)).alias("x")).select("x.rule", "x.n")


def missing_fields(columns: list[str]) -> Column:
    """Names of the null columns, in order, joined by a comma."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])), ",")



def abandoned(status: Column, since: Column, as_of: Column, hours: int = 1) -> Column:
    """RUNNING or QUEUED for longer than the hours: FAILED, because nobody works on it any more."""
    return status.isin("RUNNING", "QUEUED") & (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(since.cast("timestamp")) > hours * 3600)


def backlog(listings: DataFrame, features: DataFrame, version: str | None = None) -> DataFrame:
    """Active sales with a description, canonical or not clustered, that have no features (of the version, if one is named)."""
    have = features if version is None else features.where(F.col("extractor_version") == version)
    rows = listings.where(F.col("active") & (F.col("operation") == "SALE") & (F.coalesce(F.trim("description"), F.lit("")) != "") & (F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("listing_id"))))
    return rows.join(have.select("listing_id"), "listing_id", "left_anti")


def explorer(rows: DataFrame, org: str, area: int | None = None, source: str | None = None, text: str | None = None, without_features: bool = False, needs_review: bool = False) -> DataFrame:
    """Listings that an organisation may see (public or its own), by the filters that are given."""
    rows = rows.where(F.col("org_id").isNull() | (F.col("org_id") == org))
    if area is not None:
        rows = rows.where(F.col("area_id") == area)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if text is not None:
        rows = rows.where(F.col("address").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%"))
    if without_features:
        rows = rows.where(F.col("features_version").isNull())
    return rows.where(F.col("needs_review")) if needs_review else rows
