"""Label and place lookups as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geo import haversine, within
from plumbline.functions.text import key


def alias_index(*sources: DataFrame) -> DataFrame:
    """sources(name, id), the most authoritative first; a key keeps its first source's smallest id."""
    named = [s.select(key(F.col("name")).alias("key"), F.lit(i).alias("priority"), F.col("id").alias("id")) for i, s in enumerate(sources)]
    all_names = named[0]
    for n in named[1:]:
        all_names = all_names.unionByName(n)
    return all_names.where("key <> ''").groupBy("key").agg(F.min(F.struct("priority", "id")).alias("x")).select("key", "x.id")


def cascade(rows: DataFrame, row_id: str, label: str, index: DataFrame, suffixes: bool = False) -> DataFrame:
    """row_id, id: the whole label, then its comma parts from last to first; rows that match nothing are left out.

    With suffixes, each part is followed by its ends word by word, from the longest to the shortest.
    """
    parts = F.reverse(F.transform(F.split(F.col(label), ","), lambda p: F.trim(p)))
    if suffixes:
        split = lambda p: F.split(p, r"\s+")
        ends = lambda p: F.transform(F.sequence(F.lit(1), F.size(split(p))), lambda i: F.array_join(F.slice(split(p), i, F.size(split(p))), " "))
        parts = F.flatten(F.transform(parts, ends))
    tries = F.concat(F.array(F.col(label)), parts)
    t = rows.select(row_id, F.posexplode(tries).alias("place", "name")).select(row_id, "place", key(F.col("name")).alias("key"))
    return t.join(index, "key").groupBy(row_id).agg(F.min(F.struct("place", "id")).alias("x")).select(row_id, "x.id")


def nearest(points: DataFrame, point: str, places: DataFrame, place: str, metres: int) -> DataFrame:
    """point, place, metres: the closest place within reach, of equals the smallest.

    Both sides carry lat and lng. The globe is cut into bands of latitude as high as the reach
    and those into cells that are at least as wide as the reach on the band's narrow side, so a
    place meets the points of nine cells, across 180 degrees too; a band at a pole is one cell.
    """
    high = metres / 111_000.0
    band = lambda lat: F.floor((lat + 90) / high)
    edge = lambda b: F.least(F.greatest(F.abs(b * high - 90), F.abs((b + 1) * high - 90)), F.lit(90.0))
    # Cells of a band around the globe: none is narrower than the reach at the band's far side.
    count = lambda b: F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge(b))) / high)).cast("long")
    column = lambda lng, n: F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360.0 * n).cast("long")
    p = points.select(point, "lat", "lng").withColumn("lat_cell", band(F.col("lat"))).withColumn("lng_cell", column(F.col("lng"), count(F.col("lat_cell"))))
    spread = places.select(place, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    spread = spread.withColumn("lat_cell", F.explode(F.array(*[band(F.col("p_lat")) + i for i in (-1, 0, 1)]))).withColumn("n", count(F.col("lat_cell")))
    spread = spread.withColumn("lng_cell", F.explode(F.array_distinct(F.array(*[F.pmod(column(F.col("p_lng"), F.col("n")) + i, F.col("n")) for i in (-1, 0, 1)])))).drop("n")
    pairs = p.join(spread, ["lat_cell", "lng_cell"])
    gap = haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    pairs = pairs.withColumn("metres", gap).where(F.col("metres") <= metres)
    return pairs.groupBy(point).agg(F.min(F.struct("metres", place)).alias("x")).select(point, f"x.{place}", "x.metres")


# Metres around an area's centre that each scope of the relaxation reaches.
SCOPES = {"self": 0, "near": 3500, "wide": 7000}


def scopes(areas: DataFrame, area: str, radii: dict[str, int] = SCOPES) -> DataFrame:
    """area, other, metres, scope (the smallest that reaches): areas whose centres lie within the widest radius.

    An area without a centre reaches only itself. Areas are few: the cells of nearest() are not needed, the join is on
    coarse bands of latitude.
    """
    widest = max(radii.values())
    band = F.floor(F.col("lat") / (widest / 111_000.0))
    known = areas.where("lat is not null and lng is not null").select(area, "lat", "lng", band.alias("band"))
    other = known.select(F.col(area).alias("other"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    pairs = known.join(other, "band").withColumn("metres", haversine(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"))).where(F.col("metres") <= widest)
    scope = F.lit(None).cast("string")
    for name, radius in sorted(radii.items(), key=lambda x: -x[1]):
        scope = F.when((F.col(area) == F.col("other")) if radius == 0 else (F.col("metres") <= radius), name).otherwise(scope)
    alone = areas.where("lat is null or lng is null").select(area, F.col(area).alias("other"), F.lit(0).cast("long").alias("metres"), F.lit("self").alias("scope"))
    return pairs.select(area, "other", "metres", scope.alias("scope")).unionByName(alone)


# Classes of map entries that are places, and the box around the metropolis.
PLACE_CLASSES, METROPOLIS = ["place", "boundary"], (-35.10, -59.10, -34.20, -58.10)


def geocoded(results: DataFrame, query: str, kind: str) -> DataFrame:
    """query, result_id, lat, lng: the chosen map entry of each query; queries without a fit are left out.

    results: query, result_id, class, lat, lng, importance, road, house_number, street, number.
    kind `place`: entries of PLACE_CLASSES by importance. kind `address`: entries whose road and the
    asked street hold one another (or one is unknown); an equal house number counts 10, a fitting road 5.
    Outside METROPOLIS nothing counts; of equals the smallest result_id.
    """
    inside = results.where(within(F.col("lat"), F.col("lng"), METROPOLIS))
    importance = F.coalesce(F.col("importance"), F.lit(0.0))
    if kind == "place":
        rows = inside.where(F.col("class").isin(PLACE_CLASSES)).withColumn("points", importance)
    else:
        road, asked = (F.coalesce(key(F.col(c)), F.lit("")) for c in ("road", "street"))
        both = (road != "") & (asked != "")
        fits = F.contains(road, asked) | F.contains(asked, road)
        number = F.coalesce((F.col("number") != "") & (F.col("house_number") == F.col("number")), F.lit(False))
        rows = inside.where(~both | fits).withColumn("points", importance + F.when(number, 10).otherwise(0) + F.when(both, 5).otherwise(0))
    best = rows.groupBy(query).agg(F.min(F.struct((-F.col("points")).alias("minus"), "result_id", "lat", "lng")).alias("x"))
    return best.select(query, "x.result_id", "x.lat", "x.lng")


def contained(rows: DataFrame, row_id: str, text: str, index: DataFrame) -> DataFrame:
    """row_id, id: the longest index key that stands in the text as whole words.

    Runs of as many words as some key has are joined with the keys, so the work follows the
    texts and not texts times keys. Of equally long keys the first in the text wins. The
    distinct numbers of words of the keys come to the driver.
    """
    words = F.split(key(F.col(text)), " ")
    counts = sorted(r.n for r in index.select(F.size(F.split("key", " ")).alias("n")).where("key is not null").distinct().collect()) or [1]
    starts = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size("w"))
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in counts]), lambda n: F.transform(starts(n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i, n), " ").alias("key")))))
    t = rows.select(row_id, words.alias("w")).select(row_id, F.explode(runs).alias("r")).select(row_id, "r.at", "r.key").distinct()
    return t.join(index, "key").groupBy(row_id).agg(F.max_by("id", F.struct(F.length("key"), -F.col("at"))).alias("id"))
