"""Duplicates of the same real thing: blocked pairs, complete-linkage groups, the canonical record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import jaccard, same_unit

CLOSE, GREY = 0.85, 0.45
LARGEST = 8  # members of a group that is believed
SLICE = 1000  # rows of a block that other rows meet at once
ASKED = 15  # grey pairs of a group that a judge is asked


def blocked_pairs(rows: DataFrame, block: list[str], pos: str, key: str, grams: str, surface: str, price: str, unit: str | None = None, specific: str | None = None, rooms: str | None = None, only: DataFrame | None = None, blocks: bool = False) -> DataFrame:
    """Pairs (a before b) of a block with their similarity and layer, layer1, layer2 or grey: a, b, sim, layer, before them the block with `blocks`.

    Keys (block key of the address) with their trigram sets are columns made once for each row;
    tolerances are relative to a. Different units are no pair in any layer; the same unit under
    the same key is layer1 outright if it is specific (a flat, not only a floor) in both, whatever
    surface and price say. Else layer1 is the same key, 2 square metres, equal rooms where both
    are known (0 is unknown) and 5 % of the price; layer2 is a similar key, 10 % and 5 %; without
    surface or price neither. Without the unit columns units are unknown. With only(a), pairs of these a.

    What keys and units say is said once for each two addresses (key and unit) of a block, and
    only addresses that can be a pair meet. Rows of an address are cut into slices by pos, and a row meets its own
    and later slices: no task has a whole block on both sides, and few pairs are looked at from both ends.
    """
    none = F.lit(None).cast("string")
    rows = rows.select(*block, *[F.col(c).alias(n) for c, n in ((pos, "_pos"), (key, "_key"), (grams, "_grams"), (surface, "_s"), (price, "_p"))], (F.col(unit) if unit else none).alias("_unit"), (F.col(specific) if specific else F.lit(False)).alias("_specific"), (F.col(rooms) if rooms else F.lit(0)).alias("_rooms"))
    rows = rows.where(F.col("_key").isNotNull())
    rows = rows.withColumns({"_address": F.dense_rank().over(W.partitionBy(*block).orderBy("_key", "_unit", "_specific")), "_slice": F.floor((F.row_number().over(W.partitionBy(*block).orderBy("_pos")) - 1) / SLICE)})
    said = rows.groupBy(*block, "_address").agg(*[F.first(c).alias(c) for c in ("_key", "_grams", "_unit", "_specific")], F.max("_slice").alias("_last"))
    known = lambda c: F.coalesce(c, F.lit(False))
    side = lambda df, p, names: df.select(*block, *[F.col(c).alias(p + c) for c in names])
    about = ("_address", "_key", "_grams", "_unit", "_specific", "_last")
    two = side(said, "a", about).join(side(said, "b", about), block)
    same = same_unit(F.col("a_unit"), F.col("b_unit"))
    one_key = F.col("a_key") == F.col("b_key")
    # One struct, so that the similarity is computed once.
    two = two.where(~known(~same)).select("*", F.explode(F.array(F.round(F.when(one_key, 1.0).otherwise(jaccard(F.col("a_grams"), F.col("b_grams"))), 6))).alias("sim"))
    two = two.where(one_key | (F.col("sim") >= GREY)).select(*block, "a_address", "b_address", "b_last", "sim", one_key.alias("one_key"), (one_key & known(same) & F.col("a_specific") & F.col("b_specific")).alias("outright"))
    own = ("_pos", "_s", "_p", "_rooms", "_address", "_slice")
    a = side(rows, "a", own)
    a = a if only is None else a.join(only.select(F.col("a").alias("a_pos")).distinct(), "a_pos", "left_semi")
    a = a.join(two, [*block, "a_address"]).where(F.col("a_slice") <= F.col("b_last")).withColumn("b_slice", F.explode(F.sequence("a_slice", "b_last"))).drop("a_address", "a_slice", "b_last")
    gap = F.abs(F.col("a_s") - F.col("b_s"))
    share = F.when(F.col("a_s") > 0, gap / F.col("a_s"))
    priced = known(F.when(F.col("a_p") != 0, F.abs(F.col("a_p") - F.col("b_p")) / F.col("a_p")) <= 0.05)
    rooms_fit = known((F.col("a_rooms") == 0) | (F.col("b_rooms") == 0) | (F.col("a_rooms") == F.col("b_rooms"))) | F.col("a_rooms").isNull() | F.col("b_rooms").isNull()
    far = known(share > 0.25)
    pairs = a.join(side(rows, "b", own), [*block, "b_address", "b_slice"]).where((F.col("a_pos") < F.col("b_pos")) & (~far | F.col("outright")))
    first = F.col("outright") | (F.col("one_key") & known(gap <= 2) & rooms_fit & priced)
    layer = F.when(first, "layer1").when((F.col("sim") >= CLOSE) & known(share <= 0.10) & priced, "layer2").when((F.col("sim") >= GREY) & ~far, "grey")
    # None is null: what meets has a similarity of GREY at least, and far pairs are left only outright.
    return pairs.withColumn("layer", layer).select(*(block if blocks else []), F.col("a_pos").alias("a"), F.col("b_pos").alias("b"), "sim", "layer")


def likest(pairs: DataFrame, group: str, most: int = ASKED) -> DataFrame:
    """group, sim, a: where the `most` likest grey pairs of each group begin. They are counted by their first record, not sorted."""
    starts = pairs.where(F.col("layer") == "grey").groupBy(group, "sim", "a").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("sim"), "a"))
    return starts.withColumn("n", place).where(F.col("n") <= most).drop("n")


def asked(pairs: DataFrame, group: str, most: int = ASKED) -> DataFrame:
    """Of a group's grey pairs the `most` likest (ties: smaller ids), which a judge is asked. pairs may be only those that begin where likest() says."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("sim"), "a", "b"))
    return pairs.where(F.col("layer") == "grey").withColumn("n", place).where(F.col("n") <= most).drop("n")


def decided(pairs: DataFrame, questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs that count as the same: layers 1 and 2, and the questions of asked() to which the judge said `mismo`.

    verdicts(a, b, verdict: mismo, distinto or no_se); method is LLM where a judge decided.
    """
    said = questions.join(verdicts.where(F.col("verdict") == "mismo").select("a", "b").distinct(), ["a", "b"]).withColumn("method", F.lit("LLM"))
    sure = pairs.where(F.col("layer") != "grey").withColumn("method", F.when(F.col("layer") == "layer1", "EXACT_ADDR").otherwise("FUZZY"))
    return sure.unionByName(said.select(*sure.columns))


def labelled(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """member, cluster, method of groups: LLM if a judge decided any pair inside, else FUZZY if any was fuzzy, else EXACT_ADDR."""
    a = clusters.select(F.col("member").alias("a"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("member").alias("b"), F.col("cluster").alias("cb"))
    inside = edges.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("cluster"))
    rank = F.when(F.col("method") == "LLM", 3).when(F.col("method") == "FUZZY", 2).otherwise(1)
    return clusters.join(inside.agg(F.max_by("method", rank).alias("method")), "cluster", "left").select("member", "cluster", "method")


def cliques(edges: DataFrame, largest: int = LARGEST) -> DataFrame:
    """edges(block, a, b) -> block, member, cluster (smallest member): complete-linkage groups.

    Degrees are counted over the whole block first. In a block, by falling degree and then
    id, a record takes in neighbours that are linked to all it has so far; groups larger
    than `largest` are dropped and their members used up.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        order = sorted(near, key=lambda x: (-len(near[x]), x))
        used, out = set(), []
        place = {x: i for i, x in enumerate(order)}
        for seed in order:
            if seed in used:
                continue
            group = [seed]
            for x in sorted(near[seed] - used, key=place.__getitem__):
                if near[x].issuperset(group):
                    group.append(x)
            used.update(group)
            if 1 < len(group) <= largest:
                out += [(pdf["block"].iloc[0], m, min(group)) for m in group]
        return pd.DataFrame(out, columns=["block", "member", "cluster"])

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return edges.groupBy("block").applyInPandas(grow, f"block {kinds['block']}, member {kinds['a']}, cluster {kinds['a']}")


def canonical(rows: DataFrame, cluster: str, fields: list[str], days: str, pos: str) -> DataFrame:
    """cluster, canonical, members: the most complete record, then the newest (0 or unknown days count 9999), then the first."""
    complete = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    fresh = -F.when(F.coalesce(F.col(days), F.lit(0)) == 0, 9999).otherwise(F.col(days))
    return rows.groupBy(cluster).agg(F.max_by(pos, F.struct(complete, fresh, -F.col(pos))).alias("canonical"), F.count("*").alias("members"))
