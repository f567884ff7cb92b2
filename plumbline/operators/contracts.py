"""What stands around model calls and texts: batches, verdicts, reranking, figures that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import marked_places, normal, number, numbers, orphans

# The reasons that a judge may give for leaving a listing out.
MOTIVES = ["permuta_o_financiacion", "en_pozo_o_construccion", "precio_promocional", "tipologia_distinta", "descripcion_inconsistente"]

# How a text asserts a value, and how it speaks of comparables instead.
CLAIM = (
    r"(?i)(?:valor(?:\s+(?:de\s+la\s+propiedad|estimado|sugerido|medio))?"
    r"|precio\s+(?:sugerido|de\s+publicaci[oó]n|estimado)|estimaci[oó]n|tasaci[oó]n)"
    r"[^.\n]{0,40}?(?:USD|U\$S|d[oó]lares)\s*[\d.,]+"
)
OF_COMPARABLES = r"(?i)comparabl|avis[oa]|por\s*m2|por\s*m²|/\s*m2|/\s*m²|el\s+m2|el\s+m²"
LOT = 6


def lots(pending: DataFrame, order: str, size: int = LOT) -> DataFrame:
    """Pending rows in lots of `size`, numbered through; only a range's last lot can be short.

    Rows are counted in ranges of `order` first, so each range knows where its lots begin and
    no task holds all rows.
    """
    bucket = F.floor(F.col(order) / 4096)
    counts = pending.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n"))  # a row for each 4,096 ids
    counts = counts.withColumn("__before", F.sum("__n").over(W.orderBy("__bucket")) - F.col("__n")).drop("__n")
    rows = pending.withColumn("__bucket", bucket)
    number = F.row_number().over(W.partitionBy("__bucket").orderBy(order)) - 1
    rows = rows.withColumn("__number", number).join(counts, "__bucket")
    return rows.withColumn("lot", F.floor((F.col("__before") + F.col("__number")) / size)).drop("__bucket", "__number", "__before")


def extraction_rounds(asked: DataFrame, answers: DataFrame, ref: str, most: int = 2) -> DataFrame:
    """asked with round (the first that answered it: 0 the lots, then one by one up to `most`; null: never).

    answers(ref, round): answers nobody asked for and later rounds have no part in it.
    """
    first = answers.where(F.col("round").between(0, most)).groupBy(ref).agg(F.min("round").alias("round"))
    return asked.join(first, ref, "left")


def omitted(asked: DataFrame, answered: DataFrame, ref: str) -> DataFrame:
    """Asked for and not answered: the next round; answers nobody asked for have no part in it."""
    return asked.join(answered, ref, "left_anti")


def verdict(motive: Column, cite: Column, text: Column) -> Column:
    """The motive, if it is one of MOTIVES and its cite stands in the text, both folded; else null."""
    return F.when(motive.isin(MOTIVES) & (F.trim(cite) != "") & F.contains(normal(text), normal(cite)), motive)


def reranked(rows: DataFrame, query: str, pos: str, score: str, top: int = 60) -> DataFrame:
    """The first `top` by score, those without one after them in their old order; the rest as it was."""
    head = F.col(pos) <= top
    order = [F.when(head, 0).otherwise(1), F.desc_nulls_last(F.when(head, F.col(score))), F.col(pos)]
    return rows.withColumn("new_pos", F.row_number().over(W.partitionBy(query).orderBy(*order)))


def pooled(rankings: DataFrame, query: str, doc: str, system: str, pos: str, depth: int = 30) -> DataFrame:
    """Each document of the systems' first `depth` once, where it is first seen (system, then position)."""
    first = F.min(F.struct(system, pos))
    return rankings.where(F.col(pos) <= depth).groupBy(query, doc).agg(first.alias("x")).select(query, doc, F.col(f"x.{system}").alias(system), F.col(f"x.{pos}").alias(pos))


def asserted_values(text: Column, least: float = 50_000) -> Column:
    """Amounts of `least` or more that a text asserts as the value, in order; those in a sentence about comparables do not count."""
    claim = lambda before, own, after: F.struct(
        number(F.regexp_extract(own, r"([\d.,]+)$", 1)).alias("value"),
        F.concat(F.substring_index(before, ".", -1), own, F.substring_index(after, ".", 1)).alias("sentence"),
    )
    found = marked_places(text, CLAIM, claim)
    return F.transform(F.filter(found, lambda c: (c["value"] >= least) & ~c["sentence"].rlike(OF_COMPARABLES)), lambda c: c["value"])


def wrong_values(asserted: Column, figures: Column, share: float = 0.001, least: float = 0.5) -> Column:
    """Asserted values that no key figure explains; without figures nothing is wrong."""
    far = lambda n: ~F.exists(figures, lambda p: F.abs(n - p) <= F.greatest(F.abs(p) * share, F.lit(least)))
    return F.when(F.size(figures) > 0, F.filter(asserted, far)).otherwise(F.array().cast("array<double>"))


def answer_problems(answer: Column, cites: Column, no_evidence: Column, allowed: Column) -> Column:
    """Why an answer may not go out, in order: no_cite, unknown_cite, untraced_number. `[N]` and N are one cite.

    allowed: a map from the fragments' ids to their texts. An answer that says it has no evidence has no problem.
    """
    ids = F.filter(F.transform(cites, lambda c: F.trim(F.regexp_replace(F.trim(c), r"^[\[\]]+|[\[\]]+$", ""))), lambda c: c != "")
    known = F.filter(ids, lambda c: F.map_contains_key(allowed, c))
    said = F.flatten(F.transform(known, lambda c: numbers(F.element_at(allowed, c))))
    problems = [
        F.when(F.size(ids) == 0, "no_cite"),
        F.when(F.size(known) < F.size(ids), "unknown_cite"),
        F.when(F.size(orphans(numbers(answer), said)) > 0, "untraced_number"),
    ]
    return F.when(F.coalesce(no_evidence, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*problems)))


def incoherent(low: Column, mid: Column, high: Column, used: Column, found: Column) -> Column:
    """Names of the broken relations, joined by a comma."""
    broken = [F.when(low > mid, "low_over_mid"), F.when(mid > high, "mid_over_high"), F.when(used > found, "used_over_found")]
    return F.array_join(F.array_compact(F.array(*broken)), ",")


def next_state(rejections: Column, passed: Column, most: int = 2) -> Column:
    """accepted, retry, or without_prose once the rejections are used up."""
    return F.when(passed, "accepted").when(rejections < most, "retry").otherwise("without_prose")
