"""Merges by key: upserts with price snapshots, inventory refresh, incremental index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the text of the columns; nulls are written out, so they do not shift their neighbours."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]), 256)


def first_in_batch(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return batch.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], hashed: str, price: str) -> DataFrame:
    """keys, action (insert, touch, update, keep) and snapshot (the price is new) of a full outer merge."""
    old = current.select(*keys, F.col(hashed).alias("old_hash"), F.col(price).alias("old_price"), F.lit(True).alias("is_old"))
    new = batch.select(*keys, F.col(hashed).alias("new_hash"), F.col(price).alias("new_price"), F.lit(True).alias("is_new"))
    both = old.join(new, keys, "full_outer")
    action = F.when(F.col("is_old").isNull(), "insert").when(F.col("is_new").isNull(), "keep").when(F.col("old_hash") == F.col("new_hash"), "touch").otherwise("update")
    changed = (action == "insert") | ((action == "update") & ~F.col("old_price").eqNullSafe(F.col("new_price")))
    return both.select(*keys, action.alias("action"), changed.alias("snapshot"))


def merged(current: DataFrame | None, batch: DataFrame, keys: list[str], data: list[str], now: str, order: list[Column]) -> DataFrame:
    """The listings after a batch: keys, data, content_hash, first_seen, last_seen, active, delisted_at, with action
    (insert, touch, update, keep) and snapshot (a new price, or the first).

    Of a batch's rows with one key the first by order counts. A row with the same content is
    touched: seen now and active, and nothing else, so the day it was taken off stays. Other content
    overwrites the data, whatever is null in it too, and clears that day. Rows that the batch lacks are kept as they are.
    data has price and currency; current has these columns, or is None before the first batch.
    """
    kind = batch.schema
    at = F.lit(now).cast("timestamp")
    if current is None:
        current = batch.select(*keys, *data, F.lit("").alias("content_hash"), at.alias("first_seen"), at.alias("last_seen"), F.lit(True).alias("active"), at.alias("delisted_at")).where("false")
    new = first_in_batch(batch, keys, order).withColumn("content_hash", content_hash(data))
    both = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("o")).join(new.select(*keys, F.struct(*data, "content_hash").alias("n")), keys, "full_outer")
    o, n = F.col("o"), F.col("n")
    action = F.when(o.isNull(), "insert").when(n.isNull(), "keep").when(o["content_hash"] == n["content_hash"], "touch").otherwise("update")
    both = both.withColumn("action", action)
    written = F.col("action").isin("insert", "update")
    seen = F.col("action") != "keep"
    return both.select(
        *keys,
        *[F.when(written, n[c]).otherwise(o[c]).cast(kind[c].dataType).alias(c) for c in data],
        F.when(written, n["content_hash"]).otherwise(o["content_hash"]).alias("content_hash"),
        F.coalesce(o["first_seen"], at).alias("first_seen"),
        F.when(seen, at).otherwise(o["last_seen"]).alias("last_seen"),
        F.when(seen, F.lit(True)).otherwise(o["active"]).alias("active"),
        F.when(~written, o["delisted_at"]).alias("delisted_at"),
        "action",
        ((F.col("action") == "insert") | ((F.col("action") == "update") & ~o["price"].eqNullSafe(n["price"]))).alias("snapshot"),
    )


def merged_inventory(current: DataFrame | None, batch: DataFrame, keys: list[str], data: list[str], now: str, order: list[Column], full: bool, scope: Column | None = None) -> DataFrame:
    """The inventory after a batch: keys, data, last_seen and action (created, updated, unchanged, unpublished, kept).

    Of a batch's rows with one key the last by order counts (each overwrites the one before).
    A row that differs in any field is overwritten. A full batch unpublishes rows in scope that
    it lacks, unless they are so already (published false, not null), and deletes none. data has published.
    """
    kind = batch.schema
    at = F.lit(now).cast("timestamp")
    if current is None:
        current = batch.select(*keys, *data, at.alias("last_seen")).where("false")
    new = first_in_batch(batch, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    old = current.select(*keys, F.struct(*data, "last_seen").alias("o"), (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))).alias("within"))
    both = old.join(new.select(*keys, F.struct(*data).alias("n")), keys, "full_outer")
    o, n = F.col("o"), F.col("n")
    same = F.lit(True)
    for c in data:
        same = same & o[c].eqNullSafe(n[c])
    gone = F.lit(full) & F.col("within") & ~o["published"].eqNullSafe(F.lit(False))
    both = both.withColumn("action", F.when(o.isNull(), "created").when(n.isNull() & gone, "unpublished").when(n.isNull(), "kept").when(same, "unchanged").otherwise("updated"))
    value = lambda c: F.when(n.isNotNull(), n[c]).when((F.col("action") == "unpublished") & F.lit(c == "published"), F.lit(False).cast(kind[c].dataType)).otherwise(o[c])
    return both.select(*keys, *[value(c).alias(c) for c in data], F.when(F.col("action") == "kept", o["last_seen"]).otherwise(at).alias("last_seen"), "action")


def inventory_refresh(current: DataFrame, batch: DataFrame, keys: list[str], hashed: str, full: bool) -> DataFrame:
    """keys, action; a full refresh unpublishes what is absent and never deletes."""
    merged = upsert(current, batch, keys, hashed, hashed).drop("snapshot")
    names = {"insert": "created", "touch": "unchanged", "update": "updated", "keep": "unpublished" if full else "kept"}
    out = F.col("action")
    for a, b in names.items():
        out = F.when(F.col("action") == a, b).otherwise(out)
    return merged.withColumn("action", out)


def index_delta(stored: DataFrame, chunks: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, action: unchanged when the set of chunk hashes is equal, else replace; new ones insert, gone ones delete."""
    marks = lambda df: df.groupBy(doc).agg(F.sort_array(F.collect_set(F.sha2(F.col(text), 256))).alias("h"))
    both = marks(stored).withColumnRenamed("h", "old").join(marks(chunks).withColumnRenamed("h", "new"), doc, "full_outer")
    return both.select(doc, F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "unchanged").otherwise("replace").alias("action"))


def idempotent(requests: DataFrame, keys: list[str], at: str, ttl_seconds: int, tiebreak: str) -> DataFrame:
    """Requests that create something: no request of their key that did so lies within the time before.

    A repeat creates nothing and so does not prolong the time. A key's requests are folded in
    order (of equal times by tiebreak); a key's requests within one time to live meet in a task.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.where(F.col(at).isNotNull())
    # A pause longer than the time to live starts anew, so a key is folded run by run.
    order = W.partitionBy(*keys).orderBy("__at", tiebreak)
    runs = rows.select(*keys, micros.alias("__at"), tiebreak).withColumn("__gap", F.coalesce(F.col("__at") - F.lag("__at").over(order) > ttl_seconds * 1_000_000, F.lit(True)))
    runs = runs.withColumn("__run", F.sum(F.col("__gap").cast("int")).over(order))
    listed = runs.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list(F.struct("__at", tiebreak))).alias("x"))
    kind = f"struct<last: bigint, kept: array<{requests.schema[tiebreak].dataType.simpleString()}>>"
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(kind[kind.index("kept: ") + 6 : -1]).alias("kept"))

    def fold(acc, x):  # noqa: ANN001, ANN202
        new = acc["last"].isNull() | (x["__at"] - acc["last"] > ttl_seconds * 1_000_000)
        return F.struct(F.when(new, x["__at"]).otherwise(acc["last"]).alias("last"), F.when(new, F.concat(acc["kept"], F.array(x[tiebreak]))).otherwise(acc["kept"]).alias("kept"))

    kept = listed.select(*keys, F.explode(F.aggregate("x", start, fold)["kept"]).alias(tiebreak))
    return rows.join(kept, [*keys, tiebreak], "left_semi")


def regenerated(reports: DataFrame, asked: DataFrame, id_of: Column) -> DataFrame:
    """New report rows for those asked to be made again: a copy with a new id and its origin; the old rows stay as they are."""
    again = reports.join(asked.select("report_id").distinct(), "report_id", "left_semi")
    return again.withColumn("origin_id", F.col("report_id")).withColumn("report_id", id_of).withColumn("status", F.lit("QUEUED"))


def chunk_ids(rows: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """rows with a client-made id from their key, so that the tables that refer to each other can be written apart and again."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])
    return rows.withColumn(name, F.substring(F.sha2(text, 256), 1, 32))
