"""What the operators of this folder share: reading tables, shared-folder tables, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.tables import drop, shared_folder, stored

#: Rows and bytes of an Arrow batch sent to Python, so that a batch of very long texts fits a worker.
ARROW_ROWS, ARROW_BYTES = 1000, "16m"
__all__ = ["drop", "held_out", "learnable", "prepare", "shared_folder", "slices", "stored", "table", "whole_groups"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small from here on; texts have no length limit. Operators are lazy, so the
    setting has to outlast the call; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def learnable(doc_id: Column) -> Column:
    """True for rows that a model may learn from: crc32(doc_id as text) mod 4 is not 2. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(texts: list[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit characters together (a longer text stands alone)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from sorted batches, many groups at once."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows >= least:
            all_rows = pd.concat(held, ignore_index=True)
            last = (all_rows[keys] == all_rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield all_rows.iloc[:cut]
            held, rows = [all_rows.iloc[cut:]], len(all_rows) - cut
    if rows:
        yield pd.concat(held, ignore_index=True)
