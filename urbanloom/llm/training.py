"""Labelled rows for training: a bounded, deterministic sample that never looks at held-out documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.llm.storage import stored

#: Bytes of labelled text that training reads at most; its one task holds all of them.
TRAINING_BYTES = 32 << 20


def held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text has this remainder; a null id is not held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(df: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_BYTES) -> DataFrame:
    """(id, _text, _label) of at most ``rows`` labelled ids and ``most`` bytes, the same for each run: those of least hash.

    Only ids, labels and sizes, of which there are at most ``rows``, are broadcast or sent to one task; texts are
    filtered where they are read. An id counts once, with its least text and its largest label; null ids and labels are
    left out. Ids are taken whole, in order of their hash, for as long as their texts add up to at most ``most`` bytes.
    """
    chosen = (
        labels.where(keep & F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(rows)
    )
    own = df.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), id_col)
    once = stored(own.groupBy(id_col).agg(F.min("_text").alias("_text"), F.first("_label").alias("_label")), "labelled")
    size = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64(id_col), id_col).rowsBetween(Window.unboundedPreceding, 0))
    few = once.select(id_col, size.alias("_upto")).where(F.col("_upto") <= most).select(id_col)
    return once.join(F.broadcast(few), id_col)
