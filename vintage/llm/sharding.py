"""Sharding (operator 9): a reproducible shuffle into shards.

Rows are numbered globally in (doc_id, text) order and the number goes
through a Feistel permutation with cycle walking (``permute.py``); the image
p gives ``shard = p mod shards`` and ``slot = p div shards``. So shard and
slot of a row number can be computed without the table, shard counts differ
by one at most, slots run from 0 without gaps, and a group of copies is
spread over all shards.

Null texts count as empty; null doc_ids are numbered first; rows that agree
in doc_id and text are interchangeable; an empty table gives an empty result;
other columns pass through untouched unless they carry a result's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import positions, text_key
from vintage.llm.permute import permute, permute_int

#: Names one shuffle; another key gives another.
KEY = 20_261


def place(number: int, rows: int, shards: int, key: int = KEY) -> tuple[int, int]:
    """Shard and slot of a row number, without the table."""
    slot, shard = divmod(permute_int(number, rows, key), shards)
    return shard, slot


def assign_shards(docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 16), text_crc32,
    row_number, shard, slot."""
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("_text"))
    numbered = positions(slim, ["doc_id", "_text"])
    total = numbered.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = numbered.withColumn("_total", total)
    rows = rows.withColumn("_p", permute(F.col("_at"), F.col("_total"), F.lit(key).cast("long")))
    return rows.select("doc_id", "size", "text_crc32", F.col("_at").alias("row_number"),
                       (F.col("_p") % shards).cast("int").alias("shard"),
                       F.call_function("div", F.col("_p"), F.lit(shards).cast("long")).alias("slot"))
