"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.hashing import mix


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys (Lamping and Veach, 2014), all keys at once."""
    key = mix(keys.astype(np.int64).view(np.uint64))
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))
        j[live] = np.minimum(step, float(1 << 62)).astype(np.int64)
        live = live[j[live] < shards]
    return b


def shard_of(key, shards: int):
    """Column: shard 0 to ``shards`` - 1 of a long key. A null key counts as one key of its own."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key, F.lit(-(1 << 62))))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """Every row with ``size, text_crc32, law, shard, slot, grown_shard``; law is ``key``.

    The shard depends on the key and the number of shards only, so repeated rows and rows of
    equal key share a shard, and with one more shard (``grown_shard``) a row either stays or
    moves into the new one. Size is the text's UTF-8 bytes (a null text: none) plus 8.
    ``slot`` numbers a shard's rows from 0 without gaps: rows are dealt to ``buckets`` hash
    buckets, counted there, and numbered after the buckets before theirs, so no task has to
    sort a whole shard. Only ``buckets`` x ``shards`` counts are broadcast. An empty table gives
    an empty result; other columns stay unless they bear one of the new names. They travel as
    one column, so none clashes with a helper.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in docs.columns if c.lower() not in new]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key).cast("long"), shards).alias("shard"),
        shard_of(F.col(key).cast("long"), shards + 1).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("n", F.row_number().over(own))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        *[F.col("row")[c].alias(c) for c in kept], "size", "text_crc32", "law", "shard", (F.col("before") + F.col("n") - 1).alias("slot"), "grown_shard"
    )
