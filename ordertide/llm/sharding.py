"""Rendezvous hashing of stable record keys over weighted shards, and gapless slots within shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of rows within a shard: rows are numbered inside blocks, and blocks by a table of this many rows a shard.
BLOCKS = 1024
_BITS = 52


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard whose hash with the key wins: least of -ln(u) / weight, ties to the lower shard.

    A shard's score depends on the key and the shard alone. So a further shard takes rows only into itself, one that goes
    gives only its own rows away, and a shard's share is proportional to its weight. Weight 0 gets no row. A null key is one
    more key: its rows go together.
    """
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite, none below 0, and one above")
    scores = []
    for shard, weight in enumerate(weights):
        if weight:
            bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000null")), F.lit(shard), F.lit(seed)), 64 - _BITS)
            u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << _BITS))
            scores.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_rows(df: DataFrame, key: str, weights: list[float], *, order: list[str], seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: rows of a shard are numbered from 0 without gaps.

    Rows are numbered within blocks, by a hash of the key and ``order``, and the blocks' starts come from a table of
    ``blocks`` rows for each shard: no task holds a shard. Any columns may be null; rows that repeat in key and ``order``
    take slots of one block, in any order. An empty table gives an empty result. Columns of ``df`` named shard or slot are replaced.
    """
    placed = df.drop("shard", "slot", "_block", "_start").withColumn("shard", rendezvous(F.col(key), weights, seed))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64(key, *order), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy(key, *order)
    # at most len(weights) * blocks rows
    both = placed.withColumn("_row", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "_block"])
    return both.withColumn("slot", (F.col("_start") + F.col("_row")).cast("bigint")).drop("_block", "_start", "_row")


def moved(df: DataFrame, key: str, before: list[float], after: list[float], seed: int = 0) -> DataFrame:
    """Rows whose shard differs between two weightings, with both shards."""
    both = df.withColumn("shard_before", rendezvous(F.col(key), before, seed)).withColumn("shard_after", rendezvous(F.col(key), after, seed))
    return both.where("shard_before != shard_after")


def op9(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of documents by doc_id, law ``key``, equal weights."""
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, "doc_id", [1.0] * shards, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"))
