"""Sharding by longest-processing-time scheduling.

Groups that must stay together are sorted by size and go, one by one, to the least-loaded shard through a heap. The
scheduler sees a bounded list at any input size: groups above ``1 / (shards * grain)`` of all bytes one by one (there
are at most ``shards * grain`` of them), the others in ``bundles`` hashed bundles of whole groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm._common import materialize


def schedule(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item: largest first, to the least-loaded shard (the lower number on a tie)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, shard = heapq.heappop(heap)
        out[i] = shard
        heapq.heappush(heap, (load + sizes[i], shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, grain: int = 512, bundles: int = 8192, rows_per_bucket: int = 50_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot.

    Law ``bytes``: equal texts share a shard, and the bytes of the shards are near equal. A null text counts as
    empty (size 1) and groups with empty texts; repeated rows are rows like any other. Slots are gapless from 0 in each
    shard. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), part(1).alias("g1"), part(16).alias("g2"))
    base = materialize(base, "sizes")
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = base.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    bundle = F.pmod("g2", F.lit(bundles)).alias("bundle")
    groups = materialize(groups.withColumn("big", F.col("bytes") * (shards * grain) > total[0]).withColumn("bundle", bundle), "groups")
    big = groups.where("big").select("g1", "g2", "bytes").orderBy(F.desc("bytes"), "g1", "g2").collect()  # at most shards * grain
    small = groups.where("not big").groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()  # at most `bundles`
    at = schedule([r["bytes"] for r in [*big, *small]], shards)
    spark = docs.sparkSession
    of_big = spark.createDataFrame([(r["g1"], r["g2"], s) for r, s in zip(big, at)], "g1 long, g2 long, big_shard int")
    of_small = spark.createDataFrame([(r["bundle"], s) for r, s in zip(small, at[len(big) :])], "bundle long, small_shard int")
    buckets = max(8, -(-total[1] // (shards * rows_per_bucket)))
    rows = base.withColumn("bundle", bundle).join(F.broadcast(of_big), ["g1", "g2"], "left").join(F.broadcast(of_small), "bundle", "left")
    rows = rows.select("doc_id", "size", "text_crc32", "g1", F.coalesce("big_shard", "small_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", "g1", "size"), F.lit(buckets)).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "g1", "size"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
