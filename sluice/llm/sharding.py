"""Shards of near equal size: minimax contiguous partition, in DataFrame operations only.

Equal texts are one group and stay together.  Groups are in order of their text's
SHA-256.  The smallest capacity that lets a greedy walk over that order fit into the
given number of shards is found by search: a probe is one aggregate over the running
sums that tells, for several capacities at once, where each walk's next cut lies; the
feasible interval shrinks to one value, and the cuts are those of its walk.

Running sums are in two levels: groups fall into ``buckets`` ranges of the hash, sums
run inside a bucket, and bucket totals run over at most ``buckets`` rows.  Rows of a
group are dealt by a salt of the id, so a group with a third of all rows is counted
and numbered in many tasks; slots follow group, salt, id.

Sizes: UTF-8 bytes and 1.  Null texts count as empty, in one group with empty ones.
Ids may be null or repeat; repeated rows get a slot each.  Columns other than id and
text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import ids_and_texts, staged


def running_sums(groups: DataFrame, buckets: int) -> DataFrame:
    """groups (g, n, size) with n0 and p0: rows and sizes of all groups before."""
    keyed = groups.withColumn("bucket", F.expr(f"cast(conv(substring(g, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296"))
    totals = keyed.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("size").alias("bs"))
    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    before = totals.select("bucket", F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("bn0"), F.coalesce(F.sum("bs").over(over), F.lit(0)).alias("bs0"))
    inside = Window.partitionBy("bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("n0", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("p0", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(before, "bucket").select("g", "n", "size", (F.col("n0") + F.col("bn0")).alias("n0"), (F.col("p0") + F.col("bs0")).alias("p0"))
    )


def smallest_capacity(sums: DataFrame, shards: int, probes: int = 15) -> tuple[int, list[int]]:
    """The capacity, and the running sums at which its shards end (fewer than shards - 1: the last ones are empty)."""
    total, largest = (x or 0 for x in sums.agg(F.max(F.col("p0") + F.col("size")), F.max("size")).first())
    end = F.col("p0") + F.col("size")

    def walks(capacities: list[int]) -> list[list[int]]:
        cuts: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards):
            reach = [(c[-1] if c else 0) + cap for c, cap in zip(cuts, capacities, strict=True)]
            open_ = [k for k, r in enumerate(reach) if not cuts[k] or cuts[k][-1] < total]
            if not open_:
                break
            got = sums.agg(*(F.max(F.when(end <= F.lit(reach[k]), end)).alias(f"c{k}") for k in open_)).first()
            for k in open_:
                cuts[k].append(got[f"c{k}"] or 0)
        return cuts

    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    best = None
    while best is None or low < high:
        step = max(1, -(-(high - low + 1) // (probes + 1)))
        tried = sorted({*range(low, high, step), high})
        found = walks(tried)
        first = next(k for k, c in enumerate(found) if not total or (c and c[-1] >= total))
        best, high = found[first], tried[first]
        low = tried[first - 1] + 1 if first else high
    return high, [c for c in best if c < total]


def shard_by_bytes(df: DataFrame, shards: int = 8, buckets: int = 4096, salts: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        ids_and_texts(df, id_col, text_col).select(
            "id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
            F.sha2(text.cast("binary"), 256).alias("g"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
        ), "shard-rows",
    )
    parts = rows.groupBy("g", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    in_group = Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most ``salts`` rows
    parts = parts.withColumn("s0", F.coalesce(F.sum("n").over(in_group), F.lit(0)))
    groups = parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    sums = staged(running_sums(groups, buckets), "shard-sums")
    _, cuts = smallest_capacity(sums, shards)
    shard = sum((F.when(F.col("p0") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = sums.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("n0").alias("first"))  # at most ``shards`` rows
    group_slots = placed.join(F.broadcast(first), "shard").select("g", "shard", (F.col("n0") - F.col("first")).alias("g0"))
    salt_slots = parts.join(group_slots, "g").select("g", "salt", "shard", (F.col("g0") + F.col("s0")).alias("slot0"))
    inner = Window.partitionBy("g", "salt").orderBy("id")
    return (
        rows.join(salt_slots, ["g", "salt"]).withColumn("slot", F.col("slot0") + F.row_number().over(inner) - 1)
        .select("id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")
    )


def op10_sharding(spark, sf_dir):
    got = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
