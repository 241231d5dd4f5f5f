"""Sharding by longest-processing-time scheduling (operator 3).

Groups that must stay together are put, largest first, on the least-loaded shard through a heap. The law that
holds is ``bytes``: the shards' sizes are near equal, as near as the groups that stay together let them be.

At scale the heap can't see every group one by one. Groups that are large against a shard (over a thousandth of
one; so there are at most ``1000 * shards`` of them, whatever the input) go through it by themselves. Smaller
ones form classes of equal size (exact below 64 KB, else 128 classes an octave), at most ~70,000 in all; the
heap deals a class in order and, as soon as its pops repeat in a fixed cycle, the rest of the class follows that
cycle by rank. Ranks are numbered in salted parts, so no size, group or shard meets in one task.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import id_and, ranked, salts, written

#: A group larger than this part of a shard is scheduled by itself.
HEAVY = 1000
#: Sizes below this are classes of their own.
EXACT = 1 << 16
#: Classes an octave above EXACT.
OCTAVE = 128
#: What a document counts besides its bytes.
PER_DOC = 16


def deal_class(heap: list[tuple[float, int]], size: float, count: int) -> tuple[list[int], list[int]]:
    """Put ``count`` groups of one size on the shards of ``heap``: the first shards in order, and the cycle of the rest.

    Once the loads lie within one size of each other, the pops go round in the order of the loads; whole rounds
    then add the same to each shard and are not simulated.
    """
    head: list[int] = []
    n = len(heap)
    while count and heap[0][0] + size < max(heap)[0]:
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        head.append(shard)
        count -= 1
    if not count:
        return head, []
    order = sorted(heap)
    rounds, rest = divmod(count, n)
    after = [(load + size * (rounds + (i < rest)), shard) for i, (load, shard) in enumerate(order)]
    heap[:] = after
    heapq.heapify(heap)
    return head, [shard for _, shard in order]


def shard_by_size(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every document into one of ``n_shards`` shards of near equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law (``bytes``), shard, slot (gapless
    from 0 in the shard) and grown_shard (null: this law moves documents freely when shards are added).

    Null texts: size 16, text_crc32 null; each is a group of its own. Empty texts are one group like any other
    text. Null and repeated doc_ids are kept, one result row for each input row. An empty table gives no rows.
    Other columns are not looked at. A text that a third of all rows share is one group, hence in one shard,
    however large; the other shards share the rest evenly.
    """
    spark = docs.sparkSession
    rows = id_and(docs, key, text).select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + PER_DOC).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), F.encode(F.concat(F.lit("null-"), F.uuid()), "UTF-8")).alias("grp"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), "shard-groups")
    n_groups, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    heavy_from = max(total / n_shards / HEAVY, 1)
    octave = EXACT + F.floor((F.log2(F.col("bytes")) - math.log2(EXACT)) * OCTAVE)
    groups = groups.withColumn("cls", F.when(F.col("bytes") > heavy_from, F.lit(-1)).when(F.col("bytes") < EXACT, F.col("bytes")).otherwise(octave).cast("long"))
    heap = [(0.0, s) for s in range(n_shards)]
    heavy = groups.where("cls = -1").select("grp", "bytes").collect()  # at most HEAVY * n_shards rows
    placed = []
    for g in sorted(heavy, key=lambda g: (-g["bytes"], bytes(g["grp"]))):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + g["bytes"], shard))
        placed.append((g["grp"], shard))
    classes = groups.where("cls >= 0").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()  # at most EXACT + OCTAVE * 47 rows
    plan = []
    for c in sorted(classes, key=lambda c: -c["b"] / c["n"]):
        head, cycle = deal_class(heap, c["b"] / c["n"], c["n"])
        plan.append((c["cls"], head, cycle))
    light = ranked(groups.where("cls >= 0").select("grp", "cls"), "cls", ["grp"], salts(n_groups))
    plan_df = F.broadcast(spark.createDataFrame(plan, "cls long, head array<int>, cycle array<int>"))
    n_head = F.size("head")
    shard = F.when(F.col("rank") < n_head, F.get("head", F.col("rank").cast("int"))).otherwise(F.get("cycle", ((F.col("rank") - n_head) % F.size("cycle")).cast("int")))
    of_group = light.join(plan_df, "cls").select("grp", shard.alias("shard")).unionByName(spark.createDataFrame(placed, "grp binary, shard int"))
    out = rows.join(of_group, "grp")
    out = written(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard"), "shard-of")
    out = ranked(out, "shard", ["doc_id", "text_crc32", "size"], salts(out.count()), "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 39."""
    return shard_by_size(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
