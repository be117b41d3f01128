"""Contiguous shards of minimal capacity over ordered atomic groups.

Rows are ordered by a hash of their text, so equal texts stand together. The
order is cut into a fixed number of hash ranges, none of which parts equal
texts; their byte totals (a table of bounded size) are all the driver sees. A
binary search finds the smallest capacity for which greedy filling needs no
more than the wanted shards; cuts are then placed under that capacity as evenly
as it allows. A range larger than an even share stands alone, and what lies
before and after it is divided by the same rule. Slots are counted range by
range; a range of very many rows (copies of one text) is counted in salted parts.

Defined cases: a null text has no bytes and is the group of the empty text;
repeated rows each get a slot; an empty table gives no rows; fewer groups than
shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges (a power of two); bounds what the driver and broadcasts hold.
RANGE_BITS = 17
#: Bytes that each row adds to its text's.
ROW_BYTES = 8
#: A range of more rows is counted in parts; there are no more than about 200,000 parts.
ROWS_A_PART, MOST_PARTS = 512, 100_000


def _greedy(sums: np.ndarray, at: int, end: int, cap: int, most: int) -> bool:
    """Whether ranges at..end fit in ``most`` shards of capacity ``cap``."""
    while at < end and most:
        to = int(np.searchsorted(sums, sums[at] + cap, "right")) - 1
        if to <= at:
            return False
        at, most = to, most - 1
    return at >= end


def capacity(sums: np.ndarray, at: int, end: int, shards: int) -> int:
    """The smallest capacity for which ``shards`` contiguous shards suffice. sums: totals before each range."""
    total = int(sums[end] - sums[at])
    low = max(int(np.diff(sums[at : end + 1]).max(initial=0)), -(-total // shards))
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if _greedy(sums, at, end, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def cuts(sums: np.ndarray, at: int, end: int, shards: int) -> list[int]:
    """Where each of ``shards`` shards of the ranges at..end ends."""
    if shards <= 1 or end <= at:
        return [end] * shards
    cap = capacity(sums, at, end, shards)
    sizes = np.diff(sums[at : end + 1])
    big = at + int(sizes.argmax())
    if sizes.max() == cap and cap * shards > 1.02 * (sums[end] - sums[at]):  # one range alone sets the capacity
        before, after = big > at, end > big + 1
        best = None
        for left in range(int(before), shards - int(after)):
            right = shards - 1 - left
            if (left and not before) or (right and not after and left < shards - 1 and before):
                continue
            worst = max(capacity(sums, at, big, left) if left and before else 0, capacity(sums, big + 1, end, right) if right and after else 0)
            if best is None or worst < best[0]:
                best = (worst, left)
        if best is not None and best[0] <= cap:
            left = best[1]
            return (cuts(sums, at, big, left) if left else []) + [big + 1] + (cuts(sums, big + 1, end, shards - 1 - left) if shards - 1 - left else [])
    out = []
    need = [end]  # need[k]: the first place from which k shards reach the end
    for _ in range(shards):
        need.append(int(np.searchsorted(sums[: need[-1] + 1], sums[need[-1]] - cap, "left")))
    for left in range(shards, 0, -1):
        if left == 1:
            out.append(end)
            break
        even = sums[at] + (sums[end] - sums[at]) / left
        most = int(np.searchsorted(sums, sums[at] + cap, "right")) - 1
        to = int(np.searchsorted(sums, even))
        if to > at and even - sums[to - 1] < sums[min(to, end)] - even:
            to -= 1
        at = min(max(to, need[left - 1], at), most, end)
        out.append(at)
    return out


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    hashed = F.xxhash64(text)
    rows = docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hashed.alias("__hash"), F.shiftrightunsigned(hashed, 64 - RANGE_BITS).cast("int").alias("__range"))
    totals = sorted((r[0], int(r[1]), r[2]) for r in rows.groupBy("__range").agg(F.sum("size"), F.count("*")).collect())
    size, count = np.zeros(1 << RANGE_BITS, np.int64), np.zeros(1 << RANGE_BITS, np.int64)
    for k, s, n in totals:
        size[k], count[k] = s, n
    used = np.flatnonzero(count)
    sums = np.concatenate(([0], np.cumsum(size[used])))
    shard = np.searchsorted(cuts(sums, 0, len(used), shards), np.arange(len(used)), "right")
    before = np.concatenate(([0], np.cumsum(count[used])))[:-1]
    first = np.searchsorted(shard, shard)
    offset = before - before[first] if len(used) else before
    part_rows = max(ROWS_A_PART, int(count.sum()) // MOST_PARTS)
    parts = -(-count[used] // part_rows)
    places = spark.createDataFrame([(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(used, shard, offset, parts, strict=True)], "__range int, shard int, __offset bigint, __parts int")
    placed = rows.join(F.broadcast(places), "__range").withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.col("__parts")).cast("int"))
    if (parts > 1).any():
        found = {(r[0], r[1]): r[2] for r in placed.where("__parts > 1").groupBy("__range", "__part").count().collect()}
        more, last, at = [], None, 0
        for (k, p), n in sorted(found.items()):
            at = at if k == last else 0
            more.append((k, p, at))
            last, at = k, at + n
        placed = placed.join(F.broadcast(spark.createDataFrame(more, "__range int, __part int, __more bigint")), ["__range", "__part"], "left")
    else:
        placed = placed.withColumn("__more", F.lit(0).cast("bigint"))
    order = Window.partitionBy("__range", "__part").orderBy("__hash", "text_crc32", "size", "doc_id")
    slot = F.col("__offset") + F.coalesce("__more", F.lit(0)) + F.row_number().over(order) - 1
    return placed.withColumn("slot", slot.cast("bigint")).select("doc_id", "size", "text_crc32", "shard", "slot")
