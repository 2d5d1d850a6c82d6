"""Longest-processing-time scheduling of groups of equal texts onto shards.

Sizes are summed per group before anything moves. Groups of one size are exchangeable, so what is
scheduled are classes of a size and a count, the largest size first: each next group of a class goes
to the least loaded shard. Loads within one size of each other take turns in a fixed order, so a
class of any count is a few runs of such turns. A group finds its shard by its rank in its class.
The result is that of scheduling all groups one by one. Sizes that differ add up to no more than
all bytes, so ``n`` bytes have at most ``sqrt(2 n)`` of them, and only these reach the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadrift.llm.common import shuffle_parts, slices
from cadrift.session import cut

PLACED = "doc_id long, size long, text_crc32 long, shard int, part int, local long"


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Largest first, each to the least loaded shard; ties by name and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def turns(loads: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """Runs (first rank, end, shards in turn) of ``count`` groups of one size; ``loads`` are brought up to date."""
    if count <= 64:
        heap = [(n, s) for s, n in enumerate(loads)]
        heapq.heapify(heap)
        order = []
        for _ in range(count):
            n, s = heap[0]
            order.append(s)
            heapq.heapreplace(heap, (n + size, s))
        for n, s in heap:
            loads[s] = n
        return [(0, count, order)]
    waiting = sorted((n, s) for s, n in enumerate(loads))
    active, out, done = [waiting.pop(0)], [], 0
    while done < count:
        if waiting:  # turns until the next shard is the least loaded
            n, s = waiting[0]
            each = [max(0, -(-(n - m) // size)) + (n >= m and (n - m) % size == 0 and k < s) for m, k in active]
            step = min(sum(each), count - done)
        else:
            step = count - done
        if step:
            cycle = [k for _, k in active]
            out.append((done, done + step, cycle))
            full, rest = divmod(step, len(cycle))
            active = sorted((m + size * (full + (i < rest)), k) for i, (m, k) in enumerate(active))
            done += step
        if waiting and done < count:
            active = sorted([*active, waiting.pop(0)])
    for n, s in [*active, *waiting]:
        loads[s] = n
    return out


def number_runs(batches):
    """Running number of the rows of each class in a sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in slices(batches, 1 << 16):
        size = b.column("bytes").to_numpy()
        first = np.append(True, size[1:] != size[:-1])
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        local = np.arange(len(size)) - start
        local[start == 0] += seen if size[0] == last else 0
        last, seen = size[-1], local[-1] + 1
        yield pa.RecordBatch.from_arrays([b.column("bytes"), b.column("key"), pa.array(np.full(len(size), part, np.int32)), pa.array(local)], names=["bytes", "key", "part", "local"])


def number(batches):
    """Running number of each shard's rows in a sorted partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in slices(batches, 1 << 16):
        shard = b.column("shard").to_numpy()
        local = np.empty(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            mine = np.flatnonzero(shard == s)
            local[mine] = seen.get(s, 0) + np.arange(len(mine))
            seen[s] = seen.get(s, 0) + len(mine)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
            names=["doc_id", "size", "text_crc32", "shard", "part", "local"])


def ranked_in_class(groups: DataFrame) -> DataFrame:
    """``bytes, key, rank``: place of each group among those of its size, by key; no task sorts a whole class."""
    order = ["bytes", "key"]
    numbered = cut(groups.select(*order).repartitionByRange(shuffle_parts(groups.sparkSession), *order).sortWithinPartitions(*order)
                   .mapInArrow(number_runs, "bytes long, key binary, part int, local long"))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("bytes", "part").agg(F.count("*").alias("n"))
               .select("bytes", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return numbered.join(offsets, ["bytes", "part"]).select("bytes", "key", (F.col("before") + F.col("local")).alias("rank"))


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs(doc_id, text)``.

    Size is the text's bytes plus one; a null text is empty. Equal texts share a shard; groups of one
    size are scheduled in the order of their text's hash. Slots number a shard's rows from 0 in
    ascending doc_id order, null ids first; repeated rows get a slot each. A very long text is a
    group as any other. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                           F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
                           F.monotonically_increasing_id().alias("row")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    classes = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()  # one row a size
    loads, dealt = [0] * shards, []
    for size, n in sorted(zip(classes.column("bytes").to_pylist(), classes.column("n").to_pylist()), reverse=True):
        dealt += [(size, *run) for run in turns(loads, size, n)]
    runs = spark.createDataFrame(pa.table(dict(zip(("bytes", "first", "end", "cycle"), map(list, zip(*dealt)))))) if dealt else spark.createDataFrame(
        [], "bytes long, first long, end long, cycle array<long>")
    at = F.get("cycle", F.pmod(F.col("rank") - F.col("first"), F.size("cycle")).cast("int")).cast("int")
    of_key = (ranked_in_class(groups).join(runs, "bytes").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
              .select("key", at.alias("shard")))
    placed = rows.join(of_key, "key")
    order = ["shard", "doc_id", "row"]
    numbered = cut(placed.select("doc_id", "size", "text_crc32", "shard", "row").repartitionByRange(shuffle_parts(spark), *order)
                   .sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "shard").mapInArrow(number, PLACED))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
               .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    return (numbered.join(F.broadcast(offsets), ["shard", "part"])  # one row per range and shard in it
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("local")).alias("slot")))
