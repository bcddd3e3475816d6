"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new ones.

1. Sizes: every old shard's rows are cut into at most ``BLOCKS`` blocks of
   consecutive rows; a partial aggregate sums each block's bytes.
2. Flow: old shards supply their bytes, new shards take up to their capacity.
   Staying (old shard i into new shard i) costs nothing, moving costs one a
   byte through a pool node, so the network has about as many edges as shards.
   The primal-dual method solves it on the driver from the shards' totals alone.
3. Cuts: each old shard's flows become consecutive stretches of its blocks.
   There are at most old + 2 * new of them, and a stretch is known by its first
   row: that short list, broadcast, gives every row its shard and slot.
4. Rewrite: rows of affected shards are written, partitioned by new shard,
   straight from the scan (its rows are in order already: no shuffle). Shards
   that neither give nor take keep their files.

Skew: an old shard with a third of all rows is still at most ``BLOCKS`` blocks,
and nothing is collected by shard.

Defined results: a null text has size 1 (0 bytes and 1) and the crc of empty
text; sizes differ by at most a block for each stretch; empty tables give no
rows; repeated rows each keep a slot; other columns travel inside ``doc``, so
their names can't clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path

BLOCKS = 4096


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one: all supplies placed, fewest bytes moved.

    Nodes: source, old shards, pool, new shards, sink. Shortest paths give
    potentials; a blocking flow on the edges of zero reduced cost follows; there
    are as many rounds as there are distinct path costs."""
    n, m = len(supply), len(capacity)
    pool, sink = 1 + n, 2 + n + m
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def edge(a: int, b: int, most: int, price: int) -> int:
        for x, y, c, p in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    total = sum(supply)
    stays, gives, takes = {}, {}, {}
    for i, s in enumerate(supply):
        edge(0, 1 + i, s, 0)
        if i < m:
            stays[i] = edge(1 + i, 2 + n + i, total, 0)
        gives[i] = edge(1 + i, pool, total, 1)
    for j, c in enumerate(capacity):
        takes[j] = edge(pool, 2 + n + j, total, 0)
        edge(2 + n + j, sink, c, 0)
    height = [0] * (sink + 1)
    while True:
        far, done = {0: 0}, set()
        heap = [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in out[x]:
                if room[e] > 0:
                    y, z = to[e], d + cost[e] + height[x] - height[to[e]]
                    if z < far.get(y, z + 1):
                        far[y] = z
                        heapq.heappush(heap, (z, y))
        if sink not in far:
            break
        height = [h + far.get(x, far[sink]) for x, h in enumerate(height)]
        while True:  # blocking flows by breadth-first levels over edges of zero reduced cost
            level, queue = {0: 0}, [0]
            for x in queue:
                for e in out[x]:
                    y = to[e]
                    if room[e] > 0 and y not in level and cost[e] + height[x] - height[y] == 0:
                        level[y] = level[x] + 1
                        queue.append(y)
            if sink not in level:
                break
            nxt = [0] * (sink + 1)
            path: list[int] = []
            x = 0
            while True:
                if x == sink:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    path, x = [], 0
                    continue
                while nxt[x] < len(out[x]):
                    e = out[x][nxt[x]]
                    if room[e] > 0 and level.get(to[e], -1) == level[x] + 1 and cost[e] + height[x] - height[to[e]] == 0:
                        break
                    nxt[x] += 1
                if nxt[x] < len(out[x]):
                    path.append(out[x][nxt[x]])
                    x = to[path[-1]]
                elif path:
                    x = to[path.pop() ^ 1]
                    nxt[x] += 1
                else:
                    break
    flow = {(i, i): room[e ^ 1] for i, e in stays.items() if room[e ^ 1]}
    # what goes through the pool is dealt out in order
    want = [[j, room[e ^ 1]] for j, e in takes.items() if room[e ^ 1]]
    k = 0
    for i, e in gives.items():
        left = room[e ^ 1]
        while left:
            step = min(left, want[k][1])
            j = want[k][0]
            flow[i, j] = flow.get((i, j), 0) + step
            left -= step
            want[k][1] -= step
            k += not want[k][1]
    return flow


@dataclass
class Stretch:
    old: int
    first: int      # row of the old shard
    shard: int
    base: int       # slot of its first row
    rows: int
    size: int


def old_layout(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The table at ``path`` as (old, row, doc): old shard = its file by name, row = its place there."""
    read = spark.read.parquet(path)
    at = read.select(F.col("_metadata.file_path").alias("f")).distinct().orderBy("f").collect()  # one entry a file
    files = [r.f for r in at]
    number = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "f string, old int")
    rows = read.select(F.struct(*[F.col(f"`{c}`") for c in read.columns]).alias("doc"),
                       F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("row"))
    return rows.join(F.broadcast(number), "f").select("old", "row", "doc"), files  # a file's name and number: metadata the driver has


def plan(rows: DataFrame, old_shards: int, new_shards: int, capacity: list[int] | None = None) -> list[Stretch]:
    """Stretches of old shards and where they go; capacity: bytes of each new shard (default: equal)."""
    spark = rows.sparkSession
    n = {r.old: r.n for r in rows.groupBy("old").agg((F.max("row") + 1).alias("n")).collect()}
    per = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, max(1, -(-v // BLOCKS)))]) if n else F.lit(None)
    if not n:
        return []
    size = F.coalesce(F.octet_length("doc.text"), F.lit(0)).cast("long") + 1
    blocks = (rows.select("old", "row", size.alias("size"), F.floor(F.col("row") / per[F.col("old")]).alias("block"))
              .groupBy("old", "block").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("row").alias("first")))
    before = F.sum("size").over(Window.partitionBy("old").orderBy("block")) - F.col("size")  # at most BLOCKS rows a partition
    blocks = blocks.withColumn("middle", before + F.col("size") / 2).checkpoint()
    supply = [0] * old_shards
    for r in blocks.groupBy("old").agg(F.sum("size").alias("size")).collect():
        supply[r.old] = r["size"]
    total = sum(supply)
    if capacity is None:
        capacity = [total * (j + 1) // new_shards - total * j // new_shards for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity)
    spans, at = [], [0] * old_shards
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):  # what stays comes first
        spans.append((i, at[i], at[i] + amount, j))
        at[i] += amount
    wanted = spark.createDataFrame(spans, "o int, lo long, hi long, shard int")
    cut = (blocks.join(F.broadcast(wanted), (F.col("old") == F.col("o")) & (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")))
           .groupBy("old", "shard").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.sum("size").alias("size"))
           .orderBy("shard", "old").collect())  # at most old + 2 * new rows
    used = [0] * new_shards
    found = []
    for r in cut:
        found.append(Stretch(r.old, r["first"], r.shard, used[r.shard], r["rows"], r["size"]))
        used[r.shard] += r["rows"]
    return found


def reshard(rows: DataFrame, stretches: list[Stretch], out: str) -> DataFrame:
    """Rewrite the affected shards under ``out`` and return all rows in their new places:
    doc, size, text_crc32, shard, slot."""
    spark = rows.sparkSession
    places = spark.createDataFrame([(s.old, s.first, s.first + s.rows, s.shard, s.base) for s in stretches],
                                   "o int, lo long, hi long, shard int, base long")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    placed = (rows.join(F.broadcast(places), (F.col("old") == F.col("o")) & (F.col("row") >= F.col("lo")) & (F.col("row") < F.col("hi")))
              .select("doc", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                      "shard", (F.col("base") + F.col("row") - F.col("lo")).alias("slot")))
    gives = {s.old for s in stretches if s.shard != s.old}
    takes = {s.shard for s in stretches if s.shard != s.old}
    same = sorted({s.shard for s in stretches} - gives - takes)  # these keep their files
    affected = placed.where(~F.col("shard").isin(same)) if same else placed
    affected.write.partitionBy("shard").parquet(out)
    schema = affected.schema
    moved = spark.read.schema(schema).parquet(out).select(*placed.columns)
    return moved.unionByName(placed.where(F.col("shard").isin(same))) if same else moved


def reshard_files(spark: SparkSession, path: str, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of the table at ``path``."""
    rows, files = old_layout(spark, path)
    stretches = plan(rows, max(len(files), 1), shards)
    if not stretches:
        return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    placed = reshard(rows, stretches, scratch_path(spark, "resharded"))
    return placed.select(F.col("doc.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
                         F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
