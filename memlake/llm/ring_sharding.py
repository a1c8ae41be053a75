"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is a circle of ``CELLS`` equal arcs.  Every shard owns virtual nodes at hashed places; a key
belongs to the first node clockwise from its hash.  A shard takes keys up to its capacity; the keys
beyond go on clockwise to the next shard with room.  Capacities add up to the number of rows, so the
counts of two shards differ by one at most, and only overflowing keys leave their home.

Placing works on counts by arc, whose number is fixed by the ring: each arc's rows are cut into runs
(shard, first place, first slot), and a row finds its run by its rank in the arc.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.scratch import cut

CELLS = 1 << 12
VIRTUAL = 64
RUN_ROWS = 1 << 18


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, list[int]]]:
    """For each cell: the shard of the first virtual node clockwise, and all shards in clockwise order.

    A parameter table of fixed size; of two nodes in one cell the lower shard comes first.
    """
    nodes = sorted(
        (xxhash.xxh64_intdigest(f"shard {s} node {v}") % CELLS, s) for s in range(shards) for v in range(virtual)
    )
    out, first = [], 0
    for cell in range(CELLS):
        while first < len(nodes) and nodes[first][0] < cell:
            first += 1
        walk: dict[int, None] = {}
        for k in range(len(nodes)):
            walk[nodes[(first + k) % len(nodes)][1]] = None
            if len(walk) == shards:
                break
        out.append((cell, list(walk)))
    return out


def shard_rows(rows: DataFrame, key: str, shards: int, virtual: int = VIRTUAL) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard).

    Law ``rows``: counts of any two shards differ by at most one.  Any row has a place: null keys hash
    like a value, and repeated keys (or whole rows) share an arc, whose overflow other shards take, so
    one key may hold any share of the rows.  ``key`` names the column whose hash places a row; all
    columns are kept, whatever their names, but none may be called shard or slot.
    """
    if taken := {c.lower() for c in rows.columns} & {"shard", "slot"}:
        raise ValueError(f"rows already have columns {sorted(taken)}")
    spark = rows.sparkSession
    cell = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(CELLS)).cast("int")
    # an arc's rows are ranked in about equal parts of at most RUN_ROWS, so a hot key is as many tasks' work
    parts = rows.select(cell.alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / RUN_ROWS).alias("parts"))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), cell.alias("cell"))
    # the part of a row is written down, so later reads see the same one
    placed = cut(
        packed.join(F.broadcast(cut(parts, "parts")), "cell")
        .select("row", "cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).alias("salt")),
        "placed",
    )
    loads = placed.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    loads = cut(loads, "loads")  # one row for each cell, and one more for each RUN_ROWS rows
    table = json.dumps([{"cell": cell, "walk": walk} for cell, walk in ring(shards, virtual)])
    walks = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<cell:int,walk:array<int>>>")))
    arcs = (
        walks.join(F.broadcast(loads.groupBy("cell").agg(F.sum("n").alias("n"))), "cell", "left")
        .select("cell", "walk", F.coalesce("n", F.lit(0)).alias("n"), F.element_at("walk", 1).alias("home"))
    )
    # capacities: the remainder goes to the shards with most rows at home, which moves least
    total = arcs.agg(F.sum("n").alias("total"))
    homes = (
        spark.range(shards).select(F.col("id").cast("int").alias("home"))
        .join(F.broadcast(arcs.groupBy("home").agg(F.sum("n").alias("load"))), "home", "left")
        .crossJoin(F.broadcast(total))
        .select("home", F.coalesce("load", F.lit(0)).alias("load"), F.coalesce("total", F.lit(0)).alias("total"))
    )
    by_load = Window.partitionBy().orderBy(F.col("load").desc(), "home")
    limits = homes.select(
        "home", F.least("load", F.expr(f"total div {shards}") + (F.row_number().over(by_load) <= F.expr(f"total % {shards}")).cast("bigint")).alias("stay"),
        (F.expr(f"total div {shards}") + (F.row_number().over(by_load) <= F.expr(f"total % {shards}")).cast("bigint")).alias("capacity"),
    )
    # home: arcs in ring order fill their shard up to its capacity
    along = Window.partitionBy("home").orderBy("cell")
    settled = (
        arcs.join(F.broadcast(limits), "home")
        .withColumn("before", F.sum("n").over(along) - F.col("n"))
        .withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("capacity") - F.col("before"))))
    )
    settled = cut(settled, "settled")  # CELLS rows
    stays = settled.where("kept > 0").select(
        "cell", F.col("home").alias("shard"), F.lit(0).cast("bigint").alias("first"), F.col("kept").alias("run"), F.col("before").alias("start")
    )
    # overflow: arcs in ring order walk clockwise over the room that is left, one fold over CELLS rows
    room = limits.agg(F.array_sort(F.collect_list(F.struct("home", (F.col("capacity") - F.col("stay")).alias("free"), F.col("stay").alias("used")))).alias("room"))
    spill = settled.where("n > kept").agg(
        F.array_sort(F.collect_list(F.struct("cell", "kept", (F.col("n") - F.col("kept")).alias("left"), "walk"))).alias("spill")
    )
    empty = "cast(array() as array<struct<cell:int,shard:int,first:bigint,run:bigint,start:bigint>>)"
    free = "element_at(s.free, shard + 1)"
    take = f"least(s.left, {free})"
    fold = f"""
      aggregate(spill, struct(transform(room, r -> r.free) as free, transform(room, r -> r.used) as used, {empty} as runs),
        (state, arc) -> aggregate(arc.walk,
          struct(state.free as free, state.used as used, state.runs as runs, arc.left as left, arc.kept as first),
          (s, shard) -> if(s.left = 0 or {free} = 0, s, struct(
            transform(s.free, (f, i) -> if(i = shard, f - {take}, f)) as free,
            transform(s.used, (u, i) -> if(i = shard, u + {take}, u)) as used,
            concat(s.runs, array(struct(arc.cell as cell, shard as shard, s.first as first, {take} as run, element_at(s.used, shard + 1) as start))) as runs,
            s.left - {take} as left, s.first + {take} as first)),
          s -> struct(s.free as free, s.used as used, s.runs as runs)),
        state -> state.runs)"""
    moved = spill.crossJoin(room).select(F.explode(F.expr(fold)).alias("r")).select("r.*")
    runs = cut(stays.unionByName(moved), "runs")
    by_cell = runs.groupBy("cell").agg(F.collect_list(F.struct("shard", "first", "run", "start")).alias("runs"))
    offsets = loads.select(
        "cell", "salt", (F.sum("n").over(Window.partitionBy("cell").orderBy("salt")) - F.col("n")).alias("offset")
    )
    guide = offsets.join(F.broadcast(by_cell), "cell")  # as many rows as loads
    rank = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("row")) - 1
    found = (
        placed.withColumn("rank", rank)
        .join(F.broadcast(guide), ["cell", "salt"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .withColumn("run", F.expr("filter(runs, r -> rank >= r.first and rank < r.first + r.run)[0]"))
    )
    return found.select(
        "row.*", F.col("run.shard").alias("shard"),
        (F.col("run.start") + F.col("rank") - F.col("run.first")).alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs(doc_id, text)``.

    size is the UTF-8 bytes of the text plus 1 (a null text has none: 1, and the CRC of no bytes).
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_rows(rows, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
