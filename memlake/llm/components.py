"""Connected components by minimum-label propagation with pointer jumping, all as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.scratch import counted, cut, discard, join_hot, rows_of


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over undirected ``edges``.

    Nodes without an edge do not appear.  Each round every node takes the least label among itself
    and its neighbours, then the label of its label; a component of diameter d needs about log d
    rounds.  Labels are pre-aggregated before each shuffle and the edges of a node with very many
    neighbours are dealt out, so a hub costs no single task more than its share.  Null ends are ignored.
    """
    both = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    both = cut(
        both.select(F.col(src).alias("node"), F.col(dst).alias("near"))
        .union(both.select(F.col(dst).alias("node"), F.col(src).alias("near")))
        .distinct(),
        "cc-edges",
    )
    labels = counted(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "cc-0")
    nodes = rows_of(labels)  # the same in every round
    while True:
        heard = (
            join_hot(both, labels.select(F.col("node").alias("near"), "label"), ["near"], rows=nodes)
            .groupBy("node").agg(F.min("label").alias("heard"))
        )
        met = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("met")
        )
        jump = labels.select(F.col("node").alias("met"), F.col("label").alias("further"))
        after = counted(
            join_hot(met, jump, ["met"], "left", rows=nodes).select(
                "node", "old", F.least("met", F.coalesce("further", "met")).alias("label")
            ),
            "cc", moved=F.count_if(F.col("label") != F.col("old")),
        )
        discard(labels)
        labels = after
        if not after.scratch_seen["moved"]:
            discard(both)
            found = labels.select("node", "label")
            found.scratch_rows = nodes
            return found


def extend_components(labels: DataFrame | None, edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``labels`` (node, label) as they are once ``edges`` are there as well.

    Only components that an edge joins are looked at: each is one node, its label, of a smaller graph.
    """
    if labels is None:
        return connected_components(edges, src, dst)
    ends = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).where("node is not null").distinct()
    ends = counted(ends.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("fresh")), "cc-ends")
    known = rows_of(ends)
    joined = join_hot(edges.select(F.col(src).alias("node"), F.col(dst).alias("far")), ends.select("node", "label"), ["node"], rows=known)
    joined = joined.select(F.col("label").alias("a"), F.col("far").alias("node"))
    joined = join_hot(joined, ends.select("node", "label"), ["node"], rows=known).select("a", F.col("label").alias("b")).where("a <> b").distinct()
    moved = connected_components(cut(joined, "cc-joined"))
    every = labels.select("node", "label").union(ends.where("fresh").select("node", "label"))
    renamed = moved.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return cut(join_hot(every, renamed, ["label"], "left", rows=rows_of(moved)).select("node", F.coalesce("least", "label").alias("label")), "cc-labels")
