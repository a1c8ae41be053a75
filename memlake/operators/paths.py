"""Multi-probe path retrieval: anchors, probe composition, paths and their scores.

Anchors and compositions are joins of a few probes with all claims and sums by claim.  Paths run on the
claims graph as frontier joins; the walk of one query is bounded by its anchors and its depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import vector
from memlake.operators import filters
from memlake.plans.scratch import broadcast_if_small, cut

TAU, TOP = 0.2, 5
# The cost of a hop in time, and the weights of a path's parts.
TEMPORAL_COST = 0.5
PATH_WEIGHTS = {"coverage": 1.0, "diversity": 0.3, "recency": 0.1, "quality": 0.0, "length": 0.1}


#: All edges (src, dst, kind, weight), or a function of nodes (id) that gives those that touch one of them, or,
#: if its second argument is true, those with both ends among them.
Edges = DataFrame | Callable[[DataFrame, bool], DataFrame]


def edges_at(edges: Edges, nodes: DataFrame, inside: bool) -> DataFrame:
    if callable(edges):
        return edges(nodes, inside)
    few = broadcast_if_small(nodes)
    src, dst = (edges.join(few.withColumnRenamed("id", end), end, "left_semi").select(*edges.columns) for end in ("src", "dst"))
    if inside:
        return src.join(few.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    return src.unionByName(dst.join(few.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns))


def edges_between(edges: Edges, anchors: DataFrame, valid: DataFrame, depth: int) -> DataFrame:
    """The edges that a walk of at most ``depth`` edges between two of ``anchors(id)`` can take, through ``valid(id)`` nodes.

    A node of such a walk is no more than half of its edges away from one of its ends, so what lies
    further from all anchors is not read.
    """
    ball = cut(anchors.select("id").distinct(), "ball")
    for _ in range(depth // 2):
        touching = edges_at(edges, ball, False)
        ends = touching.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(valid.select("id"), "id", "left_semi")
        ball = cut(ends.unionByName(ball).distinct(), "ball")
    return cut(edges_at(edges, ball, True), "between")


def probe_scores(claims: DataFrame, probes: DataFrame, similarity=None) -> DataFrame:
    """(probe, weight, id, sim) of each claim with a vector for each of the (few, broadcast) probes.

    ``similarity`` makes an expression of two vector columns; cosine if it is not given.
    """
    likeness = similarity or vector.cosine
    few = F.broadcast(probes.select("probe", "weight", F.col("embedding").alias("query")))
    return claims.where("embedding is not null").select("id", "embedding").crossJoin(few).select(
        "probe", "weight", "id", F.round(likeness(F.col("embedding"), F.col("query")), 6).alias("sim")
    )


def session_weights(probes: DataFrame, tau: float | None) -> DataFrame:
    """Probe weights that decay with turns: e^(-(last turn - turn) / tau); 1 without tau."""
    if tau is None:
        return probes.withColumn("weight", F.lit(1.0))
    last = F.max("turn").over(Window.partitionBy("session"))
    return probes.withColumn("weight", F.exp(-(last - F.col("turn")) / F.lit(float(tau))))


def per_probe_top(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` claims of each probe by ``sim``, ties by id."""
    order = Window.partitionBy("probe").orderBy(F.col("sim").desc(), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    return rows.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id").limit(top)


def idf_mass_anchor(scored: DataFrame, mass: DataFrame, alpha: float, top: int = TOP) -> DataFrame:
    """Per probe: sim * (1 + alpha * mass / largest mass); alpha 0 is plain cosine."""
    most = mass.agg(F.max("mass").alias("most"))
    joined = scored.join(mass, "id", "left").crossJoin(F.broadcast(most))
    share = F.coalesce(F.col("mass") / F.col("most"), F.lit(0.0))
    return per_probe_top(joined.withColumn("sim", F.round(F.col("sim") * (1 + alpha * share), 6)), top)


def density(scored: DataFrame, tau: float = TAU, top: int = TOP, exponent: float = 1.0) -> DataFrame:
    """Sum of weight * max(0, sim - tau), times exponent^(probes above tau - 1); exponent 1 is plain."""
    over = F.greatest(F.col("sim") - tau, F.lit(0.0))
    rows = scored.groupBy("id").agg(F.sum(F.col("weight") * over).alias("mass"), F.count_if(over > 0).alias("n"))
    return _ranked(rows.where("mass > 0").select("id", (F.col("mass") * F.pow(F.lit(float(exponent)), F.col("n") - 1)).alias("score")), top)


def min_gate(scored: DataFrame, tau: float = TAU, top: int = TOP) -> DataFrame:
    """Claims over ``tau`` for every probe, by their least similarity and a hair of the sum."""
    rows = scored.groupBy("id").agg(
        F.min("sim").alias("least"), F.sum("sim").alias("total"), F.count_if(F.col("sim") > tau).alias("n"), F.count(F.lit(1)).alias("probes")
    )
    return _ranked(rows.where("n = probes").select("id", (F.col("least") + 1e-6 * F.col("total")).alias("score")), top)


def idf_fusion(scored: DataFrame, mass: DataFrame, alpha: float, tau: float = TAU, top: int = TOP) -> DataFrame:
    """Density times (1 + alpha * mass / largest mass)."""
    most = mass.agg(F.max("mass").alias("most"))
    rows = density(scored, tau, 2_000_000_000).join(mass, "id", "left").crossJoin(F.broadcast(most))
    return _ranked(rows.select("id", (F.col("score") * (1 + alpha * F.coalesce(F.col("mass") / F.col("most"), F.lit(0.0)))).alias("score")), top)


def reciprocal_rank(scored: DataFrame, k: int = 60, depth: int = 50, top: int = TOP) -> DataFrame:
    """Fusion of per-probe (or per-encoder) lists by the sum of 1 / (k + rank)."""
    rows = per_probe_top(scored, depth).groupBy("id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("place"))).alias("score"))
    return _ranked(rows, top)


def compose_union(anchors: DataFrame) -> DataFrame:
    """(id, probes): which probes reached each claim."""
    return anchors.groupBy("id").agg(F.array_sort(F.collect_set("probe")).alias("probes"))


def compose_intersection(anchors: DataFrame) -> DataFrame:
    """Claims whose probes hold half of all weight; if there are none, the union."""
    total = anchors.select("probe", "weight").distinct().agg(F.sum("weight").alias("total"))
    rows = anchors.groupBy("id").agg(F.array_sort(F.collect_set("probe")).alias("probes"), F.sum("weight").alias("held")).crossJoin(F.broadcast(total))
    strong = F.col("held") >= 0.5 * F.col("total")
    any_strong = rows.agg(F.max(strong.cast("int")).alias("any"))
    return rows.crossJoin(F.broadcast(any_strong)).where(strong | (F.col("any") == 0)).select("id", "probes")


def compose_fusion(scored: DataFrame, tau: float = TAU, top: int = TOP) -> DataFrame:
    """Claims by density over all probes; a single probe has nothing to fuse and ranks by similarity."""
    probes = F.broadcast(scored.agg(F.countDistinct("probe").alias("probes")))
    fused = density(scored, tau, top).crossJoin(probes).where("probes > 1")
    single = scored.select("id", F.col("sim").alias("score")).crossJoin(probes).where("probes = 1")
    return fused.select("id", "score").unionByName(_ranked(single, top).select("id", "score"))


def walk_costs(edges: DataFrame, by_weight: bool = False, temporal: float = TEMPORAL_COST, decay: bool = False, hot: DataFrame | None = None, cold: float = 1.0) -> DataFrame:
    """``edges(src, dst, kind, weight)`` with the ``cost`` of a hop: 1 each, or by weight.

    By weight a hop costs what its weight lacks of 1, and never less than 0; a temporal hop costs
    ``temporal``, times what its weight lacks if weights ``decay`` with time.  Edges that are not among
    the ``hot(src, dst, kind)`` ones, in this direction, cost ``cold`` times as much.
    """
    if not by_weight:
        return edges.withColumn("cost", F.lit(1.0))
    lack = F.greatest(F.lit(0.0), 1 - F.col("weight"))
    along = F.lit(float(temporal)) * (lack if decay else F.lit(1.0))
    rows = edges.withColumn("cost", F.when(F.col("kind") == "temporal", along).otherwise(lack))
    if hot is None or cold == 1.0:
        return rows
    known = hot.select("src", "dst", "kind", F.lit(True).alias("hot")).distinct()
    rows = rows.join(known, ["src", "dst", "kind"], "left")
    return rows.withColumn("cost", F.when(F.col("hot"), F.col("cost")).otherwise(F.col("cost") * F.lit(float(cold)))).drop("hot")


def shortest_paths(edges: DataFrame, anchors: DataFrame, depth: int = 3) -> DataFrame:
    """(anchor, id, cost, hops, nodes, kinds, weights): least-cost simple walks of at most ``depth`` edges.

    ``edges(src, dst, cost)``, with ``kind`` and ``weight`` if they have them, are used both ways.  Each
    round extends the frontier by one join and keeps the best walk to each node (cost, then hops, then
    node list); for unit costs this is a breadth-first search, for others Dijkstra within the hop bound.
    """
    kind = F.col("kind") if "kind" in edges.columns else F.lit("edge")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select("src", "dst", F.struct(F.col("cost").cast("double").alias("cost"), kind.alias("kind"), weight.alias("weight")).alias("step"))
    both = rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "step"))
    both = both.groupBy("src", "dst").agg(F.min("step").alias("step"))
    best = cut(
        anchors.select(
            F.col("id").alias("anchor"), "id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("id").alias("nodes"),
            F.array().cast("array<string>").alias("kinds"), F.array().cast("array<double>").alias("weights"),
        ), "paths"
    )
    frontier = best
    for level in range(1, depth + 1):
        longer = (
            frontier.alias("f").join(both.alias("e"), F.col("f.id") == F.col("e.src"))
            .where(~F.array_contains("f.nodes", F.col("e.dst")))
            .select("f.anchor", F.col("e.dst").alias("id"), F.round(F.col("f.cost") + F.col("e.step.cost"), 9).alias("cost"),
                    F.lit(level).alias("hops"), F.array_append("f.nodes", F.col("e.dst")).alias("nodes"),
                    F.array_append("f.kinds", F.col("e.step.kind")).alias("kinds"), F.array_append("f.weights", F.col("e.step.weight")).alias("weights"))
        )
        rank = F.struct("cost", "hops", "nodes", "kinds", "weights")
        merged = best.unionByName(longer).groupBy("anchor", "id").agg(F.min(rank).alias("m")).select("anchor", "id", "m.*")
        best = cut(merged, "paths")
        frontier = best.where(F.col("hops") == level)
    return best


def pair_paths(paths: DataFrame, anchors: DataFrame) -> DataFrame:
    """Paths between two different anchors, each once by its set of nodes, and each anchor alone."""
    ends = anchors.select(F.col("id"))
    kept = paths.join(ends, "id", "left_semi").where("anchor <= id")
    key = F.array_join(F.array_sort(F.col("nodes").cast("array<string>")), ",")
    order = Window.partitionBy("key").orderBy("cost", "anchor", "id")
    return kept.withColumn("key", key).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "key")


def score_paths(paths: DataFrame, reached: DataFrame, claims: DataFrame, probes: DataFrame, depth: int = 3, top: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """The ``top`` paths with their score and its parts, each between 0 and 1.

    coverage: the weight of ``probes(probe, weight)`` that reached a node of the path (``reached``: id,
    probes), of all weight; diversity: kinds of edges, of three; recency: the latest valid_from on the
    path, of the latest of ``claims``; quality: mean edge weight; length: hops that do not lead to a
    further anchor, of ``depth``, which counts against the path.
    """
    weights = {**PATH_WEIGHTS, **(weights or {})}
    latest = claims.agg(F.greatest(F.max("valid_from"), F.lit(0)).alias("latest"))
    total = probes.agg(F.sum("weight").alias("total"))
    nodes = paths.select("anchor", "id", F.explode("nodes").alias("node"))
    seen = nodes.join(reached.select(F.col("id").alias("node"), "probes"), "node", "left").join(claims.select(F.col("id").alias("node"), "valid_from"), "node", "left")
    facts = seen.groupBy("anchor", "id").agg(
        F.array_distinct(F.flatten(F.collect_list("probes"))).alias("met"), F.count("probes").alias("anchors"), F.greatest(F.max("valid_from"), F.lit(0)).alias("last")
    )
    held = facts.select("anchor", "id", F.explode("met").alias("probe")).join(F.broadcast(probes.select("probe", "weight")), "probe")
    held = held.groupBy("anchor", "id").agg(F.sum("weight").alias("held"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    idle = F.greatest(F.lit(0), F.col("hops") - F.greatest(F.lit(0), F.col("anchors") - 1))
    summed = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    parts = {
        "coverage": ratio(F.coalesce("held", F.lit(0.0)), F.col("total")), "diversity": F.size(F.array_distinct("kinds")) / 3.0,
        "recency": ratio(F.col("last"), F.col("latest")), "quality": ratio(summed, F.size("weights")), "length": idle / float(max(1, depth)),
    }
    rows = paths.join(facts, ["anchor", "id"]).join(held, ["anchor", "id"], "left").crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(total))
    rows = rows.select("anchor", "id", "hops", "nodes", "kinds", *[F.round(c, 6).alias(n) for n, c in parts.items()])
    score = sum((F.lit(float(weights[n])) * F.col(n) * (-1 if n == "length" else 1) for n in parts), F.lit(0.0))
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.col("score").desc(), "anchor", "id").limit(top)


def best_by_claim(scored: DataFrame) -> DataFrame:
    """(id, score): each claim at the score of the best path that holds it."""
    return scored.select(F.explode("nodes").alias("id"), "score").groupBy("id").agg(F.max("score").alias("score"))


def hot_edges(log: DataFrame, top: int) -> DataFrame:
    """The ``top`` edges (src, dst, kind) of an access log by count, ties by ends and kind."""
    counts = log.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "src", "dst", "kind").limit(top).select("src", "dst", "kind")


def cluster_affinity(scored: DataFrame, claim_clusters: DataFrame, probe_clusters: DataFrame, beta: float, tau: float = TAU, top: int = TOP) -> DataFrame:
    """Density times (1 + beta * the best likeness of a claim's soft clusters to a probe's).

    The clusters are (id, cluster, share) and (probe, cluster, share); likeness is the cosine of shares.
    """
    length = lambda c, key: c.groupBy(key).agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias(f"{key}_norm"))
    few = F.broadcast(probe_clusters.join(length(probe_clusters, "probe"), "probe").select("probe", "cluster", F.col("share").alias("probe_share"), "probe_norm"))
    dots = claim_clusters.join(few, "cluster").groupBy("id", "probe").agg(
        F.sum(F.col("share") * F.col("probe_share")).alias("dot"), F.first("probe_norm").alias("probe_norm")
    )
    like = dots.join(length(claim_clusters, "id"), "id").groupBy("id").agg(F.max(F.col("dot") / (F.col("probe_norm") * F.col("id_norm"))).alias("like"))
    over = F.greatest(F.col("sim") - tau, F.lit(0.0))
    mass = scored.groupBy("id").agg(F.sum(F.col("weight") * over).alias("mass")).where("mass > 0").join(like, "id", "left")
    return _ranked(mass.select("id", (F.col("mass") * (1 + beta * F.greatest(F.coalesce("like", F.lit(0.0)), F.lit(0.0)))).alias("score")), top)


def retrieve(
    claims: DataFrame, edges: Edges, probes: DataFrame, at_ms: int | None = None, anchors: int = TOP, depth: int = 3, top: int = 10,
    by_weight: bool = False, tau: float = TAU, session_tau: float | None = None, temporal: float = TEMPORAL_COST, decay: bool = False,
    hot: DataFrame | None = None, cold: float = 1.0, weights: dict[str, float] | None = None, similarity=None,
) -> DataFrame:
    """Probes to scored paths: the claims valid at ``at_ms`` (None: open ones), probe weights, anchors,
    the best walk between each two anchors and each anchor alone, and the ``top`` of them by score.

    ``claims``: id, embedding, valid_from, valid_to; ``edges``: src, dst, kind, weight, or a function that
    gives them (``Edges``), as only those near the anchors are read; ``probes``: probe, embedding, and turn and session where ``session_tau`` is set.  With several probes the anchors are
    the densest claims over ``tau``, each reached by the probes over it, and where none is over it those
    that a single probe would take; a single probe takes the nearest claims.  Without probes or claims
    there is no path.
    """
    valid = filters.as_of(claims, at_ms).select("id", "embedding", "valid_from")
    weighted = session_weights(probes, session_tau)
    scored = cut(probe_scores(valid, weighted, similarity), "scored")
    nearest = compose_union(per_probe_top(scored, anchors))
    several = F.broadcast(weighted.agg(F.count(F.lit(1)).alias("probes_n")))
    dense = density(scored, tau, anchors).select("id")
    fused = compose_union(scored.where(F.col("sim") > tau).join(F.broadcast(dense), "id", "left_semi"))
    fused = cut(fused.crossJoin(several).where("probes_n > 1").select("id", "probes"), "anchors")
    reached = nearest if fused.isEmpty() else fused
    reached = cut(reached, "anchors")
    near = edges_between(edges, reached, valid, depth)
    walks = shortest_paths(walk_costs(near, by_weight, temporal, decay, hot, cold), reached.select("id"), depth)
    return score_paths(pair_paths(walks, reached), reached, valid, weighted.select("probe", "weight"), depth, top, weights)


def spread_activation(edges: Edges, seeds: DataFrame, hops: int = 2, retention: float = 0.5, inhibit: int | None = None) -> DataFrame:
    """(id, activation): each round a node keeps a share and spreads the rest over its edges, diluted by
    its fan-out and by weight; then only the ``inhibit`` strongest stay active (None: all).

    A round reads the edges that touch an active node (``Edges``), and no others.
    """
    active = cut(seeds.select("id", F.col("activation").cast("double")), "activation")
    for _ in range(hops):
        ids = cut(active.select("id").distinct(), "active")
        touching = cut(edges_at(edges, ids, False).select("src", "dst", "weight"), "touching")
        both = touching.unionByName(touching.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        both = both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        fan = both.groupBy("src").agg(F.sum("weight").alias("fan"))
        flow = both.join(fan, "src").select("src", "dst", (F.col("weight") / F.col("fan")).alias("share"))
        sent = active.join(flow, active.id == flow.src).select(F.col("dst").alias("id"), (F.col("activation") * F.col("share") * (1 - retention)).alias("activation"))
        kept = active.select("id", (F.col("activation") * retention).alias("activation"))
        active = kept.unionByName(sent).groupBy("id").agg(F.round(F.sum("activation"), 9).alias("activation"))
        if inhibit is not None:
            active = active.orderBy(F.col("activation").desc(), "id").limit(inhibit)
        active = cut(active, "activation")
    return active


def natural_probes(queries: DataFrame, tokens) -> DataFrame:
    """One probe for each content token of a natural query, in order."""
    return queries.select("query_id", F.posexplode(tokens).alias("place", "probe"))


def view_weights(text_column) -> dict:
    """Weights of the temporal, lexical and semantic views for a question, none under 0.2, summing to 1."""
    from memlake.functions.text import temporal_signal

    time = F.when(temporal_signal(text_column), F.lit(0.5)).otherwise(F.lit(0.2))
    quoted = F.when(text_column.rlike("[\"'][^\"']+[\"']|[A-Z][a-z]+ [A-Z]"), F.lit(0.4)).otherwise(F.lit(0.2))
    meaning = F.lit(0.4)
    total = time + quoted + meaning
    return {"temporal": time / total, "lexical": quoted / total, "semantic": meaning / total}
