"""Edges kept up while claims arrive: each batch adds or rewires what it touches, and no more.

After any split of the claims into batches the edges are those of one batch with all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import graph
from memlake.plans.scratch import broadcast_if_small, cut

MOST_PARTS = 16


@dataclass(frozen=True)
class Kept:
    """All claims so far, their vectors' edges (a, b, weight), their chains (src, dst, delta_t, weight and the
    chain's columns), and the pairs (a, b) that share a token, where claims have tokens.  The vectors' edges
    lie in ``parts`` tables, one for each batch since they were last written together."""

    claims: DataFrame
    semantic: DataFrame
    temporal: DataFrame
    sharing: DataFrame | None
    parts: int = 1


def add_claims(new: DataFrame, kept: Kept | None, by: Sequence[str], threshold: float = 0.65, tau_ms: float | None = None) -> Kept:
    """``kept`` with the claims ``new`` (id, embedding, valid_from, the columns ``by``, and tokens or not).

    Vectors: the new ones meet all others in the cells they reach.  Chains: those that get a new claim are
    linked anew, others are not read.  Tokens: pairs with a new claim are added; their weights follow
    the frequencies of all claims and so are computed when they are read (:func:`lexical_weights`).
    A claim that is there already, by its id, is not added again.
    """
    if kept is not None:
        new = new.join(kept.claims.select("id"), "id", "left_anti").select(*kept.claims.columns)
    new = cut(new.dropDuplicates(["id"]), "new-claims")
    claims = new if kept is None else cut(kept.claims.unionByName(new), "claims")
    fresh = new.select("id")
    semantic, parts = cut(graph.semantic_edges(claims.select("id", "embedding"), threshold, fresh), "semantic"), 1
    touched = cut(new.select(*by).distinct(), "touched")
    same = lambda rows: [rows[c].eqNullSafe(touched[c]) for c in by]
    near = broadcast_if_small(touched)
    chains = claims.join(near, same(claims), "left_semi")
    temporal = graph.temporal_chain(chains, *by, tau_ms=tau_ms)
    sharing = graph.sharing_pairs(claims, fresh) if "tokens" in claims.columns else None
    if kept is not None:
        # edges that are there already stay where they are
        semantic, parts = kept.semantic.unionByName(semantic), kept.parts + 1
        if parts > MOST_PARTS:
            semantic, parts = cut(semantic, "semantic"), 1
        temporal = kept.temporal.join(near, same(kept.temporal), "left_anti").unionByName(temporal)
        sharing = sharing if kept.sharing is None else kept.sharing.unionByName(sharing)
    return Kept(claims, semantic, cut(temporal, "temporal"), None if sharing is None else cut(sharing, "sharing"), parts)


def lexical_weights(kept: Kept, min_weight: float = 0.0) -> DataFrame:
    """(a, b, shared, weight) of the pairs that share a token, by the frequencies of all claims so far."""
    return graph.weigh_pairs(kept.sharing, graph.token_weights(kept.claims.select("id", "tokens")), min_weight)
