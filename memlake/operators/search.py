"""Hybrid retrieval: vector, full-text and graph candidates, merged, filtered, re-ranked and enriched.

A search is one lazy plan.  As in any engine with a top-k per modality, the id, tag and domain
filters apply after each modality's own limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import scoring, text, vector
from memlake.operators import filters

FALLBACK_SCORE = 0.3
DIGITS = 6


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads: memories, and edges with in_id and out_id."""

    memory: DataFrame
    tagged: DataFrame | None = None
    owned: DataFrame | None = None
    references: DataFrame | None = None
    edges: Mapping[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class SearchQuery:
    mode: str = "hybrid"
    text: str | None = None
    vector: Sequence[float] | None = None
    tags: Sequence[str] = ()
    traversal: str | None = None
    start: Sequence[str] | DataFrame = ()
    ids: Sequence[str] = ()
    domains: Sequence[str] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    before: int | None = None
    after: int | None = None
    weights: Mapping[str, float] = field(default_factory=lambda: dict(scoring.WEIGHTS))
    min_score: float = 0.0
    limit: int = 10
    token_budget: int | None = None
    rerank: float | None = None


def _candidates(rows: DataFrame, score, mode: str, limit: int | None) -> DataFrame:
    rows = rows.select("id", F.round(score, DIGITS).alias(mode))
    return rows if limit is None else rows.orderBy(F.col(mode).desc(), "id").limit(limit)


def vector_search(memory: DataFrame, query: Sequence[float] | None, limit: int = 10, **where) -> DataFrame:
    """(id, vector): nearest by cosine; nothing without a query vector."""
    rows = filters.memory_filters(memory, **where).where("embedding is not null")
    if query is None:
        rows = rows.where(F.lit(False))
    return _candidates(rows, vector.cosine(F.col("embedding"), vector.literal(query or [])), "vector", limit)


def fulltext_search(memory: DataFrame, query: str | None, limit: int = 10, **where) -> DataFrame:
    """(id, fulltext): memories with every query term, by rank.

    If there are none, those that contain any query word of more than two signs, at a constant score.
    Both branches are in the plan; the fallback is empty as soon as one real match exists.
    """
    rows = filters.memory_filters(memory, **where)
    ranked = _candidates(rows.where(text.matches_all(F.col("content"), query or "")), text.term_rank(F.col("content"), query or ""), "fulltext", limit)
    words = [w for w in (query or "").split() if len(w) > 2]
    if not words:
        return ranked
    none = ranked.agg(F.count(F.lit(1)).alias("n"))
    loose = _candidates(rows.where(filters.contains_any(F.col("content"), words)), F.lit(FALLBACK_SCORE), "fulltext", limit)
    return ranked.unionByName(loose.join(F.broadcast(none), F.col("n") == 0).select("id", "fulltext"))


def parse_hop(pattern: str) -> tuple[str, str, str]:
    """(direction, edge, table) of ``->edge->table`` or ``<-edge<-table``, ``.*`` allowed at the end."""
    m = re.fullmatch(r"->(\w+)->(\w+)(?:\.\*)?", pattern)
    if m:
        return "out", m[1], m[2]
    m = re.fullmatch(r"<-(\w+)<-(\w+)(?:\.\*)?", pattern)
    if m:
        return "in", m[1], m[2]
    raise ValueError(f"not a single hop: {pattern!r}")


def hop(edges: Mapping[str, DataFrame], start: Sequence[str] | DataFrame, pattern: str) -> DataFrame:
    """Distinct ids one hop from ``start``, ids or a frame of them; no limit and no time filter."""
    direction, edge, table = parse_hop(pattern)
    near, far = ("in_id", "out_id") if direction == "out" else ("out_id", "in_id")
    rows = edges[edge].where(F.col(far).startswith(f"{table}:"))
    if isinstance(start, DataFrame):
        rows = rows.join(start.select(F.col("id").alias(near)), near, "left_semi")
    else:
        rows = rows.where(F.col(near).isin(list(start)))
    return rows.select(F.col(far).alias("id")).distinct()


def graph_search(corpus: Corpus, query: SearchQuery, limit: int = 10) -> DataFrame:
    """(id, graph) at score 1: by traversal if one is given, else by any of the tags, else nothing."""
    if query.traversal:
        found = hop(corpus.edges, query.start, query.traversal)
        return corpus.memory.join(found, "id", "left_semi").select("id", F.lit(1.0).alias("graph"))
    rows = filters.memory_filters(corpus.memory, query.filters, query.before, query.after)
    if not query.tags:
        return rows.where(F.lit(False)).select("id", F.lit(1.0).alias("graph"))
    return _candidates(filters.having_tags(rows, corpus.tagged, query.tags), F.lit(1.0), "graph", limit)


def candidates(corpus: Corpus, query: SearchQuery) -> DataFrame:
    """(id, vector, fulltext, graph): the union of the modalities that the mode asks for."""
    where = {"filters": query.filters, "before": query.before, "after": query.after}
    asked = ("vector", "fulltext", "graph") if query.mode == "hybrid" else (query.mode,)
    found = None
    for mode in asked:
        if query.mode == "hybrid" and query.weights.get(mode, 0) <= 0:
            continue
        if mode == "vector":
            rows = vector_search(corpus.memory, query.vector, query.limit, **where)
        elif mode == "fulltext":
            rows = fulltext_search(corpus.memory, query.text, query.limit, **where)
        else:
            rows = graph_search(corpus, query, query.limit)
        rows = rows.select("id", *[(F.col(m) if m == mode else F.lit(None)).cast("double").alias(m) for m in scoring.WEIGHTS])
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return corpus.memory.where(F.lit(False)).select("id", *[F.lit(None).cast("double").alias(m) for m in scoring.WEIGHTS])
    return found.groupBy("id").agg(*[F.max(m).alias(m) for m in scoring.WEIGHTS])


def rerank_by_embedding(rows: DataFrame, memory: DataFrame, query: Sequence[float], threshold: float = 0.5) -> DataFrame:
    """Scores become the cosine to the query; those below go; rows without a vector keep their score."""
    vectors = memory.select("id", "embedding")
    near = F.round(vector.cosine(F.col("embedding"), vector.literal(query)), DIGITS)
    return (
        rows.join(vectors, "id", "left").withColumn("near", near)
        .where(F.col("near").isNull() | (F.col("near") >= threshold))
        .withColumn("score", F.coalesce("near", "score")).drop("near", "embedding")
    )


def token_budget(rows: DataFrame, budget: int, *order) -> DataFrame:
    """The longest prefix, by score and id, whose tokens fit; the first that does not fit ends it.

    ``rows`` is a result list, bounded by its limit, so one running sum over it is fine.
    """
    window = Window.orderBy(*(order or (F.col("score").desc(), F.col("id")))).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("token_count").over(window)).where(F.col("used") <= budget)


def search(corpus: Corpus, query: SearchQuery) -> DataFrame:
    """(id, score, vector, fulltext, graph, token_count): the whole retrieval as one plan."""
    rows = candidates(corpus, query)
    if query.ids:
        rows = rows.where(F.col("id").isin([i if i.startswith("memory:") else f"memory:{i}" for i in query.ids]))
    if query.tags and query.mode != "graph":
        rows = filters.having_tags(rows, corpus.tagged, query.tags)
    if query.domains:
        rows = filters.owned_by(rows, corpus.owned, query.domains)
    merged = scoring.merge_scores({m: F.col(m) for m in scoring.WEIGHTS}, query.weights, query.mode == "hybrid")
    rows = rows.withColumn("score", F.round(merged, DIGITS)).where(F.col("score") >= query.min_score)
    if query.rerank is not None and query.vector is not None:
        rows = rerank_by_embedding(rows, corpus.memory, query.vector, query.rerank)
    rows = rows.orderBy(F.col("score").desc(), "id").limit(query.limit)
    rows = rows.join(corpus.memory.select("id", "token_count"), "id")
    return rows if query.token_budget is None else token_budget(rows, query.token_budget)


def hydrate_tags(rows: DataFrame, tagged: DataFrame) -> DataFrame:
    """Adds ``tags``, the sorted labels of each row."""
    wanted = tagged.join(rows.select(F.col("id").alias("in_id")), "in_id", "left_semi")
    labels = wanted.groupBy(F.col("in_id").alias("id")).agg(F.array_sort(F.collect_set(text.tag_label(F.col("out_id")))).alias("tags"))
    return rows.join(labels, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def enrich_connections(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Adds ``references``: far id and type of the reference edges, both ways."""
    both = references.select(F.col("in_id").alias("id"), F.col("out_id").alias("far"), "edge_type").unionByName(
        references.select(F.col("out_id").alias("id"), F.col("in_id").alias("far"), "edge_type")
    )
    found = both.join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("far", "edge_type"))).alias("references"))
    return rows.join(found, "id", "left")


def enrich_domains(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Adds ``domains``: the attributes of each owner, by domain."""
    found = (
        owned.join(rows.select(F.col("id").alias("in_id")), "in_id", "left_semi")
        .groupBy(F.col("in_id").alias("id"))
        .agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.regexp_replace("out_id", "^domain:", ""), "attributes")))).alias("domains"))
    )
    return rows.join(found, "id", "left")


def first_owner(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Adds ``owner`` and its ``attributes``: of a row's owners the first by time, then by name."""
    first = owned.groupBy(F.col("in_id").alias("id")).agg(F.min_by(F.struct("out_id", "attributes"), F.struct("owned_at", "out_id")).alias("first"))
    return rows.join(first, "id", "left").withColumn("owner", F.col("first.out_id")).withColumn("attributes", F.col("first.attributes")).drop("first")


def entry_fields(rows: DataFrame) -> DataFrame:
    """Memories as callers see them: id, content, eventTime, createdAt, tokenCount."""
    return rows.select("id", "content", F.col("event_time").alias("eventTime"), F.col("created_at").alias("createdAt"), F.col("token_count").alias("tokenCount"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """Edges with their ends as ``in`` and ``out``."""
    return edges.withColumnsRenamed({"in_id": "in", "out_id": "out"})


Expand = Callable[[SearchQuery], SearchQuery]
Rank = Callable[[DataFrame], DataFrame]


def engine_search(corpus: Corpus, query: SearchQuery, expand: Sequence[Expand] = (), rank: Sequence[Rank] = (), visible: Sequence[str] | None = None) -> DataFrame:
    """Expansion hooks in order, the search, then ranking hooks after the limit; a scoped caller sees
    its visible domains only."""
    for hook in expand:
        query = hook(query)
    if visible is not None:
        asked = [d for d in query.domains if d in visible] if query.domains else list(visible)
        query = replace(query, domains=asked or ["domain:"])
    rows = search(corpus, query)
    for hook in rank:
        rows = hook(rows)
    return rows.orderBy(F.col("score").desc(), "id")


def build_context(rows: DataFrame, memory: DataFrame, budget: int = 4000, core: DataFrame | None = None) -> DataFrame:
    """One row ``context``: numbered texts in score order within the budget, core memories before them."""
    order = Window.orderBy(F.col("score").desc(), "id")
    kept = token_budget(rows, budget).withColumn("place", F.row_number().over(order)).join(memory.select("id", "content"), "id")
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "content")
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]))
    out = kept.agg(body.alias("context"))
    if core is None:
        return out
    head = core.agg(F.concat_ws("\n", F.array_sort(F.collect_list("content"))).alias("head"))
    return out.crossJoin(head).select(F.concat_ws("\n\n", F.when(F.col("head") != "", F.col("head")), "context").alias("context"))
