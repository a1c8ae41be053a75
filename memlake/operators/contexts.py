"""Context builders of a domain: a search, its merges, a selection within a budget, and the text of it.

What :func:`domain_entries` chains are the operators of ``retrieval``; every list that reaches a
sequential choice is bounded by the search's limit and the merges' own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import filters, retrieval, search
from memlake.plans.scratch import cut

# The sections of a context and the classes in each, in order.
KB_SECTIONS = {"Definitions & Concepts": ("definition", "concept"), "Facts & References": ("fact", "reference"), "How-Tos & Insights": ("how-to", "insight")}
REPO_SECTIONS = {"Decisions": ("decision", "rationale"), "Architecture": ("direction", "clarification"), "Recent Observations": ("observation", "question")}
CHAT_SECTIONS = {"working": "Recent", "episodic": "Context", "semantic": "Background"}


@dataclass(frozen=True)
class Plan:
    """What a domain adds to a search; each part may be left out.

    ``keywords`` are looked up in the domain's texts; ``questions`` looks the query text up in
    answers_question; ``topics(id)`` and ``about(in_id, out_id)`` bring what is about a matched topic;
    ``refines`` leads from parts to wholes; ``judge`` (rows -> id, grade of 5) ranks anew.
    """

    sections: Mapping[str, Sequence[str]] = field(default_factory=lambda: KB_SECTIONS)
    keywords: Sequence[str] = ()
    questions: bool = False
    topics: DataFrame | None = None
    about: DataFrame | None = None
    refines: DataFrame | None = None
    judge: Callable[[DataFrame], DataFrame] | None = None
    balance: float = 1.0
    likeness: float = 0.5
    audience: str | None = None


def _sectioned(rows: DataFrame, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``section`` and its ``rank`` (section, then class within it); other classes go."""
    name, rank, n = F.lit(None).cast("string"), F.lit(None).cast("int"), 0
    for title, kinds in sections.items():
        for kind in kinds:
            name, rank = F.when(F.col("classification") == kind, title).otherwise(name), F.when(F.col("classification") == kind, n).otherwise(rank)
            n += 1
    return rows.withColumn("section", name).withColumn("rank", rank).where("section is not null")


def domain_entries(corpus: search.Corpus, query: search.SearchQuery, domain: str, plan: Plan, now_ms: int, budget: int) -> DataFrame:
    """(id, alias_of, score, section, rank, place): what a domain's context holds for a query.

    Search (a cosine rank where there is a vector, three times the budget), entries that the domain owns
    and that are valid and of the audience, merges of questions, keywords and topics, the judge, wholes
    for their parts, near copies as aliases of the first, and a fill of ``budget`` tokens.  An alias
    follows its survivor.  If the search finds nothing valid, nothing is merged and there is no entry.
    """
    mine = corpus.owned.where(F.col("out_id") == f"domain:{domain}")
    mine = mine.where(filters.still_valid(F.col("attributes"), now_ms) & filters.audience_matches(F.col("attributes"), plan.audience))
    kinds = mine.groupBy(F.col("in_id").alias("id")).agg(F.min(F.get_json_object("attributes", "$.classification")).alias("classification"))
    memory = corpus.memory.join(kinds.select("id"), "id", "left_semi")
    asked = replace(query, min_score=0.0, token_budget=3 * budget, rerank=None if query.vector is None else 0.0)
    rows = cut(search.search(corpus, asked).join(kinds.select("id"), "id", "left_semi").select("id", "score"), "found")
    if not rows.isEmpty():
        if plan.questions and query.text:
            rows = retrieval.question_merge(rows, memory, query.text)
        if plan.keywords:
            rows = retrieval.keyword_merge(rows, memory, plan.keywords)
        if plan.topics is not None and plan.about is not None:
            rows = retrieval.topic_merge(rows, plan.about, plan.topics, kinds.select("id"), limit=50)
        if plan.judge is not None:
            rows = retrieval.rerank_by_model(cut(rows, "judged"), plan.judge)
        if plan.refines is not None:
            rows = retrieval.resolve_parents(rows, plan.refines, kinds)
    alike = cut(retrieval.dedupe_greedy(rows, memory, plan.likeness), "alike")
    kept = alike.where("alias_of = id").select("id", "score")
    filled = retrieval.mmr_fill(kept.join(memory.select("id", F.coalesce("token_count", F.lit(0)).cast("bigint").alias("token_count"), "embedding"), "id"), budget, plan.balance)
    placed = _sectioned(filled.select(F.col("id").alias("alias_of"), "place").join(kinds.withColumnRenamed("id", "alias_of"), "alias_of"), plan.sections)
    return alike.join(placed, "alias_of").select("id", "alias_of", "score", "section", "rank", "place")


def sections_text(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, context) of rows (by, section, rank, place, content): titled sections in the order of their ranks."""
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", c))), lambda x: x[c]), "\n")
    each = rows.groupBy(*by, "section").agg(F.min("rank").alias("first"), lines("content").alias("body"))
    part = F.struct("first", F.concat(F.lit("["), "section", F.lit("]\n"), "body").alias("text"))
    return each.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("context"))


def domain_context(entries: DataFrame, memory: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """One row ``context``: the sections of :func:`domain_entries`, core memories before them as instructions."""
    rows = entries.where("alias_of = id").join(memory.select("id", "content"), "id").select("section", "rank", "place", "content")
    if core is not None:
        order = F.row_number().over(Window.orderBy("created_at", "id"))
        head = core.select(F.lit("Instructions").alias("section"), F.lit(-1).alias("rank"), order.alias("place"), "content")
        rows = rows.unionByName(head)
    return sections_text(rows)


def chat_context(rows: DataFrame, budget: int, by: str, order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """(by, context) of layered rows (by, layer, token_count, content and ``order``): half of the budget for
    the working layer, oldest first, then episodic and semantic rows, the best first."""
    kept = retrieval.layered_budget(rows, budget, by, order)
    title, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for n, (layer, name) in enumerate(CHAT_SECTIONS.items()):
        title, rank = F.when(F.col("layer") == layer, name).otherwise(title), F.when(F.col("layer") == layer, n).otherwise(rank)
    along = Window.partitionBy(by, "layer")
    place = F.when(F.col("layer") == "working", F.row_number().over(along.orderBy(*order))).otherwise(F.row_number().over(along.orderBy(*[F.col(c).desc() for c in order])))
    return sections_text(kept.select(by, title.alias("section"), rank.alias("rank"), place.alias("place"), "content"), [by])


def access_log(entries: DataFrame, at_ms: int) -> DataFrame:
    """(id, at) of the entries that a context showed, for ``ingest.record_access``."""
    return entries.select("id", F.lit(at_ms).alias("at")).distinct()


def entity_expansion(tables: Mapping[str, DataFrame], edge: str = "about_entity", each: int = 5) -> Callable[[search.SearchQuery], search.SearchQuery]:
    """A search hook: entities (id, name) whose name holds the query text, ``each`` of a table, and from
    them one hop to the memories about them.  Without a match the query stays as it is."""

    def expand(query: search.SearchQuery) -> search.SearchQuery:
        if not query.text:
            return query
        found = None
        for rows in tables.values():
            part = rows.where(F.lower("name").contains(query.text.lower())).select("id").orderBy("id").limit(each)
            found = part if found is None else found.unionByName(part)
        return query if found is None or found.isEmpty() else replace(query, start=found, traversal=f"<-{edge}<-memory.*")

    return expand


def topic_matches(memory: DataFrame, tagged: DataFrame, query: str, tag: str = "tag:topic", longer_than: int = 3) -> DataFrame:
    """(id) of topic memories that contain a query word of more than ``longer_than`` signs."""
    words = [w for w in query.lower().split() if len(w) > longer_than]
    return filters.having_tags(memory, tagged, [tag]).where(filters.contains_any(F.col("content"), words)).select("id")


def topic_expansion(memory: DataFrame, tagged: DataFrame, edge: str = "about_topic", tag: str = "tag:topic") -> Callable[[search.SearchQuery], search.SearchQuery]:
    """A search hook: from the topics that the query text names one hop to the memories about them."""

    def expand(query: search.SearchQuery) -> search.SearchQuery:
        if not query.text:
            return query
        found = topic_matches(memory, tagged, query.text, tag)
        return query if found.isEmpty() else replace(query, start=found, traversal=f"<-{edge}<-memory.*")

    return expand
