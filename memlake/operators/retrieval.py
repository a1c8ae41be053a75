"""Context building on top of a search: merges, parents, and the sequential choices.

Merges are joins and sums.  Near-duplicate removal, diversity and the skipping budget depend on the
order of choice, so they run as kernels over one query's bounded result list; many queries at once are
groups of ``applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text

BOOST_TEXT, BOOST_QUESTION = 1.3, 1.5


def _best(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("id", "score")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("id", "score"))
    return out.groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


def layered_budget(rows: DataFrame, budget: int, group: str, order: Sequence[str] = ("created_at", "id"), shares: dict[str, float] | None = None) -> DataFrame:
    """Rows (group, layer, token_count, ...) that fit their layer's share of ``budget``, with ``used``.

    ``working`` fills from the oldest row, other layers from the newest; the first row that does not
    fit ends its layer.  Shares are half, three tenths and a fifth unless given; other layers get none.
    """
    shares = shares or {"working": 0.5, "episodic": 0.3, "semantic": 0.2}
    limit = F.lit(0)
    for layer, share in shares.items():
        limit = F.when(F.col("layer") == layer, int(budget * share)).otherwise(limit)
    forward = Window.partitionBy(group, "layer").orderBy(*order)
    backward = Window.partitionBy(group, "layer").orderBy(*[F.col(c).desc() for c in order])
    used = F.when(F.col("layer") == "working", F.sum("token_count").over(forward)).otherwise(F.sum("token_count").over(backward))
    return rows.withColumn("used", used).where(F.col("used") <= limit)


def keyword_hits(memory: DataFrame, words: Sequence[str], per_keyword: int | None = None) -> DataFrame:
    """(id, hits): how many of the keywords each memory contains, case-insensitively."""
    if not words:
        return memory.where(F.lit(False)).select("id", F.lit(0).alias("hits"))
    if per_keyword is None:
        count = sum((F.lower("content").contains(w.lower()).cast("int") for w in words), F.lit(0))
        return memory.select("id", count.alias("hits")).where("hits > 0")
    rows = None
    for w in words:  # a stated few keywords, each with its own top-k
        part = memory.where(F.lower("content").contains(w.lower())).orderBy("id").limit(per_keyword).select("id", F.lit(w).alias("word"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.countDistinct("word").alias("hits"))


def keyword_merge(rows: DataFrame, memory: DataFrame, words: Sequence[str], per_keyword: int | None = 20) -> DataFrame:
    """Rows that a keyword hits get x 1.3; new rows score the share of keywords they contain.

    ``memory`` must be restricted to owned memories already.
    """
    hits = keyword_hits(memory, words, per_keyword)
    known = rows.join(hits, "id", "left").select("id", F.when(F.col("hits").isNotNull(), F.col("score") * BOOST_TEXT).otherwise(F.col("score")).alias("score"))
    fresh = hits.join(rows, "id", "left_anti").select("id", (F.col("hits") / float(max(1, len(words)))).alias("score"))
    return _best(known, fresh)


def topic_merge(rows: DataFrame, about: DataFrame, topics: DataFrame, owned_ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows about a matched topic get x 1.3; new ones 0.5 + 0.2 * min(1, matched / topics).

    With a ``limit`` only that many memories count, those with most matched topics, ties by id.
    """
    total = topics.agg(F.count(F.lit(1)).alias("topics"))
    match = (
        about.join(F.broadcast(topics.select(F.col("id").alias("out_id"))), "out_id", "left_semi")
        .groupBy(F.col("in_id").alias("id")).agg(F.countDistinct("out_id").alias("matched"))
        .join(owned_ids, "id", "left_semi")
    )
    match = (match if limit is None else match.orderBy(F.col("matched").desc(), "id").limit(limit)).crossJoin(F.broadcast(total))
    known = rows.join(match, "id", "left").select("id", F.when(F.col("matched").isNotNull(), F.col("score") * BOOST_TEXT).otherwise(F.col("score")).alias("score"))
    fresh = match.join(rows, "id", "left_anti").select("id", (0.5 + 0.2 * F.least(F.lit(1.0), F.col("matched") / F.col("topics"))).alias("score"))
    return _best(known, fresh)


def question_merge(rows: DataFrame, memory: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Memories whose ``answers_question`` matches: known x 1.5, new 0.2 * rank / best rank."""
    hit = memory.where(text.matches_all(F.col("answers_question"), query)).select("id", text.term_rank(F.col("answers_question"), query).alias("rank"))
    hit = hit.orderBy(F.col("rank").desc(), "id").limit(limit)
    top = hit.agg(F.max("rank").alias("top"))
    hit = hit.crossJoin(F.broadcast(top))
    known = rows.join(hit, "id", "left").select("id", F.when(F.col("rank").isNotNull(), F.col("score") * BOOST_QUESTION).otherwise(F.col("score")).alias("score"))
    fresh = hit.join(rows, "id", "left_anti").select("id", (0.2 * F.col("rank") / F.col("top")).alias("score"))
    return _best(known, fresh)


def rerank_by_model(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], least: int = 3, best: int = 5) -> DataFrame:
    """(id, score) as ``judge`` (rows -> id, grade) sees it: grades from ``least`` on, over ``best``.

    Rows without a grade go with those below; if none is left, the rows stay as they were.
    """
    graded = rows.join(judge(rows).groupBy("id").agg(F.max("grade").alias("grade")), "id", "left")
    some = F.broadcast(graded.agg(F.coalesce(F.max((F.col("grade") >= least).cast("int")), F.lit(0)).alias("some")))
    kept = graded.crossJoin(some).where((F.col("some") == 0) | (F.col("grade") >= least))
    return kept.select("id", F.when(F.col("some") == 0, F.col("score")).otherwise(F.round(F.col("grade") / float(best), 6)).alias("score"))


def resolve_parents(rows: DataFrame, refines: DataFrame, valid: DataFrame) -> DataFrame:
    """Children (in_id refines out_id) are replaced by their valid parent at the best child's score;
    a child without a valid parent stays, and a parent that was found itself takes the higher score."""
    up = refines.select(F.col("in_id").alias("id"), F.col("out_id").alias("parent")).join(valid.select(F.col("id").alias("parent")), "parent", "left_semi")
    return _best(rows.join(up, "id", "left").select(F.coalesce("parent", "id").alias("id"), "score"))


def _budget(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
    left, keep = budget, []
    for size in pdf["token_count"]:
        keep.append(size <= left)
        left -= size if keep[-1] else 0
    return pdf[keep]


def budget_skipping(rows: DataFrame, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """Greedy: take each row in score order that still fits; larger ones are skipped, later ones may fit.

    ``rows`` is one bounded result list for each group of ``by``.
    """
    return rows.groupBy(*by).applyInPandas(lambda pdf: _budget(pdf, budget), rows.schema)


def _dedupe(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
    kept: list[tuple[str, set]] = []
    alias = []
    for key, words in zip(pdf["id"], pdf["words"]):
        mine = set(words)
        of = next((k for k, w in kept if (len(mine & w) / len(mine | w) if mine | w else 1.0) >= threshold), None)
        alias.append(of or key)
        if of is None:
            kept.append((key, mine))
    return pdf.assign(alias_of=alias)[["id", "score", "alias_of"]]


def dedupe_greedy(rows: DataFrame, memory: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(id, score, alias_of): in score order, a row whose words are close to a kept one is its alias."""
    worded = rows.join(memory.select("id", text.word_set(F.col("content")).alias("words")), "id").select(*by, "id", "score", "words")
    return worded.groupBy(*by).applyInPandas(lambda pdf: _dedupe(pdf, threshold), "id string, score double, alias_of string")


def _mmr(pdf: pd.DataFrame, budget: int, balance: float) -> pd.DataFrame:
    import numpy as np

    pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    if balance >= 1:
        return _budget(pdf, budget).assign(place=lambda d: range(len(d)))[["id", "score", "token_count", "place"]]
    have = pdf["embedding"].notna().to_numpy()
    width = max((len(v) for v in pdf["embedding"][have]), default=1)
    m = np.zeros((len(pdf), width))
    for i in np.flatnonzero(have):
        m[i] = pdf["embedding"][i]
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    left, chosen, close = budget, [], np.zeros(len(pdf))
    open_ = np.ones(len(pdf), bool)
    while True:
        fits = open_ & (pdf["token_count"].to_numpy() <= left)
        if not fits.any():
            break
        value = np.where(fits, np.round(balance * pdf["score"].to_numpy() - (1 - balance) * close, 9), -np.inf)
        best = int(value.argmax())
        chosen.append(best)
        open_[best] = False
        left -= int(pdf["token_count"][best])
        close = np.maximum(close, m @ m[best])
    return pdf.iloc[chosen].assign(place=range(len(chosen)))[["id", "score", "token_count", "place"]]


def mmr_fill(rows: DataFrame, budget: int, balance: float = 0.7, by: Sequence[str] = ()) -> DataFrame:
    """(id, score, token_count, place): fill a token budget by relevance less the likeness to what was
    taken; ``balance`` 1 is the skipping budget.  ``rows`` needs score, token_count and embedding."""
    return rows.select(*by, "id", "score", "token_count", "embedding").groupBy(*by).applyInPandas(
        lambda pdf: _mmr(pdf, budget, balance), "id string, score double, token_count bigint, place int"
    )
