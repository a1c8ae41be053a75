"""Enrichment of an inbox batch.  Models are callables over DataFrames and optional: without one, each
stage takes its deterministic branch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.plans.scratch import cut

Model = Callable[[DataFrame], DataFrame]


def decompose(rows: DataFrame, longer_than: int, facts: Model | None = None, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows with ``decomposed``, children): entries over ``longer_than`` tokens are split into at most
    ``most`` facts by ``facts`` (rows -> id, facts array); a child refines its parent.  No model: unchanged."""
    if facts is None:
        nothing = rows.where(F.lit(False)).select("id", "content", F.col("id").alias("parent"))
        return rows.withColumn("decomposed", F.lit(False)), nothing
    found = facts(rows.where(F.col("token_count") > longer_than)).select("id", F.slice("facts", 1, most).alias("facts")).where(F.size("facts") > 0)
    children = found.select(F.col("id").alias("parent"), F.posexplode("facts").alias("n", "content")).select(
        F.concat("parent", F.lit("/"), F.col("n").cast("string")).alias("id"), "content", "parent"
    )
    marked = rows.join(found.select("id", F.lit(True).alias("decomposed")), "id", "left").withColumn("decomposed", F.coalesce("decomposed", F.lit(False)))
    return marked, children


def assign(rows: DataFrame, domain: str, root_tag: str, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owner edges, tag edges, tag tree edges): attributes on the owner, the class tag under the root tag."""
    owners = rows.select(
        F.col("id").alias("in_id"), F.lit(f"domain:{domain}").alias("out_id"),
        F.to_json(F.struct("classification", F.lit(False).alias("superseded"))).alias("attributes"), F.lit(now_ms).alias("owned_at"),
    )
    tag = F.concat(F.lit(f"tag:{root_tag}/"), "classification")
    tags = rows.select(F.col("id").alias("in_id"), tag.alias("out_id")).distinct()
    tree = rows.select(tag.alias("in_id"), F.lit(f"tag:{root_tag}").alias("out_id")).distinct()
    return owners, tags, tree


def supersession(pairs: DataFrame, fresh: DataFrame, decide: Model | None, threshold: float = 0.7) -> DataFrame:
    """(in_id, out_id): new entries that supersede older ones.  ``pairs(new, old, score)`` at ``threshold`` or
    more, old ones not of the batch itself; ``decide`` keeps the true ones.  No model: none."""
    candidates = pairs.where(F.col("score") >= threshold).join(fresh.select(F.col("id").alias("old")), "old", "left_anti")
    if decide is None:
        return candidates.where(F.lit(False)).select(F.col("new").alias("in_id"), F.col("old").alias("out_id"))
    return decide(candidates).select(F.col("new").alias("in_id"), F.col("old").alias("out_id")).distinct()


def user_facts(fresh: DataFrame, about: DataFrame, memory: DataFrame, owned: DataFrame, domain: str, room: int) -> DataFrame:
    """(user, new, old): new facts (id, user, content) beside each fact already known of the same user.

    Known facts are texts about the user that the domain does not hold as superseded, without empty ones
    and without the new ones.  A user with more than ``room`` characters on both sides is left out before
    anything is paired, so no group grows beyond that.
    """
    mine = owned.where(F.col("out_id") == f"domain:{domain}").groupBy(F.col("in_id").alias("old")).agg(F.min("attributes").alias("attributes"))
    known = (
        about.select(F.col("in_id").alias("old"), F.regexp_replace("out_id", "^user:", "").alias("user")).distinct()
        .join(fresh.select(F.col("id").alias("old")), "old", "left_anti")
        .join(memory.select(F.col("id").alias("old"), "content"), "old").join(mine, "old", "left")
        .where(~F.coalesce(F.get_json_object("attributes", "$.superseded") == "true", F.lit(False)) & (F.length("content") > 0))
    )
    given = fresh.where("user is not null").select("id", F.col("user").cast("string").alias("user"), "content")
    size = given.select("user", "content").unionByName(known.select("user", "content")).groupBy("user").agg(F.sum(F.length("content")).alias("size"))
    fits = size.where(F.col("size") <= room).select("user")
    return given.join(fits, "user", "left_semi").select("user", F.col("id").alias("new")).join(known.select("user", "old"), "user").select("user", "new", "old")


def user_supersession(pairs: DataFrame, decide: Model | None) -> DataFrame:
    """(in_id, out_id): which new facts supersede which known ones of their user, as ``decide`` picks of the
    ``pairs(user, new, old)``; what it makes up itself is ignored.  No model: none."""
    picked = pairs.where(F.lit(False)) if decide is None else pairs.join(decide(pairs).select("new", "old").distinct(), ["new", "old"], "left_semi")
    return picked.select(F.col("new").alias("in_id"), F.col("old").alias("out_id")).distinct()


def ask_questions(rows: DataFrame, ask: Model | None) -> DataFrame:
    """``rows`` with ``answers_question``: what ``ask`` (rows -> id, question) says of all, then once more of
    those that it left out, else empty.  No model: empty."""
    if ask is None:
        return rows.withColumn("answers_question", F.lit(""))
    said = lambda r: ask(r).where(F.length(F.trim("question")) > 0).groupBy("id").agg(F.min("question").alias("question"))
    first = cut(said(rows), "questions")
    again = said(rows.join(first.select("id"), "id", "left_anti"))
    return rows.join(first.unionByName(again), "id", "left").withColumn("answers_question", F.coalesce("question", F.lit(""))).drop("question")


def related(pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Edges between an entry and related knowledge."""
    return pairs.where((F.col("score") >= threshold) & (F.col("new") != F.col("old"))).select(F.col("new").alias("in_id"), F.col("old").alias("out_id"), F.col("score").alias("strength"))


def link_topics(mentions: DataFrame, topics: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, new topics) of mentions (id, name, topic_id): a given id wins, then an equal normalised
    name, then a near topic (name, topic_id by vector), else a topic is created, once for each name."""
    named = mentions.withColumn("key", text.topic_name(F.col("name")))
    known = topics.groupBy(text.topic_name(F.col("name")).alias("key")).agg(F.min("id").alias("by_name"))
    rows = named.join(known, "key", "left")
    if near is not None:
        rows = rows.join(near.groupBy(text.topic_name(F.col("name")).alias("key")).agg(F.min("topic_id").alias("by_vector")), "key", "left")
    else:
        rows = rows.withColumn("by_vector", F.lit(None).cast("string"))
    made = F.concat(F.lit("topic:"), text.short_key(F.col("key")))
    found = F.coalesce("topic_id", "by_name", "by_vector")
    links = rows.select(F.col("id").alias("in_id"), F.coalesce(found, made).alias("out_id")).distinct()
    fresh = rows.where(found.isNull()).select(made.alias("id"), F.col("key").alias("name")).distinct()
    return links, fresh


def find_or_create(mentions: DataFrame, entities: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(links, new entities) by exact name: (id, name) of mentions against (id, name) of the table."""
    known = entities.groupBy("name").agg(F.min("id").alias("entity"))
    made = F.concat(F.lit(f"{table}:"), text.short_key(F.col("name")))
    rows = mentions.join(known, "name", "left")
    links = rows.select(F.col("id").alias("in_id"), F.coalesce("entity", made).alias("out_id")).distinct()
    return links, rows.where("entity is null").select(made.alias("id"), "name").distinct()


def about_user(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Missing about_user edges of rows (id, user_id)."""
    wanted = rows.where("user_id is not null").select(F.col("id").alias("in_id"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("out_id")).distinct()
    return wanted.join(edges, ["in_id", "out_id"], "left_anti")


def pack(rows: DataFrame, size: int, reserved: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``batch``: consecutive rows whose texts fit a prompt of ``size`` characters, ``reserved`` of them taken.

    By running length, so a batch may end early where a text crosses a bucket's edge; none is too long
    unless one text alone is.
    """
    room = max(1, size - reserved)
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("batch", F.floor((F.sum(F.length("content")).over(window) - 1) / room))


def validate_graph(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes once by name; relations without self links and dangling ends, each once."""
    once = nodes.groupBy(text.kebab(F.col("name")).alias("name")).agg(F.min("kind").alias("kind"))
    ends = once.select("name")
    rows = relations.select(text.kebab(F.col("src")).alias("src"), text.kebab(F.col("dst")).alias("dst"), "relationship").where("src <> dst")
    for end in ("src", "dst"):
        rows = rows.join(ends.withColumnRenamed("name", end), end, "left_semi")
    return once, rows.select("src", "dst", "relationship").distinct()


def query_intent(question: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """Classes whose cue words a question has; all classes if none."""
    hits = F.filter(
        F.array(*[F.when(F.lower(question).rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(name)) for name, words in classes.items()]), lambda x: x.isNotNull()
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(*[F.lit(c) for c in classes]))
