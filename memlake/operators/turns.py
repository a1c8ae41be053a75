"""Choices that are made one after the other, in parallel rounds with the same result.

Nodes take turns in the order of their ids.  At its turn a node looks at a short list of nodes and may
change those alone.  Two turns can only affect each other if their lists meet, so in each round every node
takes its turn whose id is the least of all waiting nodes with which it shares a list entry: all that could
have changed its list has happened.  Rounds follow the longest chain of lists that meet in order of ids,
not the number of nodes; what is left when a bounded number of entries waits is done in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.scratch import cut, discard, join_hot

LIST = 10
FINISH = 200_000


def nearest_lists(pairs: DataFrame, nodes: DataFrame | None = None, most: int = LIST, unique: bool = False) -> DataFrame:
    """(a, b, place): each node's list, itself first, then its partners of ``pairs(a, b, weight)`` by falling
    weight and id; at most ``most`` entries, as a search returns.  ``nodes(id)`` adds those without a pair.

    ``pairs`` are computed once.  Where they are known to be ``unique``, what is shuffled are a task's nearest
    of each node, and not all pairs.
    """
    ends = F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = pairs.select(F.inline(ends))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("weight").desc(), "b"))
    near = (both if unique else both.distinct()).withColumn("place", place).where(F.col("place") < most)
    entry, own = F.struct("a", "b", "place"), F.struct("a", F.col("a").alias("b"), F.lit(0).alias("place"))
    if nodes is None:  # the first entry brings the node itself
        return near.select(F.inline(F.when(F.col("place") == 1, F.array(own, entry)).otherwise(F.array(entry))))
    return near.select("a", "b", "place").unionByName(nodes.select(F.col("id").alias("a")).distinct().select(F.inline(F.array(own))))


def ready(waiting: DataFrame) -> DataFrame:
    """The entries (a, b, ...) of the nodes whose turn it is: each entry of theirs is met by no lesser node."""
    least = cut(waiting.groupBy("b").agg(F.min("a").alias("least")), "least")
    blocked = cut(join_hot(waiting.select("a", "b"), least, ["b"]).where("a > least").select("a").distinct(), "blocked")
    turn = cut(join_hot(waiting, blocked, ["a"], "left_anti"), "turn")
    discard(least, blocked)
    return turn


def greedy_clusters(lists: DataFrame, least: int = 3, finish: int = FINISH) -> DataFrame:
    """(cluster, id): in id order each free node takes the free nodes of its list, if they are ``least`` or more.

    ``lists(a, b)`` hold the node itself; a cluster is named by the node that took it and is no longer than a
    list.  A node with too few free entries stays free for later ones.
    """
    waiting, found = cut(lists.select("a", "b"), "waiting"), []
    while True:
        # lists only get shorter: one that is too short already is never taken
        alive = cut(waiting.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a"), "alive")
        waiting, old = cut(join_hot(waiting, alive, ["a"]), "waiting"), waiting
        discard(old, alive)
        n = waiting.count()
        if not n:
            break
        if n <= finish:
            found.append(cut(_sequential(waiting, least), "clusters"))
            break
        # of those that are ready each list is long enough, and no two of them meet
        taken = ready(waiting).select(F.col("a").alias("cluster"), F.col("b").alias("id"))
        found.append(taken)
        gone = cut(taken.select("id").distinct(), "gone")
        left = join_hot(waiting.withColumnRenamed("a", "id"), gone, ["id"], "left_anti").withColumnRenamed("id", "a")
        left = join_hot(left.withColumnRenamed("b", "id"), gone, ["id"], "left_anti").withColumnRenamed("id", "b")
        waiting, old = cut(left.select("a", "b"), "waiting"), waiting
        discard(old, gone)
    kind = dict(lists.dtypes)["a"]
    out = lists.sparkSession.createDataFrame([], f"cluster {kind}, id {kind}")
    for part in found:
        out = out.unionByName(part)
    return out


def _sequential(entries: DataFrame, least: int) -> DataFrame:
    """:func:`greedy_clusters` of a bounded number of entries, in one task."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for a, own in pdf.sort_values(["a", "b"]).groupby("a", sort=True)["b"]:
            free = [] if a in used else [b for b in own if b not in used]
            if len(free) >= least:
                used.update(free)
                out += [(a, b) for b in free]
        return pd.DataFrame(out, columns=["cluster", "id"])

    kind = dict(entries.dtypes)["a"]
    return entries.groupBy().applyInPandas(kernel, f"cluster {kind}, id {kind}")


def merge_topics(topics: DataFrame, lists: DataFrame, finish: int = FINISH) -> DataFrame:
    """(id, merged_into, first_into, mention_count) of ``topics(id, mention_count, created_at)``.

    At its turn a topic meets the topics of its list that are not merged yet, nearest first: of the two the
    one with more mentions stays, or the older one, or else the one whose turn it is.  The other is merged
    into it and its mentions are added to the count as it then stands; a topic that is merged stops.
    ``first_into`` is the topic it was merged into then; ``merged_into`` the one that still stands at the
    end, where its mentions are, so the counts of the standing topics add up to all mentions.
    """
    state = cut(topics.select("id", F.col("mention_count").cast("bigint").alias("mention_count"), "created_at", F.expr("cast(null as " + dict(topics.dtypes)["id"] + ")").alias("first_into")), "topics")
    waiting = cut(lists.select("a", "b", "place"), "waiting")
    while True:
        # a list of the topic alone has nothing to merge
        alive = cut(waiting.where("a <> b").select("a").distinct(), "alive")
        waiting, old = cut(join_hot(waiting, alive, ["a"]), "waiting"), waiting
        discard(old, alive)
        n = waiting.count()
        if not n:
            break
        if n <= finish:
            changed = _merge_sequentially(waiting, state)
            state = cut(_update(state, cut(changed, "changed")), "topics")
            break
        turn = ready(waiting)
        changed = cut(_merge_turn(turn, state), "changed")
        state, old = cut(_update(state, changed), "topics"), state
        discard(old)
        done = cut(turn.select("a").distinct(), "done")
        gone = cut(changed.where("first_into is not null").select("id").distinct(), "gone")
        left = join_hot(waiting, done, ["a"], "left_anti")
        left = join_hot(left.withColumnRenamed("a", "id"), gone, ["id"], "left_anti").withColumnRenamed("id", "a")
        left = join_hot(left.withColumnRenamed("b", "id"), gone, ["id"], "left_anti").withColumnRenamed("id", "b")
        waiting, old = cut(left.select("a", "b", "place"), "waiting"), waiting
        discard(old, turn, changed, done, gone)
    return state.join(standing(state.where("first_into is not null").select("id", F.col("first_into").alias("into"))), "id", "left").select(
        "id", F.col("root").alias("merged_into"), "first_into", "mention_count"
    )


def _update(state: DataFrame, changed: DataFrame) -> DataFrame:
    new = changed.select("id", F.col("mention_count").alias("new_count"), F.col("first_into").alias("new_into"))
    return state.join(new, "id", "left").select(
        "id", F.coalesce("new_count", "mention_count").alias("mention_count"), "created_at", F.coalesce("new_into", "first_into").alias("first_into")
    )


def _merge_turn(turn: DataFrame, state: DataFrame) -> DataFrame:
    """(id, mention_count, first_into) of the topics that the turns of a round change; lists do not meet."""
    now = state.select(F.col("id").alias("b"), F.col("mention_count").alias("n"), F.col("created_at").alias("c"))
    kind = dict(state.dtypes)["id"]
    own = F.max_by(F.struct("n", "c"), F.col("a") == F.col("b"))
    met = F.array_sort(F.collect_list(F.when(F.col("a") != F.col("b"), F.struct("place", "b", "n", "c"))))
    rows = turn.join(now, "b").groupBy("a").agg(own.alias("own"), met.alias("met"))
    step = f"""aggregate(met, struct(own.n as n, cast(null as {kind}) as into, cast(null as bigint) as gain, cast(array() as array<struct<id:{kind},n:bigint>>) as merged),
      (s, x) -> case when s.into is not null then s
        when s.n > x.n or (s.n = x.n and own.c <= x.c) then struct(s.n + x.n as n, s.into as into, s.gain as gain, concat(s.merged, array(struct(x.b as id, x.n as n))) as merged)
        else struct(s.n as n, x.b as into, x.n + s.n as gain, s.merged as merged) end)"""
    rows = rows.select("a", F.expr(step).alias("s"))
    mine = F.array(F.struct(F.col("a").alias("id"), F.col("s.n").alias("mention_count"), F.col("s.into").alias("first_into")))
    merged = F.transform("s.merged", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("mention_count"), F.col("a").alias("first_into")))
    winner = F.when(F.col("s.into").isNotNull(), F.array(F.struct(F.col("s.into").alias("id"), F.col("s.gain").alias("mention_count"), F.lit(None).cast(kind).alias("first_into"))))
    return rows.select(F.inline(F.concat(mine, merged, F.coalesce(winner, F.array().cast(f"array<struct<id:{kind},mention_count:bigint,first_into:{kind}>>")))))


def _merge_sequentially(entries: DataFrame, state: DataFrame) -> DataFrame:
    """The turns of a bounded number of entries, in one task."""
    now = state.select(F.col("id").alias("b"), F.col("mention_count").alias("n"), F.col("created_at").alias("c"))
    kind = dict(state.dtypes)["id"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c, into = dict(zip(pdf["b"], pdf["n"])), dict(zip(pdf["b"], pdf["c"])), {}
        for a, own in pdf.sort_values(["a", "place"]).groupby("a", sort=True)["b"]:
            for b in own:
                if b == a or a in into or b in into:
                    continue
                stays, goes = (a, b) if n[a] > n[b] or (n[a] == n[b] and c[a] <= c[b]) else (b, a)
                into[goes] = stays
                n[stays] += n[goes]
        return pd.DataFrame({"id": list(n), "mention_count": list(n.values()), "first_into": pd.Series([into.get(k) for k in n], dtype=object)})

    return entries.join(now, "b").groupBy().applyInPandas(kernel, f"id {kind}, mention_count bigint, first_into {kind}")


def standing(links: DataFrame) -> DataFrame:
    """(id, root) of a forest ``links(id, into)``: pointer jumping, so rounds follow the log of the depth."""
    now = cut(links.select("id", F.col("into").alias("root")), "links")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if not moved.where("moved").limit(1).count():
            return moved.select("id", "root")
        discard(now)
        now = moved.select("id", "root")
