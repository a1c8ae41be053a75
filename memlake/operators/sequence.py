"""Ordered streams: context maintenance, change points, optimal segmentation and spherical k-means.

Change points are window functions.  Folds that feed each step into the next, and segmentations, run over
stretches of a stream of bounded length, so a stream of any length is several tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import vector
from memlake.plans.ranking import ranked
from memlake.plans.scratch import broadcast_if_small, cut, rows_of

STRETCH, WARM, SAME = 4096, 64, 1e-9


def change_points(turns: DataFrame, stream: str, order: str, z: float = 1.0) -> DataFrame:
    """(stream, order, drop, boundary): a boundary where 1 - cosine to the turn before lies more than
    ``z`` population deviations above the stream's mean; streams under three turns have none."""
    along = Window.partitionBy(stream).orderBy(order)
    every = Window.partitionBy(stream)
    rows = turns.select(stream, order, F.round(1 - vector.cosine(F.col("embedding"), F.lag("embedding").over(along)), 6).alias("drop"))
    spread, mean, n = F.stddev_pop("drop").over(every), F.avg("drop").over(every), F.count(F.lit(1)).over(every)
    score = F.round((F.col("drop") - mean) / F.nullif(spread, F.lit(0.0)), 6)
    return rows.withColumn("boundary", F.coalesce((n >= 3) & (score > z), F.lit(False)))


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size else v


def _fold(state: np.ndarray | None, vectors: list, rho: float, gain: float) -> list[np.ndarray | None]:
    """The context after each step; a step without a vector leaves it as it is."""
    out = []
    for v in vectors:
        if v is not None:
            content = _unit(np.asarray(v, float))
            state = content if state is None else _unit(rho * state + gain * content)
        out.append(state)
    return out


def context_stream(
    turns: DataFrame, stream: str, order: str, rho: float = 0.7, beta: float | None = None, stretch: int = STRETCH, warm: int = WARM,
) -> DataFrame:
    """(stream, order, context): c = unit(rho * c + beta * content), starting from the first content;
    beta defaults to sqrt(1 - rho^2).

    A stream is cut into stretches of ``stretch`` steps, which are folded side by side: what a context owes
    to the distant past fades, so each starts from the ``warm`` steps before it.  Then every stretch is held
    against the context with which the one before it really ended, and is folded again from there if they
    differ, in rounds until none does; so the result is that of one fold, to ``SAME``.
    """
    spark = turns.sparkSession
    gain = float(np.sqrt(max(0.0, 1 - rho * rho))) if beta is None else beta
    kinds = dict(turns.dtypes)
    placed = ranked(turns.select(stream, order, F.col("embedding")), [stream], [order], "__rank")
    own = F.expr(f"__rank div {stretch}")
    early = F.when((F.col("__rank") % stretch >= stretch - warm), F.array(own, own + 1)).otherwise(F.array(own))
    rows = placed.select(stream, order, "embedding", "__rank", F.explode(early).alias("__part")).withColumn("__warm", F.col("__part") > F.expr(f"__rank div {stretch}"))
    schema = f"{stream} {kinds[stream]}, {order} {kinds[order]}, context array<double>, __part bigint, __start array<double>, __end array<double>"
    listed = lambda c: None if c is None else c.tolist()

    def answer(pdf: pd.DataFrame, before: np.ndarray | None) -> pd.DataFrame:
        pdf = pdf.sort_values("__rank")
        if before is None:
            ahead = pdf[pdf["__warm"]]
            states = _fold(None, list(ahead["embedding"]), rho, gain)
            before = states[-1] if states else None
        pdf = pdf[~pdf["__warm"]]
        found = _fold(before, list(pdf["embedding"]), rho, gain)
        n = len(pdf)
        return pd.DataFrame({
            stream: pdf[stream], order: pdf[order], "context": pd.Series([listed(c) for c in found], index=pdf.index, dtype=object), "__part": pdf["__part"],
            "__start": pd.Series([listed(before)] + [None] * (n - 1), index=pdf.index, dtype=object) if n else None,
            "__end": pd.Series([None] * (n - 1) + [listed(found[-1])], index=pdf.index, dtype=object) if n else None,
        })

    done = cut(rows.groupBy(stream, "__part").applyInPandas(lambda pdf: answer(pdf, None), schema), "contexts")
    while True:
        ends = done.groupBy(stream, "__part").agg(F.first("__start", ignorenulls=True).alias("start"), F.first("__end", ignorenulls=True).alias("end"))
        ends = cut(ends, "ends")
        known = ends.select(F.col(stream).alias("__s"), (F.col("__part") + 1).alias("__p"), F.col("end").alias("true"))
        apart = F.aggregate(F.zip_with("start", "true", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: F.greatest(t, x))
        wrong = ends.join(known, ends[stream].eqNullSafe(known["__s"]) & (ends["__part"] == known["__p"]))
        wrong = cut(wrong.where((F.col("true").isNotNull()) & (F.col("start").isNull() | (apart > SAME))).select(stream, "__part", "true"), "wrong")
        if not rows_of(wrong):
            return done.select(stream, order, "context")
        key = F.col(f"r.{stream}").eqNullSafe(F.col(f"w.{stream}")) & (F.col("r.__part") == F.col("w.__part"))
        again = rows.where("not __warm").alias("r").join(F.broadcast(wrong).alias("w"), key).select(*[F.col(f"r.{c}") for c in rows.columns], "true")
        mended = again.groupBy(stream, "__part").applyInPandas(lambda pdf: answer(pdf.drop(columns="true"), np.asarray(pdf["true"].iloc[0], float)), schema)
        kept = done.alias("r").join(F.broadcast(wrong.select(stream, "__part")).alias("w"), key, "left_anti")
        done = cut(kept.unionByName(mended), "contexts")


def advance(context: Sequence[float] | None, content: Sequence[float], rho: float = 0.7, beta: float | None = None) -> list[float]:
    """The context after one more step."""
    gain = float(np.sqrt(max(0.0, 1 - rho * rho))) if beta is None else beta
    return _fold(None if context is None else np.asarray(context, float), [content], rho, gain)[-1].tolist()


def context_search(
    stored: DataFrame, content: list[float], context: list[float] | None = None, weight: float = 0.5, top: int = 10, mode: str = "cue", **steps: float
) -> DataFrame:
    """(id, score): weight * cosine to the content + (1 - weight) * cosine to the context.

    In mode ``cue`` the stored contexts are probed with the content itself, or with ``context`` if one is given;
    in mode ``continue`` with the running ``context`` once the content has been added to it (``rho``, ``beta``).
    """
    if mode == "continue":
        context = advance(context, content, **steps)
    elif context is None:
        context = content
    score = weight * vector.cosine(F.col("embedding"), vector.literal(content)) + (1 - weight) * vector.cosine(F.col("context"), vector.literal(context))
    return stored.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(top)


def segment_optimally(m: np.ndarray, k: int | None = None, penalty: float = 1.0, most: int = 12) -> tuple[list[int], int, float]:
    """Boundaries, segment count and cost of the least within-segment squared error; with no ``k`` the
    count that minimises cost + penalty * k * ln(n)."""
    n = len(m)
    if not n:
        return [], 0, 0.0
    sums = np.vstack([np.zeros(m.shape[1]), np.cumsum(m, axis=0)])
    squares = np.concatenate([[0.0], np.cumsum((m * m).sum(axis=1))])
    top = min(n, k or most)
    best = np.full((top + 1, n + 1), np.inf)
    back = np.zeros((top + 1, n + 1), int)
    best[0, 0] = 0.0
    for end in range(1, n + 1):
        start = np.arange(end)
        size = end - start
        cost = squares[end] - squares[start] - ((sums[end] - sums[start]) ** 2).sum(axis=1) / size
        for parts in range(1, min(top, end) + 1):
            total = best[parts - 1, :end] + cost
            back[parts, end] = int(total.argmin())
            best[parts, end] = total[back[parts, end]]
    count = min(top, k) if k else min(range(1, top + 1), key=lambda p: (best[p, n] + penalty * p * np.log(max(n, 2)), p))
    bounds, end = [], n
    for parts in range(count, 0, -1):
        end = int(back[parts, end])
        if end:
            bounds.append(end)
    return bounds[::-1], count, float(best[count, n])


def segment_penalised(m: np.ndarray, beta: float) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the segments that minimise the squared errors plus ``beta`` for each, exactly.

    A start that is no better now than a boundary here, even without paying for one, never is again; with
    such starts left out the time is linear where boundaries keep coming.
    """
    n = len(m)
    if not n:
        return []
    sums = np.vstack([np.zeros(m.shape[1]), np.cumsum(m, axis=0)])
    squares = np.concatenate([[0.0], np.cumsum((m * m).sum(axis=1))])

    def cost(start, end):
        return np.maximum(0.0, squares[end] - squares[start] - ((sums[end] - sums[start]) ** 2).sum(axis=-1) / (end - start))

    best, back, starts = np.zeros(n + 1), np.zeros(n + 1, int), np.array([0])
    for end in range(1, n + 1):
        total = best[starts] + cost(starts, end)
        k = int(total.argmin())
        best[end], back[end] = total[k] + beta, starts[k]
        starts = np.append(starts[total <= best[end] + 1e-9], end)
    out, end = [], n
    while end:
        start = int(back[end])
        out.append((start, end, float(cost(np.array([start]), end)[0])))
        end = start
    return out[::-1]


def segment_streams(turns: DataFrame, stream: str, order: str, k: int | None = None, penalty: float = 1.0, stretch: int = STRETCH) -> DataFrame:
    """(stream, boundaries, k, cost) for every stream of vectors; steps without a vector do not count.

    With ``k`` segments each stream is one task's work (for short streams).  Without, the count that minimises
    cost + penalty * k * ln(n), whatever it is: exact for streams of up to ``stretch`` steps.  Longer ones
    are cut into stretches, each solved on its own, and solved again across every joint, from the last
    segment before it to the first one after it (where the stretch before it has more than one).
    """
    kinds = dict(turns.dtypes)
    rows = turns.where("embedding is not null").select(stream, order, "embedding")
    if k is not None:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.stack([np.asarray(v, float) for v in pdf.sort_values(order)["embedding"]])
            bounds, count, cost = segment_optimally(m, k, penalty)
            return pd.DataFrame({stream: [pdf[stream].iloc[0]], "boundaries": [bounds], "k": [count], "cost": [round(cost, 6)]})

        return rows.groupBy(stream).applyInPandas(kernel, f"{stream} {kinds[stream]}, boundaries array<int>, k int, cost double")
    placed = ranked(rows, [stream], [order], "__rank").withColumn("__part", F.expr(f"__rank div {stretch}"))
    size = cut(placed.groupBy(stream).agg(F.count(F.lit(1)).alias("__n")), "stream-sizes")
    same = lambda x, y: x[stream].eqNullSafe(y[stream])
    placed = placed.alias("p").join(broadcast_if_small(size).alias("z"), same(placed, size)).select("p.*", "__n")
    schema = f"{stream} {kinds[stream]}, __part bigint, start bigint, stop bigint, cost double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rank")
        first = int(pdf["__rank"].iloc[0])
        found = segment_penalised(np.stack([np.asarray(v, float) for v in pdf["embedding"]]), penalty * float(np.log(max(int(pdf["__n"].iloc[0]), 2))))
        return pd.DataFrame([(pdf[stream].iloc[0], int(pdf["__part"].iloc[0]), first + a, first + b, c) for a, b, c in found], columns=[stream, "__part", "start", "stop", "cost"])

    parts = cut(placed.groupBy(stream, "__part").applyInPandas(solve, schema), "segments")
    if size.where(F.col("__n") > stretch).isEmpty():
        segments = parts
    else:
        ends = parts.groupBy(stream, "__part").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("last"), F.min("stop").alias("first"))
        left, right = ends.alias("l"), ends.alias("r")
        joints = left.join(right, F.col(f"l.{stream}").eqNullSafe(F.col(f"r.{stream}")) & (F.col("l.__part") + 1 == F.col("r.__part"))).where("l.n > 1")
        joints = cut(joints.select(F.col(f"l.{stream}").alias(stream), F.col("l.__part").alias("joint"), F.col("l.last").alias("lo"), F.col("r.first").alias("hi")), "joints")
        within = placed.alias("p").join(joints.alias("j"), F.col(f"p.{stream}").eqNullSafe(F.col(f"j.{stream}")) & ((F.col("p.__part") == F.col("j.joint")) | (F.col("p.__part") == F.col("j.joint") + 1)))
        within = within.where("p.__rank >= j.lo and p.__rank < j.hi").select(F.col(f"p.{stream}").alias(stream), "__rank", "embedding", "__n", F.col("j.joint").alias("__part"))
        mended = within.groupBy(stream, "__part").applyInPandas(solve, schema)
        key = parts[stream].eqNullSafe(joints[stream]) & (((parts["__part"] == joints["joint"]) & (parts["start"] == joints["lo"])) | ((parts["__part"] == joints["joint"] + 1) & (parts["stop"] == joints["hi"])))
        segments = parts.join(joints, key, "left_anti").unionByName(mended)
    starts = F.array_sort(F.collect_list(F.when(F.col("start") > 0, F.col("start").cast("int"))))
    return segments.groupBy(stream).agg(starts.alias("boundaries"), F.count(F.lit(1)).cast("int").alias("k"), F.round(F.sum("cost"), 6).alias("cost"))


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 10) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, sim) and the centres: Lloyd rounds on unit vectors, each one distributed pass.

    Seeds are k-means++ style farthest picks among a bounded few rows (least by a hash of id); a centre
    that loses all members is put on the vector that fits its own centre worst.
    """
    rows = vectors.where("embedding is not null").select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sample = [_unit(np.array(r["v"])) for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(64, 8 * k)).collect()]
    if not sample:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("sim")), np.zeros((0, 0))
    centres = [sample[0]]
    while len(centres) < min(k, len(sample)):
        near = np.max(np.stack(sample) @ np.stack(centres).T, axis=1)
        centres.append(sample[int(near.argmin())])
    centre = np.stack(centres)
    kind = dict(rows.dtypes)["id"]

    def assign(batches, c):
        for pdf in batches:
            if len(pdf):
                m = np.stack([_unit(np.asarray(v, float)) for v in pdf["v"]])
                sim = m @ c.T
                yield pdf.assign(cluster=sim.argmax(axis=1), sim=np.round(sim.max(axis=1), 6), v=list(m))

    def placed(c: np.ndarray) -> DataFrame:
        return rows.mapInPandas(lambda it: assign(it, c), f"id {kind}, v array<double>, cluster int, sim double")

    for _ in range(rounds):
        now = placed(centre)
        sums = (
            now.select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
            .toPandas()  # k times the dimension
        )
        new = centre.copy()
        for cluster, part in sums.groupby("cluster"):
            v = np.zeros(centre.shape[1])
            v[part["d"].to_numpy(int)] = part["x"].to_numpy()
            new[cluster] = _unit(v)
        dead = sorted(set(range(len(centre))) - set(sums["cluster"].tolist()))
        if dead:
            for c, row in zip(dead, now.orderBy("sim", "id").limit(len(dead)).collect()):
                new[c] = np.array(row["v"])
        if np.allclose(new, centre, atol=1e-9):
            break
        centre = new
    return placed(centre).select("id", "cluster", "sim"), centre


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


def flatten_sessions(turns: DataFrame) -> DataFrame:
    """(stream, n, sessions, gold) of turns (stream, session, turn): all turns of a stream in one row of
    steps; ``gold`` are the steps at which a session other than the first begins."""
    steps = turns.withColumn("step", F.row_number().over(Window.partitionBy("stream").orderBy("session", "turn")) - 1)
    starts = steps.groupBy("stream", "session").agg(F.min("step").alias("start"), F.count(F.lit(1)).alias("n"))
    return starts.groupBy("stream").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"), F.array_sort(F.collect_list(F.when(F.col("start") > 0, F.col("start")))).alias("gold")
    )
