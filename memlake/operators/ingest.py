"""Ingestion: duplicate routing, ownership, micro-batch selection, orphans and the failure ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text, vector
from memlake.plans.ranking import ranked

DUPLICATE, REINFORCE = 0.95, 0.85
BATCH_ROWS = 10_000
BATCH, STRETCH = 50, 1000


def nearest(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, nearest, sim): each batch row's closest corpus row by cosine.

    A micro-batch is a stated query set against all rows: it is counted, and sent to all tasks in blocks of
    about ``BATCH_ROWS``, whose products with the corpus are those of matrices; a task reduces its part of
    the corpus to one best row per batch row before the shuffle.  Ties of the rounded cosine go to the least hash of id.
    """
    rows = batch.where("embedding is not null").select("id", "embedding")
    blocks = max(1, -(-rows.count() // BATCH_ROWS))
    found = None
    for block in range(blocks):
        part = _nearest(rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block), corpus)
        found = part if found is None else found.unionByName(part)
    return found


def _by_width(column: pd.Series) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, unit vectors) of the vectors of one length; zero vectors stay zero."""
    width, out = column.map(len).to_numpy(), []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        m = np.stack(column.to_numpy()[at]).astype(np.float64)
        out.append((int(w), at, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)))
    return out


def _nearest(few: DataFrame, corpus: DataFrame) -> DataFrame:
    spark, kind, far_kind = few.sparkSession, dict(few.dtypes)["id"], dict(corpus.dtypes)["id"]
    asked = few.toArrow().to_pandas()
    ids = asked["id"].to_numpy()
    known = spark.sparkContext.broadcast((ids, {w: (at, m) for w, at, m in _by_width(asked["embedding"])}))

    def best_of(batches):
        ids, sides = known.value
        own = {}
        for k, i in enumerate(ids):
            own.setdefault(i, []).append(k)
        best, tie, other = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64), np.empty(len(ids), object)
        for pdf in batches:
            pdf = pdf.sort_values("tie", kind="stable").reset_index(drop=True)
            for w, at, m in _by_width(pdf["embedding"]):
                for lo in range(0, len(at), 128):
                    here = at[lo : lo + 128]
                    # vectors of unlike lengths have a cosine of 0
                    sims = np.zeros((len(here), len(ids)))
                    if w in sides:
                        sims[:, sides[w][0]] = m[lo : lo + 128] @ sides[w][1].T
                    sims = np.copysign(np.floor(np.abs(sims) * 1e6 + 0.5) / 1e6, sims)
                    far, ties = pdf["other"].to_numpy()[here], pdf["tie"].to_numpy()[here]
                    for row, i in enumerate(far):
                        if i in own:
                            sims[row, own[i]] = -np.inf
                    top = sims.argmax(axis=0)  # the first of equal ones has the least hash
                    sim = sims[top, np.arange(len(ids))]
                    more = (sim > best) | ((sim == best) & (sim > -np.inf) & (ties[top] < tie))
                    best[more], tie[more], other[more] = sim[more], ties[top[more]], far[top[more]]
        some = best > -np.inf
        if some.any():
            yield pd.DataFrame({"id": ids[some], "sim": best[some] + 0.0, "tie": tie[some], "other": other[some]})

    rows = corpus.where("embedding is not null").select(F.col("id").alias("other"), "embedding", F.xxhash64("id").alias("tie"))
    sims = rows.mapInPandas(best_of, f"id {kind}, sim double, tie bigint, other {far_kind}")
    best = sims.groupBy("id").agg(F.max(F.struct("sim", F.negate("tie").alias("tie"), "other")).alias("m"))
    return best.select("id", F.col("m.other").alias("nearest"), F.col("m.sim").alias("sim"))


def route(batch: DataFrame, corpus: DataFrame, duplicate: float = DUPLICATE, reinforce: float = REINFORCE) -> DataFrame:
    """(id, route, nearest, sim): ``skip`` at ``duplicate`` or more, ``reinforce`` (stored, with an edge) at
    ``reinforce`` or more, else ``store``; rows without a vector are stored."""
    near = nearest(batch, corpus)
    way = F.when(F.col("sim") >= duplicate, "skip").when(F.col("sim") >= reinforce, "reinforce").otherwise("store")
    return batch.select("id").join(near, "id", "left").select("id", way.alias("route"), "nearest", "sim")


def ownership(entries: DataFrame, domains: DataFrame) -> DataFrame:
    """(id, domain): explicit targets (an array) or, without any, the domains that own by default; read-only ones never."""
    writable = domains.where("access = 'write'")
    explicit = entries.select("id", F.explode("targets").alias("domain")).join(F.broadcast(writable.select("domain")), "domain", "left_semi")
    auto = entries.where(F.coalesce(F.size("targets"), F.lit(0)) <= 0).select("id").crossJoin(F.broadcast(writable.where("auto_own").select("domain")))
    return explicit.select("id", "domain").unionByName(auto.select("id", "domain")).distinct()


def queue(tagged: DataFrame, tag: str = "tag:inbox", in_flight_prefix: str = "tag:inbox:processing:") -> DataFrame:
    """Ids that carry the queue tag and are not in flight."""
    waiting = tagged.where(F.col("out_id") == tag).select(F.col("in_id").alias("id")).distinct()
    busy = tagged.where(F.col("out_id").startswith(in_flight_prefix)).select(F.col("in_id").alias("id"))
    return waiting.join(busy, "id", "left_anti")


def _with_context(rows: DataFrame) -> DataFrame:
    return rows.withColumn("context_key", F.coalesce(F.col("request_context"), F.lit("")) if "request_context" in rows.columns else F.lit(""))


def similarity_batch(rows: DataFrame, threshold: float = 0.0, size: int = BATCH) -> DataFrame:
    """The oldest row, then those of its context by cosine to it (at ``threshold`` or more, if set),
    filled up with rows that have no vector; at most ``size``."""
    rows = _with_context(rows)
    seed = rows.orderBy("created_at", "id").limit(1).select(F.col("id").alias("seed"), F.col("embedding").alias("seed_vector"), F.col("context_key").alias("seed_key"))
    near = rows.crossJoin(F.broadcast(seed)).where("context_key = seed_key")
    near = near.withColumn("sim", F.when(F.col("id") == F.col("seed"), F.lit(2.0)).otherwise(F.round(vector.cosine(F.col("embedding"), F.col("seed_vector")), 6)))
    if threshold > 0:
        near = near.where(F.col("sim").isNull() | (F.col("sim") >= threshold))
    return near.orderBy(F.col("sim").desc_nulls_last(), "created_at", "id").limit(size).select("id", "sim")


def _deal(pdf: pd.DataFrame, threshold: float, size: int) -> pd.DataFrame:
    """Batches of one window of a queue, oldest seed first."""
    pdf = pdf.sort_values(["created_at", "id"], kind="stable").reset_index(drop=True)
    vectors = [None if v is None else np.asarray(v, float) for v in pdf["embedding"]]
    length = np.array([-1 if v is None else len(v) for v in vectors])
    norm = np.array([0.0 if v is None else float(np.sqrt(v @ v)) for v in vectors])
    left, batch, place = np.arange(len(pdf)), np.zeros(len(pdf), int), np.zeros(len(pdf), int)
    number = 0
    while len(left):
        seed, others = left[0], left[1:]
        if vectors[seed] is None:
            some = left[:size]
        else:
            alike = others[length[others] == length[seed]]
            sims = np.zeros(0)
            if len(alike):
                scale = norm[alike] * norm[seed]
                dots = np.stack([vectors[i] for i in alike]) @ vectors[seed]
                sims = np.round(np.where(scale > 0, dots / np.where(scale > 0, scale, 1), 0.0), 6)
            if threshold > 0:
                alike, sims = alike[sims >= threshold], sims[sims >= threshold]
            near = alike[np.argsort(-sims, kind="stable")][: size - 1]
            fill = others[length[others] != length[seed]][: size - 1 - len(near)]
            some = np.concatenate([[seed], near, fill])
        batch[some], place[some] = number, np.arange(len(some))
        left = left[~np.isin(left, some)]
        number += 1
    return pd.DataFrame({"id": pdf["id"], "context_key": pdf["context_key"], "stretch": pdf["stretch"], "batch": batch, "place": place})


def assign_batches(rows: DataFrame, threshold: float = 0.0, size: int = BATCH, stretch: int = STRETCH) -> DataFrame:
    """(id, context_key, stretch, batch, place): the whole queue (id, created_at, embedding, request_context) in batches.

    As if :func:`similarity_batch` were taken again and again: each batch is the oldest row that is left and,
    of its context, those most like it (at ``threshold`` or more, if set), filled up with rows that cannot be
    compared; a seed without a vector takes the next rows by age.  At most ``size`` rows each.

    A context's queue is dealt in stretches of ``stretch`` rows by age, and likeness is sought within a
    stretch, so no task holds a whole queue and what has been dealt does not change when rows arrive later.
    """
    wanted = _with_context(rows).select("id", "created_at", "context_key", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    aged = ranked(wanted, ["context_key"], ["created_at", "id"]).withColumn("stretch", F.expr(f"rank div {stretch}"))
    kind = dict(rows.dtypes)["id"]
    return aged.drop("rank").groupBy("context_key", "stretch").applyInPandas(
        lambda pdf: _deal(pdf, threshold, size), f"id {kind}, context_key string, stretch bigint, batch int, place int"
    )


def orphans(ids: DataFrame, owned: DataFrame, tagged: DataFrame, claim_prefix: str = "tag:inbox:assert-claim:", failed_prefix: str = "tag:inbox:failed") -> DataFrame:
    """(id, owners, claims, failures) of ids with no owner, no open claim and no failure."""
    owners = owned.groupBy(F.col("in_id").alias("id")).agg(F.count(F.lit(1)).alias("owners"))
    marks = tagged.groupBy(F.col("in_id").alias("id")).agg(
        F.count_if(F.col("out_id").startswith(claim_prefix)).alias("claims"), F.count_if(F.col("out_id").startswith(failed_prefix)).alias("failures")
    )
    rows = ids.join(owners, "id", "left").join(marks, "id", "left").na.fill(0, ["owners", "claims", "failures"])
    return rows.where("owners = 0 and claims = 0 and failures = 0")


def batch_key(stage, domain, ids, context):
    """Key of a failed batch: stage, domain, sorted ids and context."""
    return text.short_key(F.concat_ws("|", stage, domain, F.array_join(F.array_sort(ids), ","), F.coalesce(context, F.lit(""))), 16)


def failure_ledger(failures: DataFrame, most: int = 2) -> DataFrame:
    """(batch_key, attempts, state): a transient error is tried ``most`` times in all, others are quarantined."""
    kind = text.error_class(F.col("error"), F.col("name") if "name" in failures.columns else None)
    rows = failures.groupBy("batch_key").agg(
        F.count(F.lit(1)).alias("attempts"), F.max_by(kind, F.struct("at", "error")).alias("kind")
    )
    return rows.withColumn("state", F.when((F.col("kind") == "transient") & (F.col("attempts") < most), "retry").otherwise("quarantine"))


def supersede(claims: DataFrame) -> DataFrame:
    """Close each claim (id, valid_from, supersedes) at the valid_from of the one that supersedes it (the earliest)."""
    closing = claims.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min("valid_from").alias("valid_to"))
    return claims.join(closing, "id", "left")


def supersession_errors(claims: DataFrame) -> DataFrame:
    """(id, supersedes, problem): claims that supersede an unknown claim, or one already closed by an earlier."""
    known = claims.select(F.col("id").alias("supersedes"), F.lit(True).alias("known"))
    order = Window.partitionBy("supersedes").orderBy("valid_from", "id")
    rows = claims.where("supersedes is not null").withColumn("n", F.row_number().over(order)).join(known, "supersedes", "left")
    return rows.select(
        "id", "supersedes", F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "already closed").alias("problem")
    ).where("problem is not null")


def classify(rows: DataFrame, valid: Sequence[str], default: str, preset: str = "classification") -> DataFrame:
    """Keep a valid preset class, else the default."""
    return rows.withColumn(preset, F.when(F.col(preset).isin(*valid), F.col(preset)).otherwise(F.lit(default)))


def record_access(log: DataFrame) -> DataFrame:
    """(id, access_count, last_accessed_at) of an append-only access log."""
    return log.groupBy("id").agg(F.count(F.lit(1)).alias("access_count"), F.max("at").alias("last_accessed_at"))


def merge_attributes(old: Mapping, new: Mapping) -> dict:
    """Shallow merge, as an update of text does for every owner."""
    return {**old, **new}
