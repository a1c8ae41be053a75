"""The phases of the inbox over tag edges: address, claim, process.

A tag says what an entry waits for.  Each phase reads the tags, calls the hooks of the domains (a few, on
the driver; the work of a hook is a DataFrame) and returns the tags as they are afterwards.  A hook that
raises leaves its batch waiting, or moves it to a failed tag once its attempts are used up.

A hook is given one batch at a time (``ingest.assign_batches``).  A batch that failed stays as it is, with its
members written beside the error, so its attempts are counted whatever arrives later, and other batches go on.

A hook called batch by batch costs the driver a plan each.  One whose work is told by rows alone can be given all
batches at once (:class:`Whole`): its errors are rows as well, and no list of batches reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import ingest
from memlake.plans.scratch import broadcast_if_small, cut

# The tags of the queue.
ROOT = "tag:inbox"
CLAIM, FAILED, FAILED_CLAIM = "tag:inbox:assert-claim:", "tag:inbox:failed:", "tag:inbox:failed-assert-claim:"
EDGE, EVENT = "in_id string, out_id string", "name string, memory_id string, domain string, at bigint"
FAILURE = "batch_key string, stage string, domain string, ids array<string>, name string, error string, at bigint"
MOST_BATCHES = 1000

Hook = Callable[[DataFrame], DataFrame | None]


@dataclass(frozen=True)
class Whole:
    """A hook that is given the rows of all batches at once, with their ``batch_key``.

    ``run`` must say of each batch what it would say of that batch alone.  ``errors`` gives the batches that
    fail, (batch_key, name, error), in any number of rows; ``run`` does not see those.  If one of them raises,
    that is the error of every batch.
    """

    run: Hook
    errors: Hook | None = None


@dataclass
class Phase:
    """What a phase leaves: owner edges to add, all tags of the queue, failures of open batches, events, the
    hooks' rows, and entries (id) that nobody wanted."""

    owners: DataFrame
    tags: DataFrame
    failures: DataFrame
    events: DataFrame
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    unclaimed: DataFrame | None = None


def address(entries: DataFrame, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owner edges, tag edges) of new entries (id, targets) over domains (domain, access, auto_own, claims).

    Explicit targets, as far as they may be written, own the entry.  Without any, domains that own by
    default do, and those that claim get to look.  Each owner and each claim is a tag beside the root's.
    An entry without a target is an error.
    """
    owned = ingest.ownership(entries, domains)
    asking = F.broadcast(domains.where("access = 'write' and claims and not auto_own").select("domain"))
    asked = entries.where(F.coalesce(F.size("targets"), F.lit(0)) <= 0).select("id").crossJoin(asking)
    edge = lambda rows, prefix: rows.select(F.col("id").alias("in_id"), F.concat(F.lit(prefix), "domain").alias("out_id"))
    tags = cut(edge(owned, f"{ROOT}:").unionByName(edge(asked, CLAIM)).distinct(), "tags")
    if not entries.join(tags.select(F.col("in_id").alias("id")), "id", "left_anti").isEmpty():
        raise ValueError("no domain takes this entry")
    return edge(owned, "domain:"), tags.unionByName(tags.select("in_id", F.lit(ROOT).alias("out_id")).distinct())


def _batches(entries: DataFrame, failures: DataFrame, stage: str, domain: str, threshold: float, size: int, most: int | None) -> DataFrame:
    """(id, batch_key) of the first ``most`` batches (None: all) of a domain's waiting entries, failed ones first."""
    mine = failures.where((F.col("stage") == stage) & (F.col("domain") == domain))
    kept = mine.select("batch_key", F.explode("ids").alias("id")).groupBy("id").agg(F.min("batch_key").alias("batch_key"))
    # the marks of a batch that failed before stay, so its attempts can be counted
    known = entries.select("id", *(c for c in ("created_at", "embedding", "request_context") if c in entries.columns)).join(broadcast_if_small(cut(kept, "kept")), "id", "left")
    fresh = known.where("batch_key is null").drop("batch_key")
    for name, kind in (("created_at", "bigint"), ("embedding", "array<double>")):
        if name not in fresh.columns:
            fresh = fresh.withColumn(name, F.lit(None).cast(kind))
    dealt = ingest.assign_batches(fresh, threshold, size)
    keys = dealt.groupBy("context_key", "stretch", "batch").agg(F.collect_list("id").alias("ids"))
    keyed = keys.select(F.explode("ids").alias("id"), ingest.batch_key(F.lit(stage), F.lit(domain), F.col("ids"), F.col("context_key")).alias("batch_key"), "stretch", "batch", "context_key")
    again = known.where("batch_key is not null").select("id", "batch_key", F.lit(-1).cast("bigint").alias("stretch"), F.lit(0).alias("batch"), F.lit("").alias("context_key"))
    every = cut(again.unionByName(keyed), "batches")
    if most is None:
        return every.select("id", "batch_key")
    first = every.select("batch_key", "stretch", "batch", "context_key").distinct().orderBy("stretch", "batch", "context_key", "batch_key").limit(most)
    return every.join(F.broadcast(first.select("batch_key")), "batch_key", "left_semi").select("id", "batch_key")


def _run(hook: Hook, batches: dict[str, DataFrame], label: str) -> tuple[DataFrame | None, dict[str, Exception]]:
    """(rows of all batches that went well, errors by batch).

    What the hook returns for its batches is computed in one job; only if that fails is each batch
    computed alone, which shows whose error it is.
    """
    plans, errors = {}, {}
    for key, rows in batches.items():
        try:
            plans[key] = hook(rows)
        except Exception as problem:  # a hook's failure is a row of the ledger
            errors[key] = problem
    plans = {k: p for k, p in plans.items() if p is not None}

    def joined(parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    try:
        whole = joined(list(plans.values()))
        return (None if whole is None else cut(whole, label)), errors
    except Exception:
        done = {}
        for key, plan in plans.items():
            try:
                done[key] = cut(plan, label)
            except Exception as problem:
                errors[key] = problem
        return joined(list(done.values())), errors


def _run_whole(hook: Whole, mine: DataFrame, label: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows of all batches that went well, (batch_key, name, error) of the others, each batch once)."""
    try:
        bad = mine.select("batch_key", F.lit("").alias("name"), F.lit("").alias("error")).where("false")
        if hook.errors is not None and (found := hook.errors(mine)) is not None:
            said = found.groupBy("batch_key").agg(F.min(F.struct("name", "error")).alias("m")).select("batch_key", "m.name", "m.error")
            bad = cut(said.join(mine.select("batch_key").distinct(), "batch_key", "left_semi"), "said")
        plan = hook.run(mine.join(bad, "batch_key", "left_anti"))
        return (None if plan is None else cut(plan, label)), bad
    except Exception as problem:  # every batch's failure
        said = [F.lit(type(problem).__name__).alias("name"), F.lit(str(problem) or None).cast("string").alias("error")]
        return None, cut(mine.select("batch_key").distinct().select("batch_key", *said), "said")


def _phase(memory, tags, hooks: Mapping[str, Hook | Whole], failures, most, now_ms, stage, waiting_tag, failed_tag, succeed, threshold, size, batches) -> Phase:
    spark = memory.sparkSession
    failures = spark.createDataFrame([], FAILURE) if failures is None else failures
    queue = cut(tags.select("in_id", "out_id").where((F.col("out_id") == ROOT) | F.col("out_id").startswith(f"{ROOT}:")), "queue")
    state = Phase(spark.createDataFrame([], EDGE), queue, failures, spark.createDataFrame([], EVENT))
    moved = []
    for domain, hook in hooks.items():
        waiting = queue.where(F.col("out_id") == waiting_tag + domain).select(F.col("in_id").alias("id")).distinct()
        entries = cut(memory.join(waiting, "id", "left_semi"), "entries")
        if entries.isEmpty():
            continue
        members = cut(_batches(entries, state.failures, stage, domain, threshold, size, batches), "members")
        mine = cut(entries.join(members, "id"), "entries")
        if isinstance(hook, Whole):
            out, said = _run_whole(hook, mine, f"{stage}-{domain}")
        else:
            keys = [r[0] for r in members.select("batch_key").distinct().orderBy("batch_key").collect()]
            out, errors = _run(hook, {k: mine.where(F.col("batch_key") == k).drop("batch_key") for k in keys}, f"{stage}-{domain}")
            said = spark.createDataFrame([(k, type(e).__name__, str(e) or None) for k, e in errors.items()], "batch_key string, name string, error string")
        if not said.isEmpty():
            listed = members.groupBy("batch_key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            new = listed.join(said, "batch_key").select("batch_key", F.lit(stage).alias("stage"), F.lit(domain).alias("domain"), "ids", "name", "error", F.lit(now_ms).cast("bigint").alias("at"))
            state.failures = cut(state.failures.unionByName(new), "failures")
        ledger = ingest.failure_ledger(state.failures.join(members, "batch_key", "left_semi"), most)
        held = broadcast_if_small(cut(ledger.join(said, "batch_key", "left_semi").select("batch_key", "state"), "ledger"))
        marked = cut(members.join(held, "batch_key", "left"), "marked")
        done, lost = marked.where("state is null").select("id"), marked.where("state = 'quarantine'").select("id")
        # batches that are through or given up are no longer open
        state.failures = cut(state.failures.join(marked.where("coalesce(state, '') <> 'retry'").select("batch_key").distinct(), "batch_key", "left_anti").select(*state.failures.columns), "failures")
        moved.append(done.select(F.col("id").alias("in_id"), F.lit(waiting_tag + domain).alias("out_id"), F.lit(None).cast("string").alias("new_id")))
        moved.append(lost.select(F.col("id").alias("in_id"), F.lit(waiting_tag + domain).alias("out_id"), F.lit(failed_tag + domain).alias("new_id")))
        succeed(state, domain, done, out)
    if moved:
        every = moved[0]
        for part in moved[1:]:
            every = every.unionByName(part)
        every = cut(every, "moved")
        rest = queue.join(every, ["in_id", "out_id"], "left_anti").select("in_id", "out_id")
        fresh = every.where("new_id is not null").select("in_id", F.col("new_id").alias("out_id"))
        state.tags = cut(rest.unionByName(fresh).unionByName(state.tags.join(queue, ["in_id", "out_id"], "left_anti")).distinct(), "tags")
    return state


def claim_phase(
    memory: DataFrame, tags: DataFrame, hooks: Mapping[str, Hook | Whole], failures: DataFrame | None = None, most: int = 2, now_ms: int = 0,
    owned: DataFrame | None = None, threshold: float = 0.0, size: int = ingest.BATCH, batches: int | None = MOST_BATCHES,
) -> Phase:
    """Each domain's hook picks, of the entries offered to it, those (id) that it claims: they get its owner
    edge and its inbox tag; the offer is over for all.  Ids that were not offered are ignored.

    With ``owned`` (in_id), ``unclaimed`` has the entries whose last offer is over and that nobody owns, nor may
    yet claim, nor failed to claim: they are to be deleted, and have no tags any more.
    """
    offered = tags.where(F.col("out_id").startswith(CLAIM)).select(F.col("in_id").alias("id")).distinct()

    def succeed(state: Phase, domain: str, done: DataFrame, out: DataFrame | None) -> None:
        if out is None:
            return
        mine = cut(done.join(out.select("id").distinct(), "id", "left_semi"), "claimed")
        edge = lambda end: mine.select(F.col("id").alias("in_id"), F.lit(end).alias("out_id"))
        state.owners = state.owners.unionByName(edge(f"domain:{domain}"))
        state.tags = state.tags.unionByName(edge(f"{ROOT}:{domain}"))
        state.events = state.events.unionByName(mine.select(F.lit("inboxClaimAsserted").alias("name"), F.col("id").alias("memory_id"), F.lit(domain).alias("domain"), F.lit(now_ms).cast("bigint").alias("at")))

    state = _phase(memory, tags, hooks, failures, most, now_ms, "assert", CLAIM, FAILED_CLAIM, succeed, threshold, size, batches)
    if owned is not None:
        held = owned.select("in_id").unionByName(state.owners.select("in_id"))
        state.unclaimed = cut(ingest.orphans(offered, held, state.tags, CLAIM, FAILED_CLAIM).select("id"), "unclaimed")
        state.tags = cut(state.tags.join(state.unclaimed.select(F.col("id").alias("in_id")), "in_id", "left_anti").select("in_id", "out_id"), "tags")
        state.events = state.events.unionByName(state.unclaimed.select(F.lit("deleted").alias("name"), F.col("id").alias("memory_id"), F.lit(None).cast("string").alias("domain"), F.lit(now_ms).cast("bigint").alias("at")))
    return state


def process_phase(
    memory: DataFrame, tags: DataFrame, hooks: Mapping[str, Hook | Whole], failures: DataFrame | None = None, most: int = 2, now_ms: int = 0,
    threshold: float = 0.0, size: int = ingest.BATCH, batches: int | None = MOST_BATCHES,
) -> Phase:
    """Each domain's handler takes the entries that wait for it, batch by batch; then they wait no more.

    An entry that waits for nothing any more loses the root tag, also if what it waited for has failed.
    """

    def succeed(state: Phase, domain: str, done: DataFrame, out: DataFrame | None) -> None:
        if out is not None:
            state.outputs[domain] = out
        state.events = state.events.unionByName(done.select(F.lit("inboxDomainProcessed").alias("name"), F.col("id").alias("memory_id"), F.lit(domain).alias("domain"), F.lit(now_ms).cast("bigint").alias("at")))

    state = _phase(memory, tags, hooks, failures, most, now_ms, "process", f"{ROOT}:", FAILED, succeed, threshold, size, batches)
    failed = F.col("out_id").startswith(f"{ROOT}:failed")
    active = state.tags.where(F.col("out_id").startswith(f"{ROOT}:") & ~failed).select("in_id").distinct()
    root = F.col("out_id") == ROOT
    done = state.tags.where(root).join(active, "in_id", "left_anti")
    state.tags = cut(state.tags.where(~root).unionByName(state.tags.where(root).join(active, "in_id", "left_semi").select("in_id", "out_id")), "tags")
    state.events = state.events.unionByName(done.select(F.lit("inboxProcessed").alias("name"), F.col("in_id").alias("memory_id"), F.lit(None).cast("string").alias("domain"), F.lit(now_ms).cast("bigint").alias("at")))
    return state
