"""The engine: a store, domains and plugins, and the operations a caller sees.  Results are DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import filters, graph, ingest, jobs, phases, search
from memlake.operators.store import Store
from memlake.plans.scratch import cut

Hook = Callable[..., Any]


@dataclass(frozen=True)
class Skill:
    """A piece of guidance: for callers (external), for the domain itself (internal), or both."""

    id: str
    content: str
    scope: str = "external"
    writes: bool = False


@dataclass
class Domain:
    """Configuration of a domain; every hook takes and returns DataFrames and may be absent."""

    name: str
    access: str = "write"
    auto_own: bool = False
    include: Sequence[str] | None = None
    exclude: Sequence[str] = ()
    handler: Hook | None = None
    claim: Hook | None = None
    rank: Hook | None = None
    expand: Hook | None = None
    context: Hook | None = None
    tables: Mapping[str, Hook] = field(default_factory=dict)
    templates: Mapping[str, Hook] = field(default_factory=dict)
    schedules: Mapping[str, tuple[int, Hook]] = field(default_factory=dict)
    requires: Sequence[str] = ()
    description: str = ""
    bootstrap: Hook | None = None
    skills: Sequence[Skill] = ()


@dataclass
class Plugin:
    name: str
    after_inbox: Hook | None = None
    expand_search: Hook | None = None
    enrich_context: Hook | None = None
    bootstrap: Hook | None = None


class Engine:
    """Operations over one store.  ``embed`` maps a text to a vector and may be absent."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[str], Sequence[float]] | None = None):
        self.spark, self.store, self.embed = spark, Store(spark, path), embed
        self.domains: dict[str, Domain] = {}
        self.plugins: list[Plugin] = []

    # -- registry ---------------------------------------------------------------------------------
    def register(self, domain: Domain) -> None:
        missing = set(domain.requires) - {p.name for p in self.plugins}
        if missing:
            raise ValueError(f"{domain.name} needs {sorted(missing)}")
        self.domains[domain.name] = domain

    def use(self, plugin: Plugin) -> None:
        self.plugins.append(plugin)

    def visible(self, name: str) -> list[str]:
        """Domains that one may see: its include list (or all) less its exclude list, itself always."""
        own = self.domains[name]
        names = [n for n in self.domains if (own.include is None or n in own.include) and n not in own.exclude]
        return sorted({*names, name})

    def skills(self, name: str, internal: bool = False) -> list[Skill]:
        """A domain's skills: its own view, or a caller's, who of a read-only domain gets none that write."""
        domain = self.domains[name]
        wanted = ("internal", "both") if internal else ("external", "both")
        return [s for s in domain.skills if s.scope in wanted and (internal or domain.access == "write" or not s.writes)]

    def summaries(self) -> list[dict[str, Any]]:
        return [{"id": d.name, "description": d.description, "access": d.access, "skills": len(d.skills)} for d in self.domains.values()]

    def bootstrap(self, name: str) -> None:
        """A domain's own first work, then the plugins'."""
        for hook in (self.domains[name].bootstrap, *(p.bootstrap for p in self.plugins)):
            if hook:
                hook(self)

    # -- inbox ------------------------------------------------------------------------------------
    def submit(self, texts: Sequence[str], domains: Sequence[str] = (), now_ms: int = 0) -> list[str]:
        """Put texts into the inbox: owners and queue tags as ``phases.address`` says; returns the ids."""
        ids = [f"memory:{uuid.uuid4()}" for _ in texts]
        rows = self.spark.createDataFrame(
            [(i, t, list(map(float, self.embed(t))) if self.embed else None, now_ms) for i, t in zip(ids, texts)],
            "id string, content string, embedding array<float>, created_at bigint",
        ).withColumn("token_count", text.token_count(F.col("content")))
        listed = self.spark.createDataFrame([(d.name, d.access, d.auto_own, d.claim is not None) for d in self.domains.values()], "domain string, access string, auto_own boolean, claims boolean")
        entries = self.spark.createDataFrame([(i, list(domains)) for i in ids], "id string, targets array<string>")
        owners, tags = phases.address(entries, listed)

        def work(store: Store) -> None:
            store.create("memory", rows)
            store.relate("owned_by", owners.withColumn("owned_at", F.lit(now_ms).cast("bigint")))
            store.relate("tagged", tags)

        self.store.transaction(work)
        self.log(rows.select(F.lit("ingested").alias("name"), F.col("id").alias("memory_id"), F.lit(None).cast("string").alias("domain"), F.lit(now_ms).cast("bigint").alias("at")))
        return ids

    def process_inbox(self, now_ms: int = 0, most: int = 2) -> dict[str, DataFrame]:
        """Claims, handlers, then the plugins' ``after_inbox`` over what was processed; the rows of each handler.

        A claim or a handler takes (entries, engine), one batch at a time, and returns rows, a handler also
        None.  Entries that were offered and that nobody wants are deleted.
        """
        memory, failures, tags = self.store.read("memory"), self.store.read("failure"), self._queue()
        bound = lambda hook: lambda rows: hook(rows, self)
        claims = {d.name: bound(d.claim) for d in self.domains.values() if d.claim and d.access == "write"}
        claimed = phases.claim_phase(memory, tags, claims, failures, most, now_ms, self._edges("owned_by").select("in_id"))
        handlers = {d.name: bound(d.handler) for d in self.domains.values() if d.handler}
        done = phases.process_phase(memory, claimed.tags, handlers, claimed.failures, most, now_ms)
        events = cut(claimed.events.unionByName(done.events), "events")
        # a handler may have written; its edges stay, only the queue's own tags are replaced
        gone = claimed.unclaimed
        now = self.store.read("edges")
        typed = lambda rows, kind: rows.select(F.lit(kind).alias("edge_type"), "in_id", "out_id")
        rest = now.where(~self._queued()).unionByName(typed(done.tags, "tagged"), allowMissingColumns=True)
        rest = rest.unionByName(typed(claimed.owners, "owned_by").withColumn("owned_at", F.lit(now_ms).cast("bigint")), allowMissingColumns=True)
        rest = rest.join(gone.select(F.col("id").alias("in_id")), "in_id", "left_anti").select(*rest.columns)

        def work(store: Store) -> None:
            store.write("edges", rest)
            store.write("failure", done.failures)
            if not gone.isEmpty():
                store.write("memory", store.read("memory").join(gone, "id", "left_anti"))

        self.store.transaction(work)
        self.log(events)
        processed = events.where("name = 'inboxProcessed'").select(F.col("memory_id").alias("id"))
        for plugin in self.plugins:
            if plugin.after_inbox:
                plugin.after_inbox(processed, self)
        return done.outputs

    def _queued(self):
        """Whether an edge is a tag of the inbox."""
        return (F.col("edge_type") == "tagged") & ((F.col("out_id") == phases.ROOT) | F.col("out_id").startswith(f"{phases.ROOT}:"))

    def _queue(self) -> DataFrame:
        return self.store.read("edges").where(self._queued()).select("in_id", "out_id")

    def log(self, events: DataFrame) -> None:
        """Append events (name, memory_id, domain, at) to the event log."""
        self.store.create("event", events.withColumn("id", F.expr("uuid()")))

    def events(self, name: str | None = None) -> DataFrame:
        rows = self.store.read("event")
        return rows if name is None else rows.where(F.col("name") == name)

    # -- tables -----------------------------------------------------------------------------------
    def _edges(self, kind: str) -> DataFrame:
        return self.store.read("edges").where(F.col("edge_type") == kind)

    def corpus(self) -> search.Corpus:
        edges = self.store.read("edges")
        kinds = {r[0] for r in edges.select("edge_type").distinct().collect()}
        return search.Corpus(
            self.store.read("memory"), self._edges("tagged"), self._edges("owned_by"),
            edges.where(F.col("edge_type").isin("reinforces", "contradicts", "summarizes", "refines")), {k: self._edges(k) for k in kinds},
        )

    # -- memories ---------------------------------------------------------------------------------
    def write(self, texts: Sequence[str], domains: Sequence[str] = (), tags: Sequence[str] = (), now_ms: int = 0, event_time: int | None = None) -> list[str]:
        """Store texts with their owners and tags; returns the ids."""
        targets = list(domains) or [d.name for d in self.domains.values() if d.auto_own]
        targets = [t for t in targets if t in self.domains and self.domains[t].access == "write"]
        if not targets:
            raise ValueError("no domain takes this entry")
        ids = [f"memory:{uuid.uuid4()}" for _ in texts]
        rows = self.spark.createDataFrame(
            [(i, t, list(map(float, self.embed(t))) if self.embed else None, event_time, now_ms) for i, t in zip(ids, texts)],
            "id string, content string, embedding array<float>, event_time bigint, created_at bigint",
        ).withColumn("token_count", text.token_count(F.col("content")))
        pairs = [(i, f"domain:{t}", now_ms) for i in ids for t in targets]

        def work(store: Store) -> None:
            store.create("memory", rows)
            store.relate("owned_by", self.spark.createDataFrame(pairs, "in_id string, out_id string, owned_at bigint"))
            if tags:
                self._tag(store, ids, tags)

        self.store.transaction(work)
        return ids

    def ingest(self, texts: Sequence[str], duplicate: float = ingest.DUPLICATE, reinforce: float = ingest.REINFORCE, **more) -> dict[str, str]:
        """Write what is no near duplicate of stored memories; (text -> skip, reinforce or store)."""
        if self.embed is None:
            self.write(texts, **more)
            return {t: "store" for t in texts}
        batch = self.spark.createDataFrame([(t, list(map(float, self.embed(t)))) for t in dict.fromkeys(texts)], "id string, embedding array<float>")
        routes = {r["id"]: (r["route"], r["nearest"]) for r in ingest.route(batch, self.store.read("memory"), duplicate, reinforce).collect()}
        fresh = [t for t, (way, _) in routes.items() if way != "skip"]
        ids = dict(zip(fresh, self.write(fresh, **more))) if fresh else {}
        edges = [(ids[t], near) for t, (way, near) in routes.items() if way == "reinforce"]
        if edges:
            self.store.relate("reinforces", self.spark.createDataFrame(edges, "in_id string, out_id string"))
        return {t: way for t, (way, _) in routes.items()}

    def get(self, *ids: str) -> DataFrame:
        return self.store.read("memory").where(F.col("id").isin(*ids))

    def update(self, memory: str, content: str | None = None, attributes: Mapping[str, Any] | None = None) -> None:
        """New text is embedded again; attributes are merged into every owner's."""
        if content is not None:
            vector = list(map(float, self.embed(content))) if self.embed else None
            self.store.update("memory", self.spark.createDataFrame([(memory, content, vector, -(-len(content) // 4))], "id string, content string, embedding array<float>, token_count bigint"))
        if attributes:
            import json

            edges = self.store.read("edges")
            mine = (F.col("edge_type") == "owned_by") & (F.col("in_id") == memory)
            old = F.from_json(F.coalesce("attributes", F.lit("{}")), "map<string,string>")
            new = F.from_json(F.lit(json.dumps({k: v if isinstance(v, str) else json.dumps(v) for k, v in attributes.items()})), "map<string,string>")
            merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new))
            self.store.write("edges", edges.withColumn("attributes", F.when(mine, merged).otherwise(F.col("attributes"))))

    def release(self, memory: str, domain: str) -> None:
        """Drop one owner; the last one takes the memory with it."""
        gone = self.spark.createDataFrame([(memory, f"domain:{domain}")], "in_id string, out_id string")
        owned, _, kept = graph.release(self._edges("owned_by"), self._edges("tagged"), self.store.read("memory"), gone)
        edges, ids = self.store.read("edges"), kept.select("id")
        rest = edges.where("edge_type <> 'owned_by'").unionByName(owned)
        for end in ("in_id", "out_id"):
            is_memory = F.col(end).startswith("memory:")
            rest = rest.where(~is_memory).unionByName(rest.where(is_memory).join(ids.withColumnRenamed("id", end), end, "left_semi").select(*rest.columns))

        def work(store: Store) -> None:
            store.write("memory", kept)
            store.write("edges", rest)

        self.store.transaction(work)

    # -- tags and edges ---------------------------------------------------------------------------
    def _tag(self, store: Store, ids: Sequence[str], tags: Sequence[str]) -> None:
        nodes, tree = graph.tag_paths(self.spark.createDataFrame([(t,) for t in tags], "path string"))
        store.create("tag", nodes, ignore=True)
        store.relate("child_of", tree)
        leaves = [(i, "tag:" + t.split("/")[-1]) for i in ids for t in tags]
        store.relate("tagged", self.spark.createDataFrame(leaves, "in_id string, out_id string"))

    def tag(self, memory: str, *tags: str) -> None:
        self.store.transaction(lambda store: self._tag(store, [memory], tags))

    def untag(self, memory: str, tag: str) -> None:
        self.store.unrelate("tagged", memory, f"tag:{tag.split('/')[-1]}")

    def tags(self, memory: str) -> DataFrame:
        return self._edges("tagged").where(F.col("in_id") == memory).select(text.tag_label(F.col("out_id")).alias("label"))

    def edges(self, node: str, direction: str = "both") -> DataFrame:
        return graph.neighbours(self.store.read("edges"), node, direction)

    def relate(self, src: str, edge: str, dst: str) -> None:
        self.store.relate(edge, self.spark.createDataFrame([(src, dst)], "in_id string, out_id string"))

    def unrelate(self, src: str, edge: str, dst: str) -> None:
        self.store.unrelate(edge, src, dst)

    def traverse(self, start: str, edges: Sequence[str], depth: int = 1) -> DataFrame:
        rows = self.store.read("edges").where(F.col("edge_type").isin(*edges))
        return graph.traverse(rows, self.spark.createDataFrame([(start,)], "id string"), depth)

    # -- retrieval --------------------------------------------------------------------------------
    def search(self, query: search.SearchQuery, caller: str | None = None) -> DataFrame:
        asked = [self.domains[n] for n in (d.removeprefix("domain:") for d in query.domains) if n in self.domains]
        expand = [d.expand for d in asked if d.expand] + [p.expand_search for p in self.plugins if p.expand_search]
        rank = [d.rank for d in asked if d.rank]
        visible = None if caller is None else [f"domain:{n}" for n in self.visible(caller)]
        return search.engine_search(self.corpus(), query, expand, rank, visible)

    def build_context(self, query: search.SearchQuery, budget: int = 4000) -> DataFrame:
        """The domain's own builder for exactly one target domain, else the default; plugins follow."""
        names = [d.removeprefix("domain:") for d in query.domains]
        if len(names) == 1 and (own := self.domains.get(names[0])) and own.context:
            return own.context(self, query, budget)
        core = None
        if names:
            core = filters.having_tags(self.store.read("memory"), self._edges("tagged"), [f"tag:core:{n}" for n in names])
        out = search.build_context(self.search(query), self.store.read("memory"), budget, core)
        for plugin in self.plugins:
            out = plugin.enrich_context(out) if plugin.enrich_context else out
        return out

    def core_memories(self, domain: str) -> DataFrame:
        return filters.having_tags(self.store.read("memory"), self._edges("tagged"), [f"tag:core:{domain}"])

    def pin(self, memory: str, domain: str) -> None:
        self.tag(memory, f"core:{domain}")

    def unpin(self, memory: str, domain: str) -> None:
        self.untag(memory, f"core:{domain}")

    def search_table(self, domain: str, table: str, params: Mapping[str, Any] = {}) -> DataFrame:
        return self.domains[domain].tables[table](self, params)

    def run_template(self, domain: str, name: str, params: Mapping[str, Any] = {}) -> DataFrame:
        return self.domains[domain].templates[name](self, params)

    # -- jobs -------------------------------------------------------------------------------------
    def schedules(self) -> list[dict[str, Any]]:
        """All schedules with their interval and last run."""
        meta = {r["id"]: int(r["value"]) for r in self.store.read("meta").where(F.col("id").startswith("schedule:")).collect()}
        return [{"domain": d.name, "schedule": s, "interval_ms": every, "last_run": meta.get(f"schedule:{d.name}:{s}")} for d in self.domains.values() for s, (every, _) in d.schedules.items()]

    def run_due(self, now_ms: int) -> list[str]:
        """Run the schedules whose interval has passed; last runs are rows of ``meta``, set after success."""
        meta = {r["id"]: int(r["value"]) for r in self.store.read("meta").where(F.col("id").startswith("schedule:")).collect()}
        listed = [(d.name, s, every, meta.get(f"schedule:{d.name}:{s}")) for d in self.domains.values() for s, (every, _) in d.schedules.items()]
        if not listed:
            return []
        rows = self.spark.createDataFrame(listed, "domain string, schedule_id string, interval_ms bigint, last_run bigint")
        done = []
        for r in jobs.due_schedules(rows, now_ms).orderBy("domain", "schedule_id").collect():
            self.trigger(r["domain"], r["schedule_id"])
            done.append(f"schedule:{r['domain']}:{r['schedule_id']}")
        kept = self.store.read("meta").where(~F.col("id").isin(*done)) if done else self.store.read("meta")
        if done:
            self.store.write("meta", kept.unionByName(self.spark.createDataFrame([(d, str(now_ms)) for d in done], "id string, value string")))
        return done

    def trigger(self, domain: str, schedule: str) -> None:
        self.domains[domain].schedules[schedule][1](self)
