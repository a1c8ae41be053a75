"""Inbox phases through the engine, contexts, paths and prompts on small fixtures."""

import pytest
from pyspark.sql import functions as F

from memlake.engine import Domain, Engine, Plugin, Skill
from memlake.operators import contexts, enrich, graph, paths, phases, search
from memlake.sources.loaders import load_prompt


def _edges(engine, kind):
    return {(r.in_id, r.out_id) for r in engine.store.read("edges").where(F.col("edge_type") == kind).collect()}


def test_inbox_through_the_engine(spark, tmp_path):
    engine, after = Engine(spark, str(tmp_path / "store")), []
    engine.use(Plugin("watch", after_inbox=lambda rows, e: after.extend(r.id for r in rows.collect())))
    engine.register(Domain("log", auto_own=True, handler=lambda rows, e: rows.select("id", F.upper("content").alias("loud"))))
    engine.register(Domain("kb", claim=lambda rows, e: rows.where("content like 'fact%'").select("id"), handler=lambda rows, e: None))
    a, b = engine.submit(["fact one", "chatter"], now_ms=5)
    assert (a, "tag:inbox:assert-claim:kb") in _edges(engine, "tagged") and (a, "domain:log") in _edges(engine, "owned_by")
    out = engine.process_inbox(now_ms=7)
    assert {r.loud for r in out["log"].collect()} == {"FACT ONE", "CHATTER"}
    assert _edges(engine, "tagged") == set()
    assert _edges(engine, "owned_by") == {(a, "domain:log"), (b, "domain:log"), (a, "domain:kb")}
    assert sorted(after) == sorted([a, b])
    assert engine.events("inboxClaimAsserted").count() == 1 and engine.events("inboxDomainProcessed").count() == 3
    assert engine.process_inbox(now_ms=8) == {}


def _waiting(spark, n, domain="kb", start=0):
    memory = [(f"m:{i:03d}", i, None) for i in range(start, start + n)]
    tags = [(m, t) for m, _, _ in memory for t in ("tag:inbox", f"tag:inbox:{domain}")]
    return spark.createDataFrame(memory, "id string, created_at bigint, embedding array<double>"), spark.createDataFrame(tags, "in_id string, out_id string")


def test_failing_handler_is_tried_twice_and_then_put_aside(spark):
    memory, tags = _waiting(spark, 2)

    def slow(rows):
        raise TimeoutError("timeout")

    state = phases.process_phase(memory, tags, {"kb": slow})
    assert state.tags.count() == 4 and state.failures.count() == 1
    state = phases.process_phase(memory, state.tags, {"kb": slow}, state.failures)
    assert {r.out_id for r in state.tags.collect()} == {"tag:inbox:failed:kb"} and state.failures.count() == 0


def test_one_bad_entry_moves_its_batch_alone(spark):
    memory, tags = _waiting(spark, 12)
    asked = []

    def hook(rows):
        got = sorted(r.id for r in rows.collect())
        asked.append(got)
        if "m:005" in got:
            raise ValueError("bad input")
        # an error that only shows when the rows are computed stays with its batch as well
        return rows.select("id", F.when(F.col("id") == "m:009", F.raise_error(F.lit("late"))).otherwise(F.lit("ok")).alias("said"))

    state = phases.process_phase(memory, tags, {"kb": hook}, size=3)
    assert sorted(asked) == [[f"m:{i:03d}" for i in range(k, k + 3)] for k in (0, 3, 6, 9)]
    assert {(r.in_id, r.out_id) for r in state.tags.collect()} == {(f"m:{i:03d}", "tag:inbox:failed:kb") for i in (3, 4, 5, 9, 10, 11)}
    assert {r.id for r in state.outputs["kb"].collect()} == {f"m:{i:03d}" for i in (0, 1, 2, 6, 7, 8)}


def test_attempts_survive_arrivals(spark):
    def slow(rows):
        if rows.where("id = 'm:001'").count():
            raise ConnectionError("connection reset")

    memory, tags = _waiting(spark, 3)
    state = phases.process_phase(memory, tags, {"kb": slow}, size=4)
    assert [sorted(r.ids) for r in state.failures.collect()] == [["m:000", "m:001", "m:002"]]
    more, fresh = _waiting(spark, 4, start=10)
    memory = memory.unionByName(more)
    state = phases.process_phase(memory, state.tags.unionByName(fresh), {"kb": slow}, state.failures, size=4)
    # the old batch is tried as it was, and given up; the new entries are through
    assert {(r.in_id, r.out_id) for r in state.tags.collect()} == {(f"m:00{i}", "tag:inbox:failed:kb") for i in range(3)}


def test_batches_are_limited_and_the_rest_waits(spark):
    memory, tags = _waiting(spark, 10)
    state = phases.process_phase(memory, tags, {"kb": lambda r: None}, size=3, batches=2)
    assert sorted(r.in_id for r in state.tags.where("out_id = 'tag:inbox:kb'").collect()) == [f"m:{i:03d}" for i in range(6, 10)]


def test_all_batches_at_once_are_as_batch_by_batch(spark):
    """More batches than the driver would be given one by one, errors as rows; then the attempts are counted alike."""
    memory, tags = _waiting(spark, 90)
    calls = []

    def run(rows):
        calls.append(1)
        return rows.select("id")

    bad = lambda r: r.where("substr(id, 3) % 20 = 7").select("batch_key", F.lit("TimeoutError").alias("name"), F.lit("timeout").alias("error"))
    hook = {"kb": phases.Whole(run, bad)}
    state = phases.process_phase(memory, tags, hook, size=3, batches=None)
    held = {f"m:{i:03d}" for k in range(7, 90, 20) for i in range(k - k % 3, k - k % 3 + 3)}
    waiting = lambda s, tag: {r.in_id for r in s.tags.where(F.col("out_id") == tag).collect()}
    assert calls == [1] and waiting(state, "tag:inbox:kb") == held and state.failures.count() == 5
    assert {r.id for r in state.outputs["kb"].collect()} == {r.id for r in memory.collect()} - held
    again = phases.process_phase(memory, state.tags, hook, state.failures, size=3, batches=None)
    assert waiting(again, "tag:inbox:failed:kb") == held and again.failures.count() == 0 and not waiting(again, "tag:inbox:kb")


def test_a_whole_hook_that_raises_fails_every_batch(spark):
    memory, tags = _waiting(spark, 7)
    late = phases.Whole(lambda r: r.select(F.raise_error(F.lit("bad input")).cast("string").alias("id")))
    state = phases.process_phase(memory, tags, {"kb": late}, size=3, batches=None)
    assert {(r.in_id, r.out_id) for r in state.tags.collect()} == {(f"m:{i:03d}", "tag:inbox:failed:kb") for i in range(7)}


def test_entries_that_nobody_wants_are_deleted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.register(Domain("kb", claim=lambda rows, e: rows.where("content like 'fact%'").select("id"), handler=lambda rows, e: None))
    a, b = engine.submit(["fact one", "chatter"], now_ms=5)
    engine.relate(a, "reinforces", "memory:other")
    engine.process_inbox(now_ms=7)
    assert {r.id for r in engine.store.read("memory").collect()} == {a}
    assert {r.in_id for r in engine.store.read("edges").collect()} == {a} and _edges(engine, "reinforces")
    assert [r.memory_id for r in engine.events("deleted").collect()] == [b] and engine.events("inboxProcessed").count() == 1


def brute_batches(rows, threshold, size, stretch):
    import math

    left, out = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        left.setdefault(r[3] or "", []).append(r)
    cosine = lambda x, y: round(sum(p * q for p, q in zip(x, y)) / (math.hypot(*x) * math.hypot(*y)), 6) if any(x) and any(y) else 0.0
    for key, queue in left.items():
        for number, lo in enumerate(range(0, len(queue), stretch)):
            some, batch = queue[lo : lo + stretch], 0
            while some:
                seed, others = some[0], some[1:]
                if seed[2] is None:
                    took = some[:size]
                else:
                    alike = [(r, cosine(seed[2], r[2])) for r in others if r[2] and len(r[2]) == len(seed[2])]
                    near = [r for r, s in sorted((x for x in alike if threshold <= 0 or x[1] >= threshold), key=lambda x: -x[1])][: size - 1]
                    took = [seed, *near, *[r for r in others if not r[2] or len(r[2]) != len(seed[2])][: size - 1 - len(near)]]
                out += [(r[0], key, number, batch, k) for k, r in enumerate(took)]
                some, batch = [r for r in some if r not in took], batch + 1
    return sorted(out)


@pytest.mark.parametrize("threshold, size, stretch", [(0.0, 4, 1000), (0.3, 5, 20), (0.9, 50, 7)])
def test_the_whole_queue_in_batches(spark, threshold, size, stretch):
    import random

    from memlake.operators import ingest

    rnd = random.Random(size)
    vector = lambda: None if rnd.random() < 0.2 else [round(rnd.gauss(0, 1), 3) for _ in range(rnd.choice([3, 3, 3, 2]))]
    rows = [(f"m:{i:03d}", rnd.randrange(40), vector(), rnd.choice(["a", "a", "a", "b", None])) for i in range(90)] + [("m:zero", 1, [0.0, 0.0, 0.0], "a")]
    frame = spark.createDataFrame(rows, "id string, created_at bigint, embedding array<double>, request_context string").repartition(4)
    found = ingest.assign_batches(frame, threshold, size, stretch).collect()
    assert sorted(tuple(r) for r in found) == brute_batches(rows, threshold, size, stretch)
    assert ingest.assign_batches(frame.limit(0), threshold, size, stretch).collect() == []


def test_ranks_within_hot_groups(spark):
    from memlake.plans.ranking import ranked

    rows = spark.range(2000).selectExpr("if(id % 10 = 0, null, id % 3) as key", "(id * 7919) % 2003 as at", "id")
    found = ranked(rows, ["key"], ["at", "id"]).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["key"], []).append((r["at"], r["id"], r["rank"]))
    for own in groups.values():
        assert [k for _, _, k in sorted(own)] == list(range(len(own)))
    assert len(found) == 2000 and [r["rank"] for r in sorted(ranked(rows, [], ["id"]).collect(), key=lambda r: r["id"])] == list(range(2000))


def test_an_entry_without_target_is_an_error(spark):
    domains = spark.createDataFrame([("old", "read", True, True)], "domain string, access string, auto_own boolean, claims boolean")
    with pytest.raises(ValueError):
        phases.address(spark.createDataFrame([("m:1", [])], "id string, targets array<string>"), domains)


def test_skills_and_prompts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.register(Domain("old", access="read", skills=(Skill("look", "how to look"), Skill("add", "how to add", writes=True), Skill("own", "inside", "internal"))))
    assert [s.id for s in engine.skills("old")] == ["look"] and [s.id for s in engine.skills("old", internal=True)] == ["own"]
    (tmp_path / "p.md").write_text("start\n@include part\nend\n")
    (tmp_path / "part.md").write_text("middle\n@include p\n")
    assert load_prompt(str(tmp_path), "p", str(tmp_path)) == "start\nmiddle\n@include p\nend"


def test_context_text_and_aliases(spark):
    memory = spark.createDataFrame(
        [("memory:a", "alpha beta gamma delta", None, 3, 1), ("memory:b", "alpha beta gamma delta epsilon", None, 3, 2), ("memory:c", "alpha other words here", None, 3, 3), ("memory:x", "alpha stale", None, 3, 4)],
        "id string, content string, embedding array<float>, token_count bigint, created_at bigint",
    )
    attributes = {"memory:a": '{"classification":"fact"}', "memory:b": '{"classification":"fact"}', "memory:c": '{"classification":"concept"}', "memory:x": '{"classification":"fact","superseded":true}'}
    owned = spark.createDataFrame([(i, "domain:kb", a) for i, a in attributes.items()], "in_id string, out_id string, attributes string")
    asked = search.SearchQuery(mode="fulltext", text="alpha", domains=("domain:kb",))
    rows = contexts.domain_entries(search.Corpus(memory, owned=owned), asked, "kb", contexts.Plan(), 0, 100)
    assert {(r.id, r.alias_of) for r in rows.collect()} == {("memory:a", "memory:a"), ("memory:b", "memory:a"), ("memory:c", "memory:c")}
    shown = contexts.domain_context(rows, memory).collect()[0].context
    assert shown == "[Definitions & Concepts]\nalpha other words here\n\n[Facts & References]\nalpha beta gamma delta"
    nothing = contexts.domain_entries(search.Corpus(memory, owned=owned), search.SearchQuery(mode="fulltext", text="zz"), "kb", contexts.Plan(keywords=("alpha",)), 0, 100)
    assert nothing.count() == 0


def test_path_costs_and_scores(spark):
    edges = spark.createDataFrame([(1, 2, "temporal", 0.5), (2, 3, "semantic", 0.9)], "src bigint, dst bigint, kind string, weight double")
    hot = spark.createDataFrame([(1, 2, "temporal")], "src bigint, dst bigint, kind string")
    cost = lambda rows: {r.kind: round(r.cost, 6) for r in rows.collect()}
    assert cost(paths.walk_costs(edges)) == {"temporal": 1.0, "semantic": 1.0}
    assert cost(paths.walk_costs(edges, True)) == {"temporal": 0.5, "semantic": 0.1}
    assert cost(paths.walk_costs(edges, True, decay=True, hot=hot, cold=2.0)) == {"temporal": 0.25, "semantic": 0.2}
    claims = spark.createDataFrame([(1, [1.0, 0.0], 10, None), (2, [0.0, 0.1], 20, None), (3, [0.0, 1.0], 40, None), (4, [1.0, 0.0], 50, 60)], "id bigint, embedding array<double>, valid_from bigint, valid_to bigint")
    probes = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "probe bigint, embedding array<double>")
    best = paths.retrieve(claims, edges, probes, anchors=3, by_weight=True).collect()[0]
    # both probes on the path, two kinds of edges of three, the latest claim, no hop without an anchor
    assert (best.anchor, best.id, best.nodes, best.score) == (1, 3, [1, 2, 3], round(1 + 0.3 * 0.666667 + 0.1, 6))
    assert {r.id for r in paths.best_by_claim(paths.retrieve(claims, edges, probes, anchors=3)).collect()} == {1, 2, 3}


def test_only_edges_near_the_anchors_are_read(spark):
    """Edges as a function: it is asked for those at anchors and their neighbours, and the paths are those of the whole graph."""
    import random

    rnd = random.Random(3)
    rows = [(a, a + 1, "temporal", 1.0) for a in range(199)] + [(a, rnd.randrange(200), "semantic", rnd.random()) for a in range(200)]
    edges = spark.createDataFrame([r for r in rows if r[0] != r[1]], "src bigint, dst bigint, kind string, weight double")
    claims = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)], i, 300 if i % 11 == 0 else None) for i in range(200)], "id bigint, embedding array<double>, valid_from bigint, valid_to bigint")
    probes = claims.where("id in (7, 42, 99)").select(F.col("id").alias("probe"), "embedding")
    asked = []

    def some(nodes, inside):
        asked.append(nodes.count())
        return paths.edges_at(edges, nodes, inside)

    for by_weight in (False, True):
        asked.clear()
        found = [tuple(r) for r in paths.retrieve(claims, some, probes, by_weight=by_weight).collect()]
        valid = claims.where("valid_to is null").select("id")
        whole = edges.join(valid.withColumnRenamed("id", "src"), "src", "left_semi").join(valid.withColumnRenamed("id", "dst"), "dst", "left_semi")
        assert asked[0] == 5 and 5 < max(asked) < 60
        assert {r[:3] for r in found if r[0] != r[1]} and sorted(found) == sorted(tuple(r) for r in paths.retrieve(claims, whole, probes, by_weight=by_weight).collect())
        walks = paths.shortest_paths(paths.walk_costs(whole, by_weight), spark.createDataFrame([(i,) for i in {r[0] for r in found}], "id bigint"), 3)
        best = {(r["anchor"], r["id"]): (r["hops"], list(r["nodes"])) for r in walks.collect()}
        assert all(best[r[0], r[1]] == (r[2], list(r[3])) for r in found)
    asked.clear()
    seeds = spark.createDataFrame([(7, 1.0), (42, 1.0)], "id bigint, activation double")
    assert sorted(map(tuple, paths.spread_activation(some, seeds).collect())) == sorted(map(tuple, paths.spread_activation(edges, seeds).collect()))
    assert len(asked) == 2 and max(asked) < 60


def test_cluster_affinity(spark):
    scored = spark.createDataFrame([(0, 1.0, 1, 0.7), (0, 1.0, 2, 0.7), (0, 1.0, 3, 0.1)], "probe bigint, weight double, id bigint, sim double")
    shares = [(1, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0)]
    rows = paths.cluster_affinity(scored, spark.createDataFrame(shares, "id bigint, cluster bigint, share double"), spark.createDataFrame([(0, 0, 1.0)], "probe bigint, cluster bigint, share double"), 0.5)
    assert [(r.id, r.score) for r in rows.collect()] == [(1, 0.75), (2, 0.5)]


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.3, 0.8])
def test_semantic_edges_equal_brute_force(spark, threshold, monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "BLOCK_ROWS", 40)
    m = np.random.default_rng(5).normal(size=(150, 4))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(998, None), (999, [0.0] * 4)], "id bigint, embedding array<double>")
    wanted = {(i, j) for i in range(150) for j in range(i + 1, 150) if round(float(unit[i] @ unit[j]), 6) >= threshold}
    assert {(r.a, r.b) for r in graph.semantic_edges(rows, threshold).collect()} == wanted


def test_user_supersession_keeps_to_the_pairs(spark):
    pairs = spark.createDataFrame([("u", "n", "o")], "user string, new string, old string")
    decide = lambda p: spark.createDataFrame([("n", "o"), ("n", "made up")], "new string, old string")
    assert [tuple(r) for r in enrich.user_supersession(pairs, decide).collect()] == [("n", "o")]
    assert enrich.user_supersession(pairs, None).count() == 0
