"""Pruned edges against brute force, and edges kept up in batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import graph, upkeep


def clustered(seed, n, clusters, width=16, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [(int(i), (centres[i % clusters] / np.linalg.norm(centres[i % clusters]) + rng.normal(size=width) * spread / 4).tolist()) for i in range(n)]


def brute_cosines(rows, threshold):
    ids, m = [i for i, v in rows if v], np.array([v for _, v in rows if v])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = np.round(m @ m.T, 6)
    return {(ids[i], ids[j]): c[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if c[i, j] >= threshold}


@pytest.mark.parametrize("threshold, n, clusters", [(0.65, 400, 8), (0.3, 300, 5), (0.95, 400, 20)])
def test_semantic_edges_are_exact(spark, threshold, n, clusters):
    rows = clustered(n, n, clusters)
    frame = spark.createDataFrame([*rows, (10_000, None), (10_001, [0.0] * 16)], "id bigint, embedding array<double>").repartition(3)
    found = {(r["a"], r["b"]): r["weight"] for r in graph.semantic_edges(frame, threshold, cell_rows=16, block_rows=20).where("a < 10000 and b < 10000").collect()}
    expected = brute_cosines(rows, threshold)
    assert set(found) == set(expected) and expected
    assert all(abs(found[k] - w) < 2e-6 for k, w in expected.items())


def test_what_is_sent_follows_the_clusters(spark):
    """Tight clusters about their pivots: what a vector is sent to does not grow with the number of vectors."""
    sent = []
    for n in (1500, 6000):
        rows = clustered(1, n, n // 100, 24, 0.2)
        frame = spark.createDataFrame(rows, "id bigint, embedding array<double>")
        sent.append(graph.sent_rows(frame, 0.9, cell_rows=10, block_rows=64) / n)
    plan = graph.semantic_edges(spark.createDataFrame(clustered(1, 1500, 15, 24, 0.2), "id bigint, embedding array<double>"), 0.9, cell_rows=10, block_rows=64)
    assert {(r["a"], r["b"]) for r in plan.collect()} == set(brute_cosines(clustered(1, 1500, 15, 24, 0.2), 0.9))
    print("sent a vector:", sent)
    assert sent[1] < 1.5 * sent[0]


def test_what_is_sent_is_bounded_where_nothing_can_be_left_out(spark):
    """Vectors in all directions: a vector goes to half of the (sixteen) blocks, however many cells there are."""
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 24)))], "id bigint, embedding array<float>")
    assert graph.sent_rows(frame, 0.3, cell_rows=16) <= 9 * 2000


@pytest.mark.parametrize("few", [0, 1000])
def test_edges_of_fresh_vectors_and_within_classes(spark, monkeypatch, few):
    """Once dealt in blocks, once sent to all tasks."""
    monkeypatch.setattr(graph, "FEW", few)
    rows = clustered(9, 240, 6)
    frame = spark.createDataFrame([(i, v, i % 4 if i % 9 else None) for i, v in rows] + [(10_000, None, 1), (10_001, [0.0] * 16, 1), (10_002, [1.0, 2.0], 1)], "id bigint, embedding array<double>, class int").repartition(3)
    fresh = frame.where("id % 5 = 0 or id > 9999").select("id")
    found = lambda **how: {(r["a"], r["b"]): r["weight"] for r in graph.semantic_edges(frame, 0.5, cell_rows=16, block_rows=20, **how).collect()}
    every = brute_cosines(rows, 0.5)
    touching = {k: w for k, w in every.items() if not k[0] % 5 or not k[1] % 5}
    alike = lambda edges: {k: w for k, w in edges.items() if k[0] % 9 and k[1] % 9 and k[0] % 4 == k[1] % 4}
    for mine, wanted in ((found(fresh=fresh), touching), (found(within="class"), alike(every)), (found(fresh=fresh, within="class"), alike(touching))):
        assert set(mine) == set(wanted) and wanted and all(abs(mine[k] - w) < 2e-6 for k, w in wanted.items())
    assert found(fresh=fresh.limit(0)) == {}


def test_edges_that_are_there_are_not_written_again(spark):
    rows = [(i, v, "u", i) for i, v in clustered(4, 60, 3, 8)]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<double>, user string, valid_from bigint")
    once = upkeep.add_claims(frame.where("id < 30"), None, ["user"], 0.6)
    twice = upkeep.add_claims(frame.where("id >= 30"), once, ["user"], 0.6)
    assert set(once.semantic.inputFiles()) < set(twice.semantic.inputFiles())
    assert {(r["a"], r["b"]) for r in twice.semantic.collect()} == set(brute_cosines([r[:2] for r in rows], 0.6))


def brute_lexical(docs):
    df = {}
    for _, ts in docs:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((len(docs) + 1) / (k + 1)) + 1 for t, k in df.items()}
    out = {}
    for k, (i, x) in enumerate(docs):
        for j, y in docs[k + 1 :]:
            both, every = set(x) & set(y), set(x) | set(y)
            if both:
                out[i, j] = (len(both), round(sum(idf[t] for t in both) / sum(idf[t] for t in every), 6))
    return out


@pytest.mark.parametrize("least", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_lexical_edges_are_exact(spark, least):
    rnd = random.Random(int(least * 10))
    docs = [(i, [f"t{int(rnd.paretovariate(0.5)) % 60}" for _ in range(rnd.choice([0, 1, 3, 8, 20]))]) for i in range(120)]
    docs += [(200 + i, docs[i][1] + [f"x{i}"]) for i in range(40)]
    found = {(r["a"], r["b"]): (r["shared"], r["weight"]) for r in graph.lexical_edges(spark.createDataFrame(docs, "id bigint, tokens array<string>"), least).collect()}
    expected = {k: v for k, v in brute_lexical(docs).items() if v[1] >= least}
    assert set(found) == set(expected) and expected
    assert all(found[k][0] == v[0] and abs(found[k][1] - v[1]) < 2e-6 for k, v in expected.items())


@pytest.mark.parametrize("least, often", [(0.3, 1024), (0.5, 2)])
def test_lexical_edges_by_blocks(spark, monkeypatch, least, often):
    """Many small blocks, frequent tokens in the matrix or not: exact, and no candidates are shuffled."""
    monkeypatch.setattr(graph, "LEXICAL_ROWS", 20)
    monkeypatch.setattr(graph, "SENT_ROWS", 7)
    monkeypatch.setattr(graph, "MOST_DENSE", often)
    rnd = random.Random(8)
    docs = [(i, [f"t{int(rnd.paretovariate(0.5)) % 60}" for _ in range(rnd.choice([0, 1, 3, 8, 20]))]) for i in range(150)]
    docs += [(200 + i, docs[i % 7][1] + [f"x{i}"] * (i % 2)) for i in range(90)] + [(900, None)]
    rows = graph.lexical_edges(spark.createDataFrame(docs, "id bigint, tokens array<string>").repartition(3), least)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
    found = {(r["a"], r["b"]): (r["shared"], r["weight"]) for r in rows.collect()}
    # a document of no tokens counts among all
    expected = {k: v for k, v in brute_lexical([(i, ts or []) for i, ts in docs]).items() if v[1] >= least}
    assert set(found) == set(expected) and expected
    assert all(found[k][0] == v[0] and abs(found[k][1] - v[1]) < 2e-6 for k, v in expected.items())


@pytest.mark.parametrize("seed, batches", [(1, 2), (2, 5)])
def test_edges_do_not_depend_on_the_batches(spark, seed, batches):
    rnd = random.Random(seed)
    claims = [(i, v, rnd.choice(["u1", "u2", None]), rnd.randrange(20), [f"t{rnd.randrange(12)}" for _ in range(3)]) for i, v in clustered(seed, 60, 4, 8, 1.0)]
    schema = "id bigint, embedding array<double>, user string, valid_from bigint, tokens array<string>"
    frame = spark.createDataFrame([(*c, k) for c, k in zip(claims, [rnd.randrange(batches) for _ in claims])], schema + ", batch int")

    def edges(kept):
        rows = lambda f, *c: sorted((tuple(r[x] for x in c) for r in f.collect()), key=str)
        return (
            rows(kept.semantic, "a", "b", "weight"), rows(kept.temporal, "user", "src", "dst", "delta_t"),
            rows(upkeep.lexical_weights(kept, 0.2), "a", "b", "shared", "weight"),
        )

    once = edges(upkeep.add_claims(frame.drop("batch"), None, ["user"], 0.6))
    kept = None
    for k in range(batches):
        # a claim that comes again changes nothing
        again = frame.where((F.col("batch") == k) | ((F.col("id") % 7 == 0) & (F.col("batch") < k))).drop("batch")
        kept = upkeep.add_claims(again, kept, ["user"], 0.6)
    assert edges(kept) == once and all(once)
