"""Segmentation and context maintenance over stretches, against the plain loops."""

import numpy as np
import pytest

from memlake.operators import sequence


def steps(seed, n, width=6, every=15):
    rng = np.random.default_rng(seed)
    level = np.zeros(width)
    out = []
    for k in range(n):
        if k % every == 0:
            level = rng.normal(size=width)
        out.append((level + rng.normal(size=width) * 0.3).tolist())
    return out


def quadratic(m, beta):
    """Least cost and boundaries over all ways to cut, without leaving any out."""
    n = len(m)
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end):
            part = m[start:end]
            total = best[start] + ((part - part.mean(axis=0)) ** 2).sum() + beta
            if total < best[end] - 1e-9:
                best[end], back[end] = total, start
    bounds, end = [], n
    while end:
        end = back[end]
        if end:
            bounds.append(end)
    return bounds[::-1], best[n]


@pytest.mark.parametrize("seed, n, beta", [(1, 80, 2.0), (2, 60, 0.2), (3, 70, 40.0), (4, 1, 1.0)])
def test_pruning_loses_no_cut(seed, n, beta):
    m = np.array(steps(seed, n, every=7))
    found = sequence.segment_penalised(m, beta)
    bounds, cost = quadratic(m, beta)
    assert [a for a, _, _ in found if a] == bounds and sum(c for *_, c in found) + beta * len(found) == pytest.approx(cost)
    assert sequence.segment_penalised(np.zeros((0, 2)), 1.0) == []


def frame(spark, streams):
    rows = [(name, k, v) for name, vs in streams.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "s string, k bigint, embedding array<double>").repartition(3)


def test_streams_have_as_many_segments_as_pay(spark):
    streams = {"a": steps(5, 300, every=12), None: steps(6, 40), "c": steps(7, 1)}
    found = {r["s"]: r for r in sequence.segment_streams(frame(spark, streams), "s", "k").collect()}
    for name, vs in streams.items():
        bounds, cost = quadratic(np.array(vs), np.log(max(len(vs), 2)))
        assert list(found[name]["boundaries"]) == bounds and found[name]["k"] == len(bounds) + 1
        assert found[name]["cost"] == pytest.approx(cost - (len(bounds) + 1) * np.log(max(len(vs), 2)), abs=1e-5)
    assert found["a"]["k"] > 12


def test_long_streams_are_solved_across_their_joints(spark):
    vs = steps(8, 260, every=13)
    whole = sequence.segment_streams(frame(spark, {"a": vs}), "s", "k").collect()[0]
    parts = sequence.segment_streams(frame(spark, {"a": vs}), "s", "k", stretch=50).collect()[0]
    assert list(parts["boundaries"]) == list(whole["boundaries"]) and parts["cost"] == pytest.approx(whole["cost"])


@pytest.mark.parametrize("stretch, warm", [(4096, 64), (20, 8), (7, 0)])
def test_contexts_are_those_of_one_fold(spark, stretch, warm):
    streams = {"a": steps(9, 150), None: [None, *steps(10, 30)[:9], None, *steps(11, 12)], "z": [None, None]}
    found = {}
    for r in sequence.context_stream(frame(spark, streams), "s", "k", stretch=stretch, warm=warm).collect():
        found.setdefault(r["s"], {})[r["k"]] = r["context"]
    for name, vs in streams.items():
        expected = sequence._fold(None, vs, 0.7, np.sqrt(0.51))
        assert len(found[name]) == len(vs)
        for k, c in enumerate(expected):
            assert found[name][k] is None if c is None else np.allclose(found[name][k], c, atol=1e-7)


def test_cued_and_continued_probes(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [0.0, 1.0], [0.6, 0.8])], "id bigint, embedding array<double>, context array<double>")
    cue = {r["id"]: r["score"] for r in sequence.context_search(stored, [1.0, 0.0], weight=0.5).collect()}
    assert cue == {1: 1.0, 2: 0.3}
    ahead = sequence.advance([0.0, 1.0], [1.0, 0.0], rho=0.6)
    assert ahead == pytest.approx([0.8, 0.6])
    run = {r["id"]: r["score"] for r in sequence.context_search(stored, [1.0, 0.0], [0.0, 1.0], 0.5, mode="continue", rho=0.6).collect()}
    assert run == {1: 0.9, 2: 0.48}
