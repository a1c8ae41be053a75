"""Sequential choices against the plain loops they stand for."""

import random

import pytest

from memlake.operators import turns


def random_lists(seed, n, degree, most=5):
    """Lists of mixed shapes: chains of neighbouring ids, hubs and random partners; the node itself first."""
    rnd = random.Random(seed)
    rows = []
    for a in range(n):
        near = {rnd.randrange(n) for _ in range(rnd.randrange(degree + 1))} | ({a + 1} if a % 3 and a + 1 < n else set()) | ({0} if a % 7 == 0 else set())
        rows += [(a, b, k) for k, b in enumerate([a, *sorted(near - {a}, key=lambda b: (b * 7919) % 101)][:most])]
    return rows


def brute_clusters(rows, least):
    own, used, out = {}, set(), []
    for a, b, _ in rows:
        own.setdefault(a, []).append(b)
    for a in sorted(own):
        free = [b for b in own[a] if b not in used]
        if a not in used and len(free) >= least:
            used.update(free)
            out += [(a, b) for b in free]
    return sorted(out)


def brute_merge(topics, rows):
    own, n, c, into = {}, {i: m for i, m, _ in topics}, {i: t for i, _, t in topics}, {}
    for a, b, place in sorted(rows, key=lambda r: (r[0], r[2])):
        own.setdefault(a, []).append(b)
    for a in sorted(own):
        for b in own[a]:
            if b == a or a in into or b in into:
                continue
            stays, goes = (a, b) if n[a] > n[b] or n[a] == n[b] and c[a] <= c[b] else (b, a)
            into[goes] = stays
            n[stays] += n[goes]

    def root(i):
        while i in into:
            i = into[i]
        return i

    return sorted((i, root(i) if i in into else None, into.get(i), n[i]) for i in n)


@pytest.mark.parametrize("seed, n, degree, finish", [(1, 60, 3, 0), (2, 40, 1, 0), (3, 80, 4, 40), (4, 50, 2, 10**6)])
def test_clusters_in_rounds_are_those_of_the_loop(spark, seed, n, degree, finish):
    rows = random_lists(seed, n, degree)
    lists = spark.createDataFrame(rows, "a bigint, b bigint, place int")
    found = turns.greedy_clusters(lists, 3, finish).collect()
    assert sorted((r["cluster"], r["id"]) for r in found) == brute_clusters(rows, 3) != []


@pytest.mark.parametrize("seed, n, degree, finish", [(5, 60, 2, 0), (6, 40, 3, 0), (7, 60, 4, 40), (8, 50, 2, 10**6)])
def test_merges_in_rounds_are_those_of_the_loop(spark, seed, n, degree, finish):
    rnd = random.Random(seed)
    rows = random_lists(seed, n, degree)
    topics = [(i, rnd.randrange(1, 6), rnd.randrange(5)) for i in range(n)]
    found = turns.merge_topics(spark.createDataFrame(topics, "id bigint, mention_count int, created_at bigint"), spark.createDataFrame(rows, "a bigint, b bigint, place int"), finish).collect()
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted((tuple(r) for r in found), key=key) == sorted(brute_merge(topics, rows), key=key)
    standing = {r["id"] for r in found if r["merged_into"] is None}
    assert {r["merged_into"] for r in found} - {None} <= standing
    assert sum(r["mention_count"] for r in found if r["id"] in standing) == sum(m for _, m, _ in topics)


def test_mentions_survive_a_chain(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a bigint, b bigint, weight double")
    topics = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "id bigint, mention_count bigint, created_at bigint")
    rows = {r["id"]: r for r in turns.merge_topics(topics, turns.nearest_lists(pairs, topics)).collect()}
    # 1 goes into 2, which then has three mentions like 3 and is older
    assert {i: (r["merged_into"], r["first_into"], r["mention_count"]) for i, r in rows.items()} == {1: (2, 2, 1), 2: (None, None, 6), 3: (2, 2, 3)}


def test_lists_are_short_and_nearest_first(spark):
    pairs = spark.createDataFrame([(1, k, 1 - k / 100) for k in range(2, 30)] + [(40, 41, 0.5), (40, 41, 0.5)], "a bigint, b bigint, weight double")
    rows = turns.nearest_lists(pairs, spark.createDataFrame([(1,), (99,)], "id bigint")).collect()
    own = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        own.setdefault(r["a"], []).append(r["b"])
    assert own[1] == list(range(1, 11)) and own[99] == [99] and own[5][-1] == 1
    assert turns.greedy_clusters(spark.createDataFrame([], "a bigint, b bigint"), 3).collect() == []


def test_lists_of_unique_pairs_are_not_shuffled_whole(spark):
    pairs = spark.createDataFrame([(a, a + k, 1 - k / 100) for a in range(40) for k in range(1, 15)], "a bigint, b bigint, weight double")
    lists = lambda **how: sorted(tuple(r) for r in turns.nearest_lists(pairs, **how).collect())
    assert lists(unique=True) == lists() and len({r[0] for r in lists()}) == 54
    plan = turns.nearest_lists(pairs, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


def test_roots_of_a_deep_forest(spark):
    links = [(i, i + 1) for i in range(70)] + [(100, 50), (200, 201)]
    rows = {r["id"]: r["root"] for r in turns.standing(spark.createDataFrame(links, "id bigint, into bigint")).collect()}
    assert rows == {**{i: 70 for i in range(70)}, 100: 70, 200: 201}
