"""Filter audit, quality trees and lexical search against brute-force versions, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("memlake.llm.queries")

from memlake.llm import filter_audit, lexical_index, quality_trees, queries  # noqa: E402
from oracle import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABEL = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of():
    """Nulls, empty and very long texts, ties, repeated rows, copies, and texts that fail each filter."""
    rnd = random.Random(3)
    line = lambda n, v=10**6: " ".join(f"w{rnd.randrange(v)}" for _ in range(n))
    rows = [(1, None, "en"), (2, "", "en"), (3, "", None), (None, "", "de"), (None, None, None), (4, " \n\t", ""), (5, "É ñ ÀB CD", "es")]
    for i in range(40):
        text = line(rnd.choice([20, 99, 100, 130]), rnd.choice([30, 10**6]))
        if rnd.random() < 0.3:
            text = text.upper()
        if rnd.random() < 0.3:
            text += " | x"
        rows += [(100 + 3 * i + k, text, rnd.choice(["en", "de", None])) for k in range(rnd.choice([1, 1, 2, 3]))]
    rows += [rows[10]] * 3 + [(None, rows[10][1], "en"), (900, line(60_000), "en"), (901, "Z" * 200_000, "fr"), (902, "É" * 9 + " 漢字 x 😀y", "fr")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", 0) for i, t, lang in rows_of()]
    clash = {n: F.lit(1) for n in ("rank", "mask", "digest", "first", "part", "label", "score", "terms", "item_id")}
    return spark.createDataFrame(rows, DOC).withColumns(clash).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


LABELS = [(100, 1, 0), (100, 1, 0), (103, 0, 1), (106, 1, 1), (109, None, 1), (None, 1, 1), (5, 1, None), (777, 1, 1)]


def masks(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        failed = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t],
        ]
        yield i, lang or "", {f for f, bad in zip("ABCDE", failed) if bad}


def brute_audit(rows, labels):
    """Every order applied to the documents themselves."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    marked = list(masks(rows))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in marked}:
        mine = [(i, m) for i, p, m in marked if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in m for _, m in mine) - len(gone), sum(m == {f} for _, m in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f,
                ]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_all_orders(spark, docs):
    found = filter_audit.audit_filters(docs, spark.createDataFrame(LABELS, LABEL)).collect()
    expected = brute_audit(rows_of(), LABELS)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found} == expected
    assert len(found) == len(expected) == 600 * len({k[0] for k in expected})


def test_audit_with_tables_too_large_for_the_driver(spark, docs, monkeypatch):
    """Copies and labels beyond the bound are not broadcast, and the counts stay."""
    monkeypatch.setattr(filter_audit, "LOOKUP_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = spark.createDataFrame(LABELS, LABEL)
        plan = filter_audit.failure_masks(docs, labels)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        found = filter_audit.audit_filters(docs, labels).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found} == brute_audit(rows_of(), LABELS)


def test_audit_of_an_empty_table(spark, nothing):
    assert filter_audit.audit_filters(nothing, spark.createDataFrame([], LABEL)).collect() == []


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_lexical_search"])
def test_equals_oracle(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == ""


def brute_statistics(text):
    """The statistics that words and lines decide, in plain Python."""
    words, lines = WORD.findall(text), [WORD.findall(x) for x in text.split("\n")]
    full = [tuple(x) for x in lines if x]
    n, size = max(len(words), 1), [len(w.encode()) for w in words]
    counts, pairs = Counter(words), set(zip(words, words[1:]))
    return {
        "log_words": math.log1p(len(words)), "word_bytes": sum(size) / n, "distinct_words": len(counts) / n,
        "common_word": max(counts.values(), default=0) / n, "short_words": sum(s <= 3 for s in size) / n, "long_words": sum(s > 12 for s in size) / n,
        "capitalised": sum("A" <= w[0] <= "Z" for w in words) / n, "line_words": len(words) / len(lines),
        "distinct_lines": len(set(full)) / max(len(full), 1), "repeated_pairs": 1 - len(pairs) / max(len(words) - 1, 1),
        "upper": len(re.findall("[A-Z]", text)) / max(len(text.encode()), 1), "line": text.count("\n") / max(len(text.encode()), 1),
    }


def test_statistics_of_a_block():
    texts = ["", " \n ", "a", "A b, c\na b, c\n\nx! É", "x\n" * 50, "one two one two one two", "Z" * 40, "#a b# | c"] + [t or "" for _, t, _ in rows_of()[:60]]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    found = quality_trees.statistics(raw, at)
    assert found.shape == (len(texts), len(quality_trees.NAMES)) and np.isfinite(found).all()
    for text, row in zip(texts, found):
        mine = dict(zip(quality_trees.NAMES, row))
        for name, value in brute_statistics(text).items():
            if name == "repeated_pairs" and len(WORD.findall(text)) < 2:
                continue
            assert mine[name] == pytest.approx(value), (name, text[:40])


def test_trees_in_arrays_go_where_single_rows_go():
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=(600, len(quality_trees.NAMES))), 1)
    label = ((values[:, 0] > 0.3) ^ (values[:, 5] < -0.2)).astype(float)
    forest = quality_trees.grow_forest(values, label, trees=12)

    def walk(row):
        total = forest.bias
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                f = feature[node]
                node = 2 * node + 1 + int(sum(row[f] > e for e in forest.edges[:, f]) > cut[node])
            total += leaf[node - len(feature)]
        return total

    odds = quality_trees.traverse(forest, values)
    assert np.allclose(odds, [walk(r) for r in values])
    assert ((odds > 0) == label).mean() > 0.97


def test_a_level_takes_the_best_of_all_cuts():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 8, size=(200, 4)).astype(np.uint8)
    slope, curve = rng.normal(size=200), rng.random(200) + 0.1
    feature, cut, leaf, node = quality_trees._grow(bins, slope, curve)
    score = lambda some: slope[some].sum() ** 2 / (curve[some].sum() + quality_trees.RIDGE)
    gains = {
        (f, c): score(bins[:, f] <= c) + score(bins[:, f] > c) - score(np.ones(200, bool))
        for f in range(4) for c in range(8) if quality_trees.MIN_LEAF <= (bins[:, f] <= c).sum() <= 200 - quality_trees.MIN_LEAF
    }
    assert gains[feature[0], cut[0]] == pytest.approx(max(gains.values()))
    assert np.allclose(leaf[node], [-quality_trees.RATE * slope[node == k].sum() / (curve[node == k].sum() + quality_trees.RIDGE) for k in node])


def test_quality_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op12_quality_trees(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if i in rows and rows[i]["held_out"]]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95


def test_quality_of_awkward_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 220)] + [(1, 0, 0), (None, 1, 0), (100, None, 0)], LABEL)
    forest = quality_trees.train_quality(docs, labels, F.lit(True))
    assert forest == forest and len(forest.feature) == quality_trees.TREES
    found = quality_trees.score_quality(docs, forest).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, *_ in rows_of())
    empty = {r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in found)
    untaught = quality_trees.train_quality(docs, spark.createDataFrame([], LABEL), F.lit(True))
    assert all(r["predicted"] == 1 for r in quality_trees.score_quality(docs, untaught).collect())
    assert quality_trees.score_quality(nothing, forest).collect() == []
    assert len(quality_trees.train_quality(nothing, labels, F.lit(True)).feature) == 0


def brute_search(docs, items, top=10):
    terms = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted = {}
    for item, text in dict.fromkeys(items):
        wanted.setdefault(item, Counter()).update(TERM.findall((text or "").translate(FOLD)))
    out = []
    for item, query in wanted.items():
        scored = []
        for i, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // length if length else 0
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in query.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def library():
    """Texts with ties, repeats, null ids and one very long one."""
    rnd = random.Random(9)
    docs = [(1, None), (2, ""), (3, "--- ..."), (None, "alpha beta"), (None, "alpha beta"), (4, "Alpha BETA"), (5, "alpha-beta"), (6, "É é ÑANDÚ a1")]
    docs += [(10 + i, " ".join(f"t{int(rnd.paretovariate(0.7)) % 300}" for _ in range(rnd.choice([3, 20, 200])))) for i in range(120)]
    docs += [(500 + i, "same words here") for i in range(30)] + [docs[20]] * 2 + [(900, "same " * 50_000 + "t1")]
    rnd.shuffle(docs)
    return docs


ITEMS = [(1, "Alpha beta alpha"), (2, "same words"), (3, None), (4, ""), (5, "nowhere"), (None, "same t1"), (6, "t1 t2 t3 t4 t1"), (6, "t1 t2 t3 t4 t1"), (7, "É a1 ñandÚ"), (8, "t5"), (8, "t6")]


def search(spark, docs, items, top=10):
    clash = {n: F.lit(1) for n in ("rank", "score", "item_id", "terms", "repeats", "n")}
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOC).withColumns(clash).repartition(5)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("x")).withColumn("doc_id", F.lit(1))
    return sorted((tuple(r) for r in lexical_index.rank_documents(d, q, top).collect()), key=str)


def test_search_equals_scoring_every_document(spark):
    assert search(spark, library(), ITEMS) == brute_search(library(), ITEMS)


def test_search_in_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "ITEMS_AT_ONCE", 2)
    monkeypatch.setattr(lexical_index, "TOP", 3)
    shards = lexical_index._Shard

    class Small(shards):
        def full(self):
            return self.docs >= 7

    monkeypatch.setattr(lexical_index, "_Shard", Small)
    monkeypatch.setattr(lexical_index, "WORK_BYTES", 64)
    docs = library()
    index = [b for b in lexical_index._index(iter([_batch(docs)]), lexical_index.Totals(150, 10_000))]
    assert len(index) > 10 and all(len(b.column("doc_ids")[0]) >= 7 for b in index[:-1])
    assert search(spark, docs, ITEMS, 3) == brute_search(docs, ITEMS, 3)


def _batch(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t or "" for _, t in docs])], ["doc_id", "text"])


def test_best_places_keep_ties_in_order():
    rng = np.random.default_rng(1)
    for _ in range(50):
        scores, ids, missing = rng.integers(0, 4, 40), rng.permutation(40), rng.random(40) < 0.1
        expected = sorted((k for k in range(40) if scores[k] > 0), key=lambda k: (-scores[k], missing[k], ids[k]))[:7]
        assert lexical_index.best_places(scores, ids, missing, 7).tolist() == expected


def test_lengths_beyond_64_bits():
    totals = lexical_index.Totals(10**12, 10**15)
    assert lexical_index.length_terms(np.array([10**6, 3]), totals).tolist() == [25 + 75 * 10**6 * 10**12 // 10**15, 25]


def test_search_of_empty_tables(spark):
    assert search(spark, [], ITEMS) == [] and search(spark, library(), []) == []
    assert search(spark, [(1, None), (2, "..")], ITEMS) == []
