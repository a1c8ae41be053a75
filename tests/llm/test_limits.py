"""Hot keys, clashing columns, very long inputs and rules in conflict."""

import collections
import tracemalloc

import pytest
from pyspark.sql import functions as F

pytest.importorskip("memlake.llm.queries")

from memlake.llm import ring_sharding, url_filter  # noqa: E402

PAGE = "page_id bigint, url string"


def test_a_url_of_a_million_dots(spark):
    pages = spark.createDataFrame([(1, "http://" + "." * 1_000_000 + "com/en/x"), (2, "http://a.com/en/" + "y" * 1_000_000), (3, "x" * 1_000_000)], PAGE)
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.entries()).collect()}
    assert (rows[1]["rule"], rows[1]["verdict"]) == ("com/en/", "block") == (rows[2]["rule"], rows[2]["verdict"])
    assert (rows[3]["host"], rows[3]["verdict"]) == ("", "allow")


def test_memory_of_suffixes_does_not_follow_the_host():
    limits = url_filter.Limits.of(url_filter.entries())
    peaks = []
    for n in (10_000, 1_000_000):
        host = "ab." * n + "example.com"
        tracemalloc.start()
        found = list(limits.suffixes(host))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found[:3] == ["com", "example.com", "ab.example.com"] and len(found) <= limits.labels
    assert max(peaks) < 10_000


def test_suffixes_are_those_that_an_entry_can_equal():
    items = [url_filter.Entry(url_filter.BLOCK, "b.c", "/"), url_filter.Entry(url_filter.LISTED, "x.y.z", "")]
    limits = url_filter.Limits.of(items)
    for host in ("c", "b.c", "a.b.c", "w.x.y.z", "", ".", "a.b.", "..", "longer.than.any.entry"):
        parts = host.split(".")
        every = [".".join(parts[i:]) for i in range(len(parts))]
        assert set(limits.suffixes(host)) == {s for s in every if len(s) <= 5 and s.count(".") < 3}


def test_of_two_rules_with_one_text_the_blocking_one_holds(spark):
    pages = spark.createDataFrame([(1, "x://h.org/p"), (1, "x://h.org/p")], PAGE).withColumn("host", F.lit(7)).withColumn("rule", F.lit(7))
    for order in (("allow", "block"), ("block", "allow")):
        items = url_filter.entries([(v, "h.org", "/p") for v in order], [])
        assert [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, items).collect()] == [("h.org/p", "block")] * 2


def test_sharded_rows_keep_their_columns_whatever_their_names(spark):
    names = ["cell", "salt", "rank", "runs", "offset", "run", "row", "parts", "n", "a.b"]
    rows = spark.range(500).selectExpr("id % 7 as doc_id", "id", *[f"id * {k} as `{c}`" for k, c in enumerate(names, 2)])
    out = ring_sharding.shard_rows(rows, "doc_id", 4)
    assert out.columns == ["doc_id", "id", *names, "shard", "slot"]
    found = out.collect()
    assert collections.Counter(tuple(r)[:-2] for r in found) == collections.Counter(tuple(r) for r in rows.collect())
    counts = collections.Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in range(4) for k in range(counts[s])]
    with pytest.raises(ValueError, match="shard"):
        ring_sharding.shard_rows(rows.withColumn("Shard", F.lit(1)), "doc_id", 4)


def test_a_hot_key_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ring_sharding, "RUN_ROWS", 50)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) as doc_id", "id").repartition(2)
    out = ring_sharding.shard_rows(rows, "doc_id", 8).collect()
    counts = collections.Counter(r["shard"] for r in out)
    assert set(counts.values()) == {375}
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(8) for k in range(375)]


def planted(rnd, items, n):
    """Texts that hold an item, word for word or with up to half of it changed, and some that hold none."""
    pool = [f"v{rnd.randrange(3000)}" for _ in range(3000)]
    rows = []
    for k in range(n):
        share = rnd.choice([0, 0, 0.2, 0.35, 0.5])
        words = []
        for w in rnd.choice(items).split():
            r = rnd.random()
            words += [] if r < share / 3 else [rnd.choice(pool)] if r < share * 2 / 3 else [w, rnd.choice(pool)] if r < share else [w]
        host = [rnd.choice(pool) for _ in range(rnd.choice([0, 30, 300]))]
        at = rnd.randrange(len(host) + 1)
        rows.append((k, " ".join(host[:at] + words + host[at:]) if k % 5 else " ".join(host)))
    return rows


def every_window(items, rows, idf):
    """(doc_id, item_id) that hold when every window is a candidate for every item."""
    import pyarrow as pa

    from memlake.llm import decontaminate as D
    from memlake.llm import textkernels as K

    checks = [D._Item(w, idf) for w in D._item_words(pa.array(items))]
    found = set()
    for i, text in rows:
        for _, _, raw, at in K.blocks(pa.array([text])):
            words = K.Words(raw, at)
            for k, check in enumerate(checks):
                step = D._step(check.size)
                if D._settle({(0, k): [(0.0, a, a + 2 * step) for a in range(0, len(words.hashes), step)]}, words, [*checks]):
                    found.add((i, k))
    return found


@pytest.mark.parametrize("n_items, n_docs", [(40, 300), (2000, 60)])
def test_latent_search_against_every_window(spark, monkeypatch, n_items, n_docs):
    import random

    import numpy as np

    from memlake.llm import decontaminate as D

    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 700)
    rnd = random.Random(n_items)
    # a third of the words are common ones
    items = [" ".join(f"w{rnd.randrange(rnd.choice([60, 4000, 4000]))}" for _ in range(rnd.choice([6, 20, 45, 90]))) for _ in range(n_items)]
    rows = planted(rnd, items, n_docs)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    counts, texts = D.document_frequencies(docs)
    expected = every_window(items, rows, 1 + np.log((texts + 1) / (counts + 1)))
    assert found <= expected and len(expected) > n_docs / 2
    assert len(found) / len(expected) >= 0.9


def test_the_space_is_that_of_the_gram_of_all_passages(spark):
    import random

    import numpy as np

    from memlake.llm import decontaminate as D

    rnd = random.Random(2)
    items = [" ".join(f"w{rnd.randrange(300)}" for _ in range(40)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in items], "text string").repartition(7)
    idf = np.random.default_rng(1).random(1 << D.FEATURE_BITS) + 1
    space = D.latent_space(frame, idf, 32)
    import pyarrow as pa

    passages = [p for w in D._item_words(pa.array(items)) for p in D._passages(w, D._step(len(w)))]
    row, feature, weight = D._flat(passages, idf)
    rows = D._sketched(row, feature, weight, len(passages))
    exact = np.linalg.svd(rows, full_matrices=False)
    mine = np.linalg.norm(rows @ space.basis) ** 2
    assert space.basis.shape == (D.SKETCH, 32) and mine == pytest.approx((exact[1][:32] ** 2).sum(), rel=1e-5)
    assert set(np.flatnonzero(space.known)) == set(feature.tolist())


def test_toxic_share_is_learned_alike_at_every_size(spark):
    from memlake.llm import toxicity

    rows = [(i, f"a{i % 7} b{i % 5} " + ("bad" if i % 4 == 0 else "good")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)] + [(10_000 + i, 1) for i in range(500)], "doc_id bigint, toxic int")
    for bound in (400, 5000):
        weights = toxicity.train_toxicity(docs, labels, F.lit(True), bound)
        score = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, weights).collect()}
        assert score == {i: int(i % 4 == 0) for i in range(2000)}
    # labels without a document use up no part of the bound, and long texts teach nothing
    chosen = toxicity.train_toxicity(docs, labels, F.lit(True), 2000, 3)
    assert chosen.bias == toxicity.UNTAUGHT


def test_lines_above_the_limit_are_taken_out(spark):
    import re

    from memlake.llm import quality_rules

    word = re.compile(r"[^\x20\x09-\x0D]+")
    norm = lambda line: re.sub("[0-9]+", "0", " ".join(word.findall(line))).lower()
    rows = [(i, f"own line {chr(97 + i % 26)}{i // 26} here\n\n  Page 1{i}  of 20\nwhat is  left\nown line {chr(97 + i % 26)}{i // 26} here", "s1") for i in range(6)]
    rows += [(i, "page 7 of 9\nPAGE 8 of 10\nx", "s1") for i in range(10, 12)] + [(20, "page 1 of 2", "s2"), (21, None, "s1"), (22, "", None), (None, "what is left\nand much more that is only here", "s1")]
    rows += [rows[0]]
    where = {}
    for k, (_, t, host) in enumerate(rows):
        for line in (t or "").split("\n"):
            if norm(line):
                where.setdefault((host or "", norm(line)), set()).add(k)
    expected = []
    for _, t, host in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if norm(x) and len(where[host or "", norm(x)]) > 4]
        if 2 * sum(len(word.findall(x)) for x in gone) <= len(word.findall(t or "")):
            expected.append(None if t is None else "\n".join(x for x in lines if x not in gone))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lines", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("host", F.lit("h"))
    out = quality_rules.strip_common_lines(docs, max_docs=4)
    assert out.columns == ["doc_id", "text", "source", "lines", "gone", "host"]
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(map(str, expected)) and len(expected) < len(rows)
    assert quality_rules.strip_common_lines(docs.limit(0)).collect() == []


def test_the_driver_runs_few_queries_and_makes_no_row_objects(spark, monkeypatch):
    """What filled the driver: a query to count each table written, and a Row for each of 262,144 counters."""
    from pyspark.sql import DataFrame

    from memlake.llm import decontaminate, jaccard_join

    def refused(self, *_):
        raise AssertionError("rows are gathered as Arrow batches and counted as they are written")

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:50]), " ".join(words[:50] + ["more"]), " ".join(words[10:60]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toPandas", refused)
        m.setattr(DataFrame, "count", refused)
        m.setattr(DataFrame, "isEmpty", refused)
        kept = jaccard_join.near_duplicate_keepers(docs)
        counts, n = decontaminate.document_frequencies(docs)
    assert {r["doc_id"] for r in kept.collect()} == {0, 2, 3, 4}
    assert (n, counts.sum()) == (4, 151)


def test_rows_are_counted_as_they_are_written(spark):
    from memlake.plans.scratch import counted, rows_of

    for n in (0, 7):
        rows = spark.range(50).where(F.col("id") < n).repartition(3)
        table = counted(rows, even=F.count_if(F.col("id") % 2 == 0))
        assert (rows_of(table), table.count(), table.scratch_seen["even"]) == (n, n, (n + 1) // 2)
        assert table.columns == ["id"]
