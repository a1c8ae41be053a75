"""Evaluation: set and token F1, recall, ranks, boundaries, and roll-ups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text


def f1(hits: Column, found: Column, wanted: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without hits."""
    return F.when(hits > 0, 2.0 * hits / (found + wanted)).otherwise(F.lit(0.0))


def set_f1_at_ideal(ranked: DataFrame, ideal: DataFrame) -> DataFrame:
    """(query, f1): the first k results, k being the size of the ideal set, against that set."""
    size = ideal.groupBy("query").agg(F.countDistinct("id").alias("k"))
    top = ranked.join(size, "query").where(F.col("rank") <= F.col("k"))
    hits = top.join(ideal.distinct(), ["query", "id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    found = top.groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    rows = size.join(found, "query", "left").join(hits, "query", "left").na.fill(0)
    return rows.select("query", F.round(f1(F.col("hits"), F.col("found"), F.col("k")), 6).alias("f1"))


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, f1) of two texts as multisets of analysed tokens."""
    def counts(column: str, name: str) -> DataFrame:
        each = pairs.select(key, F.explode(text.tokens(F.col(column))).alias("token"))
        return each.groupBy(key, "token").agg(F.count(F.lit(1)).alias(name))

    both = counts(a, "na").join(counts(b, "nb"), [key, "token"], "full_outer").na.fill(0, ["na", "nb"])
    sums = both.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("hits"), F.sum("na").alias("fa"), F.sum("nb").alias("fb"))
    return sums.select(key, F.round(f1(F.col("hits"), F.col("fa"), F.col("fb")), 6).alias("f1"))


def answer_metrics(pairs: DataFrame, key: str, gold: str, answer: str, abstained: Column, adversarial: Column) -> DataFrame:
    """(key, contained, recall, f1, full, abstained, false_abstention) of answers against gold texts.

    recall is the share of gold tokens, repeats included, that the answer has; f1 is over multisets.
    An empty gold text is contained in nothing and has recall and f1 of 0.
    """
    wanted = F.lower(F.trim(gold))
    tokens = pairs.select(key, text.tokens(F.col(gold)).alias("g"), text.tokens(F.col(answer)).alias("a"), (F.length(wanted) > 0).alias("any"),
                          F.lower(answer).contains(wanted).alias("inside"), abstained.alias("abstained"), adversarial.alias("adversarial"))
    hits = F.size(F.filter("g", lambda t: F.array_contains("a", t)))
    rows = tokens.select(
        key, (F.col("any") & F.col("inside")).alias("contained"),
        F.when(F.size("g") > 0, F.round(hits / F.size("g"), 6)).otherwise(0.0).alias("recall"),
        ((F.size("g") > 0) & (hits == F.size("g"))).alias("full"), "abstained", (F.col("abstained") & ~F.col("adversarial")).alias("false_abstention"),
    )
    return rows.join(token_f1(pairs, key, gold, answer), key, "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


def persona_recall(rows: DataFrame, key: str, persona: str, context: str) -> DataFrame:
    """(key, recall, contained) of persona lines (array) in a context: the share of their tokens, repeats
    included, that it has, and the share of lines that it holds whole."""
    gold = text.tokens(F.array_join(persona, " "))
    parts = rows.select(key, gold.alias("g"), F.array_distinct(text.tokens(F.col(context))).alias("c"), F.lower(context).alias("whole"), F.col(persona).alias("p"))
    hits = F.size(F.filter("g", lambda t: F.array_contains("c", t)))
    held = F.size(F.filter("p", lambda line: (F.length(F.trim(line)) > 0) & F.col("whole").contains(F.lower(F.trim(line)))))
    return parts.select(
        key, F.when(F.size("g") > 0, F.round(hits / F.size("g"), 6)).otherwise(0.0).alias("recall"),
        F.when(F.size("p") > 0, F.round(held / F.size("p"), 6)).otherwise(0.0).alias("contained"),
    )


def arc_summary(turns: DataFrame) -> DataFrame:
    """(arcs, narrowed, coherent) over turns (arc, turn, size, coverage): an arc narrows if its last turn
    has no more results than its first, and is coherent if its last turn covers half of what it should."""
    first, last = (f("turn") for f in (lambda c: F.min_by("size", c), lambda c: F.max_by(F.struct("size", "coverage"), c)))
    arcs = turns.groupBy("arc").agg(first.alias("first"), last.alias("last"))
    return arcs.agg(
        F.count(F.lit(1)).alias("arcs"), F.count_if(F.col("last.size") <= F.col("first")).alias("narrowed"), F.count_if(F.col("last.coverage") >= 0.5).alias("coherent")
    )


def repeated_signatures(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n) of signatures that occur twice or more."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def evidence_recall(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """(query, recall) of evidence ids (query, id) among found ones."""
    hit = evidence.join(found.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left")
    return hit.groupBy("query").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def reciprocal_ranks(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """(mrr, top1, median_rank, queries) over targets (query, id); a target not ranked counts 0."""
    first = targets.join(ranked, ["query", "id"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    return first.agg(
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0))), 6).alias("top1"),
        F.median("rank").alias("median_rank"), F.count(F.lit(1)).alias("queries"),
    )


def pair_accuracy(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_accuracy, queries) of (query, target, distractor): how often the target ranks before its
    distractor; what is not ranked ranks last, and two that are not ranked are no hit."""
    at = lambda name: ranked.select("query", F.col("id").alias(name), F.col("rank").alias(f"{name}_rank"))
    rows = pairs.join(at("target"), ["query", "target"], "left").join(at("distractor"), ["query", "distractor"], "left")
    hit = F.col("target_rank").isNotNull() & (F.col("distractor_rank").isNull() | (F.col("target_rank") < F.col("distractor_rank")))
    return rows.agg(F.round(F.avg(hit.cast("int")), 6).alias("pair_accuracy"), F.count(F.lit(1)).alias("queries"))


def path_coverage(paths: DataFrame, ideal: DataFrame, top: int = 5) -> DataFrame:
    """(query, coverage): the share of ideal ids (query, id) on the ``top`` paths (query, rank, nodes)."""
    seen = paths.where(F.col("rank") <= top).select("query", F.explode("nodes").alias("id"), F.lit(1).alias("hit")).distinct()
    return ideal.distinct().join(seen, ["query", "id"], "left").groupBy("query").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage"))


def path_signature(paths: DataFrame, top: int = 3) -> DataFrame:
    """(query, signature): the node sets of the ``top`` paths (query, rank, nodes), in order."""
    nodes = F.array_join(F.array_sort(F.col("nodes").cast("array<string>")), ",").alias("nodes")
    rows = paths.where(F.col("rank") <= top).select("query", "rank", nodes)
    return rows.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nodes"))), lambda x: x["nodes"]), "|").alias("signature"))


def win_loss_tie(scores: DataFrame, a: str, b: str, eps: float = 1e-6) -> DataFrame:
    gap = F.col(a) - F.col(b)
    return scores.agg(F.count_if(gap > eps).alias("wins"), F.count_if(gap < -eps).alias("losses"), F.count_if(F.abs(gap) <= eps).alias("ties"))


def category_rollup(rows: DataFrame, category: str, **rates: Column) -> DataFrame:
    """Means of the given expressions by category, with the overall line (category null) in the same pass."""
    return rows.rollup(category).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(v), 6).alias(k) for k, v in rates.items()])


def boundary_counts(bounds: DataFrame, tolerance: int = 2) -> DataFrame:
    """(id, tp, fp, fn) of rows (id, predicted, gold): each prediction takes the nearest free gold within reach."""

    def kernel(batches):
        for pdf in batches:
            out = []
            for key, predicted, gold in zip(pdf["id"], pdf["predicted"], pdf["gold"]):
                free, tp = sorted(gold), 0
                for p in sorted(predicted):
                    near = min(free, key=lambda g: (abs(g - p), g), default=None)
                    if near is not None and abs(near - p) <= tolerance:
                        free.remove(near)
                        tp += 1
                out.append((key, tp, len(predicted) - tp, len(free)))
            yield pd.DataFrame(out, columns=["id", "tp", "fp", "fn"])

    return bounds.select("id", "predicted", "gold").mapInPandas(kernel, f"id {dict(bounds.dtypes)['id']}, tp long, fp long, fn long")


def micro_average(counts: DataFrame) -> DataFrame:
    """(precision, recall, f1) over summed true positives, false positives and misses."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return counts.agg(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
