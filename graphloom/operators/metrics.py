"""Classification, rollup and sweep metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(F.lit(b) == 0, F.lit(0.0)).otherwise(F.lit(a) / F.lit(b))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where it has no denominator."""
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)


def threshold_sweep(rows: DataFrame, thresholds: list[float], example="example_id", label="label", p="p_yes") -> DataFrame:
    """Per threshold: micro precision, recall and F1, and by question the extra, missed and exact selections.

    Thresholds are literals of the plan. A question's rows come together as they are, so that a task holds one entry for
    each question, with the counts of all thresholds; only then does it become a row for each.
    """
    gold = F.col(label) == 1
    yes = [F.col(p) >= F.lit(float(t)) for t in thresholds]
    counts = [F.count_if(y & g).alias(f"{name}{i}") for name, g in (("tp", gold), ("fp", ~gold)) for i, y in enumerate(yes)]
    by = rows.select(example, label, p).repartition(example).groupBy(example).agg(*counts, F.count_if(gold & F.col(p).isNotNull()).alias("gold"))
    each = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("gold") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)]
    per = by.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    total = per.groupBy("threshold").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("questions"),
        F.count_if(F.col("fn") > 0).alias("missing"), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"),
    )
    precision, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    share = lambda c: F.lit(100) * F.col(c) / F.col("questions")
    return total.select(
        "threshold", "questions", (100 * precision).alias("precision"), (100 * recall).alias("recall"), (100 * f1).alias("f1"),
        (F.col("fp") / F.col("questions")).alias("extra_per_question"), share("missing").alias("missing_pct"), share("exact").alias("exact_pct"),
    )


def confusion(rows: DataFrame, by: list[str], label="label", predicted="predicted") -> DataFrame:
    """Confusion counts and P/R/F1. INVALID misses a gold YES and is never a true negative, yet counts for accuracy."""
    gold, said = F.col(label) == 1, F.col(predicted)
    counts = rows.groupBy(*by).agg(
        F.count_if(gold & (said == "YES")).alias("tp"), F.count_if(~gold & (said == "YES")).alias("fp"),
        F.count_if(gold & (said != "YES")).alias("fn"), F.count_if(~gold & (said == "NO")).alias("tn"),
        F.count_if(said == "INVALID").alias("invalid"), F.count("*").alias("n"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f, "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n"))})


def coverage_adjusted(metrics: DataFrame, labelled: DataFrame, every: DataFrame, names: list[str], example="example_id") -> DataFrame:
    """Metrics times the share of examples that have labels."""
    have = labelled.select(example).distinct().agg(F.count("*").alias("labelled"))
    all_ = every.select(example).distinct().agg(F.count("*").alias("examples"))
    # One row each: the sides are single aggregates.
    joined = metrics.crossJoin(F.broadcast(have)).crossJoin(F.broadcast(all_))
    share = ratio(F.col("labelled"), F.col("examples"))
    return joined.select("labelled", "examples", *[(F.col(n) * share).alias(n) for n in names])


def rollup_scores(rows: DataFrame, graph="graph", metric="metric", failed="failed") -> DataFrame:
    """Mean of a metric for each graph and over all; an error counts as 0, rows without a value not at all."""
    value = F.when(F.col(failed), F.lit(0)).otherwise(F.col(metric))
    out = rows.groupingSets([[graph], []], graph).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_scored"), F.avg(value).alias("mean"), F.grouping(graph).alias("is_total"))
    return out.select(F.when(F.col("is_total") == 1, F.lit("overall")).otherwise(F.col(graph)).alias("graph"), "n_rows", "n_scored", "mean")


def mean_of_means(rows: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over outer groups of the means over inner ones."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("m"), F.count(value).alias("k")).groupBy(*outer).agg(F.avg("m").alias("mean"), F.sum("k").alias("n"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose numbers differ between a and b, with both numbers; none if the multisets are equal."""
    count = lambda df, sign: df.select(*keys, F.lit(sign).alias("side"))
    return (
        count(a, 1).unionByName(count(b, 2)).groupBy(*keys)
        .agg(F.count_if(F.col("side") == 1).alias("in_a"), F.count_if(F.col("side") == 2).alias("in_b"))
        .where("in_a <> in_b")
    )


def weighted_task_mean(rows: DataFrame, batch: str, task: str, loss: str, weights: dict[str, float]) -> DataFrame:
    """Per batch: mean loss of each task, weighted by the tasks present with weights made to sum to 1."""
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    per = rows.groupBy(batch, task).agg(F.avg(loss).alias("m")).withColumn("w", F.element_at(pairs, F.col(task)))
    return per.groupBy(batch).agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("loss"), F.count("*").alias("tasks"))
