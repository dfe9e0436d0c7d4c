"""Measures of a labelled corpus: confusion, grouping sets, severity met, comparison with earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.findings import rank


def verdicts(items: DataFrame, worst: DataFrame, threshold: str) -> DataFrame:
    """items (item_id, positive, …) with `flagged`: is the item's worst finding (item_id, severity) at least the threshold?"""
    w = worst.groupBy("item_id").agg(F.max(rank(F.col("severity"))).alias("r"))
    return items.join(w, "item_id", "left").withColumn("flagged", F.coalesce(F.col("r") >= rank(F.lit(threshold)), F.lit(False))).drop("r")


def confusion(v: DataFrame, groups: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and fpr over all rows and for each group column (grouping sets)."""
    p, f = F.col("positive"), F.col("flagged")
    counts = [F.count_if(p & f).alias("tp"), F.count_if(~p & f).alias("fp"), F.count_if(p & ~f).alias("fn"), F.count_if(~p & ~f).alias("tn")]
    out = v.groupingSets([[], *[[F.col(g)] for g in groups]], *[F.col(g) for g in groups]).agg(*counts)
    ratio = lambda a, b: F.round(F.when(b != 0, a / b), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("fpr", ratio(fp, fp + tn))


def severity_met(items: DataFrame, worst: DataFrame) -> DataFrame:
    """How many positives reach their expected severity, and which stay below."""
    w = worst.groupBy("item_id").agg(F.max(rank(F.col("severity"))).alias("r"))
    j = items.filter("expected_severity is not null").join(w, "item_id", "left").withColumn("met", F.coalesce(F.col("r") >= rank(F.col("expected_severity")), F.lit(False)))
    return j.agg(F.count("*").alias("expected"), F.count_if("met").alias("met"), F.count_if(F.col("expected_severity") == "critical").alias("critical"), F.count_if((F.col("expected_severity") == "critical") & F.col("met")).alias("critical_met"), F.array_sort(F.collect_list(F.when(~F.col("met"), F.col("item_id")))).alias("below"))


def false_hits(items: DataFrame, fired: DataFrame) -> DataFrame:
    """(rule_id, items): how many benign items each rule fires on."""
    return fired.join(items.filter("not positive").select("item_id"), "item_id", "left_semi").groupBy("rule_id").agg(F.count_distinct("item_id").alias("items"))


def expected_fired(items: DataFrame, fired: DataFrame) -> DataFrame:
    """(item_id, hit, missed): expected rules that fired and those that did not."""
    f = fired.groupBy("item_id").agg(F.collect_set("rule_id").alias("f"))
    j = items.join(f, "item_id", "left").withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    return j.select("item_id", F.array_sort(F.array_intersect("expected_rules", "f")).alias("hit"), F.array_sort(F.array_except("expected_rules", "f")).alias("missed"))


def regressions(old: DataFrame, new: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, old, new, state): metrics that fell by more than the tolerance, vanished or are new."""
    j = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("new") < F.col("old") - tolerance, "worse").when(F.col("new") > F.col("old") + tolerance, "better").otherwise("same")
    return j.withColumn("state", state)


def first_seen(rows: DataFrame, key: list[str], name: str, order: str, most: int = 100) -> DataFrame:
    """The first `most` distinct names per key in order of first appearance, for a listing."""
    from pyspark.sql import Window

    one = rows.groupBy(*key, name).agg(F.min(order).alias("first"))
    return one.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("first", name))).filter(F.col("n") <= most)


def worst_entry(rows: DataFrame, key: list[str], value: str, weight: Column, order: str) -> DataFrame:
    """Per key the entry of greatest weight; of equal ones the first in order."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(weight, -F.col(order))).alias(value))
