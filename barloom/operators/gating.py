"""Rule sets over candidate rows, screens, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comparison operators a rule may name.
OPS = {
    "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, ">": lambda v, t: v > t,
    ">=": lambda v, t: v >= t, "==": lambda v, t: v == t, "!=": lambda v, t: v != t,
}


def rule_holds(op: Column, value: Column, threshold: Column) -> Column:
    """Apply a rule's operator; a missing value never satisfies a rule."""
    out = F.when(value.isNull(), F.lit(False))
    for name, fn in OPS.items():
        out = out.when(op == name, fn(value, threshold))
    return F.coalesce(out.otherwise(False), F.lit(False))


def gate(candidates: DataFrame, modes: DataFrame, metrics: Sequence[str], key: str = "name") -> DataFrame:
    """Evaluate failure modes on candidates: key, fired, severities, passes.

    ``modes``: id, logic ('all'/'any'), severity, rules array<struct<key,op,threshold>>.
    The exploded rule table is joined on the metric name, so no pair of a
    candidate and an unrelated rule is formed.
    """
    values = candidates.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], list(metrics), "metric", "value")
    rules = modes.select("id", "logic", "severity", F.explode("rules").alias("r")).select(
        "id", "logic", "severity", F.col("r.key").alias("metric"), F.col("r.op").alias("op"), F.col("r.threshold").alias("threshold"))
    judged = values.join(rules, "metric").withColumn("_ok", rule_holds(F.col("op"), F.col("value"), F.col("threshold")))
    per_mode = judged.groupBy(key, "id").agg(
        F.first("logic").alias("logic"), F.first("severity").alias("severity"),
        F.bool_and("_ok").alias("_all"), F.bool_or("_ok").alias("_any"), F.count(F.lit(1)).alias("_n"))
    sizes = modes.select("id", F.size("rules").alias("_size"))
    # a rule on an unknown metric is false, so "all" needs every rule judged
    hit = per_mode.join(sizes, "id").where(
        F.when(F.col("logic") == "all", F.col("_all") & (F.col("_n") == F.col("_size"))).otherwise(F.col("_any")))
    fired = hit.groupBy(key).agg(
        F.sort_array(F.collect_list("id")).alias("fired"), F.max(F.when(F.col("severity") == "reject", 1).otherwise(0)).alias("_rej"))
    out = candidates.join(fired, key, "left")
    return out.withColumns({
        "fired": F.coalesce("fired", F.array().cast("array<string>")), "passes": F.coalesce(F.col("_rej"), F.lit(0)) == 0,
    }).drop("_rej")


def derived_metrics(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({
        "icir_abs": F.abs("icir"),
        "lambda_at_max": F.when(F.col("lambda_locked").isNotNull() & F.col("lambda_max").isNotNull(), F.when(F.col("lambda_locked") >= F.col("lambda_max"), 1).otherwise(0)),
    })


def compare_screens(before: DataFrame, after: DataFrame, key: str = "factor", metric: str = "icir") -> DataFrame:
    """Previous and new screen side by side: sign flip and status."""
    a = before.select(key, F.col(metric).alias("before"))
    b = after.select(key, F.col(metric).alias("after"))
    j = a.join(b, key, "full_outer")
    flip = (F.signum("before") * F.signum("after")) < 0
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(flip, "flipped").otherwise("kept")
    return j.withColumns({"status": status, "move": F.col("after") - F.col("before")})


def label_factors(screened: DataFrame, labels: DataFrame, order: Sequence[str], key: str = "factor", default: str = "unlabelled") -> DataFrame:
    """Label each factor with the first class of ``order`` whose list names it."""
    hits = labels.groupBy(key).agg(F.collect_set("label").alias("_l"))
    out = screened.join(hits, key, "left")
    col = F.when(F.col("_l").isNull(), default)
    for name in order:
        col = col.when(F.array_contains("_l", name), name)
    return out.withColumn("label", col.otherwise(default)).drop("_l")
