"""Evaluation of scores (label 0/1, score): rank AUC, thresholds, calibration, bootstrap. Sums over distinct scores, not rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import running

#: Replicates of the bootstrap that are summed together.
REPLICATES = 50


def score_table(rows: DataFrame) -> DataFrame:
    """(score, pos, neg): one row a distinct score."""
    return rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def auc(rows: DataFrame) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties as halves; null where a class is empty."""
    t = running(score_table(rows), [F.asc("score")], {"upto": "neg"})
    return t.agg(F.try_divide(F.sum(F.col("pos") * (F.col("upto") - 0.5 * F.col("neg"))), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def confusion(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts and rates at each threshold (score >= threshold is positive). Rows are counted once, by the number of
    thresholds that they reach; sums over these few counts give every threshold's cells."""
    cuts = sorted({float(t) for t in thresholds})
    reached = reduce(lambda out, t: out + (F.col("score") >= t).cast("int"), cuts, F.lit(0))
    one = rows.where(F.col("score").isNotNull()).groupBy(reached.alias("reached")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    # a row a threshold, and one more
    steps = rows.sparkSession.createDataFrame([(k, t) for k, t in enumerate(cuts, 1)], "k int, threshold double")
    at = F.col("reached") >= F.col("k")
    c = steps.crossJoin(F.broadcast(one)).groupBy("threshold").agg(
        *[F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0)).alias(n) for n, cond, x in (("tp", at, "pos"), ("fp", at, "neg"), ("fn", ~at, "pos"), ("tn", ~at, "neg"))]
    )
    d = F.try_divide
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    recall, spec = d(tp, tp + fn), d(tn, tn + fp)
    mcc = d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        "threshold", "tp", "fp", "fn", "tn", d(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"),
        d(tp, tp + fp).alias("precision"), recall.alias("recall"), spec.alias("specificity"), d(tn, tn + fn).alias("npv"),
        d(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"), d(tp + fp, tp + fp + fn + tn).alias("alert_rate"),
    )


def _from_above(rows: DataFrame) -> DataFrame:
    """The score table with tp and fp at each score as threshold."""
    return running(score_table(rows), [F.desc("score")], {"tp": "pos", "fp": "neg"})


def policies(rows: DataFrame, recall: float = 0.95) -> DataFrame:
    """Thresholds by policy: a half, best F1 (the highest of equals), the highest that keeps the recall."""
    t = _from_above(rows)
    t = t.crossJoin(F.broadcast(t.agg(F.sum("pos").alias("all_pos"))))
    t = t.withColumns({"f1": F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")), "rec": F.try_divide(F.col("tp").cast("double"), F.col("all_pos"))})
    found = t.agg(F.max_by("score", F.struct("f1", "score")).alias("max_f1"), F.max(F.when(F.col("rec") >= recall, F.col("score"))).alias("recall"))
    return found.select(F.explode(F.array(F.struct(F.lit("fixed").alias("policy"), F.lit(0.5).alias("threshold")), F.struct(F.lit("max_f1").alias("policy"), F.col("max_f1").alias("threshold")), F.struct(F.lit("recall").alias("policy"), F.col("recall").alias("threshold")))).alias("p")).select("p.policy", "p.threshold")


def calibration(rows: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, confidence, observed) over equal widths."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("label").cast("double")).alias("observed"))


def probability_metrics(rows: DataFrame, bins: int = 15) -> DataFrame:
    """ECE, Brier score and log loss, one row."""
    ece = calibration(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("observed"))) / F.sum("n")).alias("ece"))
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col("label").cast("double")
    rest = rows.agg(F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    return ece.crossJoin(rest)


def average_precision(rows: DataFrame) -> DataFrame:
    t = _from_above(rows)
    return t.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double")).alias("auprc"))


#: Equal rows of a chunk.
EQUAL = 10_000


def bootstrap_difference(rows: DataFrame, replicates: int = 500, seed: int = 42, key: str | None = None) -> pd.DataFrame:
    """(delta mean, 2.5 and 97.5 % quantiles, share above 0) of AUC(score_b) - AUC(score_a), stratified by class and paired.

    Replicates weigh rows by Poisson counts drawn from a hash of (seed, replicate, row), the large-table form of drawing with
    replacement; a row has the same counts in both arms. Rows are summed by score and replicate, replicates of a block
    together, so nothing but sums is shuffled and no task holds the table. `key` tells rows apart (default: their values and
    an even deal among equal ones)."""
    plain = rows.select(*([F.col(key).alias("_id")] if key else []), "label", "score_a", "score_b")
    if not key:
        # equal rows are counted, and made again in chunks with numbers of their own, so that many of them are spread over tasks
        values = ["label", "score_a", "score_b"]
        counted = plain.groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
        chunks = counted.select("*", F.explode(F.expr(f"sequence(0, (_n - 1) div {EQUAL})")).alias("_chunk")).repartition(*values, "_chunk")
        number = F.explode(F.expr(f"sequence(_chunk * {EQUAL} + 1, least(_n, (_chunk + 1) * {EQUAL}))")).alias("_at")
        plain = chunks.select(*values, number).select(*values, F.struct(*values, F.col("_at").cast("int")).alias("_id"))
    # Poisson(1) by inversion of its distribution function; beyond 7 there are 10 in a million
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]).tolist()
    out = None
    for lo in range(0, replicates, REPLICATES):
        some = range(lo, min(lo + REPLICATES, replicates))
        u = F.transform(F.sequence(F.lit(some[0]), F.lit(some[-1])), lambda k: (F.pmod(F.xxhash64(F.lit(seed), k, "_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40))
        drawn = plain.withColumn("_u", u).withColumn("_w", F.transform("_u", lambda x: reduce(lambda n, c: n + (x >= c).cast("int"), steps, F.lit(0))))
        for arm in ("score_a", "score_b"):
            weigh = lambda c, k: F.sum(F.when(F.col("label") == c, F.col("_w")[k]).otherwise(0))
            by_score = drawn.groupBy(F.col(arm).alias("score")).agg(*[weigh(c, i).alias(f"{t}{i}") for i in range(len(some)) for c, t in ((1, "p"), (0, "n"))])
            t = running(by_score, [F.asc("score")], {f"u{i}": f"n{i}" for i in range(len(some))})
            one = t.agg(*[F.try_divide(F.sum(F.col(f"p{i}") * (F.col(f"u{i}") - 0.5 * F.col(f"n{i}"))), (F.sum(f"p{i}") * F.sum(f"n{i}")).cast("double")).alias(f"a{i}") for i in range(len(some))])
            part = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("replicate"), F.lit(arm).alias("arm"), F.col(f"a{i}").alias("auc")) for i, k in enumerate(some)])).alias("x")).select("x.*")
            out = part if out is None else out.unionByName(part)
    deltas = out.groupBy("replicate").agg((F.max(F.when(F.col("arm") == "score_b", F.col("auc"))) - F.max(F.when(F.col("arm") == "score_a", F.col("auc")))).alias("delta"))
    # a row a replicate
    return deltas.agg(F.avg("delta").alias("mean"), F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("p_above_0")).toPandas()


def standardised(rows: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """Columns minus the train mean, over the train deviation (1 where that is at most the floor)."""
    m = rows.where("split = 'train'").agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(m))
    z = {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") <= floor, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(z).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])
