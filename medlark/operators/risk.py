"""Disproportionality: contingency cells, ROR and PRR, and encodings from strictly earlier dates.

exposures: distinct (report, key...). reports: report, report_date, is_serious (0/1), split.
Daily facts are summed before any cumulative frame, so a frame runs over days, not reports; its bounds exclude the own day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def contingency(exposures: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """a, b by key and c, d from the totals of all reports."""
    return counted(exposures.join(reports.select("report", "is_serious"), "report"), reports, keys)


def counted(rows: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """`contingency` of exposures that have is_serious already."""
    serious = F.col("is_serious") == 1
    return with_totals(rows.groupBy(*keys).agg(F.count_if(serious).alias("a"), F.count_if(~serious).alias("b")), reports, keys)


def with_totals(cells: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) with c and d. The totals are one row."""
    serious = F.col("is_serious") == 1
    total = reports.agg(F.count_if(serious).alias("serious"), F.count_if(~serious).alias("calm"))
    return cells.crossJoin(F.broadcast(total)).select(*keys, "a", "b", (F.col("serious") - F.col("a")).alias("c"), (F.col("calm") - F.col("b")).alias("d"))


def with_ror(cells: DataFrame, smoothing: str) -> DataFrame:
    return cells.withColumn("ror", C.ror(*[F.col(x).cast("double") for x in "abcd"], smoothing))


def risk_lookup(exposures: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Frozen on train: always smoothed, 1 where train has one class only."""
    train = reports.where("split = 'train'")
    cells = contingency(exposures, train, [key]).withColumn("support", F.col("a") + F.col("b"))
    one_class = ((F.col("a") + F.col("c")) == 0) | ((F.col("b") + F.col("d")) == 0)
    return cells.withColumn("ror", F.when(one_class, 1.0).otherwise(C.ror(*[F.col(x).cast("double") for x in "abcd"], "always")))


def _prior(daily: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """Sums over strictly earlier days of the same keys; 0 on the first."""
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, date, *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"prior_{v}") for v in values])


def prior_cells(exposures: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """a, b, c, d before each (key, day) on which dated reports are exposed. Totals by day are at most some ten thousand
    rows: a row a day."""
    dated = reports.where(F.col("report_date").isNotNull())
    serious = F.col("is_serious") == 1
    days = dated.groupBy("report_date").agg(F.count_if(serious).alias("s"), F.count_if(~serious).alias("n"))
    own = exposures.join(dated.select("report", "report_date", "is_serious"), "report").groupBy(*keys, "report_date").agg(F.count_if(serious).alias("a"), F.count_if(~serious).alias("b"))
    return prior_of(own, days, keys)


def prior_of(own: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """`prior_cells` of daily facts: (keys, report_date, a, b) and the totals (report_date, s, n)."""
    totals = _prior(days, [], "report_date", ["s", "n"])
    before = _prior(own, keys, "report_date", ["a", "b"])
    return before.join(totals, "report_date").select(*keys, "report_date", F.col("prior_a").alias("a"), F.col("prior_b").alias("b"), (F.col("prior_s") - F.col("prior_a")).alias("c"), (F.col("prior_n") - F.col("prior_b")).alias("d"))


def temporal_ror(exposures: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """(report, key, ror): train reports from strictly earlier train dates (1 without history or with one class before),
    the others from the frozen lookup (1 where it has no such key)."""
    train = reports.where("split = 'train'")
    cells = [F.col(x).cast("double") for x in "abcd"]
    empty = ((F.col("a") + F.col("b")) == 0) | ((F.col("a") + F.col("c")) == 0) | ((F.col("b") + F.col("d")) == 0)
    history = prior_cells(exposures, train, [key]).select(key, "report_date", F.when(empty, 1.0).otherwise(C.ror(*cells, "always")).alias("ror"))
    own = exposures.join(train.select("report", "report_date"), "report").join(history, [key, "report_date"], "left").select("report", key, F.coalesce("ror", F.lit(1.0)).alias("ror"))
    frozen = risk_lookup(exposures, reports, key).select(key, "ror")
    rest = exposures.join(reports.where("split <> 'train'").select("report"), "report").join(frozen, key, "left").select("report", key, F.coalesce("ror", F.lit(1.0)).alias("ror"))
    return own.unionByName(rest)


def patient_risk(scored: DataFrame, boxed: DataFrame | None = None, key: str = "dc_id") -> DataFrame:
    rows = scored if boxed is None else scored.join(boxed, key, "left")
    more = [] if boxed is None else [F.coalesce(F.max("has_boxed_warning"), F.lit(0)).alias("has_boxed_warning")]
    return rows.groupBy("report").agg(F.max("ror").alias("max_ror"), F.avg(F.log(F.greatest("ror", F.lit(1e-12)))).alias("mean_log_ror"), F.count_if(F.col("ror") > 2).alias("high_ror_count"), *more)


def pairs(exposures: DataFrame, key: str = "dc_id") -> DataFrame:
    """Distinct (report, key_1 < key_2). A report has few keys, so the self join grows with reports."""
    one = exposures.select("report", F.col(key).alias("k")).distinct()
    return one.select("report", F.col("k").alias(f"{key}_1")).join(one.select("report", F.col("k").alias(f"{key}_2")), "report").where(F.col(f"{key}_1") < F.col(f"{key}_2"))


def pair_risk(pair_rows: DataFrame, fit: DataFrame, least: int = 25, key: str = "dc_id") -> DataFrame:
    """a, b, c, d, pair_reports, prr and log_ror of pairs with enough reports among those to fit on."""
    keys = [f"{key}_1", f"{key}_2"]
    cells = contingency(pair_rows, fit, keys).withColumn("pair_reports", F.col("a") + F.col("b")).where(F.col("pair_reports") >= least)
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    prr = F.try_divide(F.try_divide(a, a + b), F.try_divide(c, c + d))
    return cells.withColumn("prr", prr).withColumn("log_ror", C.log_ror(a, b, c, d))


def top_pairs(risk: DataFrame, k: int = 50, key: str = "dc_id") -> DataFrame:
    """The k pairs of highest PRR with their rank; the limit comes first, so the rank is over k rows."""
    order = [F.desc("prr"), F.desc("pair_reports"), F.asc(f"{key}_1"), F.asc(f"{key}_2")]
    first = risk.where(C.finite(F.col("prr"))).orderBy(*order).limit(k)
    return first.withColumn("risk_rank", F.row_number().over(Window.orderBy(*order)))


def pair_scores(pair_rows: DataFrame, reports: DataFrame, fit: Column, least: int = 25, key: str = "dc_id") -> DataFrame:
    """(report, pair, log_ror): reports to fit on from strictly earlier dates, with enough support before, else no row;
    the others from the frozen risk."""
    keys = [f"{key}_1", f"{key}_2"]
    chosen = reports.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    fitted = chosen.where("_fit")
    risk = pair_risk(pair_rows, fitted, least, key).select(*keys, F.col("log_ror").alias("frozen"))
    eligible = pair_rows.join(risk, keys)
    before = prior_cells(eligible.select("report", *keys), fitted, keys).where(F.col("a") + F.col("b") >= least)
    cells = [F.col(x).cast("double") for x in "abcd"]
    temporal = before.select(*keys, "report_date", C.log_ror(*cells).alias("log_ror"))
    own = eligible.join(fitted.select("report", "report_date"), "report").join(temporal, [*keys, "report_date"]).select("report", *keys, "log_ror")
    rest = eligible.join(chosen.where("not _fit").select("report"), "report").select("report", *keys, F.col("frozen").alias("log_ror"))
    return own.unionByName(rest)


def patient_pair_risk(scores: DataFrame) -> DataFrame:
    return scores.groupBy("report").agg(F.count_if(F.col("log_ror") > F.log(F.lit(1.5))).alias("num_high_risk_pairs"), F.max("log_ror").alias("max_pair_log_ror"), F.avg("log_ror").alias("mean_pair_log_ror"), F.count(F.lit(1)).alias("scored_pairs"))
