"""Dose canonicalisation, train-only references, relative doses, patient aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as V
from .ranges import quantiles

#: Support and spread that a drug's own reference needs, and the clip of relative doses.
SUPPORT, SPREAD, CLIP = 20, 1e-12, 10.0


def canonical(edges: DataFrame) -> DataFrame:
    """Row-preserving: dimension, amount in the base unit, administrations and amount a day."""
    token = C.unit_token(F.col("dose_unit"))
    rows = edges.withColumns({"dose_dimension": C.dose_dimension(token), "administrations_per_day": C.per_day(F.col("dose_freq")), "_factor": C.dose_factor(token), "_n": C.number(F.col("dose_amt"))})
    rows = rows.withColumn("canonical_amount", C.positive_product(F.col("_n"), F.col("_factor")))
    daily = F.when(F.col("canonical_amount").isNotNull(), C.positive_product(F.col("canonical_amount"), F.col("administrations_per_day")))
    return rows.withColumns({"canonical_unit": C.base_unit(F.col("dose_dimension")), "canonical_daily_amount": daily}).drop("_factor", "_n")


def single_ingredient(dictionary: DataFrame) -> DataFrame:
    """(faers_raw, positive ids, dc_id if there is exactly one)."""
    n = F.countDistinct(F.when(F.col("dc_id") > 0, F.col("dc_id")))
    return dictionary.groupBy("faers_raw").agg(n.alias("positive_ids"), F.when(n == 1, F.max(F.when(F.col("dc_id") > 0, F.col("dc_id")))).alias("dc_id"))


def eligible(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    joined = rows.join(mapping, "faers_raw", "left").withColumn("positive_ids", F.coalesce("positive_ids", F.lit(0)))
    return joined.withColumn("eligible", C.flag((F.col("positive_ids") == 1) & F.col("dc_id").isNotNull() & F.col("canonical_amount").isNotNull()))


def _spread(prefix: str, value) -> list:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    return [F.count(value).alias(f"{prefix}_support"), q.alias(f"{prefix}_q")]


def references(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Support, quartiles, spread and 90th percentile of the log amounts of eligible training rows. Quantiles are exact."""
    used = rows.where((F.col("split") == "train") & (F.col("eligible") == 1))
    out = used.groupBy(*keys).agg(*_spread("amount", F.log("canonical_amount")), *_spread("daily", F.log("canonical_daily_amount")))
    cols = []
    for p in ("amount", "daily"):
        q = F.col(f"{p}_q")
        cols += [F.col(f"{p}_support"), q[1].alias(f"{p}_median"), q[0].alias(f"{p}_q25"), q[2].alias(f"{p}_q75"), (q[2] - q[0]).alias(f"{p}_iqr"), q[3].alias(f"{p}_p90")]
    return out.select(*keys, *cols)


def wide_references(rows: DataFrame) -> DataFrame:
    """`references` by dimension alone: nine groups at most, each ranked over many tasks, amounts and daily amounts at once."""
    used = rows.where((F.col("split") == "train") & (F.col("eligible") == 1))
    both = F.array(*[F.struct(F.lit(p).alias("kind"), F.log(c).alias("log")) for p, c in (("amount", "canonical_amount"), ("daily", "canonical_daily_amount"))])
    long = used.select("dose_dimension", F.explode(both).alias("x")).select("dose_dimension", "x.kind", "x.log")
    found = quantiles(long, "log", [0.25, 0.5, 0.75, 0.9], ["dose_dimension", "kind"])
    cols = []
    for p in ("amount", "daily"):
        at = lambda x, p=p: F.max(F.when(F.col("kind") == p, x))
        q = at(F.col("q"))
        cols += [F.coalesce(at(F.col("support")), F.lit(0)).alias(f"{p}_support"), q[1].alias(f"{p}_median"), q[0].alias(f"{p}_q25"), q[2].alias(f"{p}_q75"), (q[2] - q[0]).alias(f"{p}_iqr"), q[3].alias(f"{p}_p90")]
    return found.groupBy("dose_dimension").agg(*cols)


def lookup(rows: DataFrame) -> DataFrame:
    """The frozen table that doses are scored against: a row a drug and dimension with its own reference, the dimension's
    beside it (dim_...), and which of the two applies."""
    own, wide = references(rows, ["dc_id", "dose_dimension"]), wide_references(rows)
    out = own.join(F.broadcast(wide.select("dose_dimension", *[F.col(c).alias(f"dim_{c}") for c in wide.columns if c != "dose_dimension"])), "dose_dimension", "left")
    enough = lambda p: (F.col(f"{p}_support") >= SUPPORT) & (F.col(f"{p}_iqr") > SPREAD)
    return out.withColumns({f"{p}_level": F.when(enough(p), "drug").when(F.col(f"dim_{p}_support") > 0, "dimension") for p in ("amount", "daily")})


def relative(rows: DataFrame) -> DataFrame:
    """Log doses against the drug's reference, else the dimension's; null where neither applies or the row isn't eligible."""
    own, wide = references(rows, ["dc_id", "dose_dimension"]), wide_references(rows)
    rename = lambda df, tag: df.select(*[F.col(c).alias(c if c in ("dc_id", "dose_dimension") else f"{tag}_{c}") for c in df.columns])
    # a row a dimension: nine at most
    out = rows.join(rename(own, "drug"), ["dc_id", "dose_dimension"], "left").join(F.broadcast(rename(wide, "dim")), "dose_dimension", "left")
    for p, amount, result, above in (("amount", "canonical_amount", "relative_log_amount", "above_train_p90"), ("daily", "canonical_daily_amount", "relative_log_daily_amount", "above_train_daily_p90")):
        use_drug = (F.coalesce(f"drug_{p}_support", F.lit(0)) >= SUPPORT) & (F.col(f"drug_{p}_iqr") > SPREAD)
        use_dim = F.coalesce(f"dim_{p}_support", F.lit(0)) > 0
        pick = lambda c: F.when(use_drug, F.col(f"drug_{p}_{c}")).when(use_dim, F.col(f"dim_{p}_{c}"))  # noqa: B023, E731
        width = pick("iqr")
        z = (F.log(amount) - pick("median")) / F.when(width > SPREAD, width).otherwise(1.0)
        ok = (F.col("eligible") == 1) & F.col(amount).isNotNull() & (use_drug | use_dim)
        out = out.withColumn(result, F.when(ok, F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP)))).withColumn(above, F.when(ok, (F.log(amount) > pick("p90")).cast("int")))
    return out.select(*rows.columns, "relative_log_amount", "above_train_p90", "relative_log_daily_amount", "above_train_daily_p90")


def patient_features(rows: DataFrame, key: str = "primaryid") -> DataFrame:
    """The fifteen dose features of each patient; rows are not deduplicated."""
    route = F.upper(F.trim(F.coalesce("route", F.lit(""))))
    name, n = F.when(F.col("faers_raw") != "", F.col("faers_raw")), F.count(F.lit(1))
    parenteral = route.rlike(V.DOSE_PARENTERAL)
    share = lambda c: (F.count(c) / n).cast("double")
    above = F.count_if(F.col("above_train_p90") == 1)
    p = "dose_normalized_"
    return rows.groupBy(key).agg(
        share("canonical_amount").alias(f"{p}numeric_fraction"),
        share("canonical_daily_amount").alias(f"{p}scheduled_fraction"),
        share("relative_log_amount").alias(f"{p}relative_available_fraction"),
        F.coalesce(F.avg("relative_log_amount"), F.lit(0.0)).alias(f"{p}relative_log_mean"),
        F.coalesce(F.max("relative_log_amount"), F.lit(0.0)).alias(f"{p}relative_log_max"),
        share("relative_log_daily_amount").alias(f"{p}daily_relative_available_fraction"),
        F.coalesce(F.avg("relative_log_daily_amount"), F.lit(0.0)).alias(f"{p}daily_relative_log_mean"),
        F.coalesce(F.max("relative_log_daily_amount"), F.lit(0.0)).alias(f"{p}daily_relative_log_max"),
        above.cast("int").alias(f"{p}above_train_p90_count"),
        F.coalesce(F.try_divide(above, F.count("relative_log_amount")), F.lit(0.0)).alias(f"{p}above_train_p90_fraction"),
        F.countDistinct(F.when(parenteral, name)).cast("int").alias(f"{p}num_parenteral_drugs"),
        F.coalesce(F.try_divide(F.countDistinct(F.when(parenteral, name)), F.countDistinct(name)), F.lit(0.0)).alias(f"{p}parenteral_fraction"),
        *[F.max(route.rlike(pattern).cast("int")).alias(f"{p}has_{k}") for k, pattern in V.DOSE_ROUTES.items()],
    )
