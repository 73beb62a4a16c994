"""Totals and ranks in an order over all rows, without bringing them into one task: rows are dealt by ranges, summed by range,
and only one row a range is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Rows that a task of `dealt` takes, about.
ROWS = 100_000


def parts_for(rows: DataFrame) -> int:
    """Tasks for so many rows, at least as many as shuffles have, so that joins follow them. Best asked of a table as it is
    stored, where counting reads no rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))


def dealt(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """rows by key, over a number of tasks that isn't coalesced: small shuffle files of short rows are large once they are hashed
    or sorted, so memory is bounded by rows and not by bytes. What groups by the key and more isn't shuffled again."""
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def running(rows: DataFrame, order: list, sums: dict[str, str], parts: int | None = None, by: str | None = None) -> DataFrame:
    """rows with running sums: {new column: summed column}, in the given order and including the own row; with `by`, of each
    group apart. The order should be total."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*([F.col(by).asc_nulls_first()] if by else []), *order]
    group = [by] if by else []
    ranged = checkpointed(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range (and group that stands in it)
    base = ranged.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    base = base.select("_part", *[F.col(g).alias(f"_g_{g}") for g in group], *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums])
    match = F.col("_part") == F.col("_p")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = ranged.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(base.withColumnRenamed("_part", "_p"), match)
    return out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_part", "_p", *[f"_g_{g}" for g in group], *[f"_b_{n}" for n in sums])


def quantiles(rows: DataFrame, value: str, at: list[float], keys: list[str]) -> DataFrame:
    """(keys, support, q: array) of exact, linearly interpolated quantiles by group. Equal values are counted first, with
    sums in each task, then ranked by ranges: a group of any size is spread over tasks."""
    n = F.col("support")
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    named = counted.withColumn("_k", F.struct(*keys) if keys else F.lit(0))
    ranked = running(named, [F.asc("_v")], {"_end": "_c"}, by="_k")
    sizes = ranked.groupBy(*keys).agg(F.max("_end").alias("support"))
    join = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))
    parts = []
    for k, p in enumerate(at):
        place = (n - 1) * F.lit(float(p))
        for tag, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
            parts.append(F.max(F.when(here, F.col("_v"))).alias(f"_{tag}{k}"))
    found = join.groupBy(*keys, "support").agg(*parts)
    mixed = [F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * ((n - 1) * F.lit(float(p)) - F.floor((n - 1) * F.lit(float(p)))) for k, p in enumerate(at)]
    return found.select(*keys, "support", F.array(*mixed).alias("q"))
