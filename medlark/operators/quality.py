"""Audits: schema contracts, row preservation, masks, orphans, finite inputs. Each is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AuditError(ValueError):
    """Data that breaks a contract."""


def require_columns(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> None:
    missing, leaked = [c for c in required if c not in df.columns], [c for c in forbidden if c in df.columns]
    if missing or leaked:
        raise AuditError(f"missing columns: {missing}; columns that mustn't be there: {leaked}")


def require_same_rows(before: DataFrame, after: DataFrame, key: str) -> int:
    n, m = before.count(), after.count()
    lost = before.select(key).join(after.select(key), key, "left_anti").limit(1).count()
    if n != m or lost:
        raise AuditError(f"rows weren't preserved: {n} before, {m} after")
    return n


def require_unique(df: DataFrame, keys: list[str]) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise AuditError(f"keys that aren't unique: {[tuple(r)[:-1] for r in twice]}")


def require_splits(df: DataFrame, splits: tuple = ("train", "validation", "test")) -> dict[str, int]:
    """Every row in exactly one known split, none of them empty."""
    counts = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != set(splits):
        raise AuditError(f"splits are {counts}")
    return counts


def require_no_orphans(edges: DataFrame, nodes: DataFrame, key: str) -> None:
    lost = edges.join(nodes.select(key).distinct(), key, "left_anti").select(key).limit(3).collect()
    if lost:
        raise AuditError(f"edges without a node: {[r[0] for r in lost]}")


def require_finite(df: DataFrame, columns: list[str], binary: list[str] = ()) -> None:
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns], *[F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias(c) for c in binary]).first().asDict()
    if any(bad.values()):
        raise AuditError(f"values that can't be trained on: { {c: n for c, n in bad.items() if n} }")


def require_no_targets(features: list[str], targets: tuple = ("is_serious", "is_death", "is_hospitalization")) -> None:
    if leaked := sorted(set(features) & set(targets)):
        raise AuditError(f"targets among the features: {leaked}")


def require_same_cases(cohort: DataFrame, splits: DataFrame) -> None:
    """The cohort and the table of splits have the same cases in the same splits, once each."""
    a, b = (t.select("caseid", "split") for t in (cohort, splits))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise AuditError("the cohort and its table of splits differ")


def require_integer_ids(df: DataFrame, columns: list[str]) -> None:
    kinds = dict(df.dtypes)
    if wrong := {c: kinds[c] for c in columns if kinds[c] != "bigint"}:
        raise AuditError(f"ids that aren't 64-bit integers: {wrong}")


def require_codec(spark, path: str, codec: str = "SNAPPY") -> int:
    """Number of column chunks of an output, all of which have to be of one codec."""
    from ..sources.delimited import codecs

    found = codecs(spark, path)
    if set(found) != {codec}:
        raise AuditError(f"{path} has column chunks of {found}")
    return found[codec]


def missing_prerequisites(paths: dict[str, str], spark) -> list[str]:
    from ..sources.manifest import exists

    return [f"{k}: {p}" for k, p in paths.items() if not exists(spark, p)]
