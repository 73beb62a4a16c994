"""Case versions, splits, aggregates, edges and the cohort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.fixed_values import SPLITS


def split_plan(spark: SparkSession, preset: str | dict = "gnn-small") -> DataFrame:
    plan = SPLITS[preset] if isinstance(preset, str) else preset
    rows = [(q, s) for s, quarters in plan.items() for q in quarters]
    if len({q for q, _ in rows}) != len(rows):
        raise ValueError("a quarter is in two splits")
    return spark.createDataFrame(rows, "quarter string, split string")


def without_deleted(demo: DataFrame, deleted: DataFrame, key: str = "caseid") -> DataFrame:
    return demo.where(F.col(key).isNotNull()).join(deleted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def latest_versions(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    ranked = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def version_order(version: str = "caseversion", date: str = "report_date", report: str = "primaryid") -> list[Column]:
    numeric = F.col(report).try_cast("decimal(38,0)")
    return [F.desc_nulls_last(version), F.desc_nulls_last(date), numeric.desc_nulls_last(), F.desc(report)]


def assign_splits(cases: DataFrame, plan: DataFrame) -> DataFrame:
    """Cases whose quarter is in no split go. The plan has a row a quarter, at most a few hundred."""
    return cases.join(F.broadcast(plan), "quarter")


def joined_set(value: Column) -> Column:
    """Distinct values in order, between bars."""
    return F.array_join(F.array_sort(F.collect_set(value)), "|")


def value_lists(rows: DataFrame, key: str, value: Column, list_name: str, count_name: str) -> DataFrame:
    kept = rows.withColumn("_v", value).where(C.filled(F.col("_v")))
    return kept.groupBy(key).agg(joined_set(F.col("_v")).alias(list_name), F.countDistinct("_v").alias(count_name))


def outcome_flags(rows: DataFrame, key: str, code: Column, serious: tuple = ("DE", "LT", "HO", "DS", "CA", "RI", "OT")) -> DataFrame:
    kept = rows.withColumn("_v", code).where(C.filled(F.col("_v")))
    return kept.groupBy(key).agg(joined_set(F.col("_v")).alias("outcome_codes"), F.max(F.col("_v").isin(*serious).cast("int")).alias("is_serious"))


def edges(facts: DataFrame, cohort: DataFrame, columns: list[str], required: str) -> DataFrame:
    """Distinct facts of the cohort's reports, on report and case."""
    return facts.where(C.filled(F.col(required))).join(cohort.select("primaryid", "caseid", "split"), ["primaryid", "caseid"]).select("primaryid", "caseid", "split", *columns).distinct()


@dataclass(frozen=True)
class Cohort:
    cohort: DataFrame
    report_drug: DataFrame
    report_reaction: DataFrame
    report_outcome: DataFrame
    case_splits: DataFrame
    latest: DataFrame
    aged: DataFrame
    source: DataFrame
    deleted: DataFrame

    def audit(self) -> dict[str, int]:
        """Counts of what went in and stayed."""
        ids = self.aged.select("primaryid")
        latest_n = self.latest.count()
        gone = self.source.join(self.deleted.select("caseid").distinct(), "caseid", "left_semi").select("caseid").distinct().count()
        return {
            "source_demo_rows": self.source.count(),
            "source_cases": latest_n + gone,
            "deleted_cases": gone,
            "latest_cases": latest_n,
            "valid_age_cases": ids.count(),
            "cohort_rows": self.cohort.count(),
            "duplicate_reports": self.cohort.groupBy("primaryid").count().where("count > 1").count(),
            "leaked_cases": self.cohort.groupBy("caseid").agg(F.countDistinct("split").alias("n")).where("n > 1").count(),
        }


def build_cohort(demo: DataFrame, drug: DataFrame, reac: DataFrame, outc: DataFrame, deleted: DataFrame, preset: str | dict = "gnn-small") -> Cohort:
    spark = demo.sparkSession
    dated = demo.select(
        "*",
        C.report_date(F.col("fda_dt"), F.col("rept_dt"), F.col("event_dt"), F.col("quarter")).alias("report_date"),
        C.age_years(F.col("age"), F.col("age_cod")).alias("age_years"),
        F.col("caseversion").try_cast("bigint").alias("_version"),
    )
    dated = dated.drop("caseversion").withColumnRenamed("_version", "caseversion")
    latest = latest_versions(without_deleted(dated, deleted), "caseid", version_order())
    placed = assign_splits(latest, split_plan(spark, preset))
    aged = placed.where(F.col("age_years").isNull() | F.col("age_years").between(0, 120))
    drugs = value_lists(drug, "primaryid", F.upper(F.trim("drugname")), "drug_list_str", "num_drugs")
    reactions = value_lists(reac, "primaryid", F.trim("pt"), "reaction_list_str", "num_reactions")
    outcomes = outcome_flags(outc, "primaryid", F.upper(F.trim("outc_cod")))
    years = F.floor("age_years").cast("int")
    base = aged.join(drugs, "primaryid").join(reactions, "primaryid", "left").join(outcomes, "primaryid", "left")
    cohort = base.select(
        "primaryid", "caseid", "caseversion", "report_date", "quarter", years.alias("age"), "age_years", C.sex(F.col("sex")).alias("sex"),
        C.flag(C.sex(F.col("sex")) == "UNKNOWN").alias("sex_unknown"), C.flag(F.col("age_years").isNull()).alias("age_missing"),
        F.col("wt").alias("weight"), F.col("wt_cod").alias("weight_unit"), C.age_group(F.col("age_years")).alias("age_group"), "drug_list_str",
        F.col("num_drugs").cast("int").alias("num_drugs"), C.flag(F.col("num_drugs") >= 5).alias("is_polypharmacy"), "reaction_list_str",
        F.coalesce("num_reactions", F.lit(0)).cast("int").alias("num_reactions"), "outcome_codes", F.coalesce("is_serious", F.lit(0)).alias("is_serious"), "split",
    )
    return Cohort(
        cohort,
        edges(drug, cohort, ["drug_seq", "role_cod", "drugname", "prod_ai", "route", "dose_amt", "dose_unit", "dose_form", "dose_freq"], "drugname"),
        edges(reac, cohort, ["pt", "drug_rec_act"], "pt"),
        edges(outc, cohort, ["outc_cod"], "outc_cod"),
        cohort.select("caseid", F.col("report_date").alias("max_report_date"), "quarter", "split"),
        latest, aged, demo, deleted,
    )


def coverage(plan: DataFrame, staged: DataFrame) -> DataFrame:
    """Each quarter of the plan, and whether any source row has it."""
    there = staged.select("quarter").distinct().withColumn("present", F.lit(1))
    return plan.join(there, "quarter", "left").select("quarter", "split", F.coalesce("present", F.lit(0)).alias("present"))
