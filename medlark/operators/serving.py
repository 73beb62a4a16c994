"""Serving: medication lists to ingredients, features of one case, prediction with a threshold, ablation arms."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import evaluate as EV
from . import features as FE
from . import models as MO
from . import names as NA
from .fuzzy import candidates, weighted_score

#: Scores from which a name is matched, and from which it is ambiguous.
MATCHED, AMBIGUOUS = 90.0, 75.0


def parse_medications(texts: DataFrame, column: str) -> DataFrame:
    """A row a typed name: commas and line ends part them."""
    return texts.select("*", F.explode(NA.tokens_of(F.col(column))).alias("typed"))


def match_medications(typed: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """(typed, status, candidates): the k best aliases of the same first letter that score AMBIGUOUS or more; exact ones score
    100. What scores less is never used, so it isn't looked for."""
    one = typed.select("typed").distinct().withColumn("name", C.drug_name(F.col("typed")))
    near = candidates(one, known, AMBIGUOUS / 100).withColumn("score", weighted_score("name", "alias")).where(F.col("score") >= AMBIGUOUS)
    scored = one.join(near, "name", "left").join(known.select("alias", "dc_id"), "alias", "left")
    # the engine keeps no more than the k best of each name in a task
    order = Window.partitionBy("typed").orderBy(F.desc_nulls_last("score"), F.desc("alias"), F.desc("dc_id"))
    first = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    listed = F.array_sort(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("_r", "score", "alias", "dc_id"))))
    best = first.groupBy("typed").agg(F.transform(listed, lambda x: F.struct(x["score"].alias("score"), x["alias"].alias("alias"), x["dc_id"].alias("dc_id"))).alias("candidates"))
    top = F.try_element_at("candidates", F.lit(1))["score"]
    status = F.when(top >= MATCHED, "matched").when(top >= AMBIGUOUS, "ambiguous").otherwise("unmatched")
    return best.select("typed", status.alias("status"), "candidates")


def case_features(cases: DataFrame, named: DataFrame, lookup: DataFrame, codes: DataFrame) -> DataFrame:
    """Features of new cases as builders make them: the frozen risk lookup and the same ATC counts. cases: report, ...;
    named: (report, dc_id)."""
    risk = named.join(lookup.select("dc_id", "ror"), "dc_id", "left").select("report", F.coalesce("ror", F.lit(1.0)).alias("ror"))
    per = risk.groupBy("report").agg(F.max("ror").alias("max_ror"), F.avg(F.log(F.greatest("ror", F.lit(1e-12)))).alias("mean_log_ror"), F.count_if(F.col("ror") > 2).alias("high_ror_count"))
    drugs = named.groupBy("report").agg(F.countDistinct("dc_id").cast("int").alias("num_drugs"))
    return FE.assemble(cases, "report", [drugs, per, FE.atc_features(FE.atc_rows(named, codes))], {"max_ror": 1.0})


def predict(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return MO.scored(model, rows).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def ablation(spark: SparkSession, rows: DataFrame, base: list[str], extra: list[str], kind: str = "forest", replicates: int = 200, seed: int = 42, **options) -> dict:
    """The same rows and parameters with and without the extra features: AUCs and the paired bootstrap of their difference
    on validation."""
    held = rows.where("split = 'validation'")
    arms = {}
    for name, features in (("a", base), ("b", [*base, *extra])):
        arms[name] = MO.scored(MO.fit(rows, features, kind, **options), held).select("report", "label", F.col("score").alias(f"score_{name}"))
    both = arms["a"].join(arms["b"].drop("label"), "report")
    auc = {k: EV.auc(both.select("label", F.col(f"score_{k}").alias("score"))).first()["auc"] for k in arms}
    return {"auc_without": auc["a"], "auc_with": auc["b"], "difference": EV.bootstrap_difference(both, replicates, seed, "report").iloc[0].to_dict()}
