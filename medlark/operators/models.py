"""Tabular models with features fitted on train only: boosted trees (`boosted`) and forests (`forest`) of our own, adaptive
boosting of weighted pyspark.ml trees, and the models of pyspark.ml."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted as BO
from . import forest as FO
from .graph import checkpointed, shared_dir
from .quality import require_no_targets


def classifier(kind: str, width: int, seed: int = 42, **options):
    base = {"featuresCol": "scaled", "labelCol": "label"}
    made = {
        "logistic": lambda: LogisticRegression(**base, weightCol="weight", maxIter=options.get("rounds", 100)),
        "svm": lambda: LinearSVC(**base, weightCol="weight", maxIter=options.get("rounds", 50)),
        "network": lambda: MultilayerPerceptronClassifier(**base, seed=seed, maxIter=options.get("rounds", 60), layers=[width, options.get("hidden", 64), 2]),
    }
    return made[kind]()


def balanced(rows: DataFrame) -> DataFrame:
    """Weights that give both classes of train the same mass."""
    n = rows.where("split = 'train'").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_p"))
    w = F.when(F.col("label") == 1, F.col("_n") / (2.0 * F.greatest(F.col("_p"), F.lit(1)))).otherwise(F.col("_n") / (2.0 * F.greatest(F.col("_n") - F.col("_p"), F.lit(1))))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", w).drop("_n", "_p")


def fit(rows: DataFrame, features: list[str], kind: str = "forest", **options) -> PipelineModel | BO.Model | FO.Forest | Voting:
    """rows: features, label (0/1), split. Medians and scales come from train; boosted trees take options of boosted.Settings
    and stop by validation."""
    require_no_targets(features)
    if kind == "boosted":
        id = next(c for c in ("report", "patient_index", "primaryid") if c in rows.columns)
        settings = BO.Settings(**{k: v for k, v in options.items() if k in BO.Settings.__dataclass_fields__})
        return BO.fit(rows, features, f"{shared_dir(rows.sparkSession).rstrip('/')}/boosted-{uuid.uuid4().hex}", settings, id)
    if kind == "forest":
        return FO.fit(rows, features, **{k: v for k, v in options.items() if k in ("trees", "depth", "seed")})
    weighted = balanced(rows).withColumn("held", F.col("split") == "validation")
    filled = [f"{c}_filled" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True)]
    prepared = Pipeline(stages=stages).fit(weighted.where("split = 'train'"))
    used = prepared.transform(weighted.where("split = 'train'"))
    if kind == "adaboost":
        return adaptive(prepared, used, **{k: v for k, v in options.items() if k in ("rounds", "depth", "rate", "seed")})
    return PipelineModel(stages=[*prepared.stages, classifier(kind, len(features), **options).fit(used)])


@dataclass(frozen=True)
class Voting:
    """Trees that vote with their stage's weight."""

    prepared: PipelineModel
    trees: list
    weights: list[float]


#: Rounds after which the weights are written anew.
WRITTEN_EVERY = 10


def adaptive(prepared: PipelineModel, rows: DataFrame, rounds: int = 200, depth: int = 3, rate: float = 1.0, seed: int = 42) -> Voting:
    """SAMME for two classes: each round fits a tree to weighted rows, its vote is rate * log((1 - error) / error), and rows that
    it missed weigh exp(vote) times as much from then on. It stops at a tree without error, or one no better than chance.
    Weights start even, whatever the classes' sizes."""
    n = rows.count()
    state, trees, votes = checkpointed(rows.select("label", "scaled").withColumn("weight", F.lit(1.0 / max(n, 1)))), [], []
    for k in range(rounds):
        tree = DecisionTreeClassifier(featuresCol="scaled", labelCol="label", weightCol="weight", maxDepth=depth, seed=seed, minWeightFractionPerNode=0.0).fit(state)
        guessed = tree.transform(state).select("label", "scaled", "weight", (F.col("prediction") != F.col("label")).alias("missed"))
        total, wrong = guessed.agg(F.sum("weight"), F.sum(F.when(F.col("missed"), F.col("weight")).otherwise(0.0))).first()
        error = wrong / total
        if error >= 0.5:
            break
        trees.append(tree)
        if error <= 0:
            votes.append(1.0)
            break
        votes.append(rate * math.log((1 - error) / error))
        state = guessed.select("label", "scaled", (F.col("weight") / total * F.when(F.col("missed"), math.exp(votes[-1])).otherwise(1.0)).alias("weight"))
        if k % WRITTEN_EVERY == WRITTEN_EVERY - 1:
            state = checkpointed(state)
    if not trees:
        raise ValueError("no tree is better than chance")
    return Voting(prepared, trees, votes)


def scored(model: PipelineModel | BO.Model | FO.Forest | Voting, rows: DataFrame) -> DataFrame:
    """rows with score: the probability of class 1, or the margin through a logistic curve where there is none."""
    if isinstance(model, (BO.Model, FO.Forest)):
        return model.scored(rows)
    if isinstance(model, Voting):
        out = model.prepared.transform(rows)
        sums = F.lit(0.0)
        for k, (tree, vote) in enumerate(zip(model.trees, model.weights, strict=True)):
            out = tree.copy({tree.predictionCol: f"_p{k}", tree.rawPredictionCol: "", tree.probabilityCol: ""}).transform(out)
            sums = sums + (2 * F.col(f"_p{k}") - 1) * vote
        # the share of the votes, -1 to 1, through a logistic curve
        return out.withColumn("score", 1 / (1 + F.exp(-sums / sum(model.weights)))).select(*rows.columns, "score")
    out = model.transform(rows)
    vector = F.col("probability") if "probability" in out.columns else F.col("rawPrediction")
    from pyspark.ml.functions import vector_to_array

    s = vector_to_array(vector)[1]
    return out.withColumn("score", s if "probability" in out.columns else 1 / (1 + F.exp(-s))).select(*rows.columns, "score")


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    if isinstance(model, (BO.Model, FO.Forest)):
        return model.importances()
    if isinstance(model, Voting):
        total = sum(w * t.featureImportances.toArray() for t, w in zip(model.trees, model.weights, strict=True)) / sum(model.weights)
        return sorted(zip(features, map(float, total), strict=True), key=lambda x: -x[1])
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(features, map(float, values.toArray()), strict=True), key=lambda x: -abs(x[1]))


def save(spark: SparkSession, model: PipelineModel | BO.Model | FO.Forest | Voting, path: str) -> None:
    if isinstance(model, BO.Model):
        model.save(spark, f"{path}/boosted")
    elif isinstance(model, FO.Forest):
        model.save(spark, f"{path}/forest")
    elif isinstance(model, Voting):
        PipelineModel(stages=[*model.prepared.stages, *model.trees]).write().overwrite().save(f"{path}/trees")
        spark.createDataFrame([(len(model.prepared.stages), model.weights)], "first int, weights array<double>").write.mode("overwrite").parquet(f"{path}/votes")
    else:
        model.write().overwrite().save(f"{path}/pipeline")


def load(spark: SparkSession, path: str) -> PipelineModel | BO.Model | FO.Forest | Voting:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(folder)}
    if "boosted" in there:
        return BO.Model.load(spark, f"{path}/boosted")
    if "forest" in there:
        return FO.Forest.load(spark, f"{path}/forest")
    if "votes" in there:
        first, weights = spark.read.parquet(f"{path}/votes").first()
        stages = PipelineModel.load(f"{path}/trees").stages
        return Voting(PipelineModel(stages=stages[:first]), stages[first:], weights)
    return PipelineModel.load(f"{path}/pipeline")


def calibrated(rows: DataFrame, fit_on: str = "validation") -> DataFrame:
    """rows (score, label, split) with `calibrated`: a logistic curve (Platt) over the logit of the score, fitted on one split."""
    clipped = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    assembler = VectorAssembler(inputCols=["_logit"], outputCol="_x")
    data = assembler.transform(rows.withColumn("_logit", F.log(clipped / (1 - clipped))))
    curve = LogisticRegression(featuresCol="_x", labelCol="label", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q").fit(data.where(F.col("split") == fit_on))
    from pyspark.ml.functions import vector_to_array

    return curve.transform(data).withColumn("calibrated", vector_to_array("_q")[1]).select(*rows.columns, "calibrated")
