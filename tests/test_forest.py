"""Forests on counted cells: cuts against all cuts by hand, scores against pyspark.ml's forest, cells against rows, reruns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlark.operators import evaluate as EV
from medlark.operators import forest as FO
from medlark.operators import models as MO


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x = rng.normal(size=(n, 3))
    few = rng.integers(0, 5, n)
    label = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) + few - 3)))).astype(int)
    made = [(k, ["train", "train", "validation", "test"][k % 4], int(label[k]), *map(float, x[k]), [None, float("nan")][k % 2] if k % 50 == 0 else float(few[k])) for k in range(n)]
    return spark.createDataFrame(made, "report long, split string, label int, a double, b double, c double, d double").repartition(3)


FEATURES = ["a", "b", "c", "d"]


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(6)
    sums, weights = rng.poisson(0.6, (40, 3, FO.BINS, 2)).astype(float), np.array([0.7, 1.9])
    sums[:, 1] = sums[:, 0, ::-1]  # a node's features hold the same rows
    sums[:, 2] = np.roll(sums[:, 0], 7, axis=1)
    sums[0] = 0
    sums[1, :, :, 0] = 0  # of one class
    place, cut, gain, left = FO.best_cuts(sums, weights)

    def gini(c):
        w = c * weights
        return 1 - ((w / w.sum()) ** 2).sum() if w.sum() else 0.0

    for k in range(len(sums)):
        whole = sums[k, 0].sum(axis=0)
        found = [0.0]
        for f in range(3):
            for c in range(1, FO.BINS):
                l = sums[k, f, :c].sum(axis=0)
                r = whole - l
                if l.sum() and r.sum():
                    a, b, n = (l * weights).sum(), (r * weights).sum(), (whole * weights).sum()
                    found.append(gini(whole) - a / n * gini(l) - b / n * gini(r))
                    if (f, c) == (place[k], cut[k]):
                        assert gain[k] == pytest.approx(found[-1]) and left[k].tolist() == l.tolist()
        assert gain[k] == pytest.approx(max(found), abs=1e-12)


def test_scores_are_near_those_of_single_rows(spark, rows):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = MO.fit(rows, FEATURES, "forest", trees=60, depth=5)
    filled = [f"{c}_" for c in FEATURES]
    weighted = MO.balanced(rows)
    ready = VectorAssembler(inputCols=filled, outputCol="x").transform(Imputer(strategy="median", inputCols=FEATURES, outputCols=filled).fit(weighted.where("split = 'train'")).transform(weighted))
    other = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", seed=1, numTrees=60, maxDepth=5).fit(ready.where("split = 'train'"))
    theirs = other.transform(ready).select("report", vector_to_array("probability")[1].alias("theirs"))
    both = MO.scored(model, rows).join(theirs, "report").select("split", "label", "score", "theirs").toPandas()
    assert np.corrcoef(both.score, both.theirs)[0, 1] > 0.98 and abs(both.score - both.theirs).mean() < 0.03
    held = both[both.split == "test"]
    auc = [EV.auc(spark.createDataFrame(held[["label", c]].rename(columns={c: "score"}))).first()["auc"] for c in ("score", "theirs")]
    assert auc[0] > auc[1] - 0.01
    order = [f for f, _ in MO.importances(model, FEATURES)]
    assert set(order[:2]) == {"a", "d"} and sum(v for _, v in MO.importances(model, FEATURES)) == pytest.approx(1)


def test_reruns_agree_in_any_number_of_passes_and_models_come_back(spark, rows, tmp_path, monkeypatch):
    def scores(model):
        return sorted(map(tuple, MO.scored(model, rows).select("report", "score").collect()))

    first = MO.fit(rows, FEATURES, "forest", trees=8, depth=6)
    want = scores(first)
    monkeypatch.setattr(FO, "HISTOGRAM", 2000)  # some nodes a pass
    assert scores(MO.fit(rows.repartition(5), FEATURES, "forest", trees=8, depth=6)) == want
    MO.save(spark, first, f"file://{tmp_path}/m")
    assert scores(MO.load(spark, f"file://{tmp_path}/m")) == want
    assert MO.scored(first, rows.limit(0)).count() == 0


def test_passes_read_cells_however_often_rows_repeat(rows, monkeypatch):
    read = []
    found = FO._found
    monkeypatch.setattr(FO, "_found", lambda cells, *a: (read.append(cells.count()), found(cells, *a))[1])
    small = rows.withColumns({c: F.round(c) for c in "abc"})
    MO.fit(small, FEATURES, "forest", trees=2, depth=2)
    MO.fit(small.crossJoin(rows.sparkSession.range(30)), FEATURES, "forest", trees=2, depth=2)
    assert len(set(read)) == 1 and read[0] < 2000


def test_what_cannot_be_learnt_from(rows):
    with pytest.raises(ValueError, match="rows by label"):
        MO.fit(rows.where("split <> 'train'"), FEATURES, "forest", trees=2, depth=2)
    one = MO.scored(MO.fit(rows.where("label = 1"), ["a"], "forest", trees=2, depth=2), rows)
    assert {r["score"] for r in one.select("score").distinct().collect()} == {1.0}
