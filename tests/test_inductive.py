"""The inductive network: gradients by differences, the signal it must find, reruns, and resuming."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlark.operators import evaluate as EV
from medlark.operators import inductive as IN


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = IN.initial(5, 4, 6, 3)
    own, near, label = rng.normal(size=(9, 5)), rng.normal(size=(9, 4)), rng.integers(0, 2, 9)
    keep = (rng.random((9, 6)) >= 0.3) / 0.7
    _, g = IN.gradients(p, own, near, label, 1.7, keep)
    assert set(g) == set(p)
    for k in p:
        for at in np.ndindex(p[k].shape):
            was, e = p[k][at], 1e-6
            p[k][at] = was + e
            up = IN.gradients(p, own, near, label, 1.7, keep)[0]
            p[k][at] = was - e
            down = IN.gradients(p, own, near, label, 1.7, keep)[0]
            p[k][at] = was
            assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-5), (k, at)
    # the loss is that of the logits
    z = IN.logits(p, own, near)
    chance = 1 / (1 + np.exp(-z))
    assert IN.gradients(p, own, near, label, 1.7)[0] == pytest.approx(-np.sum(np.where(label == 1, 1.7 * np.log(chance), np.log(1 - chance))))


@pytest.fixture(scope="module")
def rows(spark):
    """The label needs both sides together, which no linear model sees: the signs of one own and one neighbour component."""
    rng = np.random.default_rng(4)
    own, near = rng.normal(size=(1500, 4)), rng.normal(size=(1500, 3))
    label = ((own[:, 0] * near[:, 1] > 0) ^ (rng.random(1500) < 0.05)).astype(int)
    data = [(k, ["train", "train", "train", "validation", "test"][k % 5], int(label[k]), [*map(float, own[k]), 7.0], [None if k % 50 == 0 else float(near[k, 0]), *map(float, near[k, 1:])]) for k in range(1500)]
    return spark.createDataFrame(data, "patient_index long, split string, label int, own array<double>, near array<double>").repartition(3)


SETTINGS = {"batch": 300, "hidden": 12, "rate": 0.02, "dropout": 0.1, "patience": 8, "save_every": 4}


def test_finds_what_no_linear_model_does_and_reruns_agree(spark, rows, tmp_path):
    settings = IN.Settings(epochs=12, **SETTINGS)
    net = IN.fit(rows, f"file://{tmp_path}/a", settings)
    held = net.scored(rows.where("split = 'test'"))
    assert EV.auc(held.select("label", "score")).first()["auc"] > 0.8
    assert [h["epoch"] for h in net.history] == list(range(1, len(net.history) + 1)) and net.history[net.best_epoch - 1]["auc"] == max(h["auc"] for h in net.history)
    # stopped after four epochs and resumed: the same to the last bit, as the same batches come in the same order
    IN.fit(rows, f"file://{tmp_path}/b", IN.Settings(epochs=4, **SETTINGS))
    again = IN.fit(rows, f"file://{tmp_path}/b", settings, resume=True)
    assert again.history == net.history and all(np.array_equal(again.params[k], net.params[k]) for k in net.params)
    with pytest.raises(IN.TrainingError, match="another graph"):
        IN.fit(rows.withColumn("label", F.when(F.col("patient_index") == 0, 1 - F.col("label")).otherwise(F.col("label"))), f"file://{tmp_path}/b", settings, resume=True)
    with pytest.raises(IN.TrainingError, match="no saved state"):
        IN.fit(rows, f"file://{tmp_path}/c", settings, resume=True)
    IN.save(spark, net, f"file://{tmp_path}/net")
    assert sorted(map(tuple, IN.load(spark, f"file://{tmp_path}/net").scored(rows).select("patient_index", "score").collect())) == sorted(map(tuple, net.scored(rows).select("patient_index", "score").collect()))


def test_what_cannot_be_learnt_from(rows, tmp_path):
    for bad in (rows.where("false"), rows.where("split <> 'validation'"), rows.where("split <> 'train' or label = 1")):
        with pytest.raises(IN.TrainingError):
            IN.fit(bad, f"file://{tmp_path}/x", IN.Settings(epochs=1, **SETTINGS))
    with pytest.raises(IN.TrainingError):
        IN.Settings(dropout=1.0)


def test_steps_are_no_jobs_and_both_ways_agree(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(IN, "TASK_ROWS", 8)  # several tasks a step
    sc = spark.sparkContext

    def jobs(batch: int) -> int:
        sc.setJobGroup(f"network-{batch}", "")
        IN.fit(rows, f"file://{tmp_path}/{batch}", IN.Settings(epochs=1, **{**SETTINGS, "batch": batch}))
        found = len(sc.statusTracker().getJobIdsForGroup(f"network-{batch}"))
        sc.setJobGroup("other", "")
        return found

    assert IN._slots(spark) == 4 and jobs(30) <= jobs(300)  # 30 and 3 steps
    # without dropout, what tasks sum for each other is what single jobs sum
    plain = IN.Settings(epochs=2, **{**SETTINGS, "dropout": 0.0, "batch": 100})
    a = IN.fit(rows, f"file://{tmp_path}/a", plain)
    again = IN.fit(rows.repartition(2), f"file://{tmp_path}/c", plain)
    monkeypatch.setattr(IN, "_slots", lambda spark: 0)
    b = IN.fit(rows, f"file://{tmp_path}/b", plain)
    assert [h["epoch"] for h in a.history] == [h["epoch"] for h in b.history] == [1, 2]
    for k in a.params:
        assert np.allclose(a.params[k], b.params[k], atol=1e-9) and np.allclose(a.params[k], again.params[k], atol=1e-9)
