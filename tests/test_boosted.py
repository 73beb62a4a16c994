"""Boosted trees against an exact tree by hand; growth, stopping, missing values, reruns."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlark.operators import boosted as BO
from medlark.operators import evaluate as EV


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 900
    x = rng.normal(size=(n, 3)).round(1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    z = np.where(np.isnan(x[:, 0]), 1.5, x[:, 0]) + 2 * (np.nan_to_num(x[:, 1]) > 0.5) * (np.nan_to_num(x[:, 2]) < 0)
    label = (rng.random(n) < 1 / (1 + np.exp(-2 * (z - 0.7)))).astype(int)
    split = np.array(["train", "train", "validation", "test"])[np.arange(n) % 4]
    return x, label, split


@pytest.fixture(scope="module")
def rows(spark, data):
    x, label, split = data
    made = [(k, str(split[k]), int(label[k]), *[None if np.isnan(v) and k % 2 else float(v) for v in x[k]]) for k in range(len(x))]
    return spark.createDataFrame(made, "report long, split string, label int, a double, b double, c double").repartition(3)


def by_hand(x, label, margin, leaves, s):
    """(leaf value of each row, cuts) of one tree on raw values: every cut between values, best first."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - label, p * (1 - p)

    def best(rows):
        found = (0.0, None)
        own = g[rows].sum() ** 2 / (h[rows].sum() + s.ridge)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for cut in sorted(set(v[~np.isnan(v)]))[:-1]:
                for missing in (False, True):
                    left = np.where(np.isnan(v), missing, v <= cut)
                    gl, hl, gr, hr = (a[rows][side].sum() for side in (left, ~left) for a in (g, h))
                    if min(hl, hr) >= s.least_weight:
                        gain = (gl**2 / (hl + s.ridge) + gr**2 / (hr + s.ridge) - own) / 2
                        if gain > found[0] + 1e-12:
                            found = (gain, (f, float(cut), rows[left], rows[~left]))
        return found

    parts, cuts = [np.arange(len(x))], []
    options = [best(parts[0])]
    while len(parts) < leaves and max(o[0] for o in options) > 0:
        k = int(np.argmax([o[0] for o in options]))
        f, cut, a, b = options[k][1]
        cuts.append((f, round(options[k][0], 8)))
        del parts[k], options[k]
        parts += [a, b]
        options += [best(a), best(b)]
    value = np.zeros(len(x))
    for rows in parts:
        value[rows] = -s.rate * g[rows].sum() / (h[rows].sum() + s.ridge)
    return value, cuts


@pytest.mark.parametrize("leaves", [2, 5, 9])
def test_first_tree_is_the_exact_one(spark, data, rows, tmp_path, leaves):
    x, label, split = data
    s = BO.Settings(rounds=1, leaves=leaves, rows=1.0, columns=1.0, rate=0.3)
    model = BO.fit(rows, ["a", "b", "c"], f"file://{tmp_path}/w", s)
    train = split == "train"
    base = math.log(label[train].sum() / (train.sum() - label[train].sum()))
    value, cuts = by_hand(x[train], label[train], np.full(train.sum(), base), leaves, s)
    tree = model.trees[0]
    assert sorted(round(g, 8) for g, f in zip(tree.gain, tree.feature, strict=True) if f >= 0) == sorted(g for _, g in cuts) and len(tree.feature) == 2 * leaves - 1
    got = {r["report"]: r["score"] for r in model.scored(rows.where("split = 'train'")).collect()}
    want = dict(zip(np.flatnonzero(train).tolist(), 1 / (1 + np.exp(-(base + value))), strict=True))
    assert got == pytest.approx(want)


def test_boosting_stops_by_auc_and_reruns_agree(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(BO, "REFRESH", 3)  # margins are written anew on the way
    s = BO.Settings(rounds=14, leaves=6, rate=0.3, patience=4)
    model = BO.fit(rows, ["a", "b", "c"], f"file://{tmp_path}/a", s)
    assert len(model.history) <= 14 and len(model.trees) == int(np.argmax(model.history)) + 1 and (len(model.history) == 14 or len(model.history) == len(model.trees) + 4)
    held = model.scored(rows.where("split = 'validation'"))
    assert EV.auc(held.select("label", "score")).first()["auc"] == pytest.approx(max(model.history), abs=1e-9)
    assert EV.auc(model.scored(rows.where("split = 'test'")).select("label", "score")).first()["auc"] > 0.8
    monkeypatch.setattr(BO, "REFRESH", 100)
    again = BO.fit(rows, ["a", "b", "c"], f"file://{tmp_path}/b", s)
    assert [t.feature for t in again.trees] == [t.feature for t in model.trees] and again.history == pytest.approx(model.history)
    assert math.isclose(sum(v for _, v in model.importances()), 1) and {n for n, _ in model.importances()} == {"a", "b", "c"}
    model.save(spark, f"file://{tmp_path}/m")
    assert BO.Model.load(spark, f"file://{tmp_path}/m") == model
    assert model.scored(rows.where("false")).count() == 0


def test_depth_and_what_cannot_be_learnt_from(rows, tmp_path):
    model = BO.fit(rows, ["a", "b"], f"file://{tmp_path}/d", BO.Settings(rounds=2, leaves=64, depth=2, rows=0.7, columns=0.5))
    assert all(len(t.feature) <= 7 and len({f for f in t.feature if f >= 0}) == 1 for t in model.trees)
    for bad in (rows.where("false"), rows.where("label = 1"), rows.where("split = 'train'")):
        with pytest.raises(ValueError):
            BO.fit(bad, ["a"], f"file://{tmp_path}/x", BO.Settings(rounds=1))
    with pytest.raises(Exception, match="."):
        BO.fit(rows.withColumn("is_serious", F.col("label")), ["is_serious"], f"file://{tmp_path}/x")


def test_adaptive_boosting_weighs_what_was_missed(spark, data, rows, tmp_path, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    from medlark.operators import models as MO

    monkeypatch.setattr(MO, "WRITTEN_EVERY", 2)
    model = MO.fit(rows, ["a", "b", "c"], "adaboost", rounds=3, depth=1)
    train = rows.where("split = 'train'")
    table = model.prepared.transform(MO.balanced(train)).select("report", "label", vector_to_array("scaled").alias("x"), "scaled").orderBy("report")
    label = np.array([r["label"] for r in table.collect()])
    weight = np.full(len(label), 1 / len(label))
    total = np.zeros(len(label))
    for tree, vote in zip(model.trees, model.weights, strict=True):
        guess = np.array([r["prediction"] for r in tree.transform(table).orderBy("report").collect()])
        error = weight[guess != label].sum() / weight.sum()
        # a stump has the least weighted error of all cuts, so this one is fitted to these weights
        assert vote == pytest.approx(math.log((1 - error) / error)) and error < 0.5
        weight = weight / weight.sum() * np.where(guess != label, math.exp(vote), 1)
        total += vote * (2 * guess - 1)
    assert len(model.weights) == 3
    got = [r["score"] for r in MO.scored(model, train).orderBy("report").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-total / sum(model.weights)))).tolist())
    MO.save(spark, model, f"file://{tmp_path}/v")
    again = MO.load(spark, f"file://{tmp_path}/v")
    assert [r["score"] for r in MO.scored(again, train).orderBy("report").collect()] == pytest.approx(got)
    assert len(MO.importances(model, ["a", "b", "c"])) == 3


def test_attributions_against_all_subsets(spark, rows, tmp_path):
    import itertools

    model = BO.fit(rows, ["a", "b", "c"], f"file://{tmp_path}/s", BO.Settings(rounds=2, leaves=7, rate=0.5))
    held = rows.where("split = 'test'").limit(40)
    names = model.features

    def expected(tree, n, bins, known):
        """The tree's value when only some features are known, by going down both ways elsewhere."""
        if tree.feature[n] < 0:
            return tree.value[n]
        f, left = tree.feature[n], tree.left[n]
        if f in known:
            b = bins[f]
            return expected(tree, left if (tree.missing[n] if b == 0 else b <= tree.cut[n]) else left + 1, bins, known)
        return sum(tree.cover[c] / tree.cover[n] * expected(tree, c, bins, known) for c in (left, left + 1))

    made = {r["report"]: r for r in model.contributors(BO._binned(held, names, model.cuts), 2).collect()}
    scores = {r["report"]: r["score"] for r in model.scored(held).collect()}
    for r in made.values():
        bins, want = list(bytes(r["_bins"])), {}
        for f in range(3):
            others = [x for x in range(3) if x != f]
            want[names[f]] = sum(
                math.factorial(k) * math.factorial(2 - k) / 6 * sum(expected(t, 0, bins, {*some, f}) - expected(t, 0, bins, set(some)) for t in model.trees)
                for k in range(3) for some in itertools.combinations(others, k)
            )
        best = sorted(want, key=lambda n: -abs(want[n]))[:2]
        assert {c["feature"]: c["value"] for c in r["contributors"]} == pytest.approx({n: want[n] for n in best}, abs=1e-9)
        margin = r["base"] + sum(c["value"] for c in r["contributors"]) + r["rest"]
        assert 1 / (1 + math.exp(-margin)) == pytest.approx(scores[r["report"]])
    assert len(made) == 40
