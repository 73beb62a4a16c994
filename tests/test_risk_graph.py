"""Temporal encodings, pairs, graph and evaluation on literal fixtures."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from medlark.operators import evaluate as EV
from medlark.operators import graph as GR
from medlark.operators import risk as RI


def _reports(spark, rows):
    return spark.createDataFrame([(r, dt.date.fromisoformat(d) if d else None, s, x) for r, d, s, x in rows], "report string, report_date date, is_serious int, split string")


def _exposures(spark, rows):
    return spark.createDataFrame(rows, "report string, dc_id long")


def test_temporal_and_frozen(spark):
    reports = _reports(spark, [("p1", "2024-01-01", 1, "train"), ("p2", "2024-01-02", 0, "train"), ("p3", "2024-02-01", 1, "validation")])
    exposures = _exposures(spark, [("p1", 1), ("p1", 2), ("p2", 1), ("p3", 2), ("p3", 3)])
    got = {(r["report"], r["dc_id"]): r["ror"] for r in RI.temporal_ror(exposures, reports, "dc_id").collect()}
    assert got[("p1", 1)] == got[("p2", 1)] == 1.0 and got[("p3", 2)] == pytest.approx(9.0) and got[("p3", 3)] == 1.0


def test_same_day_is_no_history(spark):
    reports = _reports(spark, [("a", "2024-01-01", 1, "train"), ("b", "2024-01-01", 0, "train"), ("n", None, 1, "train")])
    got = {r["report"]: r["ror"] for r in RI.temporal_ror(_exposures(spark, [("a", 10), ("b", 11), ("n", 10)]), reports, "dc_id").collect()}
    assert got == {"a": 1.0, "b": 1.0, "n": 1.0}


def test_held_out_labels_change_nothing_in_train(spark):
    rows = [(f"r{i}", f"2024-01-{1 + i % 9:02d}", i % 2, "train") for i in range(30)] + [("v", "2024-03-01", 1, "validation")]
    exposures = _exposures(spark, [(f"r{i}", i % 4) for i in range(30)] + [("v", 1)])
    flipped = [*rows[:-1], ("v", "2024-03-01", 0, "validation")]
    one, two = (sorted(map(tuple, RI.temporal_ror(exposures, _reports(spark, x), "dc_id").collect())) for x in (rows, flipped))
    assert one == two


def test_pairs(spark):
    reports = _reports(spark, [("p1", "2023-01-01", 1, "train"), ("p2", "2023-01-02", 1, "train"), ("p3", "2023-01-03", 0, "train"), ("p4", "2023-01-04", 1, "train"), ("h", "2024-01-01", 0, "validation")])
    rows = RI.pairs(_exposures(spark, [("p1", 1), ("p1", 2), ("p2", 1), ("p2", 2), ("p3", 3), ("p4", 4), ("h", 1), ("h", 2)]))
    from pyspark.sql import functions as F

    risk = RI.pair_risk(rows, reports.where("split = 'train'"), 2).first()
    assert (risk["a"], risk["b"], risk["pair_reports"]) == (2, 0, 2) and risk["prr"] == pytest.approx(2.0)
    scores = {r["report"] for r in RI.pair_scores(rows, reports, F.col("split") == "train", 2).collect()}
    assert scores == {"h"}


def test_neighbour_mean_and_components(spark):
    w = spark.createDataFrame([(0, 1, 2), (1, 0, 2), (1, 2, 1), (2, 1, 1)], "n1 long, n2 long, weight long")
    v = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 7.0), (9, 5.0)], "node_index long, x double")
    assert {r["node_index"]: r["neighbour_x"] for r in GR.neighbour_mean(w, v, "x").collect()} == {0: 4.0, 1: 3.0, 2: 4.0, 9: 0.0}
    assert {r["node_index"]: r["component"] for r in GR.components(v, w).collect()} == {0: 0, 1: 0, 2: 0, 9: 9}


def test_chain_components(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_index long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "n1 long, n2 long")
    assert {r["component"] for r in GR.components(nodes, links).collect()} == {0}


def test_graph_features_has_eight_columns(spark):
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 2)], "patient_index long, node_index long")
    patients = spark.createDataFrame([(0, "train", 1), (1, "train", 0), (2, "test", 1), (3, "test", 0)], "patient_index long, split string, is_serious int")
    nodes = spark.createDataFrame([(0, 0.5), (1, -0.5), (2, 0.0)], "node_index long, log_ror double")
    out = GR.graph_features(edges, patients, nodes)
    assert len(out.columns) == 9 and out.count() == 4
    assert all(v == 0 for v in out.where("patient_index = 3").first()[1:])


def test_dense_index(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert all(r["k"] == r["i"] for r in GR.dense_index(rows, ["k"], "i", 5).collect())


@pytest.mark.parametrize(("labels", "scores", "auc"), [([0, 1, 0, 1], [0.1, 0.8, 0.2, 0.8], 1.0), ([0, 1], [0.5, 0.5], 0.5), ([1, 1], [0.1, 0.2], None)])
def test_auc(spark, labels, scores, auc):
    rows = spark.createDataFrame(list(zip(labels, scores, strict=True)), "label int, score double")
    assert EV.auc(rows).first()["auc"] == auc


def test_bootstrap_is_deterministic(spark):
    rows = spark.createDataFrame([(i % 2, math.sin(i), i / 50 + math.sin(i)) for i in range(60)], "label int, score_a double, score_b double")
    assert EV.bootstrap_difference(rows, 20, 3).equals(EV.bootstrap_difference(rows, 20, 3))
