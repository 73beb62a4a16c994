"""Names that stand for many ids: right results, and no row of a report and an id is shuffled, whether the names are broadcast or not."""

from __future__ import annotations

import math
import uuid

import pytest
from py4j.protocol import Py4JJavaError

from medlark.operators import graph as GR
from medlark.operators import names as NA

REPORTS, NAMES, IDS = 400, 8, 60


def shuffled(spark, run):
    """What run() returns, and the rows that its stages wrote to shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store, rows = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        try:
            rows += store.lastStageAttempt(stage).shuffleWriteRecords()
        except Py4JJavaError:  # a stage that was skipped
            pass
    return out, rows


def ids(name: int) -> set[int]:
    return {(name * 31 + k) % 200 for k in range(IDS)}


def names(report: int) -> list[int]:
    return [(report + k * (1 + report % 3)) % NAMES for k in range(4)]


@pytest.mark.parametrize("most", [400_000, 0])
def test_dictionary_ror_shuffles_no_report_and_id(spark, monkeypatch, most):
    monkeypatch.setattr(NA, "BROADCAST_PAIRS", most, raising=False)
    dictionary = spark.createDataFrame([(f"N{n}", i) for n in range(NAMES) for i in ids(n)], "faers_raw string, dc_id long")
    # names come twice, with blanks, and as null or unknown ones
    edges = spark.createDataFrame([(r, f" N{n}") for r in range(REPORTS) for n in [*names(r), names(r)[0]]] + [(0, None), (1, "NEW"), (None, "N1")], "primaryid long, drugname string")
    cohort = spark.createDataFrame([(r, int(r % 7 < 3), "train") for r in range(REPORTS + 50)], "primaryid long, is_serious int, split string")
    out, rows = shuffled(spark, lambda: NA.dictionary_ror(dictionary, edges, cohort).collect())
    seen = {r: set().union(*(ids(n) for n in names(r))) for r in range(REPORTS)}
    serious = {r for r in range(REPORTS + 50) if r % 7 < 3}
    for x in out:
        a, b = (sum(x["dc_id"] in seen[r] and (r in serious) == s for r in seen) for s in (True, False))
        c, d = len(serious) - a, REPORTS + 50 - len(serious) - b
        assert math.isclose(x["ror"], a * d / (b * c) if a * b * c * d else (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    assert len(out) == NAMES * IDS
    assert 0 < rows < sum(map(len, seen.values())) / 2


@pytest.mark.parametrize("most", [400_000, 0])
def test_graph_edges_shuffle_no_patient_and_node(spark, monkeypatch, most):
    monkeypatch.setattr(NA, "BROADCAST_PAIRS", most, raising=False)
    # id 0 is no node; GONE is known, but its id has no node, so it isn't OTHER either
    dictionary = spark.createDataFrame([(f"N{n}", i) for n in range(NAMES) for i in ids(n)] + [("RARE", 0), ("OFTEN", 0), ("GONE", 999)], "faers_raw string, dc_id long")
    unknown = spark.createDataFrame([("OFTEN", 5, 1)], "faers_raw string, n long, rank int")
    nodes = GR.drug_nodes(dictionary.where("dc_id between 1 and 200").select("dc_id").distinct(), unknown).collect()
    index = {x["semantic_id"]: x["node_index"] for x in nodes}
    often, other = next(x["node_index"] for x in nodes if x["node_label"] == "OFTEN"), index[-1]
    nodes = spark.createDataFrame(nodes)
    more = [(0, None), (0, "OFTEN"), (REPORTS, None), (REPORTS + 1, "RARE"), (REPORTS + 1, "NEW"), (REPORTS + 2, "GONE"), (REPORTS + 3, "OFTEN")]
    named = spark.createDataFrame([(r, f"N{n}") for r in range(REPORTS) for n in [*names(r), names(r)[0]]] + more, "patient_index long, faers_raw string")
    out, rows = shuffled(spark, lambda: GR.graph_edges(named, dictionary, unknown, nodes).collect())
    expected = {(r, index[i]) for r in range(REPORTS) for n in names(r) for i in ids(n) if i > 0}
    expected |= {(0, other), (0, often), (REPORTS, other), (REPORTS + 1, other), (REPORTS + 3, often)}
    assert len(out) == len(expected) and {tuple(x) for x in out} == expected
    assert 0 < rows < len(expected) / 2


def test_unknown_names_are_counted_before_they_are_joined(spark):
    edges = spark.createDataFrame([("train", f"N{k % 9}") for k in range(9000)] + [("test", "N0")] * 9 + [("train", None), ("train", " ")] * 5000, "split string, faers_raw string")
    known = spark.createDataFrame([("N0",), ("N0",), ("N1",)], "faers_raw string")
    # broadcasts by size would hide the shuffle of rows
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, rows = shuffled(spark, lambda: [tuple(x) for x in NA.unmapped_by_frequency(edges, known, 3).collect()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(out) == [("N2", 1000, 1), ("N3", 1000, 2), ("N4", 1000, 3)]
    assert 0 < rows < 1000
