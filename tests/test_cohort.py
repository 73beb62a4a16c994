"""The cohort on a small table of reports: versions, deletions, ages, dates, splits, edges."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medlark.operators import cohort as CO

#: report -> case, version, age, unit, date, sex, quarter
REPORTS = {
    "A1": ("a", "1", "44", "YR", "20230214", "f ", "2023Q1"),  # replaced by a later version
    "A3": ("a", "3", "4.5", "DEC", "20230815", "F", "2023Q3"),
    "A2": ("a", "2", "44", "YR", "20230610", "F", "2023Q2"),
    "B8": ("b", "1", "31", "YR", None, "M", "2023Q2"),  # no date: the quarter's last day
    "B9": ("b", "1", "32", "YR", None, "M", "2023Q2"),  # same version and date: the larger report
    "C1": ("c", "1", "200", "YR", "20230301", "M", "2023Q1"),  # too old
    "D1": ("d", "1", "30", "MON", "20240102", "X", "2024Q1"),
    "E1": ("e", "1", "old", "YR", "20240520", None, "2024Q2"),  # an age that is no number counts as missing
    "F1": ("f", "1", "50", "YR", "20221111", "M", "2022Q4"),  # in no split
    "G1": ("g", "1", "50", "YR", "20230202", "M", "2023Q1"),  # deleted
    "H1": ("h", "1", "50", "YR", "20230202", "M", "2023Q1"),  # without drugs
}
DRUGS = {"A1": ["X"], "A3": ["Zinc", " zinc", "Yew"], "B8": ["X"], "B9": ["P", "Q", "R", "S", "T"], "C1": ["X"], "D1": ["X", ""], "E1": ["X"], "F1": ["X"], "G1": ["X"], "H1": ["  "]}


@pytest.fixture(scope="module")
def built(spark):
    nulls = lambda df, *names: df.withColumns({n: F.lit(None).cast("string") for n in names})
    rows = [(p, *r) for p, r in REPORTS.items()]
    demo = nulls(spark.createDataFrame(rows, "primaryid string, caseid string, caseversion string, age string, age_cod string, rept_dt string, sex string, quarter string"), "fda_dt", "event_dt", "wt", "wt_cod")
    facts = lambda values, name: spark.createDataFrame([(p, REPORTS[p][0], v) for p, vs in values.items() for v in vs], f"primaryid string, caseid string, {name} string")
    drug = nulls(facts(DRUGS, "drugname"), "drug_seq", "role_cod", "prod_ai", "route", "dose_amt", "dose_unit", "dose_form", "dose_freq")
    reac = nulls(facts({"A3": ["Rash", "Ache"], "B9": ["Rash", "Rash"]}, "pt"), "drug_rec_act")
    outc = facts({"A3": ["ho", "DE"], "D1": ["XX"], "A1": ["LT"]}, "outc_cod")
    return CO.build_cohort(demo, drug, reac, outc, spark.createDataFrame([("g",), ("g",), ("z",), (None,)], "caseid string"))


def test_rows(built):
    rows = {r["primaryid"]: r for r in built.cohort.collect()}
    assert {p: r["split"] for p, r in rows.items()} == {"A3": "train", "B9": "train", "D1": "validation", "E1": "test"}
    a, b, d, e = (rows[p] for p in ("A3", "B9", "D1", "E1"))
    assert (a["age"], a["age_group"], a["sex"], a["caseversion"], a["drug_list_str"], a["num_drugs"], a["outcome_codes"], a["is_serious"]) == (45, "41-64", "F", 3, "YEW|ZINC", 2, "DE|HO", 1)
    assert (b["report_date"], b["is_polypharmacy"], b["num_reactions"], b["reaction_list_str"], b["is_serious"]) == (dt.date(2023, 6, 30), 1, 1, "Rash", 0)
    assert (d["age"], d["age_group"], d["sex"], d["sex_unknown"], d["is_serious"]) == (2, "<18", "UNKNOWN", 1, 0)
    assert (e["age"], e["age_missing"], e["age_group"], e["num_reactions"]) == (None, 1, "UNKNOWN", 0)


def test_audit(built):
    assert built.audit() == {"source_demo_rows": 11, "source_cases": 8, "deleted_cases": 1, "latest_cases": 7, "valid_age_cases": 5, "cohort_rows": 4, "duplicate_reports": 0, "leaked_cases": 0}


def test_edges(built):
    assert sorted((r["primaryid"], r["drugname"]) for r in built.report_drug.collect()) == sorted([("A3", "Zinc"), ("A3", " zinc"), ("A3", "Yew"), *(("B9", x) for x in "PQRST"), ("D1", "X"), ("E1", "X")])
    assert {tuple(r)[:3] for r in built.report_reaction.select("primaryid", "pt", "split").collect()} == {("A3", "Rash", "train"), ("A3", "Ache", "train"), ("B9", "Rash", "train")}
    assert {r["outc_cod"] for r in built.report_outcome.collect()} == {"ho", "DE", "XX"}


def test_split_plan_rejects_overlap(spark):
    with pytest.raises(ValueError):
        CO.split_plan(spark, {"train": ["2023Q1"], "test": ["2023Q1"]})
