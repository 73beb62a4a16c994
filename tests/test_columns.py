"""Column functions against the literal fixtures for doses and names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from medlark.functions import columns as C
from medlark.operators import dose as DO
from medlark.operators import fuzzy as FZ
from medlark.operators import names as NA


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("amount", "unit", "dimension", "value"), [
    ("1000", "µG", "mass_mg", 1.0), ("2", "M.G.", "mass_mg", 2.0), ("1", "gm", "mass_mg", 1000.0), ("3", "MG/M²", "mass_mg_per_m2", 3.0), ("3", "mg/m**2", "mass_mg_per_m2", 3.0),
    ("1", "L", "volume_ml", 1000.0), ("5", "KIU", "activity_iu", 5000.0), ("1", "MCI", "radioactivity_mbq", 37.0), ("7", "mmol", "substance_mmol", 7.0),
    ("0", "MG", "mass_mg", None), ("-1", "MG", "mass_mg", None), ("NaN", "MG", "mass_mg", None), ("5d", "MG", "mass_mg", None), ("1", "TABLET", None, None), ("1", "%", None, None), ("1", "", None, None),
])
def test_dose(spark, amount, unit, dimension, value):
    row = DO.canonical(spark.createDataFrame([(amount, unit, "BID")], "dose_amt string, dose_unit string, dose_freq string")).first()
    assert row["dose_dimension"] == dimension
    assert row["canonical_amount"] == (None if value is None else pytest.approx(value))
    assert row["canonical_daily_amount"] == (None if value is None else pytest.approx(2 * value))


@pytest.mark.parametrize(("code", "n"), [("qd", 1.0), (" q12h ", 2.0), ("Q5H", 4.8), ("/WK", 1 / 7), ("QM", 12 / 365.25), ("PRN", None), ("BIW", None), ("", None)])
def test_frequency(spark, code, n):
    assert one(spark, C.per_day(F.lit(code))) == (None if n is None else pytest.approx(n))


@pytest.mark.parametrize(("raw", "name"), [("Metformin ER 500MG", "METFORMIN"), ("Metformin 500MG XR", "METFORMIN"), ("Metformin Hydrochloride 500 MG Oral Tablet", "METFORMIN"), ("Aspirin (CAPSULE)", "ASPIRIN"), (None, "")])
def test_name(spark, raw, name):
    assert one(spark, C.drug_name(F.lit(raw).cast("string"))) == name


def test_hash_bin(spark):
    assert one(spark, C.hash_bin(F.lit("LUNG CANCER"), 32)) == 13


def test_ror_policies(spark):
    cells = [F.lit(float(x)) for x in (1, 0, 1, 2)]
    assert one(spark, C.ror(*cells, "zero")) == pytest.approx((1.5 * 2.5) / (0.5 * 1.5))
    cells = [F.lit(float(x)) for x in (2, 1, 1, 2)]
    assert one(spark, C.ror(*cells, "zero")) == 4.0 and one(spark, C.ror(*cells, "always")) == pytest.approx((2.5 * 2.5) / (1.5 * 1.5))


def test_frozen_dose_reference(spark):
    rows = [(f"p{i}", "train", "A", str(a), u, None, "") for i, (a, u) in enumerate([(1000, "µG"), (2, "M.G."), (3, "MG"), (4, "MG"), (5, "MG")])]
    rows += [("v", "validation", "A", "1000", "MG", None, ""), ("c", "train", "COMBO", "7", "MG", None, "")]
    edges = spark.createDataFrame(rows, "primaryid string, split string, faers_raw string, dose_amt string, dose_unit string, dose_freq string, route string")
    mapping = DO.single_ingredient(spark.createDataFrame([("A", 1), ("COMBO", 1), ("COMBO", 2)], "faers_raw string, dc_id long"))
    out = {r["primaryid"]: r for r in DO.relative(DO.eligible(DO.canonical(edges), mapping)).collect()}
    assert out["c"]["dc_id"] is None and out["c"]["positive_ids"] == 2 and out["c"]["relative_log_amount"] is None
    assert out["v"]["above_train_p90"] == 1
    f = {r["primaryid"]: r for r in DO.patient_features(DO.relative(DO.eligible(DO.canonical(edges), mapping))).collect()}
    assert f["v"]["dose_normalized_above_train_p90_count"] == 1 and f["v"]["dose_normalized_relative_available_fraction"] == 1.0


def test_cascade(spark):
    known = NA.aliases(spark.createDataFrame([(1, "Aspirin"), (2, "Warfarin")], "id long, name string"), spark.createDataFrame([(1, "ASA"), (2, "Coumadin"), (1, "Twin"), (2, "Twin")], "id long, name string"))
    rows = spark.createDataFrame([("x", "aspirin"), ("ASA 500MG", None), ("y", "aspirin/warfarin"), ("twin", None), ("z", "aspirin"), ("z", "warfarin"), ("aspirin+nothing", None)], "faers_raw string, prod_ai string")
    got = {r["faers_raw"]: (r["ids"], r["conflict"]) for r in NA.exact_cascade(rows, known).collect()}
    assert got == {"x": ([1], 0), "ASA 500MG": ([1], 0), "y": ([1, 2], 0), "twin": (None, 0), "z": (None, 1), "aspirin+nothing": (None, 0)}


def test_fuzzy(spark):
    known = spark.createDataFrame([("METFORMIN",), ("ASPIRIN",)], "alias string")
    got = NA.fuzzy(spark.createDataFrame([("METFORMINE",), ("ZZZ",)], "name string"), known, 90, 3).collect()
    assert [(r["name"], r["alias"]) for r in got] == [("METFORMINE", "METFORMIN")]
    assert FZ.weighted_ratio("A B", "B A") == 95.0 and FZ.indel_ratio("abc", "abc") == 100.0
