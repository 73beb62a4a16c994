"""Serving, ablation and numeric exports."""

from __future__ import annotations

import numpy as np
import pytest

from medlark.operators import serving as SE
from medlark.sources import arrays as AR


def test_medications(spark):
    known = spark.createDataFrame([("METFORMIN", 1), ("METOPROLOL", 2), ("ASPIRIN", 3)], "alias string, dc_id long")
    typed = SE.parse_medications(spark.createDataFrame([("a", "Metformin 500 mg, metfromin\nzzz")], "id string, list string"), "list")
    got = {r["typed"]: r for r in SE.match_medications(typed, known).collect()}
    assert got["Metformin 500 mg"]["status"] == "matched" and got["Metformin 500 mg"]["candidates"][0]["dc_id"] == 1
    assert got["metfromin"]["status"] in ("matched", "ambiguous") and got["metfromin"]["candidates"][0]["alias"] == "METFORMIN"
    assert got["zzz"]["status"] == "unmatched"


def test_case_features(spark):
    cases = spark.createDataFrame([("c", 50), ("d", 20)], "report string, age int")
    named = spark.createDataFrame([("c", 1), ("c", 2)], "report string, dc_id long")
    lookup = spark.createDataFrame([(1, 3.0)], "dc_id long, ror double")
    codes = spark.createDataFrame([(1, "N02BA01"), (2, "C07AB02")], "dc_id long, atc_code string")
    got = {r["report"]: r for r in SE.case_features(cases, named, lookup, codes).collect()}
    assert (got["c"]["max_ror"], got["c"]["num_drugs"], got["c"]["count_n"], got["c"]["num_high_risk_atc"]) == (3.0, 2, 1, 2)
    assert (got["d"]["max_ror"], got["d"]["num_drugs"], got["d"]["count_n"]) == (1.0, 0, 0)


def test_ablation(spark):
    rows = spark.range(600).selectExpr("id as report", "case when id % 3 = 0 then 'validation' else 'train' end as split", "cast(id % 2 as int) as label", "cast(id % 7 as double) as noise", "cast(id % 2 as double) + (id % 5) / 10.0 as signal")
    got = SE.ablation(spark, rows, ["noise"], ["signal"], "logistic", 20, rounds=10)
    assert got["auc_with"] > 0.99 > got["auc_without"] and got["difference"]["low"] > 0.2


def test_matrix(spark, tmp_path):
    df = spark.range(50).selectExpr("49 - id as i", "cast(id as double) as a", "cast(id * 2 as double) as b")
    assert AR.save_matrix(df, "i", ["a", "b"], str(tmp_path / "m.npy")) == (50, 2)
    back = {r["index"]: (r["a"], r["b"]) for r in AR.load_matrix(spark, str(tmp_path), "m.npy", ["a", "b"]).collect()}
    assert back == {49 - i: (float(i), 2.0 * i) for i in range(50)}
    for name, columns in (("m.npy", ["a"]), ("../m.npy", ["a", "b"])):
        with pytest.raises((AR.ArrayError, FileNotFoundError)):
            AR.load_matrix(spark, str(tmp_path), name, columns)
    with pytest.raises(AR.ArrayError):
        AR.save_matrix(df.selectExpr("i + 1 as i", "a"), "i", ["a"], str(tmp_path / "x.npy"))


def test_shards(spark, tmp_path):
    df = spark.range(25).selectExpr("id as i", "cast(id as float) / 2 as x", "cast(id % 3 as int) as label")
    made = AR.write_shards(df, str(tmp_path / "s"), "i", [("x", "<f4"), ("label", "u1")], 10)
    assert [m["rows"] for m in made] == [10, 10, 5]
    data = (tmp_path / "s" / "shard-000002.bin").read_bytes()
    assert np.frombuffer(data[:20], "<f4").tolist() == [10, 10.5, 11, 11.5, 12] and list(data[20:]) == [2, 0, 1, 2, 0]
    assert AR.write_shards(df, str(tmp_path / "s"), "i", [("x", "<f4"), ("label", "u1")], 10) == made
    assert AR.shard_estimate(100, [("x", "<f4")], 40) == {"per_shard": 10, "shards": 10, "bytes": 400}


def test_platt(spark):
    from medlark.operators import models as MO

    rows = spark.range(400).selectExpr("id", "case when id % 2 = 0 then 'validation' else 'test' end as split", "cast(id % 400 > 300 as int) as label", "0.2 + 0.6 * id / 400.0 as score")
    got = MO.calibrated(rows).toPandas()
    assert list(got.columns) == ["id", "split", "label", "score", "calibrated"] and got["calibrated"].between(0, 1).all()
    order = got.sort_values("score")["calibrated"].to_numpy()
    assert (np.diff(order) >= -1e-12).all() and ((got["calibrated"] - got["label"]) ** 2).mean() < ((got["score"] - got["label"]) ** 2).mean()


def test_bootstrap_against_numpy(spark):
    from medlark.operators import evaluate as EV

    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.4).astype(int)
    a, b = y * 0.5 + rng.random(400), y * 0.9 + rng.random(400)
    rows = spark.createDataFrame([(int(i), int(l), float(p), float(q)) for i, (l, p, q) in enumerate(zip(y, a, b, strict=True))], "id int, label int, score_a double, score_b double")
    got = EV.bootstrap_difference(rows, 120, 3, "id").iloc[0]

    def auc(s, at):
        pos, neg = s[at][y[at] == 1], s[at][y[at] == 0]
        return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()

    draws = [rng.integers(0, 400, 400) for _ in range(400)]
    deltas = np.array([auc(b, d) - auc(a, d) for d in draws])
    assert abs(got["mean"] - deltas.mean()) < 0.01 and abs(got["low"] - np.quantile(deltas, 0.025)) < 0.02 and abs(got["high"] - np.quantile(deltas, 0.975)) < 0.02 and got["p_above_0"] == 1.0
