"""Tiles of a layout, their index and shards against numpy; shards of a changed table; names and ages that were read wrongly."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlark.functions import columns as C
from medlark.operators import graph as GR
from medlark.plans import builders as B
from medlark.sources import arrays as AR

DEPTH = 3


def test_each_tiles_edges_are_found_by_the_index_alone(spark, tmp_path):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=300), rng.normal(size=300) ** 2
    links = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 300, 900), rng.integers(0, 20, 900), strict=True)})
    points = GR.tiled(spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "patient_index long, x double, y double"), DEPTH)
    points = GR.checkpointed(GR.dense_index(points, [F.asc("tile"), F.asc("patient_index")], "place"))
    near = spark.createDataFrame(links, "patient_index long, node_index long").join(points.select("patient_index", F.col("place").alias("point"), "tile"), "patient_index")
    edges = GR.checkpointed(GR.dense_index(near, [F.asc("tile"), F.asc("point"), F.asc("node_index")], "at"))
    folder = str(tmp_path / "edges")
    AR.write_shards(edges, folder, "at", B.EDGE_FIELDS, 64)
    place = {r["patient_index"]: r["place"] for r in points.collect()}
    at_point = {v: k for k, v in place.items()}
    cell = lambda v, n: np.minimum(np.floor((v - v.min()) * n / (v.max() - v.min())), n - 1).astype(int)
    index = GR.tile_index(points, edges, DEPTH).collect()
    seen = {lv: 0 for lv in range(DEPTH + 1)}
    for r in index:
        n = 1 << r["level"]
        # the cell of this number, from its bits in turn
        cx, cy = (sum((r["tile"] >> (2 * k + s) & 1) << k for k in range(DEPTH)) for s in (0, 1))
        inside = {k for k in range(300) if cell(x, 8)[k] * n // 8 == cx and cell(y, 8)[k] * n // 8 == cy}
        assert r["points"] == len(inside) and {at_point[r["first_point"] + k] for k in range(r["points"])} == inside
        assert (r["min_x"], r["max_y"]) == (min(x[k] for k in inside), max(y[k] for k in inside))
        got = AR.read_range(folder, r["first_edge"], r["edges"]) if r["edges"] else []
        assert sorted((at_point[int(e["point"])], int(e["node_index"])) for e in got) == [e for e in links if e[0] in inside]
        seen[r["level"]] += r["points"]
    assert set(seen.values()) == {300} and sum(r["level"] == 0 for r in index) == 1
    assert GR.tiled(spark.createDataFrame([(1, 2.0, None), (2, 2.0, 5.0)], "id long, x double, y double"), 2).select("tile").distinct().count() == 1
    assert B.tile_depth(1) == 0 and B.tile_depth(4097) == 1 and B.tile_depth(8_000_000) == 6


def test_shards_follow_their_table(spark, tmp_path):
    folder, fields = str(tmp_path / "s"), [("i", "<i4"), ("v", "<f4")]
    table = lambda k, n: spark.range(n).select(F.col("id").alias("i"), (F.col("id") * k).alias("v"))
    AR.write_shards(table(1, 25), folder, "i", fields, 10)
    kept = os.stat(os.path.join(folder, "shard-000000.bin")).st_mtime_ns
    AR.write_shards(table(1, 25), folder, "i", fields, 10)
    assert os.stat(os.path.join(folder, "shard-000000.bin")).st_mtime_ns == kept
    AR.write_shards(table(3, 15), folder, "i", fields, 10)
    assert AR.read_range(folder, 3, 12)["v"].tolist() == [3.0 * k for k in range(3, 15)]
    assert sorted(n for n in os.listdir(folder) if n.endswith(".bin")) == ["shard-000000.bin", "shard-000001.bin"]
    with open(os.path.join(folder, "index.json")) as f:
        shards = json.load(f)["shards"]
    for s in shards:
        with open(os.path.join(folder, f"shard-{s['shard']:06d}.bin.done")) as f:
            assert f.read() == s["sha256"]


@pytest.mark.parametrize(("raw", "want"), [("\U0001d400spirin", "ASPIRIN"), ("Tylenol™", "TYLENOLTM"), ("Advil®", "ADVIL"), ("ﬁne １０", "FINE 10")])
def test_names_in_compatibility_forms(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(C.drug_name(F.col("n")).alias("x")).first()["x"] == want


def test_ages_in_all_units(spark):
    units = {"YEARS": 6.0, "year": 6.0, " mo ": 0.5, "MONTHS": 0.5, "WEEK": 6 / 52.142857, "DAYS": 6 / 365.25, "HOUR": 6 / 8766.0, "DECADES": 60.0, "X": None}
    rows = spark.createDataFrame([(u,) for u in units], "u string").select("u", C.age_years(F.lit("6"), F.col("u")).alias("a")).collect()
    assert {r["u"]: r["a"] for r in rows} == pytest.approx(units)
