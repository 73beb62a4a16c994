"""Ingestion fixtures and the builders end to end on a small folder."""

from __future__ import annotations

import gzip
import hashlib
import os
import zipfile

import numpy as np
import pytest

from medlark import cli
from medlark.operators import models as MO
from medlark.operators import quality as QA
from medlark.plans import builders as B
from medlark.sources import copydump, delimited, manifest, zipped
from medlark.streaming import upsert


def test_report_table(spark, tmp_path):
    path = tmp_path / "demo.txt"
    path.write_text('primaryid$CASEID$age\n1$10$\n2$20$"5\n')
    rows = delimited.report_table(spark, str(path), "2024Q1").collect()
    assert [tuple(r) for r in rows] == [("1", "10", None, "2024Q1"), ("2", "20", '"5', "2024Q1")]
    path.write_bytes("a$b\nMüller$x\n".encode("latin-1"))
    assert not delimited.is_utf8(spark, str(path)) and delimited.report_table(spark, str(path), "q").first()["a"] == "Müller"
    path.write_text("a$a\n1$2\n")
    with pytest.raises(delimited.SourceError):
        delimited.report_table(spark, str(path), "q")


def test_deleted_cases(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿10417202\n999 $ 820242\nnot a number\n")
    (tmp_path / "b.txt").write_text("10417202\n")
    got = delimited.deleted_cases(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], "q")
    assert sorted(r["caseid"] for r in got.collect()) == ["10417202", "10417202", "820242", "999"]
    assert delimited.deleted_cases(spark, [], "q").count() == 0


def test_copy_dump(spark, tmp_path):
    path = str(tmp_path / "dump.sql.gz")
    with gzip.open(path, "wt") as f:
        f.write("SET x;\nCOPY public.structures (id, name, note) FROM stdin;\n1\tA\\tB\t\\N\n2\tC\\\\D\\x41\\101\tz\n\\.\nCOPY public.other (id) FROM stdin;\n9\n\\.\n")
    rows = copydump.copy_table(spark, path, "structures").collect()
    assert [tuple(r) for r in rows] == [("1", "A\tB", None), ("2", "C\\DAA", "z")]
    assert copydump.copy_table(spark, path, "structures", ["name"]).columns == ["name"]
    both = copydump.copy_tables(spark, path, {"structures": ["note", "id"], "other": None})
    assert sorted(map(tuple, both["structures"].collect()), key=repr) == [("z", "2"), (None, "1")] and [tuple(r) for r in both["other"].collect()] == [("9",)]
    with pytest.raises(Exception, match="no COPY block"):
        copydump.copy_table(spark, path, "missing").count()
    with pytest.raises(copydump.SourceError):
        copydump.copy_tables(spark, path, {"structures": ["nowhere"]})


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_plain_dump_by_byte_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(copydump, "RANGE", size if size > 1 else 13)
    path = str(tmp_path / "dump.sql")
    body = [(str(k), f"n{k}é" if k % 3 else None, "COPY public.other (id) FROM stdin;" if k == 5 else "x" * (k % 9)) for k in range(40)]
    text = "SET x;\nCOPY public.structures (id, name, note) FROM stdin;\n" + "".join("\t".join(r"\N" if v is None else v for v in r) + "\n" for r in body) + "\\.\n"
    # a row that looks like the begin of a block, and an empty block
    text += "COPY public.empty (id) FROM stdin;\n\\.\nCOPY odd (line) FROM stdin;\nCOPY public.structures (id) FROM stdin;\n\\.\nCOPY public.\"other\" (id, \"Two\") FROM stdin;\n9\ta\\tb\n\\.\nSELECT 1;"
    with open(path, "w") as f:
        f.write(text)
    assert sorted(map(tuple, copydump.copy_table(spark, f"file://{path}", "structures").collect()), key=lambda r: int(r[0])) == body
    made = copydump.copy_tables(spark, path, {"structures": ["note", "id"], "other": None, "empty": None, "odd": None})
    assert made["structures"].columns == ["note", "id"] and made["structures"].count() == 40 and made["empty"].count() == 0
    assert [tuple(r) for r in made["other"].collect()] == [("9", "a\tb")] and made["other"].columns == ["id", "two"]
    assert [r["line"] for r in made["odd"].collect()] == ["COPY public.structures (id) FROM stdin;"]
    for wanted in ({"missing": None}, {"other": ["three"]}):
        with pytest.raises(copydump.SourceError):
            copydump.copy_tables(spark, path, wanted)
    with open(path, "a") as f:
        f.write("\nCOPY late (id) FROM stdin;\n1\n")
    with pytest.raises(copydump.SourceError, match="doesn't end"):
        copydump.copy_table(spark, path, "other")


def test_zip_table(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("readme.txt", "nothing here")
        z.writestr("map.txt", 'SETID|SPL VERSION|RXCUI|RXSTRING|RXTTY\n1|2|3|"a|b"|\n\n')
    assert [tuple(r)[:5] for r in zipped.zip_table(spark, str(tmp_path / "x.zip"), "rxnorm").collect()] == [("1", "2", "3", "a|b", None)]


def test_manifest(spark, tmp_path):
    m = manifest.Manifest("1", {"a": "x"}, {"k": 1}, 5)
    manifest.save(spark, str(tmp_path / "m.json"), m)
    (tmp_path / "in").mkdir()
    for n in ("b", "a"):
        (tmp_path / "in" / f"{n}.txt").write_text(n * 3_000_000)
    folder = str(tmp_path / "in")
    one, list_one = manifest.sha256(spark, folder), manifest.listing(spark, folder)
    assert [f[1] for f in manifest.files(spark, folder)] == [3_000_000] * 2 and list_one == manifest.listing(spark, folder)
    assert manifest.sha256(spark, f"{folder}/a.txt") == hashlib.sha256(b"a" * 3_000_000).hexdigest()
    (tmp_path / "in" / "a.txt").write_text("a" * 2_999_999 + "c")
    assert manifest.sha256(spark, folder) != one
    with pytest.raises(FileNotFoundError):
        manifest.listing(spark, str(tmp_path / "nowhere"))
    assert manifest.load(spark, str(tmp_path / "m.json")) == m and manifest.load(spark, str(tmp_path / "none.json")) is None and m.same_build(manifest.Manifest("1", {"a": "x"}, {"k": 1})) and not m.same_build(manifest.Manifest("2", {}, {}))


def test_quality(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "validation")], "k int, split string")
    assert QA.require_splits(df) == {"train": 1, "test": 1, "validation": 1}
    for call in (lambda: QA.require_unique(df, ["k"]), lambda: QA.require_columns(df, ["z"]), lambda: QA.require_no_targets(["is_death"]), lambda: QA.require_same_rows(df, df.limit(1), "k"), lambda: QA.require_no_orphans(df, df.where("k = 1"), "k"), lambda: QA.require_splits(df.where("k = 1")), lambda: QA.require_finite(df, ["k"], ["k"])):
        with pytest.raises(QA.AuditError):
            call()


def _write(folder, quarter, table, text):
    d = os.path.join(folder, "raw", quarter)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{table}{quarter}.txt"), "w") as f:
        f.write(text)


def test_builders_end_to_end(spark, tmp_path):
    folder = str(tmp_path)
    quarters = ["2023Q1", "2023Q4", "2024Q1", "2024Q2"]
    n = 0
    for q in quarters:
        demo, drug, reac, outc, indi = ["primaryid$caseid$caseversion$event_dt$fda_dt$rept_dt$age$age_cod$sex$wt$wt_cod"], ["primaryid$caseid$drug_seq$role_cod$drugname$prod_ai$route$dose_amt$dose_unit$dose_form$dose_freq"], ["primaryid$caseid$pt$drug_rec_act"], ["primaryid$caseid$outc_cod"], ["primaryid$indi_pt"]
        for i in range(40):
            n += 1
            demo.append(f"{n}${n}$1$$2023{1 + i % 9:02d}{1 + i % 27:02d}$${20 + i % 60}$YR${'MF'[i % 2]}$70$KG")
            for j, d in enumerate(("Aspirin 100 MG", "warfarin", "Mystery")[: 1 + i % 3]):
                drug.append(f"{n}${n}${j}$PS${d}$$Oral${50 + i}$MG$TABLET$QD")
            reac.append(f"{n}${n}$NAUSEA$")
            if i % 3:
                outc.append(f"{n}${n}${'HO' if i % 2 else 'DE'}")
            indi.append(f"{n}$LUNG CANCER")
        for t, rows in (("DEMO", demo), ("DRUG", drug), ("REAC", reac), ("OUTC", outc), ("INDI", indi)):
            _write(folder, q, t.lower(), "\n".join(rows) + "\n")
    B.build_reports(spark=spark, data_dir=folder, quarters=quarters)
    dump = os.path.join(folder, "dump.sql")
    with open(dump, "w") as f:
        for t, columns, rows in (("structures", "id, name", ["1\tAspirin", "2\tWarfarin"]), ("synonyms", "id, name", ["1\tASA"]), ("struct2atc", "struct_id, atc_code", ["1\tB01AC06", "1\tN02BA01", "2\tB01AA03"]), ("atc", "id", ["1"]), ("drug_class", "id", ["1"]), ("section", "id, label_id, code, title", ["1\tL\t34066-1\tX"]), ("prd2label", "ndc_product_code, label_id", ["N\tL"]), ("active_ingredient", "ndc_product_code, struct_id", ["N\t1"])):
            f.write(f"COPY public.{t} ({columns}) FROM stdin;\n" + "".join(r + "\n" for r in rows) + "\\.\n")
    with open(dump, "a") as f:
        f.write("COPY public.id_type (id, type) FROM stdin;\n1\tRXNORM\n2\tUNII\n\\.\nCOPY public.identifier (identifier, id_type, struct_id) FROM stdin;\n77\tRXNORM\t2\n78\tUNII\t1\n\\.\n")
    B.build_reference(spark=spark, data_dir=folder, dump=dump)
    with zipfile.ZipFile(os.path.join(folder, "labels.zip"), "w") as z:
        z.writestr("map.txt", "SETID|SPL_VERSION|RXCUI|RXSTRING|RXTTY\n1|2|77|Coumadin Sodium 5 MG Oral Tablet|SCD\n1|2|99|Other|SCD\n")
    B.build_labels(spark=spark, data_dir=folder, archives={"rxnorm": os.path.join(folder, "labels.zip")})
    answers = os.path.join(folder, "answers.jsonl")
    with open(answers, "w") as f:
        f.write('{"query_name": "Bayer tabs", "candidates": [{"name": "Aspirin", "rxcui": "5", "rank": 1}, {"name": "Warfarin", "rxcui": "6", "rank": 2}]}\n{"query_name": "Both", "candidates": [{"name": "Aspirin", "rxcui": "5", "rank": 1}, {"name": "Warfarin", "rxcui": "6", "rank": 1}]}\n')
    lookup = B.build_rxnorm_lookup(spark=spark, data_dir=folder, dump=dump, responses=answers)
    found = {(r["rxnorm_name"], r["struct_id"], r["source"], r["query_name"]) for r in spark.read.parquet(lookup.output).collect()}
    assert found == {("Coumadin Sodium 5 MG Oral Tablet", 2, "drugcentral_identifier", None), ("Aspirin", 1, "rxnorm_api", "Bayer tabs")} and lookup.counts == {"local": 1}
    out = B.build_prospective_pipeline(spark=spark, data_dir=folder, dump=dump, minimum_pair_reports=5)
    assert out[0]["cohort"].rows == 160 and out[2].rows == out[3].rows == 160 and out[4]["drug_nodes"].rows == 3 and out[5].rows == 160
    words = {r["faers_raw"]: r for r in spark.read.parquet(out[1].output).collect()}
    assert words["Aspirin 100 MG"]["dc_id"] == 1 and words["Aspirin 100 MG"]["atc_code"] == "B01AC06|N02BA01" and words["Aspirin 100 MG"]["has_boxed_warning"] == 1 and words["Mystery"]["dc_id"] == 0
    again = B.build_cohort(spark=spark, data_dir=folder)
    assert again["cohort"].cached and again["cohort"].rows == 160 and again["cohort"].counts == out[0]["cohort"].counts
    graph = {n: spark.read.parquet(out[4][n].output) for n in ("patients", "drug_nodes", "graph_edges", "descriptor")}
    parts = sorted(name for name, _, _ in manifest.files(spark, out[4]["graph_edges"].output))
    edges = [tuple(r) for p in parts for r in spark.read.parquet(p).select("split_id", "patient_index", "node_index").collect()]
    assert edges == sorted(edges) and [tuple(r)[0] for r in graph["descriptor"].orderBy("split_id").collect()] == [0, 1, 2]
    assert sum(r["edges"] for r in graph["descriptor"].collect()) == len(edges)
    assert {r["display_name"] for r in graph["drug_nodes"].collect()} == {"Aspirin", "Warfarin", "Mystery"}
    assert all(len(r["features"]) == 28 for r in graph["drug_nodes"].collect())
    assert QA.require_codec(spark, out[0]["cohort"].output) > 0
    QA.require_integer_ids(graph["graph_edges"], ["patient_index", "node_index"])
    model = B.train_model(spark=spark, data_dir=folder, kind="logistic", rounds=5)
    assert model.rows == 40 and 0 <= model.counts["auc"]["validation"] <= 1 and B.train_model(spark=spark, data_dir=folder, kind="logistic", rounds=5).cached
    network = B.train_model(spark=spark, data_dir=folder, kind="graph", epochs=1, batch=128, hidden=4)
    assert network.rows == 40 and 0 <= network.counts["auc"]["validation"] <= 1
    ablation = B.evaluate_dosage_ablation(spark=spark, data_dir=folder, kind="logistic", bootstrap_samples=10, rounds=5)
    assert ablation.rows == 1 and ablation.counts["dose_features"] and spark.read.parquet(ablation.output).first()["auc_with"] is not None
    viewer = B.visualize_graph(spark=spark, data_dir=folder, patients=10, top_drugs=2)
    assert viewer["drugs"].rows == 2 and viewer["patients"].rows == 10 and viewer["layout"].rows == 12
    training = B.export_training_table(spark=spark, data_dir=folder)
    assert training.rows == 160 and len(spark.read.parquet(training.output).first()["features"]) == len(training.counts["features"])
    full = B.export_full_visualization(spark=spark, data_dir=folder, target_shard_bytes=560)
    assert [x["rows"] for x in full["points"]] == [40] * 4 and sum(x["rows"] for x in full["edges"]) == len(edges) and full["clusters"].rows <= 64 and full["cluster_drugs"].rows > 0
    assert B.estimate_full_visualization(spark=spark, data_dir=folder, target_shard_bytes=560)["points"] == {"per_shard": 40, "shards": 4, "bytes": 160 * 14}
    wide = spark.read.parquet(out[3].output)
    rows = wide.withColumnRenamed("is_serious", "label")
    features = ["age_imputed", "num_drugs", "max_ror", "num_high_risk_atc", "dose_normalized_numeric_fraction"]
    for kind in ("forest", "logistic", "svm", "boosted"):
        scored = MO.scored(MO.fit(rows, features, kind, rounds=3, trees=5, depth=3), rows)
        assert scored.where("score < 0 or score > 1 or score is null").count() == 0
    # one input changes: what is made of it is made anew, what isn't stays
    drug = os.path.join(folder, "raw", "2024Q1", "drug2024Q1.txt")
    with open(drug) as f:
        text = f.read()
    with open(drug, "w") as f:
        f.write(text.replace("Mystery", "Enigma"))
    made = {b.output.rsplit("/", 1)[1]: b for b in B.build_reports(spark=spark, data_dir=folder, quarters=quarters)}
    assert [n for n, b in made.items() if not b.cached] == ["drug_2024Q1.parquet"]
    later = B.build_prospective_pipeline(spark=spark, data_dir=folder, dump=dump, minimum_pair_reports=5)
    assert not later[0]["report_drug"].cached and not later[1].cached and not later[4]["graph_edges"].cached and not later[5].cached
    assert {"Enigma", "Mystery"} <= {r["faers_raw"] for r in spark.read.parquet(later[1].output).collect()} and later[4]["drug_nodes"].rows == 4
    assert {r["node_label"] for r in spark.read.parquet(later[4]["drug_nodes"].output).collect()} >= {"Mystery"}
    assert all(b.cached for b in B.build_reference(spark=spark, data_dir=folder, dump=dump))
    os.utime(dump)  # the same bytes at another time
    assert all(b.cached for b in B.build_reference(spark=spark, data_dir=folder, dump=dump))
    with pytest.raises(FileNotFoundError):
        B.build_prospective_pipeline(spark=spark, data_dir=os.path.join(folder, "nowhere"))
    more = B.build_graph(spark=spark, data_dir=folder, cohort="cohort_enriched", baseline_rounds=1, leaves=3, arrays=True)
    assert more["baseline"].rows == 40 and {"auc", "round"} <= set(more["baseline"].counts) and spark.read.parquet(more["baseline_importances"].output).count() > 3
    assert np.load(os.path.join(folder, "graph", "patients.npy"), mmap_mode="r").shape[0] == 160


def test_cli_parses():
    a = cli.parser().parse_args(["feature-rescue", "--data-dir", "x"])
    assert (a.training_end_year, a.top_pairs, a.minimum_pair_reports) == (2023, 50, 25)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:50:00", "b"), (2, "2024-01-01 03:00:00", "c")], "k int, t string, v string").selectExpr("k", "cast(t as timestamp) as ts", "v")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    latest = upsert.run_once(upsert.latest_by_key(stream, "k", ["ts"], ["v"]), "latest", "complete", str(tmp_path / "c1"))
    assert {(r["k"], r["v"]) for r in latest.collect()} == {(1, "b"), (2, "c")}
    counts = upsert.run_once(upsert.windowed_counts(stream, "ts"), "counts", "complete", str(tmp_path / "c2"))
    assert sorted(r["n"] for r in counts.collect()) == [1, 2]
