"""Command line: python -m medlark.cli <builder> --data-dir ... ."""

from __future__ import annotations

import argparse
import dataclasses
import json

from .operators.features import TRACKS
from .sources import fetch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="medlark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args):
        s = sub.add_parser(name)
        s.add_argument("--data-dir", required=True)
        for flag, options in args:
            s.add_argument(flag, **options)

    preset = ("--split-preset", {"default": "gnn-small", "choices": ["gnn-small", "gnn-full"]})
    rescue = [("--training-end-year", {"type": int, "default": 2023}), ("--top-pairs", {"type": int, "default": 50}), ("--minimum-pair-reports", {"type": int, "default": 25})]
    add("build-reports", ("--quarters", {"nargs": "+", "required": True}), ("--tables", {"nargs": "+"}))
    add("build-reference", ("--dump", {"required": True}), ("--tables", {"nargs": "+"}))
    add("build-labels", ("--archives", {"nargs": "+", "required": True, "help": "table=path"}))
    add("build-cohort", preset)
    add("build-drug-dictionary", ("--dump", {}), ("--fuzzy-trigger-rate", {"type": float, "default": 0.5}), ("--fuzzy-score-cutoff", {"type": float, "default": 97}), ("--fuzzy-margin", {"type": float, "default": 3}))
    graph = ("--rebuild-graph", {"action": argparse.BooleanOptionalAction, "default": True})
    model = [("--kind", {"default": "boosted", "choices": ["boosted", "forest", "logistic", "svm", "adaboost", "network", "graph"]})]
    add("build-rxnorm-lookup", ("--dump", {"required": True}), ("--responses", {}))
    add("add-tabular-features", graph)
    add("feature-rescue", *rescue, graph)
    add("build-graph", ("--top-unknown", {"type": int, "default": 500}), ("--cohort", {"default": "cohort"}), ("--baseline-rounds", {"type": int, "default": 300}), ("--leaves", {"type": int, "default": 31}), ("--arrays", {"action": "store_true"}))
    add("build-graph-features", ("--n-iterations", {"type": int, "default": 3}), ("--alpha", {"type": float, "default": 0.7}))
    add("build-prospective", preset, ("--dump", {}), *rescue)
    add("train-model", *model, ("--feature-track", {"default": "prospective", "choices": list(TRACKS)}), ("--evaluate-test", {"action": "store_true"}), ("--resume", {"action": "store_true"}))
    add("evaluate-dosage-ablation", *model, ("--seed", {"type": int, "default": 42}), ("--bootstrap-samples", {"type": int, "default": 500}))
    add("visualize-graph", ("--split", {"default": "validation"}), ("--patients", {"type": int, "default": 100}), ("--top-drugs", {"type": int, "default": 50}))
    add("export-training-table", ("--feature-track", {"default": "prospective", "choices": list(TRACKS)}))
    for name in ("export-full-visualization", "estimate-full-visualization"):
        add(name, ("--target-shard-bytes", {"type": int, "default": 32 << 20}))
    fetched = sub.add_parser("fetch")
    for flag, options in (("--name", {"required": True}), ("--url", {"required": True}), ("--path", {"required": True}), ("--sha256", {}), ("--unpack-to", {})):
        fetched.add_argument(flag, **options)
    return p


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .plans import builders as B

    args = {k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None}
    command = args.pop("command")
    if command == "fetch":
        folder = args.pop("unpack_to", None)
        done = fetch.fetch(**args)
        print(json.dumps(dataclasses.asdict(done) | ({"members": fetch.unpack(done.path, folder)} if folder else {}), indent=2))
        return
    spark = SparkSession.builder.appName(f"medlark {command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if "archives" in args:
        args["archives"] = dict(a.split("=", 1) for a in args["archives"])
    run = {
        "build-reports": B.build_reports, "build-reference": B.build_reference, "build-labels": B.build_labels, "build-cohort": B.build_cohort,
        "build-drug-dictionary": B.build_drug_dictionary, "add-tabular-features": B.add_tabular_features, "feature-rescue": B.build_feature_rescue,
        "build-graph": B.build_graph, "build-graph-features": B.build_graph_features, "build-prospective": B.build_prospective_pipeline,
        "build-rxnorm-lookup": B.build_rxnorm_lookup, "train-model": B.train_model, "evaluate-dosage-ablation": B.evaluate_dosage_ablation,
        "visualize-graph": B.visualize_graph, "export-training-table": B.export_training_table,
        "export-full-visualization": B.export_full_visualization, "estimate-full-visualization": B.estimate_full_visualization,
    }
    out = run[command](spark=spark, **args)
    print(json.dumps(out, default=lambda x: dataclasses.asdict(x) if dataclasses.is_dataclass(x) else str(x), indent=2))


if __name__ == "__main__":
    main()
