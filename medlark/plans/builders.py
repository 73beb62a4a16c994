"""Keyword-only builders: staged tables in, Parquet and a manifest out. An equal build is used again; nothing is computed for it.

A build is equal if its version, its parameters and every input are: source files by SHA-256 (which is only computed if
their listing has changed), staged tables by their listing. Outputs come into place whole."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.fixed_values import SPLITS
from ..operators import cohort as CO
from ..operators import dose as DO
from ..operators import features as FE
from ..operators import graph as GR
from ..operators import names as NA
from ..operators import quality as QA
from ..operators import risk as RI
from ..sources import arrays, copydump, delimited, manifest, zipped

VERSION = "2"
REPORT_TABLES = ("demo", "drug", "indi", "reac", "outc", "delete")
REFERENCE_TABLES = ("structures", "synonyms", "atc", "struct2atc", "drug_class")


@dataclass(frozen=True)
class Build:
    """What a builder did."""

    output: str
    rows: int
    cached: bool
    counts: dict


def _publish(spark: SparkSession, make: Callable, output: str, parameters: dict, sources: dict[str, str] | None = None, tables: dict[str, str] | None = None) -> Build:
    """make() gives the rows, or (rows, counts); it is called only if no equal build is there."""
    listings = {k: manifest.listing(spark, p) for k, p in {**(sources or {}), **(tables or {})}.items()}
    side = f"{output}.manifest.json"
    wanted = manifest.Manifest(VERSION, listings, parameters)
    had = manifest.reusable(spark, side, wanted, output)
    digests = None
    if had is None and sources:
        # the same bytes under other times are the same input
        digests = {k: manifest.sha256(spark, p) for k, p in sources.items()}
        old = manifest.load(spark, side)
        if old is not None and old.provenance.get("sha256") == digests and all(old.inputs.get(k) == listings[k] for k in tables or {}):
            had = manifest.reusable(spark, side, manifest.Manifest(VERSION, old.inputs, parameters), output)
    if had is not None:
        return Build(output, had.rows, True, had.provenance.get("counts", {}))
    made = make()
    df, counts = made if isinstance(made, tuple) else (made, {})
    delimited.write_staged(df, output)
    rows = spark.read.parquet(output).count()
    manifest.save(spark, side, manifest.Manifest(VERSION, listings, parameters, rows, {"counts": counts, "sha256": digests or {}, "sources": sources or {}}))
    return Build(output, rows, False, counts)


def build_reports(*, spark: SparkSession, data_dir: str, quarters: list[str], tables: tuple = REPORT_TABLES) -> list[Build]:
    """raw/<quarter>/**/*<table>*.txt to interim/<table>_<quarter>.parquet, all strings."""
    out = []
    for q in quarters:
        there = [name for name, _, _ in manifest.files(spark, os.path.join(data_dir, "raw", q))]
        for t in tables:
            paths = sorted(p for p in there if fnmatch.fnmatch(p.rsplit("/", 1)[1].lower(), f"*{t}*.txt"))
            if t != "delete" and not paths:
                raise delimited.SourceError(f"{q} has no file of {t}")
            make = (lambda paths=paths, q=q: delimited.deleted_cases(spark, paths, q)) if t == "delete" else (lambda paths=paths, q=q: delimited.report_table(spark, paths[0], q))
            out.append(_publish(spark, make, os.path.join(data_dir, "interim", f"{t}_{q}.parquet"), {"table": t, "quarter": q}, {p: p for p in paths}))
    return out


def build_reference(*, spark: SparkSession, data_dir: str, dump: str, tables: tuple = REFERENCE_TABLES) -> list[Build]:
    """The dump is read once for all tables that aren't there yet."""
    made: dict[str, DataFrame] = {}

    def make(table: str) -> DataFrame:
        if not made:
            made.update(copydump.copy_tables(spark, dump, dict.fromkeys(tables)))
        return made[table]

    return [_publish(spark, lambda t=t: make(t), os.path.join(data_dir, "reference", f"{t}.parquet"), {"table": t}, {"dump": dump}) for t in tables]


def build_labels(*, spark: SparkSession, data_dir: str, archives: dict[str, str]) -> list[Build]:
    return [_publish(spark, lambda t=t, path=path: zipped.zip_table(spark, path, t), os.path.join(data_dir, "labels", f"{t}.parquet"), {"table": t}, {t: path}) for t, path in archives.items()]


def _interim(spark, data_dir: str, *tables: str) -> dict[str, str]:
    """The staged shards of some tables, by name."""
    return {p.rsplit("/", 1)[1]: p for t in tables for p in manifest.matching(spark, os.path.join(data_dir, "interim", f"{t}_*.parquet"))}


def _staged(spark, data_dir: str, table: str, **options) -> DataFrame:
    return delimited.staged(spark, list(_interim(spark, data_dir, table).values()), **options)


def _under(data_dir: str, folder: str, *names: str) -> dict[str, str]:
    return {n: os.path.join(data_dir, folder, f"{n}.parquet") for n in names}


def build_cohort(*, spark: SparkSession, data_dir: str, split_preset: str = "gnn-small") -> dict[str, Build]:
    if split_preset not in SPLITS:
        raise ValueError(f"no such split: {split_preset}")
    parts = ("demo", "drug", "reac", "outc", "delete")
    made = CO.build_cohort(*[_staged(spark, data_dir, t) for t in parts], split_preset)
    inputs = _interim(spark, data_dir, *parts)
    put = lambda make, name: _publish(spark, make, os.path.join(data_dir, "processed", f"{name}.parquet"), {"split_preset": split_preset, "part": name}, tables=inputs)
    out = {"cohort": put(lambda: (made.cohort.orderBy(F.asc_nulls_last("report_date"), "caseid"), made.audit()), "cohort")}
    for name in ("report_drug", "report_reaction", "report_outcome", "case_splits"):
        out[name] = put(lambda name=name: getattr(made, name), name)
    cohort, splits = (spark.read.parquet(out[n].output) for n in ("cohort", "case_splits"))
    QA.require_same_cases(cohort, splits)
    return out


def build_rxnorm_lookup(*, spark: SparkSession, data_dir: str, dump: str, responses: str | None = None) -> Build:
    """(rxnorm_name, struct_id, rxcui, source, query_name): names of the dump's RxNorm identifiers, through the label mapping,
    and answers of the name service kept as JSON lines (query_name, candidates), if there are any. Nothing is fetched here."""
    labels = os.path.join(data_dir, "labels", "rxnorm.parquet")
    reference = _under(data_dir, "reference", "structures", "synonyms")
    if missing := QA.missing_prerequisites({"labels": labels, **reference}, spark):
        raise FileNotFoundError("; ".join(missing))

    def make():
        read = lambda n: spark.read.parquet(reference[n])
        local = NA.rxnorm_local(copydump.rxnorm_names(spark, dump), spark.read.parquet(labels))
        rows = local
        if responses:
            kept = spark.read.schema("query_name string, candidates array<struct<name: string, rxcui: string, rank: int>>").option("mode", "FAILFAST").json(responses)
            rows = rows.unionByName(NA.rxnorm_answers(kept, NA.aliases(read("structures"), read("synonyms").select("id", "name"))))
        rows = rows.where(C.drug_name(F.col("rxnorm_name")) != "").distinct()
        return rows.orderBy(F.coalesce("query_name", F.lit("")), "rxnorm_name", "struct_id"), {"local": local.count()}

    return _publish(spark, make, os.path.join(data_dir, "reference", "rxnorm_lookup.parquet"), {"responses": bool(responses)}, {"dump": dump, **({"responses": responses} if responses else {})}, {"labels": labels, **reference})


def build_drug_dictionary(*, spark: SparkSession, data_dir: str, dump: str | None = None, fuzzy_trigger_rate: float = 0.5, fuzzy_score_cutoff: float = 97, fuzzy_margin: float = 3) -> Build:
    """(faers_raw, dc_id, atc_code, ror, has_boxed_warning): a row an ingredient; id 0 where a name stays unmapped. Fuzzy
    matches are tried only if the exact rate is below the trigger, of prod_ai first."""
    if not (0 <= fuzzy_trigger_rate <= 1 and 0 <= fuzzy_score_cutoff <= 100 and 0 <= fuzzy_margin <= 100):
        raise ValueError("a fuzzy parameter is out of range")
    tables = {**_under(data_dir, "processed", "report_drug", "cohort"), **_under(data_dir, "reference", "structures", "synonyms", "struct2atc")}
    rx = os.path.join(data_dir, "reference", "rxnorm_lookup.parquet")
    if manifest.exists(spark, rx):
        tables["rxnorm_lookup"] = rx

    def make():
        read = lambda n: spark.read.parquet(tables[n])
        edges, cohort = read("report_drug"), read("cohort")
        known = NA.aliases(read("structures"), read("synonyms").select("id", "name"))
        rxnorm = NA.rxnorm_aliases(read("rxnorm_lookup")) if "rxnorm_lookup" in tables else None
        raw = edges.select(F.trim("drugname").alias("faers_raw"), "prod_ai").where(C.filled(F.col("faers_raw"))).distinct()
        mapped = GR.checkpointed(NA.exact_cascade(raw, known, rxnorm))
        total, hit = mapped.count(), mapped.where("ids is not null").count()
        if total and hit / total < fuzzy_trigger_rate:
            open_ = raw.join(mapped.where("ids is null and conflict = 0").select("faers_raw"), "faers_raw", "left_semi")
            more = NA.fuzzy_cascade(open_, NA.searchable(known, rxnorm), fuzzy_score_cutoff, fuzzy_margin)
            mapped = mapped.join(more.select("faers_raw", F.col("ids").alias("_f")), "faers_raw", "left").withColumn("ids", F.coalesce("ids", "_f")).drop("_f")
        rows = mapped.select("faers_raw", F.explode(F.coalesce("ids", F.array(F.lit(0).cast("bigint")))).alias("dc_id"))
        rows = rows.join(NA.atc_by_structure(read("struct2atc")), "dc_id", "left")
        if dump:
            labels = copydump.copy_tables(spark, dump, {"section": ["label_id", "code", "title"], "prd2label": None, "active_ingredient": None})
            boxed = NA.boxed_warnings(labels["section"], labels["prd2label"], labels["active_ingredient"]).withColumn("has_boxed_warning", F.lit(1))
            rows = rows.join(boxed, "dc_id", "left").fillna({"has_boxed_warning": 0})
        else:
            rows = rows.withColumn("has_boxed_warning", F.lit(0))
        out = NA.dictionary_ror(rows, edges, cohort).select("faers_raw", "dc_id", "atc_code", "ror", "has_boxed_warning")
        QA.require_unique(out, ["faers_raw", "dc_id"])
        return out.orderBy("faers_raw", "dc_id"), {"names": total, "exact": hit}

    parameters = {"trigger": fuzzy_trigger_rate, "cutoff": fuzzy_score_cutoff, "margin": fuzzy_margin, "dump": bool(dump)}
    return _publish(spark, make, os.path.join(data_dir, "processed", "drug_dictionary.parquet"), parameters, {"dump": dump} if dump else {}, tables)


def add_tabular_features(*, spark: SparkSession, data_dir: str, rebuild_graph: bool = True) -> Build:
    """The cohort with demographics, temporal risk, ATC, exposure and dose features; the frozen dose table beside it."""
    tables = _under(data_dir, "processed", "cohort", "report_drug", "drug_dictionary")
    read = lambda n: spark.read.parquet(tables[n])
    named = lambda: read("report_drug").withColumn("faers_raw", F.trim("drugname"))
    eligible = lambda: DO.eligible(DO.canonical(named()), DO.single_ingredient(read("drug_dictionary")))

    def make():
        cohort, dictionary = read("cohort"), read("drug_dictionary").where("dc_id > 0")
        reports = cohort.select(F.col("primaryid").alias("report"), "report_date", "is_serious", "split")
        exposures = named().select(F.col("primaryid").alias("report"), "faers_raw").join(dictionary.select("faers_raw", "dc_id"), "faers_raw").select("report", "dc_id").distinct()
        boxed = dictionary.groupBy("dc_id").agg(F.max("has_boxed_warning").alias("has_boxed_warning"))
        codes = dictionary.groupBy("dc_id").agg(F.min("atc_code").alias("atc_code"))
        risk = RI.patient_risk(RI.temporal_ror(exposures, reports, "dc_id"), boxed).withColumnRenamed("report", "primaryid")
        atc = FE.atc_features(FE.atc_rows(exposures, codes)).withColumnRenamed("report", "primaryid")
        doses = DO.patient_features(DO.relative(eligible()))
        out = FE.assemble(FE.demographics(cohort), "primaryid", [risk, atc, FE.exposure_features(named()), doses], {"max_ror": 1.0})
        QA.require_same_rows(cohort, out, "primaryid")
        return out

    _publish(spark, lambda: DO.lookup(eligible()), os.path.join(data_dir, "processed", "dose_reference.parquet"), {"part": "dose_reference"}, tables=tables)
    out = _publish(spark, make, os.path.join(data_dir, "processed", "cohort_tabular.parquet"), {"part": "cohort_tabular"}, tables=tables)
    if rebuild_graph:
        build_graph(spark=spark, data_dir=data_dir, cohort="cohort_tabular")
    return out


def build_feature_rescue(*, spark: SparkSession, data_dir: str, training_end_year: int = 2023, top_pairs: int = 50, minimum_pair_reports: int = 25, rebuild_graph: bool = True) -> Build:
    """Pair risks, indications and outcome flags; only training reports up to the year are fitted on."""
    tables = {**_under(data_dir, "processed", "cohort_tabular", "report_drug", "drug_dictionary"), **_interim(spark, data_dir, "indi")}
    parameters = {"year": training_end_year, "least": minimum_pair_reports, "top": top_pairs}
    fit = (F.col("split") == "train") & (F.year("report_date") <= training_end_year)
    read = lambda n: spark.read.parquet(tables[n])
    reports = lambda: read("cohort_tabular").select(F.col("primaryid").alias("report"), "report_date", "is_serious", "split")
    known: list[DataFrame] = []

    def pairs() -> DataFrame:
        if not known:
            dictionary = read("drug_dictionary").where("dc_id > 0").select("faers_raw", "dc_id")
            exposures = read("report_drug").select(F.col("primaryid").alias("report"), F.trim("drugname").alias("faers_raw")).join(dictionary, "faers_raw").select("report", "dc_id").distinct()
            known.append(GR.checkpointed(RI.pairs(exposures)))
        return known[0]

    def make():
        cohort = read("cohort_tabular")
        scored = RI.patient_pair_risk(RI.pair_scores(pairs(), reports(), fit, minimum_pair_reports)).withColumnRenamed("report", "primaryid")
        terms = _staged(spark, data_dir, "indi").select(F.col("primaryid").alias("report"), F.col("indi_pt").alias("indication"))
        vocabulary = FE.indication_vocabulary(terms.join(reports().where(fit).select("report"), "report"))
        parts = [scored, FE.indication_features(terms, vocabulary).withColumnRenamed("report", "primaryid")]
        out = FE.assemble(cohort, "primaryid", parts).withColumns(FE.outcome_targets(F.col("outcome_codes")))
        QA.require_same_rows(cohort, out, "primaryid")
        return out, {"fitted_on": f"train up to {training_end_year}, strictly earlier dates", "held_out": "frozen"}

    top = lambda: RI.top_pairs(RI.pair_risk(pairs(), reports().where(fit), minimum_pair_reports), top_pairs)
    _publish(spark, top, os.path.join(data_dir, "processed", "high_risk_drug_pairs.parquet"), parameters, tables=tables)
    out = _publish(spark, make, os.path.join(data_dir, "processed", "cohort_enriched.parquet"), parameters, tables=tables)
    if rebuild_graph:
        build_graph(spark=spark, data_dir=data_dir, cohort="cohort_enriched")
    return out


#: Columns of a cohort that aren't features: identity, time, text, and what is to be predicted.
NOT_FEATURES = {"primaryid", "caseid", "caseversion", "report_date", "quarter", "split", "is_serious", "is_death", "is_hospitalization", "outcome_codes", "age", "num_drugs"}


def numeric_features(cohort: DataFrame) -> list[str]:
    """Numeric columns that may be learnt from, beside age, sex and the number of drugs, which every vector has."""
    return [c for c, t in cohort.dtypes if c not in NOT_FEATURES and (t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal"))]


def build_graph(*, spark: SparkSession, data_dir: str, top_unknown: int = 500, cohort: str = "cohort", baseline_rounds: int = 0, leaves: int = 31, arrays: bool = False) -> dict[str, Build]:
    """patients (with their vectors), drug_nodes (with theirs), graph_edges in the order of split, patient and drug, and the
    descriptor: edges and first edge of each split. With `baseline_rounds`, boosted trees on the patients' vectors: validation
    scores, and importances with the AUC of each round. With `arrays`, both nodes' vectors as memory-mapped matrices beside
    them, which needs a data_dir that all machines mount."""
    tables = {**_under(data_dir, "processed", cohort, "report_drug", "drug_dictionary")}
    names = tables | ({"structures": p} if manifest.exists(spark, p := os.path.join(data_dir, "reference", "structures.parquet")) else {})
    read = lambda n: spark.read.parquet(names[n])
    folder, parameters = os.path.join(data_dir, "graph"), {"top_unknown": top_unknown, "cohort": cohort}
    put = lambda make, n: _publish(spark, make, os.path.join(folder, f"{n}.parquet"), parameters | {"part": n}, tables=names)

    def patients():
        rows = read(cohort)
        QA.require_splits(rows)
        numeric = numeric_features(rows)
        vectors = FE.patient_vector(rows, numeric).select("primaryid", "report_date", "split", "is_serious", "features")
        return GR.dense_index(vectors, [F.asc_nulls_last("report_date"), F.asc("primaryid")], "patient_index"), {"features": ["age", "sex_m", "num_drugs", *numeric]}

    mapped = lambda: read("drug_dictionary").where("dc_id > 0")
    named = lambda: read("report_drug").withColumn("faers_raw", F.trim("drugname"))

    def nodes():
        unknown = GR.checkpointed(NA.unmapped_by_frequency(named(), mapped(), top_unknown))
        own = mapped().groupBy("dc_id").agg(F.max("has_boxed_warning").alias("has_boxed_warning"), F.min("atc_code").alias("atc_code"))
        made = GR.drug_nodes(mapped().select("dc_id").distinct(), unknown, GR.has_other(named(), read("drug_dictionary"), unknown))
        made = made.join(own.withColumnRenamed("dc_id", "semantic_id"), "semantic_id", "left")
        train = read(cohort).where("split = 'train'").select(F.col("primaryid").alias("report"), "is_serious")
        links = GR.graph_edges(named().select(F.col("primaryid").alias("patient_index"), "faers_raw"), read("drug_dictionary"), unknown, made).withColumnRenamed("patient_index", "report")
        cells = RI.with_ror(RI.contingency(links, train, ["node_index"]), "zero").select("node_index", F.log("ror").alias("log_ror"))
        made = FE.drug_vector(made.join(cells, "node_index", "left"))
        made = GR.named_nodes(made, read("structures")) if "structures" in names else made.withColumn("display_name", F.col("node_label"))
        return made, {"features": FE.DRUG_FEATURES}

    out = {"patients": put(patients, "patients"), "drug_nodes": put(nodes, "drug_nodes")}
    here = _under(data_dir, "graph", "patients", "drug_nodes")
    who, drugs = (spark.read.parquet(here[n]) for n in ("patients", "drug_nodes"))

    def edges():
        unknown = drugs.where("node_kind = 'frequent_unknown'").select(F.col("node_label").alias("faers_raw"))
        links = GR.graph_edges(named().join(who.select("primaryid", "patient_index"), "primaryid").select("patient_index", "faers_raw"), read("drug_dictionary"), unknown, drugs)
        QA.require_no_orphans(links, drugs, "node_index")
        return GR.ordered_edges(links, who)

    # the nodes are inputs of the edges as well
    out["graph_edges"] = _publish(spark, edges, os.path.join(folder, "graph_edges.parquet"), parameters | {"part": "graph_edges"}, tables={**tables, **here})
    made = spark.read.parquet(out["graph_edges"].output)
    if baseline_rounds:
        out |= _baseline(spark, data_dir, who, out["patients"].counts["features"], baseline_rounds, leaves)
    if arrays:
        from ..sources import arrays as AR

        for df, index, n, names_ in ((who, "patient_index", "patients", out["patients"].counts["features"]), (drugs, "node_index", "drug_nodes", FE.DRUG_FEATURES)):
            AR.save_matrix(df.select(index, *[F.col("features")[k].alias(f"c{k}") for k in range(len(names_))]), index, [f"c{k}" for k in range(len(names_))], os.path.join(folder, f"{n}.npy"))
    out["descriptor"] = _publish(spark, lambda: GR.split_offsets(made), os.path.join(folder, "descriptor.parquet"), parameters | {"part": "descriptor"}, tables={"graph_edges": out["graph_edges"].output})
    return out


def _baseline(spark: SparkSession, data_dir: str, patients: DataFrame, names: list[str], rounds: int, leaves: int) -> dict[str, Build]:
    from ..operators import models as MO

    parameters = {"rounds": rounds, "leaves": leaves}
    rows = patients.select("patient_index", "split", F.col("is_serious").alias("label"), *[F.col("features")[k].cast("double").alias(n) for k, n in enumerate(names)])
    rows, found = GR.checkpointed(rows), {}

    def scores():
        found["model"] = model = MO.fit(rows, names, "boosted", rounds=rounds, leaves=leaves)
        MO.save(spark, model, os.path.join(data_dir, "models", "graph-baseline"))
        return model.scored(rows.where("split = 'validation'")).select("patient_index", "label", "score"), {"auc": max(model.history), "round": len(model.trees)}

    def importances():
        model = found.get("model") or MO.load(spark, os.path.join(data_dir, "models", "graph-baseline"))
        return spark.createDataFrame(model.importances(), "feature string, gain double")

    inputs = _under(data_dir, "graph", "patients")
    return {n: _publish(spark, make, os.path.join(data_dir, "graph", f"{n}.parquet"), parameters | {"part": n}, tables=inputs) for n, make in (("baseline", scores), ("baseline_importances", importances))}


def build_graph_features(*, spark: SparkSession, data_dir: str, n_iterations: int = 3, alpha: float = 0.7) -> Build:
    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")

    def make():
        patients, nodes, links = (spark.read.parquet(tables[n]) for n in ("patients", "drug_nodes", "graph_edges"))
        base = nodes.select("node_index", F.coalesce("log_ror", F.lit(0.0)).alias("log_ror"))
        return GR.graph_features(links.select("patient_index", "node_index"), patients, base, n_iterations, alpha)

    return _publish(spark, make, os.path.join(data_dir, "graph", "graph_features.parquet"), {"steps": n_iterations, "alpha": alpha}, tables=tables)


def _training_rows(spark, data_dir: str) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, patient features, neighbour features): a column each, with label and split, after the graph's audits."""
    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")
    patients, nodes, links = (spark.read.parquet(tables[n]) for n in ("patients", "drug_nodes", "graph_edges"))
    GR.inductive_audit(links, patients)
    own = manifest.load(spark, f"{tables['patients']}.manifest.json").provenance["counts"]["features"]
    near = [f"drug_{n}" for n in FE.DRUG_FEATURES]
    rows = patients.join(GR.one_hop_means(links, patients, nodes, len(near)), "patient_index")
    columns = [*[F.col("features")[k].cast("double").alias(n) for k, n in enumerate(own)], *[F.col("neighbours")[k].alias(n) for k, n in enumerate(near)]]
    return rows.select("patient_index", "primaryid", "split", F.col("is_serious").alias("label"), *columns), own, near


def train_model(*, spark: SparkSession, data_dir: str, kind: str = "boosted", feature_track: str = "prospective", evaluate_test: bool = False, resume: bool = False, **options) -> Build:
    """A model on patients' own features and the means of their drugs', learnt from training patients; saved under models/,
    with the scores of validation patients (and test patients where asked) and its metrics beside it. Kind "graph" is the
    network of two encoders, whose options are those of inductive.Settings; with `resume` it goes on from its last state."""
    from ..operators import evaluate as EV
    from ..operators import inductive as IN
    from ..operators import models as MO

    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")
    name = f"{kind}-{feature_track}"
    place = os.path.join(data_dir, "models", name)

    def make():
        rows, own, near = _training_rows(spark, data_dir)
        chosen = [*FE.track(own, feature_track), *near]
        rows = GR.checkpointed(rows)
        wanted = F.col("split").isin("validation", *(["test"] if evaluate_test else []))
        if kind == "graph":
            sides = rows.withColumns({"own": F.array(*FE.track(own, feature_track)), "near": F.array(*near)})
            network = IN.fit(sides, f"{place}-work", IN.Settings(**options), resume)
            IN.save(spark, network, place)
            held = network.scored(sides.where(wanted))
        else:
            model = MO.fit(rows, chosen, kind, **options)
            MO.save(spark, model, place)
            held = MO.scored(model, rows.where(wanted))
        held = GR.checkpointed(held.select("patient_index", "primaryid", "split", "label", "score"))
        auc = {s: EV.auc(held.where(F.col("split") == s)).first()["auc"] for s in ("validation", *(["test"] if evaluate_test else []))}
        return held, {"features": chosen, "auc": auc}

    return _publish(spark, make, os.path.join(data_dir, "models", f"{name}-scores.parquet"), {"kind": kind, "track": feature_track, "test": evaluate_test, **options}, tables=tables)


def evaluate_dosage_ablation(*, spark: SparkSession, data_dir: str, kind: str = "boosted", seed: int = 42, bootstrap_samples: int = 500, **options) -> Build:
    """The same model with and without the dose features: both AUCs on validation and the paired bootstrap of their difference."""
    from ..operators import serving as SE

    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")

    def make():
        rows, own, near = _training_rows(spark, data_dir)
        base = [*FE.track(own, "prospective-no-dosage"), *near]
        dose = [n for n in FE.track(own, "prospective") if n not in base]
        found = SE.ablation(spark, GR.checkpointed(rows.withColumnRenamed("patient_index", "report")), base, dose, kind, bootstrap_samples, seed, **options)
        flat = {"auc_without": found["auc_without"], "auc_with": found["auc_with"], **{f"difference_{k}": float(v) for k, v in found["difference"].items()}}
        return spark.createDataFrame([flat], ", ".join(f"{k} double" for k in flat)), {"dose_features": dose}

    return _publish(spark, make, os.path.join(data_dir, "models", "dosage_ablation.parquet"), {"kind": kind, "seed": seed, "samples": bootstrap_samples, **options}, tables=tables)


def visualize_graph(*, spark: SparkSession, data_dir: str, split: str = "validation", patients: int = 100, top_drugs: int = 50) -> dict[str, Build]:
    """Tables for a viewer: an even sample of a split's patients by label, their edges to the most frequent drugs among them,
    places on golden-angle discs and display names."""
    if not (1 <= patients <= 1_000_000 and 1 <= top_drugs <= 100_000):
        raise ValueError("patients or top_drugs is out of range")
    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")
    who, nodes, links = (spark.read.parquet(tables[n]) for n in ("patients", "drug_nodes", "graph_edges"))
    parameters = {"split": split, "patients": patients, "drugs": top_drugs}
    put = lambda make, n: _publish(spark, make, os.path.join(data_dir, "viewer", f"{n}.parquet"), parameters | {"part": n}, tables=tables)
    sample = GR.checkpointed(GR.systematic_sample(who.where(F.col("split") == split).select("patient_index", "is_serious"), "is_serious", "patient_index", -(-patients // 2)))
    among = links.join(sample, "patient_index", "left_semi").select("patient_index", "node_index")
    best = GR.degree(among).orderBy(F.desc("degree"), "node_index").limit(top_drugs)
    drugs = nodes.join(best, "node_index").select("node_index", "display_name", "node_kind", "degree")
    spots = GR.layout(GR.dense_index(sample, [F.asc("patient_index")], "place").select(F.col("place").alias("patient_index")), GR.dense_index(drugs, [F.desc("degree"), F.asc("node_index")], "place").select(F.col("place").alias("node_index")))
    return {"patients": put(lambda: sample, "patients"), "drugs": put(lambda: drugs, "drugs"), "edges": put(lambda: among.join(best.select("node_index"), "node_index").select("patient_index", "node_index"), "edges"), "layout": put(lambda: spots, "layout")}


def export_training_table(*, spark: SparkSession, data_dir: str, feature_track: str = "prospective") -> Build:
    """(patient_index, primaryid, split, label, features) for learners elsewhere; the names of the features are in the manifest."""
    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")

    def make():
        rows, own, near = _training_rows(spark, data_dir)
        chosen = [*FE.track(own, feature_track), *near]
        QA.require_no_targets(chosen)
        QA.require_finite(rows, chosen, ["label"])
        return rows.select("patient_index", "primaryid", "split", "label", F.array(*[F.col(c).cast("float") for c in chosen]).alias("features")), {"features": chosen}

    return _publish(spark, make, os.path.join(data_dir, "models", f"training-{feature_track}.parquet"), {"track": feature_track}, tables=tables)


def estimate_full_visualization(*, spark: SparkSession, data_dir: str, target_shard_bytes: int = 32 << 20) -> dict[str, dict[str, int]]:
    """Shards and bytes of a full export, without making it."""
    counts = {n: manifest.load(spark, f"{p}.manifest.json").rows for n, p in _under(data_dir, "graph", "patients", "graph_edges").items()}
    return {"points": arrays.shard_estimate(counts["patients"], POINT_FIELDS, target_shard_bytes), "edges": arrays.shard_estimate(counts["graph_edges"], EDGE_FIELDS, target_shard_bytes)}


#: Fields of the shards of a full export.
POINT_FIELDS = [("x", "<f4"), ("y", "<f4"), ("label", "u1"), ("split_id", "i1"), ("cluster", "<i4")]
EDGE_FIELDS = [("point", "<i4"), ("node_index", "<i4")]
#: Points that a tile of the finest level has on average, at most.
TILE_POINTS = 4096


def tile_depth(points: int) -> int:
    """Levels of tiles below the whole."""
    return next(d for d in range(14) if points <= TILE_POINTS << 2 * d or d == 13)


def export_full_visualization(*, spark: SparkSession, data_dir: str, target_shard_bytes: int = 32 << 20) -> dict:
    """All patients on a disc round their primary drugs' order and their edges, in binary shards with checksums in the order of
    tiles; an index of tiles of all levels of detail, with boxes and the records of points and edges of each; counts and boxes
    by cluster, and each cluster's drugs. The folder has to be shared; shards that are there with the same bytes are kept, so
    an export that was stopped goes on, and one of a changed graph is made anew. An edge names its patient by the point's place."""
    tables = _under(data_dir, "graph", "patients", "drug_nodes", "graph_edges")
    who, nodes, links = (spark.read.parquet(tables[n]) for n in ("patients", "drug_nodes", "graph_edges"))
    folder = os.path.join(data_dir, "viewer-full")
    drugs = nodes.count()
    bucket = GR.primary_drug(links, who, drugs)
    ordered = GR.dense_index(who.join(bucket, "patient_index").select("patient_index", "bucket", F.col("is_serious").alias("label"), GR.split_id(F.col("split")).alias("split_id")), [F.asc("bucket"), F.asc("patient_index")], "place")
    spots = GR.layout(ordered.select(F.col("place").alias("patient_index")), nodes.limit(0)).select(F.col("index").alias("place"), "x", "y")
    depth = tile_depth(manifest.load(spark, f"{tables['patients']}.manifest.json").rows)
    placed = GR.tiled(GR.clustered(ordered.join(spots, "place")), depth).withColumnRenamed("place", "_order")
    points = GR.checkpointed(GR.dense_index(placed, [F.asc("tile"), F.asc("_order")], "place").drop("_order"))
    sizes = estimate_full_visualization(spark=spark, data_dir=data_dir, target_shard_bytes=target_shard_bytes)
    plain = folder.removeprefix("file://")
    made = {"points": arrays.write_shards(points.select("place", *[c for c, _ in POINT_FIELDS]), os.path.join(plain, "points"), "place", POINT_FIELDS, sizes["points"]["per_shard"])}
    near = links.select("patient_index", "node_index").join(points.select("patient_index", F.col("place").alias("point"), "tile"), "patient_index").drop("patient_index")
    numbered = GR.checkpointed(GR.dense_index(near, [F.asc("tile"), F.asc("point"), F.asc("node_index")], "at"))
    made["edges"] = arrays.write_shards(numbered, os.path.join(plain, "edges"), "at", EDGE_FIELDS, sizes["edges"]["per_shard"])
    put = lambda make, n: _publish(spark, make, os.path.join(folder, f"{n}.parquet"), {"part": n}, tables=tables)
    cells = lambda: points.groupBy("cluster").agg(F.count(F.lit(1)).alias("patients"), F.sum("label").alias("positives"), *[F.count_if(F.col("split_id") == k).alias(s) for s, k in GR.SPLIT_IDS.items()], *[f(c).alias(f"{t}_{c}") for c in ("x", "y") for t, f in (("min", F.min), ("max", F.max))])
    made["tiles"] = put(lambda: GR.tile_index(points, numbered, depth), "tiles")
    made["clusters"] = put(cells, "clusters")
    made["cluster_drugs"] = put(lambda: GR.cluster_drug_edges(links, points.select("patient_index", "cluster")), "cluster_drugs")
    return made


def build_prospective_pipeline(*, spark: SparkSession, data_dir: str, split_preset: str = "gnn-small", dump: str | None = None, **options) -> list:
    """Cohort, dictionary, tabular features, rescue and graph; tells all missing inputs at once."""
    wanted = {t: os.path.join(data_dir, "reference", f"{t}.parquet") for t in ("structures", "synonyms", "struct2atc")} | {"interim": os.path.join(data_dir, "interim")}
    if missing := QA.missing_prerequisites(wanted, spark):
        raise FileNotFoundError("; ".join(missing))
    return [
        build_cohort(spark=spark, data_dir=data_dir, split_preset=split_preset),
        build_drug_dictionary(spark=spark, data_dir=data_dir, dump=dump),
        add_tabular_features(spark=spark, data_dir=data_dir, rebuild_graph=False),
        build_feature_rescue(spark=spark, data_dir=data_dir, rebuild_graph=False, **options),
        build_graph(spark=spark, data_dir=data_dir, cohort="cohort_enriched"),
        build_graph_features(spark=spark, data_dir=data_dir),
    ]


def memory_estimate(*, patients: int, edges: int, drugs: int, patient_width: int = 118, drug_width: int = 28, batch: int = 131_072) -> dict[str, int]:
    """Bytes of the graph's arrays and of a batch of them: arithmetic, not a measurement."""
    return {"patient_features": 4 * patients * patient_width, "labels": 2 * patients, "identifiers": 8 * patients, "drug_features": 4 * drugs * drug_width, "edges": 8 * edges, "batch": 4 * batch * (patient_width + drug_width)}
