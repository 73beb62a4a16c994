"""Patient features: ATC hierarchy, exposure documentation, indications, demographics, wide assembly."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as V
from .graph import checkpointed
from .ranges import dealt, quantiles

#: Terms up to which a vocabulary goes to every task.
BROADCAST_TERMS = 400_000


def atc_rows(exposures: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct (report, dc_id, l1..l4) of well-formed codes; a drug's codes stand between bars. Both sides are distinct before
    they meet, so what they make is, too."""
    code = F.explode(F.split(F.coalesce("atc_code", F.lit("")), r"\|"))
    long = codes.select("dc_id", code.alias("code")).where(F.col("code").rlike("^[A-Z][0-9]{2}"))
    levels = long.select("dc_id", *[C.atc_level(F.col("code"), n).alias(f"l{i}") for i, n in enumerate((1, 3, 4, 5), 1)]).distinct()
    return exposures.select("report", "dc_id").distinct().join(levels, "dc_id").select("report", "dc_id", "l1", "l2", "l3", "l4")


def atc_features(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Counts are of distinct drugs. Rows are dealt by report once; that also clusters (report, drug, class) and
    (report, class), so nothing is shuffled again, and no aggregate needs a distinct of its own."""
    by_report = dealt(rows, "report", parts)
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"l{i}").alias("code")) for i in range(1, 5)]))
    one = by_report.select("report", "dc_id", level.alias("at")).select("report", "dc_id", "at.level", "at.code").where("code is not null").distinct()
    n = one.groupBy("report", "level", "code").agg(F.count(F.lit(1)).alias("n"))
    at = lambda i: F.col("level") == i
    counts = n.groupBy("report").agg(
        *[F.count_if(at(i)).alias(f"atc_l{i}_diversity") for i in range(1, 5)],
        *[F.coalesce(F.sum(F.when(at(1) & (F.col("code") == x), F.col("n"))), F.lit(0)).alias(f"count_{x.lower()}") for x in string.ascii_uppercase],
        *[F.coalesce(F.sum(F.when(at(i), F.col("n") - 1)), F.lit(0)).alias(f"therapeutic_duplicates_l{i}") for i in (1, 2)],
    )
    per_drug = by_report.groupBy("report", "dc_id").agg(F.max(F.col("l1").isin(*V.ATC_RISK_LETTERS).cast("int")).alias("risk"), F.max(F.coalesce(F.col("l3").isin(*V.ATC_RISK_GROUPS), F.lit(False)).cast("int")).alias("group"))
    risk = per_drug.groupBy("report").agg(F.sum("risk").alias("num_high_risk_atc"), F.sum("group").alias("num_high_risk_atc_groups"))
    return counts.join(risk, "report")


def exposure_features(rows: DataFrame, key: str = "primaryid") -> DataFrame:
    """The thirteen documentation features, on distinct normalised rows."""
    text = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    norm = rows.select(key, text("drugname").alias("drug"), text("route").alias("route"), C.number(F.col("dose_amt")).alias("amount"), text("dose_unit").alias("unit"), text("dose_form").alias("form"), text("dose_freq").alias("freq")).distinct()
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    variety = lambda c: F.size(F.collect_set(some(c)))
    share = lambda cond: F.avg(cond.cast("int"))
    p = "exposure_"
    return norm.groupBy(key).agg(
        variety("route").alias(f"{p}route_diversity"),
        share(F.col("route") != "").alias(f"{p}route_documented_fraction"),
        *[F.max(F.col("route").rlike(x).cast("int")).alias(f"{p}has_{k}_route") for k, x in V.ROUTES.items()],
        share(F.col("amount").isNotNull() | (F.col("unit") != "")).alias(f"{p}dose_documented_fraction"),
        variety("unit").alias(f"{p}dose_unit_diversity"),
        variety("form").alias(f"{p}dose_form_diversity"),
        *[F.max(F.col("form").rlike(x).cast("int")).alias(f"{p}has_{k}_form") for k, x in V.FORMS.items()],
        share(F.col("freq") != "").alias(f"{p}frequency_documented_fraction"),
        variety("freq").alias(f"{p}frequency_diversity"),
    )


def indication_vocabulary(terms: DataFrame, bins: int = 32) -> DataFrame:
    """(indication, hash_bin, flags) of the distinct terms of training reports."""
    term = F.upper(F.trim("indication"))
    rows = terms.where(C.filled(F.col("indication"))).select(term.alias("indication")).distinct()
    return rows.select("indication", C.hash_bin(F.col("indication"), bins).alias("hash_bin"), *[F.col("indication").rlike(x).cast("int").alias(f"has_{k}") for k, x in V.INDICATIONS.items()])


def indication_features(terms: DataFrame, vocabulary: DataFrame, bins: int = 32, parts: int | None = None) -> DataFrame:
    """Flags and bin counts, a term once a report. Rows are dealt by report, and again where the vocabulary is too large to go to
    every task, so that no task holds more reports than its share."""
    vocabulary = checkpointed(vocabulary)
    small = vocabulary.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    one = dealt(terms.where(C.filled(F.col("indication"))).select("report", F.upper(F.trim("indication")).alias("indication")), "report", parts).distinct()
    one = one.join(F.broadcast(vocabulary), "indication") if small else dealt(one.join(vocabulary, "indication"), "report", parts)
    return one.groupBy("report").agg(*[F.max(f"has_{k}").alias(f"has_{k}") for k in V.INDICATIONS], *[F.count_if(F.col("hash_bin") == b).alias(f"indication_hash_{b:02d}") for b in range(bins)])


def train_medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row: the exact median of each value over training rows, by name. Ranks are taken over many tasks."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()])
    long = rows.where("split = 'train'").select(F.explode(each).alias("x")).select("x.name", "x.value")
    found = quantiles(long, "value", [0.5], ["name"])
    # a row of nulls without any value
    return found.agg(*[F.max(F.when(F.col("name") == n, F.col("q")[0])).alias(n) for n in values])


def demographics(cohort: DataFrame) -> DataFrame:
    """Imputed and clamped age and weight, bands, polypharmacy terms. Band gaps at fractional ages are as specified."""
    kg = C.weight_kg(F.col("weight"), F.col("weight_unit"))
    rows = cohort.withColumn("_kg", kg)
    medians = train_medians(rows, {"_age": F.col("age_years"), "_weight": F.col("_kg")})
    rows = rows.crossJoin(F.broadcast(medians)).withColumn("age_imputed", F.coalesce("age_years", "_age"))
    a = F.col("age_imputed")
    return rows.withColumns({
        "weight_kg_norm": C.clamped(F.coalesce("_kg", "_weight"), 250.0),
        "weight_missing": F.col("_kg").isNull().cast("int"),
        "age_band_under_18": C.flag(a < 18), "age_band_18_40": C.flag(a.between(18, 40)),
        "age_band_41_64": C.flag(a.between(41, 64)), "age_band_65_plus": C.flag(a >= 65),
        "num_drugs_squared": F.col("num_drugs") * F.col("num_drugs"), "polypharmacy_age": F.col("num_drugs") * a,
    }).drop("_kg", "_age", "_weight")


def outcome_targets(codes: Column) -> dict[str, Column]:
    parts = F.split(F.coalesce(codes, F.lit("")), r"\|")
    return {"is_death": F.array_contains(parts, "DE").cast("int"), "is_hospitalization": F.array_contains(parts, "HO").cast("int")}


def assemble(base: DataFrame, key: str, parts: list[DataFrame], defaults: dict | None = None) -> DataFrame:
    """Left joins of feature tables with a row a key each; numbers without a value get their default, else 0."""
    out, new = base, []
    for part in parts:
        new += [(c, t) for c, t in part.dtypes if c != key]
        out = out.join(part, key, "left")
    fill = {c: (defaults or {}).get(c, 0) for c, t in new if t != "string"}
    return out.fillna(fill) if fill else out


def patient_vector(cohort: DataFrame, numeric: list[str] = ()) -> DataFrame:
    """features: age, sex and drugs as floats, ages imputed by the train median, then the numeric columns, 0 where they are
    null or no number."""
    rows = cohort.crossJoin(F.broadcast(train_medians(cohort, {"_m": F.col("age")})))
    parts = [C.clamped(F.coalesce(F.col("age").cast("double"), F.col("_m")), 120.0), (F.coalesce(F.col("sex"), F.lit("")) == "M").cast("double"), C.clamped(F.coalesce(F.col("num_drugs").cast("double"), F.lit(0.0)), 50.0)]
    parts += [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numeric]
    return rows.withColumn("features", F.array(*[p.cast("float") for p in parts])).drop("_m")


def drug_vector(nodes: DataFrame) -> DataFrame:
    """nodes (log_ror, has_boxed_warning, atc_code, ...) with features: log ROR over its deviation, 0 where it is unknown,
    the boxed warning, and one flag a letter of the first ATC level."""
    m = nodes.agg(F.avg("log_ror").alias("_m"), F.stddev_pop("log_ror").alias("_s"))
    z = F.coalesce((F.col("log_ror") - F.col("_m")) / F.when(F.col("_s") > 1e-6, F.col("_s")).otherwise(1.0), F.lit(0.0))
    letters = [F.coalesce(F.col("atc_code").rlike(rf"(^|\|){x}").cast("double"), F.lit(0.0)) for x in string.ascii_uppercase]
    parts = [z, F.coalesce(F.col("has_boxed_warning").cast("double"), F.lit(0.0)), *letters]
    return nodes.crossJoin(F.broadcast(m)).withColumn("features", F.array(*[p.cast("float") for p in parts])).drop("_m", "_s")


#: Components of drug_vector.
DRUG_FEATURES = ["log_ror", "has_boxed_warning", *[f"atc_{x}" for x in string.ascii_lowercase]]
#: Who reported is known only once a report is complete.
REPORTER_FEATURES = ("reporter_md", "reporter_cn", "reporter_hp", "reporter_ph", "reporter_lw", "reporter_unknown")
TRACKS = ("prospective", "prospective-no-dosage", "completed_report")


def track(names: list[str], which: str = "prospective") -> list[str]:
    """The features of a track: all of a completed report, else none of the reporter, and no dose feature where asked."""
    if which not in TRACKS:
        raise ValueError(f"no such track: {which}")
    if which == "completed_report":
        return list(names)
    dose = [n for n in names if n.startswith("dose_normalized_")]
    if which == "prospective-no-dosage" and not dose:
        raise ValueError("there are no dose features to leave out")
    chosen = [n for n in names if n not in REPORTER_FEATURES and not (which == "prospective-no-dosage" and n in dose)]
    if not chosen:
        raise ValueError("no feature is left")
    return chosen
