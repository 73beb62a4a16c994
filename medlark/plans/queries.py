"""Registered queries over the proxy tables, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed_values as V
from ..operators import cohort as CO
from ..operators import dose as DO
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import graph as GR
from ..operators import names as NA
from ..operators import ranges as RG
from ..operators import risk as RI
from ..operators.fuzzy import EDITS
from . import proxy as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sql(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def _rounded(df: DataFrame, digits: int = 9, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- disproportionality ------------------------------------------------------------------------------------------------

_CELLS = """cells AS (SELECT dc_id, a, b, s - a AS c, n - b AS d FROM (SELECT dc_id, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM exposures JOIN {r} USING (report) GROUP BY dc_id),
    (SELECT count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM {r}))"""
_TRAIN = "train AS (SELECT * FROM reports WHERE split = 'train')"
_HALF = "((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5))"


@query(_sql(P.REPORTS, P.EXPOSURES, _CELLS.format(r="reports"), select=f"SELECT dc_id, a, b, c, d, round(CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN {_HALF} ELSE (a * d)::DOUBLE / (b * c) END, 9) AS ror FROM cells"))
def ror_by_ingredient(spark, sf_dir):
    return _rounded(RI.with_ror(RI.contingency(P.exposures(spark, sf_dir), P.reports(spark, sf_dir), ["dc_id"]), "zero"), 9, "ror")


_LOOKUP = f"lookup AS (SELECT dc_id, a, b, c, d, a + b AS support, CASE WHEN a + c = 0 OR b + d = 0 THEN 1.0 ELSE {_HALF} END AS ror FROM cells)"


@query(_sql(P.REPORTS, P.EXPOSURES, _TRAIN, _CELLS.format(r="train"), _LOOKUP, select="SELECT dc_id, a, b, c, d, support, round(ror, 9) AS ror FROM lookup"))
def ror_train_smoothed(spark, sf_dir):
    return _rounded(RI.risk_lookup(P.exposures(spark, sf_dir), P.reports(spark, sf_dir), "dc_id"), 9, "ror")


_TEMPORAL = f"""days AS (SELECT report_date, sum(s) OVER w AS s, sum(n) OVER w AS n FROM (SELECT report_date, count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM train GROUP BY report_date) WINDOW w AS (ORDER BY report_date)),
    own AS (SELECT dc_id, report_date, sum(a) OVER w AS a, sum(b) OVER w AS b FROM (SELECT dc_id, report_date, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM exposures JOIN train USING (report) GROUP BY dc_id, report_date) WINDOW w AS (PARTITION BY dc_id ORDER BY report_date)),
    early AS (SELECT e.report, e.dc_id, coalesce(o.a, 0) AS a, coalesce(o.b, 0) AS b, coalesce(d.s, 0) - coalesce(o.a, 0) AS c, coalesce(d.n, 0) - coalesce(o.b, 0) AS d
        FROM exposures e JOIN train t USING (report) ASOF LEFT JOIN days d ON t.report_date > d.report_date ASOF LEFT JOIN own o ON e.dc_id = o.dc_id AND t.report_date > o.report_date),
    scored AS (SELECT report, dc_id, CASE WHEN a + b = 0 OR a + c = 0 OR b + d = 0 THEN 1.0 ELSE {_HALF} END AS ror FROM early
        UNION ALL SELECT e.report, e.dc_id, coalesce(l.ror, 1.0) FROM exposures e JOIN reports r USING (report) LEFT JOIN lookup l USING (dc_id) WHERE r.split <> 'train')"""
_ALL_TEMPORAL = (P.REPORTS, P.EXPOSURES, _TRAIN, _CELLS.format(r="train"), _LOOKUP, _TEMPORAL)


@query(_sql(*_ALL_TEMPORAL, select="SELECT report, dc_id, round(ror, 9) AS ror FROM scored"))
def temporal_ror(spark, sf_dir):
    """Flagship: no report learns from its own day or later."""
    return _rounded(RI.temporal_ror(P.exposures(spark, sf_dir), P.reports(spark, sf_dir), "dc_id"), 9, "ror")


@query(_sql(*_ALL_TEMPORAL, select="SELECT report, round(max(ror), 9) AS max_ror, round(avg(ln(greatest(ror, 1e-12))), 9) AS mean_log_ror, count(*) FILTER (ror > 2) AS high_ror_count FROM scored GROUP BY report"))
def patient_drug_risk(spark, sf_dir):
    return _rounded(RI.patient_risk(RI.temporal_ror(P.exposures(spark, sf_dir), P.reports(spark, sf_dir), "dc_id")), 9, "max_ror", "mean_log_ror")


_PAIRS = "pairs AS (SELECT x.report, x.dc_id AS dc_id_1, y.dc_id AS dc_id_2 FROM exposures x JOIN exposures y ON x.report = y.report AND x.dc_id < y.dc_id)"
_FIT = "fit AS (SELECT * FROM reports WHERE split = 'train' AND year(report_date) <= 1999)"
_PAIR_RISK = f"""risk AS (SELECT dc_id_1, dc_id_2, a, b, c, d, a + b AS pair_reports, (a::DOUBLE / nullif(a + b, 0)) / nullif(c::DOUBLE / nullif(c + d, 0), 0) AS prr, ln({_HALF}) AS log_ror FROM
    (SELECT dc_id_1, dc_id_2, a, b, s - a AS c, n - b AS d FROM (SELECT dc_id_1, dc_id_2, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM pairs JOIN fit USING (report) GROUP BY ALL),
    (SELECT count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM fit)) WHERE a + b >= 25)"""


def _fit(reports):
    return (F.col("split") == "train") & (F.year("report_date") <= 1999)


@query(_sql(P.REPORTS, P.BRANDS, _PAIRS, _FIT, _PAIR_RISK, select="""SELECT dc_id_1, dc_id_2, a, b, c, d, pair_reports, round(prr, 9) AS prr, round(log_ror, 9) AS log_ror, CAST(row_number() OVER (ORDER BY prr DESC, pair_reports DESC, dc_id_1, dc_id_2) AS INTEGER) AS risk_rank
    FROM risk WHERE prr IS NOT NULL AND isfinite(prr) QUALIFY risk_rank <= 50"""))  # fmt: skip
def pair_prr_topk(spark, sf_dir):
    reports = P.reports(spark, sf_dir)
    return _rounded(RI.top_pairs(RI.pair_risk(RI.pairs(P.brands(spark, sf_dir)), reports.where(_fit(reports)))), 9, "prr", "log_ror")


_PAIR_TEMPORAL = f"""days AS (SELECT report_date, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(n) OVER w, 0) AS n FROM (SELECT report_date, count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM fit GROUP BY report_date)
        WINDOW w AS (ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    seen AS (SELECT p.report, dc_id_1, dc_id_2, report_date, is_serious FROM pairs p JOIN fit USING (report) JOIN (SELECT dc_id_1, dc_id_2 FROM risk) USING (dc_id_1, dc_id_2)),
    own AS (SELECT dc_id_1, dc_id_2, report_date, coalesce(sum(a) OVER w, 0) AS a, coalesce(sum(b) OVER w, 0) AS b FROM (SELECT dc_id_1, dc_id_2, report_date, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM seen GROUP BY dc_id_1, dc_id_2, report_date)
        WINDOW w AS (PARTITION BY dc_id_1, dc_id_2 ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    early AS (SELECT x.report, dc_id_1, dc_id_2, o.a, o.b, d.s - o.a AS c, d.n - o.b AS d FROM seen x JOIN own o USING (dc_id_1, dc_id_2, report_date) JOIN days d USING (report_date) WHERE o.a + o.b >= 25),
    scored AS (SELECT report, dc_id_1, dc_id_2, ln({_HALF}) AS log_ror FROM early UNION ALL
        SELECT p.report, dc_id_1, dc_id_2, log_ror FROM pairs p JOIN risk USING (dc_id_1, dc_id_2) JOIN reports r ON r.report = p.report WHERE coalesce(NOT (r.split = 'train' AND year(r.report_date) <= 1999), TRUE))"""
_ALL_PAIRS = (P.REPORTS, P.BRANDS, _PAIRS, _FIT, _PAIR_RISK, _PAIR_TEMPORAL)


def _pair_scores(spark, sf_dir):
    reports = P.reports(spark, sf_dir)
    return RI.pair_scores(RI.pairs(P.brands(spark, sf_dir)), reports, _fit(reports))


@query(_sql(*_ALL_PAIRS, select="SELECT report, dc_id_1, dc_id_2, round(log_ror, 9) AS log_ror FROM scored"))
def pair_temporal_score(spark, sf_dir):
    return _rounded(_pair_scores(spark, sf_dir), 9, "log_ror")


@query(_sql(*_ALL_PAIRS, select="SELECT report, count(*) FILTER (log_ror > ln(1.5)) AS num_high_risk_pairs, round(max(log_ror), 9) AS max_pair_log_ror, round(avg(log_ror), 9) AS mean_pair_log_ror, count(*) AS scored_pairs FROM scored GROUP BY report"))
def patient_pair_risk(spark, sf_dir):
    return _rounded(RI.patient_pair_risk(_pair_scores(spark, sf_dir)), 9, "max_pair_log_ror", "mean_pair_log_ror")


# --- cohort ------------------------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS caseid, o_orderkey AS report, CAST(o_orderdate AS DATE) AS report_date FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1""")  # fmt: skip
def latest_version_per_case(spark, sf_dir):
    gone = P.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("caseid"))
    rows = CO.without_deleted(P.reports(spark, sf_dir), gone)
    return CO.latest_versions(rows, "caseid", [F.desc_nulls_last("report_date"), F.desc("report")]).select("caseid", "report", "report_date")


@query("""SELECT l_orderkey AS report, string_agg(DISTINCT upper(trim(l_returnflag)), '|' ORDER BY upper(trim(l_returnflag))) AS outcome_codes, max(CASE WHEN l_returnflag IN ('R') THEN 1 ELSE 0 END) AS is_serious,
    count(DISTINCT l_partkey) AS num_drugs, CASE WHEN count(DISTINCT l_partkey) >= 5 THEN 1 ELSE 0 END AS is_polypharmacy FROM lineitem WHERE l_returnflag IS NOT NULL AND trim(l_returnflag) <> '' GROUP BY l_orderkey""")  # fmt: skip
def cohort_aggregates(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "report")
    outcomes = CO.outcome_flags(rows, "report", F.upper(F.trim("l_returnflag")), ("R",))
    drugs = CO.value_lists(rows, "report", F.col("l_partkey").cast("string"), "drugs", "num_drugs").drop("drugs")
    return outcomes.join(drugs, "report").select("report", "outcome_codes", "is_serious", "num_drugs", C.flag(F.col("num_drugs") >= 5).alias("is_polypharmacy"))


_QUARTER = "year(o_orderdate) || 'Q' || quarter(o_orderdate)"
_PLAN = {"train": [f"{y}Q{q}" for y in range(1996, 2000) for q in range(1, 5)], "validation": ["2000Q1"], "test": ["2000Q2"]}
_PLAN_SQL = "plan(quarter, split) AS (VALUES " + ", ".join(f"('{q}', '{s}')" for s, qs in _PLAN.items() for q in qs) + ")"


def _quarters(spark, sf_dir):
    q = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    return P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), q.alias("quarter"))


@query(_sql(_PLAN_SQL, select=f"SELECT quarter, o_orderkey AS report, split FROM (SELECT *, {_QUARTER} AS quarter FROM orders) JOIN plan USING (quarter)"))
def split_assignment(spark, sf_dir):
    return CO.assign_splits(_quarters(spark, sf_dir), CO.split_plan(spark, _PLAN))


@query(_sql(_PLAN_SQL, select=f"SELECT p.quarter, p.split, CASE WHEN q.quarter IS NULL THEN 0 ELSE 1 END AS present FROM (SELECT quarter, split FROM plan UNION ALL SELECT '2050Q1', 'later') p LEFT JOIN (SELECT DISTINCT {_QUARTER} AS quarter FROM orders) q USING (quarter)"))
def quarter_coverage(spark, sf_dir):
    """With a quarter that no order has."""
    return CO.coverage(CO.split_plan(spark, _PLAN | {"later": ["2050Q1"]}), _quarters(spark, sf_dir))


@query(_sql(P.REPORTS, select="SELECT DISTINCT l_orderkey AS report, caseid, split, l_partkey AS drug, l_returnflag AS flag FROM lineitem JOIN reports ON report = l_orderkey"))
def edge_dedup(spark, sf_dir):
    l = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("drug"), F.col("l_returnflag").alias("flag"))
    # both sides are distinct before they meet, so what they make is, too
    r = P.reports(spark, sf_dir).select("report", "caseid", "split").distinct()
    return RG.dealt(l, "report", P.parts(spark, sf_dir)).distinct().join(r, "report").select("report", "caseid", "split", "drug", "flag")


@query("""SELECT o_orderkey AS report, round(CASE u WHEN 'YR' THEN a WHEN 'MON' THEN a / 12.0 WHEN 'WK' THEN a / 52.142857 WHEN 'DY' THEN a / 365.25 WHEN 'HR' THEN a / 8766.0 WHEN 'DEC' THEN a * 10.0 END, 9) AS age_years
    FROM (SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 11 = 0 THEN '5d' WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey % 500 AS VARCHAR) || '.5' END AS DOUBLE) AS a, ['YR', 'MON', 'WK', 'DY', 'HR', 'DEC', 'XX'][1 + o_orderkey % 7] AS u FROM orders)""")  # fmt: skip
def age_unit_norm(spark, sf_dir):
    k = F.col("o_orderkey")
    age = F.when(k % 11 == 0, "5d").when(k % 13 == 0, "x").otherwise(F.concat((k % 500).cast("string"), F.lit(".5")))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("YR", "MON", "WK", "DY", "HR", "DEC", "XX")]), (1 + k % 7).cast("int"))
    return P.table(spark, sf_dir, "orders").select(k.alias("report"), F.round(C.age_years(age, unit), 9).alias("age_years"))


@query("""SELECT report, round(CASE WHEN kg BETWEEN 0.2 AND 500 THEN kg END, 9) AS weight_kg FROM (SELECT o_orderkey AS report, CASE ['KG', 'LBS', 'G', 'OZ'][1 + o_orderkey % 4] WHEN 'KG' THEN w WHEN 'LBS' THEN w * 0.45359237 WHEN 'G' THEN w / 1000.0 WHEN 'OZ' THEN w * 0.028349523125 END AS kg
    FROM (SELECT o_orderkey, floor(o_totalprice / 1000.0) AS w FROM orders))""")  # fmt: skip
def weight_norm(spark, sf_dir):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("KG", "LBS", "G", "OZ")]), (1 + k % 4).cast("int"))
    return P.table(spark, sf_dir, "orders").select(k.alias("report"), F.round(C.weight_kg(F.floor(F.col("o_totalprice") / 1000.0).cast("string"), unit), 9).alias("weight_kg"))


@query("""SELECT o_orderkey AS report, coalesce(TRY_STRPTIME(a, '%Y%m%d')::DATE, TRY_STRPTIME(b, '%Y%m%d')::DATE, TRY_STRPTIME(q, '%Y%m%d')::DATE) AS report_date FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '20231340' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y%m%d') END AS a,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') END AS b, year(o_orderdate) || ['0331', '0630', '0930', '1231'][quarter(o_orderdate)] AS q FROM orders)""")  # fmt: skip
def report_date_coalesce(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    quarter = F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate"))
    fda = F.when(k % 3 == 0, "20231340").when(k % 3 == 1, d)
    return P.table(spark, sf_dir, "orders").select(k.alias("report"), C.report_date(fda, F.when(k % 2 == 0, d), F.lit(None).cast("string"), quarter).alias("report_date"))


@query(_sql(P.REPORTS, "aged AS (SELECT report, split, CASE WHEN report % 4 <> 0 THEN report % 100 + 0.5 END AS age_years FROM reports)", select="""SELECT report, round(age, 9)::DOUBLE AS age_imputed, CASE WHEN age < 18 THEN 1 ELSE 0 END AS under_18, CASE WHEN age BETWEEN 18 AND 40 THEN 1 ELSE 0 END AS band_18_40, CASE WHEN age BETWEEN 41 AND 64 THEN 1 ELSE 0 END AS band_41_64,
    CASE WHEN age >= 65 THEN 1 ELSE 0 END AS band_65 FROM (SELECT report, coalesce(age_years, (SELECT median(age_years) FROM aged WHERE split = 'train')) AS age FROM aged)"""))  # fmt: skip
def train_median_impute(spark, sf_dir):
    k = F.col("report")
    rows = P.reports(spark, sf_dir).select("report", "split", F.when(k % 4 != 0, k % 100 + 0.5).alias("age_years"), F.lit(None).cast("string").alias("weight"), F.lit("KG").alias("weight_unit"), F.lit(1).alias("num_drugs"))
    d = FE.demographics(rows)
    return d.select("report", F.round("age_imputed", 9).alias("age_imputed"), F.col("age_band_under_18").alias("under_18"), F.col("age_band_18_40").alias("band_18_40"), F.col("age_band_41_64").alias("band_41_64"), F.col("age_band_65_plus").alias("band_65"))


# --- features ----------------------------------------------------------------------------------------------------------

_ATC_ROWS = """long AS (SELECT DISTINCT e.report, e.dc_id, code FROM exposures e JOIN (SELECT dc_id, unnest(string_split(atc_code, '|')) AS code FROM codes) USING (dc_id) WHERE regexp_matches(code, '^[A-Z][0-9]{2}')),
    lv AS (SELECT report, dc_id, substr(code, 1, 1) AS l1, CASE WHEN length(code) >= 3 THEN substr(code, 1, 3) END AS l2, CASE WHEN length(code) >= 4 THEN substr(code, 1, 4) END AS l3, CASE WHEN length(code) >= 5 THEN substr(code, 1, 5) END AS l4 FROM long)"""
_ATC_COUNTS = ", ".join(f"count(DISTINCT dc_id) FILTER (l1 = '{x}') AS count_{x.lower()}" for x in string.ascii_uppercase)


@query(_sql(P.EXPOSURES, P.CODES, _ATC_ROWS, select=f"""SELECT m.*, coalesce(d1.n, 0)::BIGINT AS therapeutic_duplicates_l1, coalesce(d2.n, 0)::BIGINT AS therapeutic_duplicates_l2 FROM (SELECT report, count(DISTINCT l1) AS atc_l1_diversity, count(DISTINCT l2) AS atc_l2_diversity, count(DISTINCT l3) AS atc_l3_diversity, count(DISTINCT l4) AS atc_l4_diversity, {_ATC_COUNTS},
    count(DISTINCT dc_id) FILTER (l1 IN ('N', 'B', 'C', 'M')) AS num_high_risk_atc, count(DISTINCT dc_id) FILTER (l3 IN ('N02A', 'B01A', 'M01A', 'A10A')) AS num_high_risk_atc_groups FROM lv GROUP BY report) m
    LEFT JOIN (SELECT report, sum(greatest(k - 1, 0)) AS n FROM (SELECT report, l1, count(DISTINCT dc_id) AS k FROM lv GROUP BY ALL) GROUP BY report) d1 USING (report)
    LEFT JOIN (SELECT report, sum(greatest(k - 1, 0)) AS n FROM (SELECT report, l2, count(DISTINCT dc_id) AS k FROM lv WHERE l2 IS NOT NULL GROUP BY ALL) GROUP BY report) d2 USING (report)"""))  # fmt: skip
def atc_hierarchy_counts(spark, sf_dir):
    return FE.atc_features(FE.atc_rows(P.exposures(spark, sf_dir), P.codes(spark, sf_dir)), P.parts(spark, sf_dir))


_EXPOSURE_SQL = ", ".join([
    "count(DISTINCT nullif(route, ''))::INTEGER AS exposure_route_diversity", "round(avg((route <> '')::INTEGER), 9) AS exposure_route_documented_fraction",
    *[f"max(regexp_matches(route, '{x}'))::INTEGER AS exposure_has_{k}_route" for k, x in V.ROUTES.items()],
    "round(avg((amount IS NOT NULL OR unit <> '')::INTEGER), 9) AS exposure_dose_documented_fraction", "count(DISTINCT nullif(unit, ''))::INTEGER AS exposure_dose_unit_diversity",
    "count(DISTINCT nullif(form, ''))::INTEGER AS exposure_dose_form_diversity", *[f"max(regexp_matches(form, '{x}'))::INTEGER AS exposure_has_{k}_form" for k, x in V.FORMS.items()],
    "round(avg((freq <> '')::INTEGER), 9) AS exposure_frequency_documented_fraction", "count(DISTINCT nullif(freq, ''))::INTEGER AS exposure_frequency_diversity",
])


@query(_sql(P.REPORTS, P.DOSES, "norm AS (SELECT DISTINCT primaryid, upper(trim(drugname)) AS drug, upper(trim(coalesce(route, ''))) AS route, TRY_CAST(dose_amt AS DOUBLE) AS amount, upper(trim(dose_unit)) AS unit, upper(trim(dose_form)) AS form, upper(trim(dose_freq)) AS freq FROM edges)", select=f"SELECT primaryid, {_EXPOSURE_SQL} FROM norm GROUP BY primaryid"))
def exposure_documentation(spark, sf_dir):
    return _rounded(FE.exposure_features(P.dose_edges(spark, sf_dir)), 9, "exposure_route_documented_fraction", "exposure_dose_documented_fraction", "exposure_frequency_documented_fraction")


_UNIT = "regexp_replace(replace(replace(replace(upper(replace(replace(trim(coalesce(dose_unit, '')), 'µ', 'U'), 'μ', 'U')), '²', '2'), '**', ''), '^', ''), '[\\s.]', '', 'g')"
_DIM_SQL = "CASE u " + " ".join(f"WHEN '{u}' THEN '{d}'" for d, _, us in V.DOSE_UNITS for u in us) + " END"
_FACTOR_SQL = "CASE u " + " ".join(f"WHEN '{u}' THEN {f!r}::DOUBLE" for _, f, us in V.DOSE_UNITS for u in us) + " END"
_DAY_SQL = "CASE f " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in V.PER_DAY.items()) + " END"
_LABEL_SQL = "CASE dose_dimension " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.BASE_UNITS.items()) + " END"
_CANON = f"""tok AS (SELECT *, {_UNIT} AS u, regexp_replace(upper(trim(coalesce(dose_freq, ''))), '[\\s.]', '', 'g') AS f FROM edges),
    dims AS (SELECT *, {_DIM_SQL} AS dose_dimension, {_FACTOR_SQL} AS factor, {_DAY_SQL} AS administrations_per_day, TRY_CAST(dose_amt AS DOUBLE) AS n FROM tok),
    canon AS (SELECT * EXCLUDE (u, f, factor, n), CASE WHEN n > 0 THEN n * factor END AS canonical_amount, CASE WHEN n > 0 THEN n * factor * administrations_per_day END AS canonical_daily_amount FROM dims)"""
_MAP = "mapping AS (SELECT faers_raw, count(DISTINCT dc_id) FILTER (dc_id > 0) AS positive_ids, CASE WHEN count(DISTINCT dc_id) FILTER (dc_id > 0) = 1 THEN max(dc_id) FILTER (dc_id > 0) END AS dc_id FROM dictionary GROUP BY faers_raw)"
_ELIG = "elig AS (SELECT c.*, coalesce(m.positive_ids, 0) AS positive_ids, m.dc_id, CASE WHEN m.positive_ids = 1 AND m.dc_id IS NOT NULL AND canonical_amount IS NOT NULL THEN 1 ELSE 0 END AS eligible FROM canon c LEFT JOIN mapping m USING (faers_raw))"
_DOSE = (P.REPORTS, P.DOSES, P.DICTIONARY, _CANON, _MAP, _ELIG)


def _eligible(spark, sf_dir):
    return DO.eligible(DO.canonical(P.dose_edges(spark, sf_dir)), DO.single_ingredient(P.dictionary(spark, sf_dir)))


@query(_sql(*_DOSE, select=f"SELECT primaryid, l_partkey, dose_amt, dose_dimension, administrations_per_day, round(canonical_amount, 9) AS canonical_amount, round(canonical_daily_amount, 9) AS canonical_daily_amount, {_LABEL_SQL} AS canonical_unit, positive_ids, dc_id, eligible FROM elig"))
def dose_canonical(spark, sf_dir):
    return _rounded(_eligible(spark, sf_dir), 9, "canonical_amount", "canonical_daily_amount").select("primaryid", "l_partkey", "dose_amt", "dose_dimension", "administrations_per_day", "canonical_amount", "canonical_daily_amount", "canonical_unit", "positive_ids", "dc_id", "eligible")


def _refs(tag: str, keys: str) -> str:
    cols = ", ".join(f"count({c}) AS {p}_support, median(ln({c})) AS {p}_median, quantile_cont(ln({c}), 0.25) AS {p}_q25, quantile_cont(ln({c}), 0.75) AS {p}_q75, quantile_cont(ln({c}), 0.75) - quantile_cont(ln({c}), 0.25) AS {p}_iqr, quantile_cont(ln({c}), 0.9) AS {p}_p90" for p, c in (("amount", "canonical_amount"), ("daily", "canonical_daily_amount")))
    return f"{tag} AS (SELECT {keys}, {cols} FROM elig WHERE split = 'train' AND eligible = 1 GROUP BY {keys})"


_REF_COLUMNS = [f"{p}_{c}" for p in ("amount", "daily") for c in ("median", "q25", "q75", "iqr", "p90")]


@query(_sql(*_DOSE, _refs("drug", "dc_id, dose_dimension"), select="SELECT dc_id, dose_dimension, amount_support, daily_support, " + ", ".join(f"round({c}, 9) AS {c}" for c in _REF_COLUMNS) + " FROM drug"))
def dose_reference_lookup(spark, sf_dir):
    return _rounded(DO.references(_eligible(spark, sf_dir), ["dc_id", "dose_dimension"]), 9, *_REF_COLUMNS)


def _relative_sql() -> str:
    parts = []
    for p, c, r, a in (("amount", "canonical_amount", "relative_log_amount", "above_train_p90"), ("daily", "canonical_daily_amount", "relative_log_daily_amount", "above_train_daily_p90")):
        own, wide = f"(coalesce(d.{p}_support, 0) >= 20 AND d.{p}_iqr > 1e-12)", f"(coalesce(g.{p}_support, 0) > 0)"
        pick = lambda x: f"CASE WHEN {own} THEN d.{p}_{x} WHEN {wide} THEN g.{p}_{x} END"  # noqa: B023, E731
        ok = f"e.eligible = 1 AND e.{c} IS NOT NULL AND ({own} OR {wide})"
        width = f"CASE WHEN ({pick('iqr')}) > 1e-12 THEN ({pick('iqr')}) ELSE 1.0 END"
        parts += [f"CASE WHEN {ok} THEN least(greatest((ln(e.{c}) - ({pick('median')})) / ({width}), -10.0), 10.0) END AS {r}", f"CASE WHEN {ok} THEN (ln(e.{c}) > ({pick('p90')}) + 1e-12)::INTEGER END AS {a}"]
    return f"rel AS (SELECT e.*, {', '.join(parts)} FROM elig e LEFT JOIN drug d ON e.dc_id = d.dc_id AND e.dose_dimension = d.dose_dimension LEFT JOIN dim g ON e.dose_dimension = g.dose_dimension)"


_REL = (*_DOSE, _refs("drug", "dc_id, dose_dimension"), _refs("dim", "dose_dimension"), _relative_sql())


@query(_sql(*_REL, select="SELECT primaryid, l_partkey, dose_amt, round(relative_log_amount, 8) AS relative_log_amount, round(relative_log_daily_amount, 8) AS relative_log_daily_amount FROM rel"))
def dose_relative(spark, sf_dir):
    return _rounded(DO.relative(_eligible(spark, sf_dir)), 8, "relative_log_amount", "relative_log_daily_amount").select("primaryid", "l_partkey", "dose_amt", "relative_log_amount", "relative_log_daily_amount")


_PATIENT_DOSE = ", ".join([
    "round(count(canonical_amount)::DOUBLE / count(*), 9) AS dose_normalized_numeric_fraction", "round(count(canonical_daily_amount)::DOUBLE / count(*), 9) AS dose_normalized_scheduled_fraction",
    "round(count(relative_log_amount)::DOUBLE / count(*), 9) AS dose_normalized_relative_available_fraction", "round(coalesce(avg(relative_log_amount), 0.0), 8) AS dose_normalized_relative_log_mean",
    "count(DISTINCT nullif(faers_raw, '')) FILTER (par)::INTEGER AS dose_normalized_num_parenteral_drugs", "round(coalesce(count(DISTINCT nullif(faers_raw, '')) FILTER (par)::DOUBLE / nullif(count(DISTINCT nullif(faers_raw, '')), 0), 0.0), 9) AS dose_normalized_parenteral_fraction",
    *[f"max(regexp_matches(rt, '{x}'))::INTEGER AS dose_normalized_has_{k}" for k, x in V.DOSE_ROUTES.items()],
])


@query(_sql(*_REL, f"flags AS (SELECT *, upper(trim(coalesce(route, ''))) AS rt, regexp_matches(upper(trim(coalesce(route, ''))), '{V.DOSE_PARENTERAL}') AS par FROM rel)", select=f"SELECT primaryid, {_PATIENT_DOSE} FROM flags GROUP BY primaryid"))
def dose_patient(spark, sf_dir):
    p = "dose_normalized_"
    d = DO.patient_features(DO.relative(_eligible(spark, sf_dir)))
    keep = ["numeric_fraction", "scheduled_fraction", "relative_available_fraction", "relative_log_mean", "num_parenteral_drugs", "parenteral_fraction", "has_iv", "has_sc", "has_im"]
    d = _rounded(_rounded(d, 9, f"{p}numeric_fraction", f"{p}scheduled_fraction", f"{p}relative_available_fraction", f"{p}parenteral_fraction"), 8, f"{p}relative_log_mean")
    return d.select("primaryid", *[p + k for k in keep])


_TERMS = "terms AS (SELECT l_orderkey AS report, CASE WHEN p_size % 5 = 0 THEN 'breast cancer ' WHEN p_size % 5 = 1 THEN 'Heart ' WHEN p_size % 5 = 2 THEN 'viral infection ' ELSE '' END || p_name AS indication FROM lineitem JOIN part ON p_partkey = l_partkey)"
_VOCAB = "vocab AS (SELECT indication, CAST(('0x' || substr(md5(indication), 1, 8))::BIGINT % 32 AS INTEGER) AS hash_bin, " + ", ".join(f"regexp_matches(indication, '{x}')::INTEGER AS has_{k}" for k, x in V.INDICATIONS.items()) + " FROM (SELECT DISTINCT upper(trim(indication)) AS indication FROM terms JOIN reports USING (report) WHERE split = 'train'))"


def _terms(spark, sf_dir):
    s = F.col("p_size") % 5
    term = F.concat(F.when(s == 0, "breast cancer ").when(s == 1, "Heart ").when(s == 2, "viral infection ").otherwise(""), "p_name")
    part = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), term.alias("indication"))
    return P.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("report"), "indication")


def _vocabulary(spark, sf_dir):
    return FE.indication_vocabulary(_terms(spark, sf_dir).join(P.reports(spark, sf_dir).where("split = 'train'").select("report"), "report"))


@query(_sql(P.REPORTS, _TERMS, _VOCAB, select="SELECT * FROM vocab"))
def indication_vocab_hash(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


@query(_sql(P.REPORTS, _TERMS, _VOCAB, select="SELECT report, " + ", ".join(f"max(has_{k}) AS has_{k}" for k in V.INDICATIONS) + ", " + ", ".join(f"count(*) FILTER (hash_bin = {b}) AS indication_hash_{b:02d}" for b in range(32)) + " FROM (SELECT DISTINCT report, upper(trim(indication)) AS indication FROM terms) JOIN vocab USING (indication) GROUP BY report"))
def indication_features(spark, sf_dir):
    return FE.indication_features(_terms(spark, sf_dir), _vocabulary(spark, sf_dir), parts=P.parts(spark, sf_dir))


# --- names -------------------------------------------------------------------------------------------------------------

_DIRTY = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' 500MG' WHEN 1 THEN p_name || ' ER 5 mg' WHEN 2 THEN p_name || ' Hydrochloride Oral Tablet' ELSE p_name || ' (CAPSULE)' END"


def _dirty():
    k = F.col("p_partkey") % 4
    n = F.col("p_name")
    return F.when(k == 0, F.concat(F.upper(n), F.lit(" 500MG"))).when(k == 1, F.concat(n, F.lit(" ER 5 mg"))).when(k == 2, F.concat(n, F.lit(" Hydrochloride Oral Tablet"))).otherwise(F.concat(n, F.lit(" (CAPSULE)")))


@query(f"SELECT p_partkey AS part, {_DIRTY} AS faers_raw, upper(p_name) AS name FROM part")
def name_normalised(spark, sf_dir):
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), _dirty().alias("faers_raw"), C.drug_name(_dirty()).alias("name"))


@query(f"""WITH canon AS (SELECT upper(p_name) AS alias, min(p_partkey % 50) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(DISTINCT p_partkey % 50) = 1),
    canon_any AS (SELECT DISTINCT upper(p_name) AS alias FROM part WHERE p_partkey % 2 = 0),
    syn AS (SELECT upper(p_brand || ' ' || p_name) AS alias, min(p_partkey % 50) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 50) = 1),
    known AS (SELECT regexp_replace(alias, '[^A-Z0-9]+', ' ', 'g') AS alias, id FROM canon UNION ALL SELECT regexp_replace(alias, '[^A-Z0-9]+', ' ', 'g'), id FROM syn WHERE alias NOT IN (SELECT alias FROM canon_any)),
    raw AS (SELECT DISTINCT p_brand || ' ' || p_name AS faers_raw FROM part)
    SELECT faers_raw, id AS dc_id FROM raw LEFT JOIN known ON regexp_replace(upper(faers_raw), '[^A-Z0-9]+', ' ', 'g') = alias""")  # fmt: skip
def name_exact_mapping(spark, sf_dir):
    p = P.table(spark, sf_dir, "part")
    known = NA.aliases(p.where("p_partkey % 2 = 0").select((F.col("p_partkey") % 50).alias("id"), F.col("p_name").alias("name")), p.select((F.col("p_partkey") % 50).alias("id"), F.concat("p_brand", F.lit(" "), "p_name").alias("name")))
    rows = p.select(F.concat("p_brand", F.lit(" "), "p_name").alias("faers_raw"), F.lit(None).cast("string").alias("prod_ai"))
    return NA.exact_cascade(rows, known).select("faers_raw", F.try_element_at("ids", F.lit(1)).alias("dc_id"))


_FUZZY = "100.0 * (1 - levenshtein(name, alias)::DOUBLE / greatest(length(name), length(alias)))"


@query(f"""WITH alias AS (SELECT DISTINCT upper(p_name) AS alias FROM part), asked AS (SELECT DISTINCT upper(p_name) || 'S' AS name FROM part),
    scored AS (SELECT name, alias, {_FUZZY} AS score FROM asked JOIN alias ON substr(name, 1, 1) = substr(alias, 1, 1)),
    ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY name ORDER BY score DESC, alias DESC))
    SELECT name, alias, round(score, 9) AS score FROM ranked WHERE r = 1 AND score >= 90 AND score - coalesce(second, 0) >= 3""")  # fmt: skip
def fuzzy_block_match(spark, sf_dir):
    """With the edit-distance scorer, which is JVM-side; blocks and margins are those of any scorer."""
    p = P.table(spark, sf_dir, "part").select("p_name").distinct()
    misspelt = p.select(F.concat(F.upper("p_name"), F.lit("S")).alias("name"))
    return _rounded(NA.fuzzy(misspelt, p.select(F.upper("p_name").alias("alias")), 90, 3, EDITS, 87), 9, "score")


# --- graph -------------------------------------------------------------------------------------------------------------

_UNKNOWN = "unknown AS (SELECT faers_raw, n, rank FROM (SELECT faers_raw, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, faers_raw) AS INTEGER) AS rank FROM edges WHERE split = 'train' AND faers_raw NOT IN (SELECT faers_raw FROM mapped_names) GROUP BY faers_raw) WHERE rank <= 20)"
_MAPPED = "mapped_names AS (SELECT DISTINCT faers_raw FROM dictionary WHERE dc_id > 0)"
_NODES = """nodes AS (SELECT CAST(row_number() OVER (ORDER BY kind, semantic_id) - 1 AS BIGINT) AS node_index, semantic_id, node_label, node_kind FROM (
    SELECT 0 AS kind, dc_id AS semantic_id, 'DC:' || dc_id AS node_label, 'mapped' AS node_kind FROM (SELECT DISTINCT dc_id FROM dictionary WHERE dc_id > 0)
    UNION ALL SELECT 1, CAST((SELECT max(dc_id) FROM dictionary) + rank AS BIGINT), faers_raw, 'frequent_unknown' FROM unknown UNION ALL SELECT 2, -1, 'OTHER', 'other'))"""
_GRAPH_EDGES = """links AS (SELECT DISTINCT primaryid AS patient_index, node_index FROM (SELECT primaryid, dc_id AS semantic_id FROM edges JOIN dictionary USING (faers_raw) WHERE dc_id > 0
    UNION ALL SELECT primaryid, coalesce((SELECT max(dc_id) FROM dictionary) + rank, -1) FROM edges LEFT JOIN unknown USING (faers_raw) WHERE faers_raw NOT IN (SELECT faers_raw FROM mapped_names)) JOIN nodes USING (semantic_id))"""
_GRAPH = (P.REPORTS, P.DOSES, P.DICTIONARY, _MAPPED, _UNKNOWN, _NODES, _GRAPH_EDGES)


def _graph(spark, sf_dir):
    edges = P.dose_edges(spark, sf_dir).select(F.col("primaryid").alias("patient_index"), "split", "faers_raw")
    dictionary = P.dictionary(spark, sf_dir)
    mapped = dictionary.where("dc_id > 0")
    unknown = GR.checkpointed(NA.unmapped_by_frequency(edges, mapped, 20))
    nodes = GR.drug_nodes(mapped.select("dc_id").distinct(), unknown)
    return edges.select("patient_index", "faers_raw"), unknown, nodes, dictionary


@query(_sql(P.REPORTS, P.DOSES, P.DICTIONARY, _MAPPED, _UNKNOWN, select="SELECT * FROM unknown"))
def top_unknown_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(_sql(P.REPORTS, P.DOSES, P.DICTIONARY, _MAPPED, _UNKNOWN, _NODES, select="SELECT * FROM nodes"))
def drug_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


@query(_sql(*_GRAPH, select="SELECT * FROM links"))
def graph_edges(spark, sf_dir):
    edges, unknown, nodes, dictionary = _graph(spark, sf_dir)
    return GR.graph_edges(edges, dictionary, unknown, nodes)


_LINKS = "links AS (SELECT DISTINCT l_orderkey AS patient_index, CAST(substr(p_brand, 7, 2) AS BIGINT) + 100 * (p_size % 4) AS node_index FROM lineitem JOIN part ON p_partkey = l_partkey)"
_WEIGHTS = "weights AS (SELECT x.node_index AS n1, y.node_index AS n2, count(*) AS weight FROM links x JOIN links y ON x.patient_index = y.patient_index AND x.node_index <> y.node_index GROUP BY ALL)"
_DEGREE = "deg AS (SELECT node_index, count(*) AS degree FROM links GROUP BY node_index)"


def _links(spark, sf_dir):
    node = F.substring("p_brand", 7, 2).cast("bigint") + 100 * (F.col("p_size") % 4)
    part = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), node.alias("node_index"))
    return RG.dealt(P.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("patient_index"), "node_index"), "patient_index", P.parts(spark, sf_dir)).distinct()


@query(_sql(_LINKS, _DEGREE, select="SELECT * FROM deg"))
def drug_degree(spark, sf_dir):
    return GR.degree(_links(spark, sf_dir))


@query(_sql(_LINKS, _WEIGHTS, select="SELECT * FROM weights"))
def cooccurrence(spark, sf_dir):
    return GR.cooccurrence(_links(spark, sf_dir))


_RISK = "risk AS (SELECT node_index, avg(is_serious) AS risk FROM links JOIN reports ON report = patient_index WHERE split = 'train' GROUP BY node_index)"


def _node_risk(spark, sf_dir):
    train = P.reports(spark, sf_dir).where("split = 'train'").select(F.col("report").alias("patient_index"), "is_serious")
    return _links(spark, sf_dir).join(train, "patient_index").groupBy("node_index").agg(F.avg("is_serious").alias("risk"))


@query(_sql(P.REPORTS, _LINKS, _WEIGHTS, _RISK, select="SELECT r.node_index, round(coalesce(m, 0.0), 9) AS neighbour_risk FROM risk r LEFT JOIN (SELECT n1, sum(weight * risk) / sum(weight) AS m FROM weights JOIN risk ON node_index = n2 GROUP BY n1) ON n1 = r.node_index"))
def neighbor_ror(spark, sf_dir):
    return _rounded(GR.neighbour_mean(GR.cooccurrence(_links(spark, sf_dir)), _node_risk(spark, sf_dir), "risk"), 9, "neighbour_risk")


def _step(k: int) -> str:
    return f"r{k} AS (SELECT p.node_index, 0.7 * p.risk + 0.3 * coalesce(m, 0.0) AS risk FROM r{k - 1} p LEFT JOIN (SELECT n1, sum(weight * risk) / sum(weight) AS m FROM weights JOIN r{k - 1} ON node_index = n2 GROUP BY n1) ON n1 = p.node_index)"


@query(_sql(P.REPORTS, _LINKS, _WEIGHTS, _RISK, "r0 AS (SELECT * FROM risk)", _step(1), _step(2), _step(3), select="SELECT node_index, round(risk, 9) AS risk FROM r3"))
def propagated_risk(spark, sf_dir):
    return _rounded(GR.propagated(GR.checkpointed(GR.cooccurrence(_links(spark, sf_dir))), _node_risk(spark, sf_dir), "risk"), 9, "risk")


_RING = "ring AS (SELECT s_suppkey AS n1, (s_suppkey + 10) % (SELECT count(*) FROM supplier) AS n2 FROM supplier WHERE s_suppkey % 3 <> 0)"


@query(f"""WITH RECURSIVE {_RING}, both_ways AS (SELECT n1, n2 FROM ring UNION SELECT n2, n1 FROM ring), reach AS (SELECT s_suppkey AS node_index, s_suppkey AS component FROM supplier UNION SELECT b.n2, r.component FROM reach r JOIN both_ways b ON b.n1 = r.node_index)
    SELECT node_index, min(component) AS component FROM reach GROUP BY node_index""")  # fmt: skip
def connected_components(spark, sf_dir):
    s = P.table(spark, sf_dir, "supplier")
    n = s.agg(F.count(F.lit(1))).scalar()
    ring = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("n1"), ((F.col("s_suppkey") + 10) % n).alias("n2"))
    return GR.components(s.select(F.col("s_suppkey").alias("node_index")), ring.unionByName(ring.select(F.col("n2").alias("n1"), F.col("n1").alias("n2"))))


@query(_sql(P.REPORTS, _LINKS, _RISK, select="SELECT o_orderkey AS patient_index, round(coalesce(avg(risk), 0.0), 9) AS risk_mean, round(coalesce(max(risk), 0.0), 9) AS risk_max FROM orders LEFT JOIN (links JOIN risk USING (node_index)) ON patient_index = o_orderkey GROUP BY o_orderkey"))
def patient_graph_pooling(spark, sf_dir):
    patients = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patient_index"))
    return _rounded(GR.pooled(_links(spark, sf_dir), patients, _node_risk(spark, sf_dir), ["risk"]), 9, "risk_mean", "risk_max")


@query(_sql(_LINKS, _DEGREE, select="SELECT o_orderkey AS patient_index, coalesce(b, -1)::BIGINT AS bucket FROM orders LEFT JOIN (SELECT patient_index, first(node_index ORDER BY degree DESC, node_index) AS b FROM links JOIN deg USING (node_index) GROUP BY patient_index) ON patient_index = o_orderkey"))
def primary_bucket(spark, sf_dir):
    return GR.primary_drug(_links(spark, sf_dir), P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patient_index")), -1)


@query(_sql(P.REPORTS, select="SELECT report, report_date, row_number() OVER (ORDER BY report_date, report) - 1 AS patient_index FROM reports"))
def patient_index(spark, sf_dir):
    return GR.dense_index(P.reports(spark, sf_dir).select("report", "report_date"), [F.asc_nulls_last("report_date"), F.asc("report")], "patient_index")


@query(_sql(P.REPORTS, select="""SELECT is_serious, report FROM (SELECT *, count(*) OVER (PARTITION BY is_serious) AS n, row_number() OVER (PARTITION BY is_serious ORDER BY report) - 1 AS k FROM reports) WHERE n <= 500 OR floor((k + 1) * 500.0 / n) > floor(k * 500.0 / n)"""))
def systematic_sample(spark, sf_dir):
    return GR.systematic_sample(P.reports(spark, sf_dir).select("is_serious", "report"), "is_serious", "report", 500)


_POINTS = "points AS (SELECT c_acctbal AS x, (c_custkey % 97)::DOUBLE AS y, (c_nationkey % 2)::BIGINT AS label FROM customer)"


@query(_sql(_POINTS, "box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points)", select="SELECT CAST(least(floor((x - x0) * 4 / (x1 - x0)), 3) AS INTEGER) AS cx, CAST(least(floor((y - y0) * 4 / (y1 - y0)), 3) AS INTEGER) AS cy, count(*) AS n, sum(label)::BIGINT AS positives, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM points, box GROUP BY 1, 2"))
def lod_grid(spark, sf_dir):
    return GR.grid_cells(P.table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), (F.col("c_nationkey") % 2).cast("bigint").alias("label")))


@query("SELECT l_returnflag AS grp, l_partkey AS drug, n FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_partkey) <= 10")
def top_k_drugs(spark, sf_dir):
    counts = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("drug")).agg(F.count(F.lit(1)).alias("n"))
    return GR.top_per_group(counts, "grp", [F.desc("n"), F.asc("drug")], 10)


# --- vectors and evaluation --------------------------------------------------------------------------------------------


@query(_sql(P.REPORTS, "base AS (SELECT report, split, CASE WHEN report % 4 <> 0 THEN report % 130 END AS age, ['M', 'F', 'UNKNOWN'][1 + report % 3] AS sex, report % 70 AS num_drugs FROM reports)", select="""SELECT report, round(least(greatest(coalesce(age, (SELECT median(age) FROM base WHERE split = 'train')) / 120.0, 0.0), 1.0), 6) AS age_n, (sex = 'M')::DOUBLE AS male, round(least(num_drugs / 50.0, 1.0), 6) AS drugs_n FROM base"""))
def patient_feature_vector(spark, sf_dir):
    k = F.col("report")
    sex = F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("UNKNOWN")), (1 + k % 3).cast("int"))
    rows = P.reports(spark, sf_dir).select("report", "split", F.when(k % 4 != 0, k % 130).alias("age"), sex.alias("sex"), (k % 70).alias("num_drugs"))
    part = lambda i: F.col("features")[i].cast("double")
    return FE.patient_vector(rows).select("report", F.round(part(0), 6).alias("age_n"), part(1).alias("male"), F.round(part(2), 6).alias("drugs_n"))


@query(_sql(P.REPORTS, P.EXPOSURES, _TRAIN, _CELLS.format(r="train"), _LOOKUP, P.CODES, select="SELECT dc_id, round((ln(ror) - (SELECT avg(ln(ror)) FROM lookup)) / (SELECT stddev_pop(ln(ror)) FROM lookup), 8) AS log_ror_z, regexp_matches(atc_code, '(^|[|])N')::INTEGER AS atc_n, regexp_matches(atc_code, '(^|[|])S')::INTEGER AS atc_s FROM lookup JOIN codes USING (dc_id)"))
def drug_feature_vector(spark, sf_dir):
    lookup = RI.risk_lookup(P.exposures(spark, sf_dir), P.reports(spark, sf_dir), "dc_id").select("dc_id", F.log("ror").alias("log_ror"), F.lit("train").alias("split"))
    z = EV.standardised(lookup, ["log_ror"]).join(P.codes(spark, sf_dir), "dc_id")
    return z.select("dc_id", F.round("log_ror_z", 8).alias("log_ror_z"), *[F.col("atc_code").rlike(rf"(^|[|]){x}").cast("int").alias(f"atc_{x.lower()}") for x in "NS"])


@query(_sql(P.REPORTS, select="SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders JOIN reports ON report = o_orderkey WHERE split = 'train')) / (SELECT stddev_pop(o_totalprice) FROM orders JOIN reports ON report = o_orderkey WHERE split = 'train'), 8) AS o_totalprice_z FROM orders"))
def standardize_train(spark, sf_dir):
    rows = P.table(spark, sf_dir, "orders").join(P.reports(spark, sf_dir).select(F.col("report").alias("o_orderkey"), "split"), "o_orderkey")
    return EV.standardised(rows, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_z", 8).alias("o_totalprice_z"))


@query(_sql(P.SCORES, select="SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc FROM (SELECT label, avg(k) OVER (PARTITION BY score) AS r FROM (SELECT *, row_number() OVER (ORDER BY score) AS k FROM scores))"))
def auc_rank(spark, sf_dir):
    return _rounded(EV.auc(P.scores(spark, sf_dir)), 9, "auc")


_CUTS = [k / 20 for k in range(1, 20)]


@query(_sql(P.SCORES, f"cuts AS (SELECT unnest({_CUTS})::DOUBLE AS threshold)", "t AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn FROM scores, cuts GROUP BY threshold)", select="SELECT threshold, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM t"))
def confusion_sweep(spark, sf_dir):
    return _rounded(EV.confusion(P.scores(spark, sf_dir), _CUTS), 9, "accuracy", "precision", "recall", "f1").select("threshold", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")


@query(_sql(P.SCORES, "t AS (SELECT score, sum(sum((label = 1)::INTEGER)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS n, (SELECT count(*) FROM scores WHERE label = 1) AS p FROM scores GROUP BY score)", select="SELECT 'fixed' AS policy, 0.5::DOUBLE AS threshold UNION ALL SELECT 'max_f1', first(score ORDER BY 2.0 * tp / (n + p) DESC, score DESC) FROM t UNION ALL SELECT 'recall', max(score) FROM t WHERE tp::DOUBLE / p >= 0.95"))
def threshold_policies(spark, sf_dir):
    return EV.policies(P.scores(spark, sf_dir))


@query(_sql(P.SCORES, "b AS (SELECT least(floor(score * 15), 14) AS bin, count(*) AS n, avg(score) AS c, avg(label) AS o FROM scores GROUP BY 1)", select="SELECT round((SELECT sum(n * abs(c - o)) / sum(n) FROM b), 9) AS ece, round(avg((score - label) ** 2), 9) AS brier, round(avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))), 9) AS log_loss FROM scores"))
def calibration_ece(spark, sf_dir):
    return _rounded(EV.probability_metrics(P.scores(spark, sf_dir)), 9, "ece", "brier", "log_loss")


@query(_sql(P.SCORES, "t AS (SELECT sum((label = 1)::INTEGER) AS pos, sum(sum((label = 1)::INTEGER)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS n FROM scores GROUP BY score)", select="SELECT round(sum(pos * (tp::DOUBLE / n)) / sum(pos), 9) AS auprc FROM t"))
def average_precision(spark, sf_dir):
    return _rounded(EV.average_precision(P.scores(spark, sf_dir)), 9, "auprc")


@query(_sql(P.REPORTS, select="SELECT count(*) AS rows, count(*) - count(DISTINCT report) AS duplicate_reports, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT report FROM reports)) AS orphans, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, (SELECT count(*) FROM (SELECT caseid FROM reports GROUP BY caseid HAVING count(DISTINCT split) > 1)) AS cases_in_several_splits FROM reports"))
def audit_counts(spark, sf_dir):
    r = P.reports(spark, sf_dir)
    orphans = P.table(spark, sf_dir, "lineitem").join(r, F.col("l_orderkey") == F.col("report"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    leaks = r.groupBy("caseid").agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("cases_in_several_splits"))
    main = r.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct("report")).alias("duplicate_reports"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    return main.crossJoin(orphans).crossJoin(leaks)


# --- models and streams ------------------------------------------------------------------------------------------------


def _exposures_once(spark, sf_dir):
    """Exposures that are read more than once: made distinct once and written."""
    folder = f"{_stream_folder(spark)}-exposures"
    P.exposures(spark, sf_dir).write.parquet(folder)
    return spark.read.parquet(folder)


def _model_rows(spark, sf_dir, exposures):
    risk = RI.patient_risk(RI.temporal_ror(exposures, P.reports(spark, sf_dir), "dc_id"))
    orders = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), "o_totalprice")
    return P.reports(spark, sf_dir).withColumnRenamed("is_serious", "label").join(orders, "report").join(risk, "report")


@query()
def rf_baseline(spark, sf_dir):
    """Scores of all reports by a forest fitted on train: no SQL."""
    from ..operators import models

    rows = GR.checkpointed(_model_rows(spark, sf_dir, _exposures_once(spark, sf_dir)))
    return models.scored(models.fit(rows, ["o_totalprice", "max_ror", "mean_log_ror", "high_ror_count"], "forest", trees=100, depth=10), rows).select("report", "split", "label", "score")


@query()
def inductive_network(spark, sf_dir):
    """Scores of all reports by the network of two encoders, three epochs: own totals and the means of their parts' risks and
    prices. Gradients and training are held against differences and planted signals in tests, so no SQL."""
    from ..operators import inductive

    exposures = _exposures_once(spark, sf_dir)
    rows = _model_rows(spark, sf_dir, exposures)
    parts = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dc_id"), F.array(F.col("p_size").cast("double"), "p_retailprice", (F.length("p_name") % 7).cast("double")).alias("features"))
    near = exposures.join(parts, "dc_id").groupBy("report").agg(F.array(*[F.avg(F.col("features")[k]) for k in range(3)]).alias("near"))
    graph = rows.join(near, "report").select(F.col("report").alias("patient_index"), "split", "label", F.array("o_totalprice", "max_ror", "mean_log_ror", F.col("high_ror_count").cast("double")).alias("own"), "near")
    graph = GR.checkpointed(graph)
    net = inductive.fit(graph, f"{_stream_folder(spark)}-network", inductive.Settings(epochs=3, hidden=16))
    return net.scored(graph).select(F.col("patient_index").alias("report"), "split", "label", "score")


_TRAINED = """mine AS (SELECT links.* FROM links JOIN reports ON report = patient_index WHERE split = 'train'),
    weights AS (SELECT x.node_index AS n1, y.node_index AS n2, count(*) AS weight FROM mine x JOIN mine y ON x.patient_index = y.patient_index AND x.node_index <> y.node_index GROUP BY ALL),
    seen AS (SELECT node_index, avg(is_serious) AS risk, count(*) AS degree FROM mine JOIN reports ON report = patient_index GROUP BY node_index),
    r0 AS (SELECT node_index, node_index / 100.0::DOUBLE AS log_ror, coalesce(risk, 0.0) AS risk, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT node_index FROM links) LEFT JOIN seen USING (node_index))"""
_SPREAD = """near AS (SELECT n1 AS node_index, sum(weight * log_ror) / sum(weight) AS m FROM weights JOIN r0 ON node_index = n2 GROUP BY n1),
    reach AS (SELECT node_index, node_index AS component FROM r0 UNION SELECT n2, component FROM reach JOIN weights ON n1 = node_index),
    part AS (SELECT node_index, min(component) AS component FROM reach GROUP BY node_index),
    by_part AS (SELECT component, avg(risk) AS component_risk FROM part JOIN r0 USING (node_index) GROUP BY component),
    vals AS (SELECT r0.node_index, coalesce(m, 0.0) AS neighbour_log_ror, r3.risk AS propagated, component_risk, r0.degree FROM r0 JOIN r3 USING (node_index) JOIN part USING (node_index) JOIN by_part USING (component) LEFT JOIN near USING (node_index))"""
_POOLED = ("neighbour_log_ror", "propagated", "component_risk", "degree")


@query("WITH RECURSIVE " + ", ".join([P.REPORTS, _LINKS, _TRAINED, _step(1), _step(2), _step(3), _SPREAD]) + " SELECT r.report AS patient_index, " + ", ".join([f"round(coalesce(avg({c}), 0.0), 9) AS {c}_mean, round(coalesce(max({c}), 0)::DOUBLE, 9) AS {c}_max" for c in _POOLED]) + " FROM reports r LEFT JOIN (links JOIN vals USING (node_index)) l ON l.patient_index = r.report GROUP BY r.report")
def patient_graph_features(spark, sf_dir):
    """The eight columns of the graph."""
    patients = P.reports(spark, sf_dir).select(F.col("report").alias("patient_index"), "split", "is_serious")
    links = _links(spark, sf_dir)
    nodes = links.select("node_index").distinct().withColumn("log_ror", F.col("node_index") / 100.0)
    out = GR.graph_features(links, patients, nodes, parts=P.parts(spark, sf_dir))
    return out.select("patient_index", *[F.round(F.col(f"{c}_{t}").cast("double"), 9).alias(f"{c}_{t}") for c in _POOLED for t in ("mean", "max")])


def _events(spark, sf_dir):
    schema = P.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _stream_folder(spark) -> str:
    import uuid

    return f"{GR.shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def stream_latest_by_user(spark, sf_dir):
    from ..streaming import upsert

    return upsert.drained(upsert.latest_by_key(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ["value"]), _stream_folder(spark))


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    from ..streaming import upsert

    out = upsert.drained(upsert.windowed_counts(_events(spark, sf_dir), "ts", by=["event_type"]), _stream_folder(spark))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
