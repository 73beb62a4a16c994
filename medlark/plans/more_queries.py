"""More registered queries over the proxy tables, and their SQL: demographics, vectors, names, graph tables, audits, files."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort as CO
from ..operators import dose as DO
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import graph as GR
from ..operators import names as NA
from ..operators import quality as QA
from ..operators import ranges as RG
from ..operators import risk as RI
from ..operators import serving as SE
from ..sources import delimited
from . import proxy as P
from .queries import _CELLS, _DOSE, _GRAPH, _LINKS, _LOOKUP, _TRAIN, _eligible, _graph, _links, _refs, _rounded, _sql, _stream_folder, query

# --- demographics ------------------------------------------------------------------------------------------------------

_PEOPLE = """people AS (SELECT report, split, CASE WHEN report % 4 <> 0 THEN report % 130 + 0.25 END AS age_years, CAST(report % 9 + 1 AS BIGINT) AS num_drugs, CASE WHEN report % 5 <> 0 THEN CAST(report % 300 AS VARCHAR) ELSE 'n/a' END AS weight,
    ['KG', 'LB', 'GMS', ' kgs'][1 + report % 4] AS weight_unit, ['M', ' f ', 'X', NULL][1 + report % 4] AS sex FROM reports)"""


def _people(spark, sf_dir):
    k = F.col("report")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (1 + k % 4).cast("int"))
    return P.reports(spark, sf_dir).select(
        "report", "split", F.when(k % 4 != 0, k % 130 + 0.25).alias("age_years"), (k % 9 + 1).alias("num_drugs"),
        F.when(k % 5 != 0, (k % 300).cast("string")).otherwise("n/a").alias("weight"), pick("KG", "LB", "GMS", " kgs").alias("weight_unit"), pick("M", " f ", "X", None).alias("sex"),
    )


@query(_sql(P.REPORTS, _PEOPLE, select="""SELECT report, CASE WHEN upper(trim(sex)) IN ('M', 'F') THEN upper(trim(sex)) ELSE 'UNKNOWN' END AS sex, CASE WHEN upper(trim(sex)) IN ('M', 'F') THEN 0 ELSE 1 END AS sex_unknown, CASE WHEN age_years IS NULL THEN 1 ELSE 0 END AS age_missing, CAST(floor(age_years) AS INTEGER) AS age,
    CASE WHEN age_years IS NULL THEN 'UNKNOWN' WHEN age_years < 18 THEN '<18' WHEN age_years < 41 THEN '18-40' WHEN age_years < 65 THEN '41-64' ELSE '65+' END AS age_group, CASE WHEN num_drugs >= 5 THEN 1 ELSE 0 END AS is_polypharmacy FROM people WHERE age_years IS NULL OR age_years BETWEEN 0 AND 120"""))  # fmt: skip
def people_normalised(spark, sf_dir):
    rows = _people(spark, sf_dir).where(F.col("age_years").isNull() | F.col("age_years").between(0, 120))
    s = C.sex(F.col("sex"))
    return rows.select("report", s.alias("sex"), C.flag(s == "UNKNOWN").alias("sex_unknown"), C.flag(F.col("age_years").isNull()).alias("age_missing"), F.floor("age_years").cast("int").alias("age"), C.age_group(F.col("age_years")).alias("age_group"), C.flag(F.col("num_drugs") >= 5).alias("is_polypharmacy"))


_KG = """kilos AS (SELECT *, CASE WHEN kg BETWEEN 0.2 AND 500 THEN kg END AS k FROM (SELECT *, CASE upper(trim(weight_unit)) WHEN 'KG' THEN w WHEN 'KGS' THEN w WHEN 'LB' THEN w * 0.45359237 WHEN 'GMS' THEN w / 1000.0 END AS kg FROM (SELECT *, CASE WHEN TRY_CAST(weight AS DOUBLE) > 0 THEN TRY_CAST(weight AS DOUBLE) END AS w FROM people)))"""


@query(_sql(P.REPORTS, _PEOPLE, _KG, select="""SELECT report, round(least(greatest(coalesce(k, (SELECT median(k) FROM kilos WHERE split = 'train')) / 250.0, 0.0), 1.0), 9) AS weight_kg_norm, (k IS NULL)::INTEGER AS weight_missing, num_drugs * num_drugs AS num_drugs_squared,
    round(num_drugs * coalesce(age_years, (SELECT median(age_years) FROM people WHERE split = 'train')), 9)::DOUBLE AS polypharmacy_age FROM kilos"""))  # fmt: skip
def weights_and_polypharmacy(spark, sf_dir):
    d = FE.demographics(_people(spark, sf_dir))
    return d.select("report", F.round("weight_kg_norm", 9).alias("weight_kg_norm"), "weight_missing", "num_drugs_squared", F.round("polypharmacy_age", 9).alias("polypharmacy_age"))


_CODES = "codes AS (SELECT l_orderkey AS report, string_agg(DISTINCT CASE l_linestatus || l_returnflag WHEN 'OA' THEN 'DE' WHEN 'OR' THEN 'HO' WHEN 'FA' THEN 'DE' WHEN 'FN' THEN 'OT' ELSE 'DEX' END, '|') AS outcome_codes FROM lineitem GROUP BY l_orderkey)"


def _outcome_codes(spark, sf_dir):
    both = F.concat("l_linestatus", "l_returnflag")
    code = F.when(both == "OA", "DE").when(both == "OR", "HO").when(both == "FA", "DE").when(both == "FN", "OT").otherwise("DEX")
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), code.alias("code"))
    return CO.outcome_flags(rows, "report", F.col("code")).drop("is_serious")


@query(_sql(P.REPORTS, _CODES, select="SELECT report, list_contains(string_split(coalesce(outcome_codes, ''), '|'), 'DE')::INTEGER AS is_death, list_contains(string_split(coalesce(outcome_codes, ''), '|'), 'HO')::INTEGER AS is_hospitalization FROM reports LEFT JOIN codes USING (report)"))
def outcome_targets(spark, sf_dir):
    rows = P.reports(spark, sf_dir).select("report").join(_outcome_codes(spark, sf_dir), "report", "left")
    return rows.withColumns(FE.outcome_targets(F.col("outcome_codes"))).drop("outcome_codes")


@query(_sql(P.REPORTS, P.EXPOSURES, "n AS (SELECT report, count(*) AS drugs, max(dc_id) AS top_drug FROM exposures WHERE dc_id % 2 = 0 GROUP BY report)", "v AS (SELECT l_orderkey AS report, round(sum(l_quantity), 6) AS quantity, max(l_linenumber) AS lines FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey)",
    "h AS (SELECT o_orderkey AS report, o_totalprice AS price FROM orders WHERE o_totalprice > 100000)", select="SELECT report, split, coalesce(drugs, 0)::BIGINT AS drugs, coalesce(top_drug, -1)::BIGINT AS top_drug, coalesce(quantity, 0)::DOUBLE AS quantity, coalesce(lines, 0)::BIGINT AS lines, coalesce(price, 1.5)::DOUBLE AS price FROM reports LEFT JOIN n USING (report) LEFT JOIN v USING (report) LEFT JOIN h USING (report)"))
def wide_assembly(spark, sf_dir):
    """Every report once, with defaults where a feature table has no row."""
    base = P.reports(spark, sf_dir).select("report", "split")
    n = P.exposures(spark, sf_dir).where("dc_id % 2 = 0").groupBy("report").agg(F.count(F.lit(1)).alias("drugs"), F.max("dc_id").alias("top_drug"))
    v = P.table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("report")).agg(F.round(F.sum("l_quantity"), 6).alias("quantity"), F.max("l_linenumber").cast("bigint").alias("lines"))
    h = P.table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("report"), F.col("o_totalprice").alias("price"))
    out = FE.assemble(base, "report", [n, v, h], {"top_drug": -1, "price": 1.5})
    QA.require_same_rows(base, out, "report")
    return out.withColumns({c: F.col(c).cast("double") for c in ("quantity", "price")})


# --- vectors -----------------------------------------------------------------------------------------------------------


def _spread(vector: str, names: list[str], digits: int = 4):
    return [F.round(F.col(vector)[k].cast("double"), digits).alias(n) for k, n in enumerate(names)]


_LETTERS = ", ".join(f"coalesce(regexp_matches(atc_code, '(^|[|]){x.upper()}')::INTEGER::DOUBLE, 0.0) AS atc_{x}" for x in string.ascii_lowercase)


@query(_sql(P.REPORTS, P.EXPOSURES, P.CODES, _TRAIN, _CELLS.format(r="train"), _LOOKUP, "known AS (SELECT codes.*, ln(ror) AS log_ror, dc_id % 3 = 0 AS boxed FROM codes LEFT JOIN lookup USING (dc_id))", select=f"SELECT dc_id, round(coalesce((log_ror - (SELECT avg(log_ror) FROM known)) / (SELECT stddev_pop(log_ror) FROM known), 0.0)::FLOAT::DOUBLE, 4) AS log_ror, CASE WHEN dc_id % 5 = 0 THEN 0.0 ELSE boxed::INTEGER::DOUBLE END AS has_boxed_warning, {_LETTERS} FROM known"))
def drug_vectors(spark, sf_dir):
    """All 28 components."""
    k = F.col("dc_id")
    lookup = RI.risk_lookup(P.exposures(spark, sf_dir), P.reports(spark, sf_dir), "dc_id").select("dc_id", F.log("ror").alias("log_ror"))
    nodes = P.codes(spark, sf_dir).join(lookup, "dc_id", "left").withColumn("has_boxed_warning", F.when(k % 5 != 0, (k % 3 == 0).cast("int")))
    return FE.drug_vector(nodes).select("dc_id", *_spread("features", FE.DRUG_FEATURES))


@query(_sql(P.REPORTS, _PEOPLE, "v AS (SELECT report, o_totalprice AS price, CASE WHEN report % 7 = 0 THEN 'x' ELSE CAST(report % 11 AS VARCHAR) END AS code FROM reports JOIN orders ON o_orderkey = report)", select="""SELECT report, round(least(greatest(coalesce(age_years, (SELECT median(age_years) FROM people WHERE split = 'train')) / 120.0, 0.0), 1.0)::FLOAT::DOUBLE, 4) AS age, coalesce(sex = 'M', FALSE)::INTEGER::DOUBLE AS sex_m, round(least(num_drugs / 50.0, 1.0)::FLOAT::DOUBLE, 4) AS num_drugs,
    coalesce(TRY_CAST(code AS DOUBLE), 0.0) AS code, round((price / 1000000.0)::FLOAT::DOUBLE, 4) AS price FROM people JOIN v USING (report)"""))  # fmt: skip
def patient_vectors(spark, sf_dir):
    """Age, sex and drugs, then any numeric columns; what is no number counts as 0."""
    k = F.col("report")
    more = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), (F.col("o_totalprice") / 1000000.0).alias("price"))
    rows = _people(spark, sf_dir).join(more, "report").withColumns({"age": F.col("age_years"), "code": F.when(k % 7 == 0, "x").otherwise((k % 11).cast("string"))})
    return FE.patient_vector(rows, ["code", "price"]).select("report", *_spread("features", ["age", "sex_m", "num_drugs", "code", "price"]))


@query("SELECT l_linestatus AS grp, count(l_extendedprice) AS support, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{int(p * 100)}" for p in (0.1, 0.5, 0.99)) + " FROM lineitem GROUP BY l_linestatus")
def quantiles_by_group(spark, sf_dir):
    """Exact quantiles of two large groups, ranked over many tasks."""
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_extendedprice").cast("double").alias("v"))
    out = RG.quantiles(rows, "v", [0.1, 0.5, 0.99], ["grp"])
    return out.select("grp", "support", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q10", "q50", "q99"))])


@query(_sql(*_DOSE, _refs("drug", "dc_id, dose_dimension"), _refs("dim", "dose_dimension"), select="""SELECT drug.dc_id, drug.dose_dimension, drug.amount_support, round(drug.amount_median, 9) AS amount_median, round(dim.amount_median, 9) AS dim_amount_median, round(dim.daily_p90, 9) AS dim_daily_p90,
    CASE WHEN drug.amount_support >= 20 AND drug.amount_iqr > 1e-12 THEN 'drug' WHEN dim.amount_support > 0 THEN 'dimension' END AS amount_level FROM drug LEFT JOIN dim USING (dose_dimension)"""))  # fmt: skip
def dose_lookup(spark, sf_dir):
    """The frozen table that doses are scored against, with its fallback."""
    out = DO.lookup(_eligible(spark, sf_dir))
    return _rounded(out.select("dc_id", "dose_dimension", "amount_support", "amount_median", "dim_amount_median", "dim_daily_p90", "amount_level"), 9, "amount_median", "dim_amount_median", "dim_daily_p90")


# --- names -------------------------------------------------------------------------------------------------------------


@query("""SELECT p_size AS dc_id, string_agg(DISTINCT upper(trim(substr(p_brand, 1, 1) || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') || ' ')), '|' ORDER BY upper(trim(substr(p_brand, 1, 1) || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') || ' '))) AS atc_code FROM part GROUP BY p_size""")
def atc_by_structure(spark, sf_dir):
    p = P.table(spark, sf_dir, "part")
    code = F.concat(F.lower(F.substring("p_brand", 1, 1)), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"), F.lit(" "))
    return NA.atc_by_structure(p.select(F.col("p_size").cast("bigint").alias("struct_id"), code.alias("atc_code"))).select(F.col("dc_id").cast("int").alias("dc_id"), "atc_code")


@query("""WITH sections AS (SELECT ps.s_suppkey AS label_id, CASE WHEN s_suppkey % 4 = 0 THEN '34066-1' ELSE 'x' END AS code, CASE WHEN s_suppkey % 7 = 0 THEN 'The Boxed Warning of it' ELSE 'Uses' END AS title FROM supplier ps),
    labels AS (SELECT DISTINCT l_partkey AS code, l_suppkey AS label_id FROM lineitem)
    SELECT DISTINCT CAST(p_size AS BIGINT) AS dc_id FROM labels JOIN sections USING (label_id) JOIN part ON labels.code = p_partkey WHERE (upper(title) LIKE '%BOXED WARNING%' OR sections.code = '34066-1') AND p_partkey % 13 <> 0""")  # fmt: skip
def boxed_warnings(spark, sf_dir):
    s = F.col("s_suppkey")
    sections = P.table(spark, sf_dir, "supplier").select(s.alias("label_id"), F.when(s % 4 == 0, "34066-1").otherwise("x").alias("code"), F.when(s % 7 == 0, "The Boxed Warning of it").otherwise("Uses").alias("title"))
    labels = P.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ndc_product_code"), F.col("l_suppkey").alias("label_id")).distinct()
    ingredients = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ndc_product_code"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size")).alias("struct_id"))
    return NA.boxed_warnings(sections, labels, ingredients)


@query("""WITH c AS (SELECT l_orderkey AS query_name, l_linenumber // 3 AS rank, l_suppkey % 3 AS struct_id FROM lineitem), b AS (SELECT query_name, min(rank) AS rank FROM c GROUP BY 1)
    SELECT CAST(query_name AS VARCHAR) AS query_name, CAST(min(struct_id) AS BIGINT) AS struct_id FROM c JOIN b USING (query_name, rank) GROUP BY query_name HAVING count(DISTINCT struct_id) = 1""")  # fmt: skip
def name_consensus(spark, sf_dir):
    l = P.table(spark, sf_dir, "lineitem")
    return NA.consensus(l.select(F.col("l_orderkey").cast("string").alias("query_name"), F.expr("l_linenumber div 3").alias("rank"), (F.col("l_suppkey") % 3).cast("bigint").alias("struct_id")))


@query(_sql(P.REPORTS, P.DOSES, P.DICTIONARY, "seen AS (SELECT DISTINCT primaryid AS report, dc_id FROM edges JOIN dictionary ON trim(edges.faers_raw) = dictionary.faers_raw)",
    "cells AS (SELECT dc_id, a, b, s - a AS c, n - b AS d FROM (SELECT dc_id, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM seen JOIN reports USING (report) GROUP BY dc_id), (SELECT count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM reports))",
    select="SELECT faers_raw, dc_id, round(CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)) ELSE (a * d)::DOUBLE / (b * c) END, 9) AS ror FROM dictionary LEFT JOIN cells USING (dc_id)"))
def dictionary_ror(spark, sf_dir):
    """Over all splits; unmapped names share id 0 and one ROR."""
    edges = P.dose_edges(spark, sf_dir).select("primaryid", F.col("faers_raw").alias("drugname"))
    reports = P.reports(spark, sf_dir).withColumnRenamed("report", "primaryid")
    return _rounded(NA.dictionary_ror(P.dictionary(spark, sf_dir), edges, reports), 9, "ror").select("faers_raw", "dc_id", "ror")


@query("SELECT id, typed FROM (SELECT id, trim(typed) AS typed FROM (SELECT c_custkey AS id, unnest(string_split(replace(c_name || chr(10) || ' ' || c_mktsegment || ', ,' || c_name, chr(10), ','), ',')) AS typed FROM customer)) WHERE typed <> ''")
def medication_list(spark, sf_dir):
    text = F.concat("c_name", F.lit("\n "), "c_mktsegment", F.lit(", ,"), "c_name")
    return SE.parse_medications(P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("list")), "list").select("id", "typed")


#: A longest common subsequence of name and alias, row by row, and the ratio of insertions and deletions from it.
_LCS = """list_extract(list_reduce(list_prepend(list_transform(range(0, length(alias) + 1), lambda j: 0), list_transform(string_split(name, ''), lambda c: [CAST(ascii(c) AS INTEGER)])),
    lambda row, c: list_reduce(list_prepend([0], list_transform(range(1, length(alias) + 1), lambda j: [CAST(j AS INTEGER)])), lambda new, j: list_append(new, CASE WHEN ascii(substr(alias, j[1], 1)) = c[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], new[j[1]]) END))), length(alias) + 1)"""
_LABEL = "upper(p_name || ' ' || p_type || ' ' || p_brand || ' LOT ' || p_partkey)"


@query(f"""WITH alias AS (SELECT DISTINCT {_LABEL} AS alias FROM part), asked AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN left(t, k) || substr(t, k + 2) WHEN 1 THEN left(t, k) || 'X' || substr(t, k + 2) ELSE left(t, k) || substr(t, k + 1, 1) || substr(t, k + 1) END AS name
        FROM (SELECT p_partkey, {_LABEL} AS t, 3 + p_partkey % 37 AS k FROM part)),
    near AS (SELECT name AS whole, alias AS other, len(list_filter(range(1, least(length(name), length(alias)) + 1), lambda i: left(name, i) = left(alias, i))) AS p FROM asked JOIN alias ON substr(name, 1, 1) = substr(alias, 1, 1)
        WHERE abs(length(name) - length(alias)) <= 0.03 * (length(name) + length(alias)) AND levenshtein(name, alias) <= 0.035 * (length(name) + length(alias))),
    rest AS (SELECT whole, other, p, substr(whole, p + 1) AS x, substr(other, p + 1) AS y FROM near),
    inner_parts AS (SELECT whole, other, p + s AS same, left(x, length(x) - s) AS name, left(y, length(y) - s) AS alias FROM (SELECT *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: right(x, i) = right(y, i))) AS s FROM rest)),
    scored AS (SELECT whole AS name, other AS alias, 200.0 * (same + CASE WHEN name = '' OR alias = '' THEN 0 ELSE {_LCS} END) / (length(whole) + length(other)) AS score FROM inner_parts),
    ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM scored WHERE score >= 97 WINDOW w AS (PARTITION BY name ORDER BY score DESC, alias DESC))
    SELECT name, alias, round(score, 9) AS score FROM ranked WHERE r = 1 AND score - coalesce(second, 0) >= 3""")  # fmt: skip
def fuzzy_names(spark, sf_dir):
    """Misspelt labels and their nearest ones: the default scorer, cutoff and margin."""
    k, n = F.col("p_partkey"), (3 + F.col("p_partkey") % 37).cast("int")
    t = F.upper(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(" LOT "), k.cast("string")))
    labels = P.table(spark, sf_dir, "part").select(k, n.alias("n"), t.alias("t"))
    head, after = F.substr("t", F.lit(1), F.col("n")), lambda i: F.substr("t", F.col("n") + i)
    wrong = F.when(k % 3 == 0, F.concat(head, after(2))).when(k % 3 == 1, F.concat(head, F.lit("X"), after(2))).otherwise(F.concat(head, F.substr("t", F.col("n") + 1, F.lit(1)), after(1)))
    return _rounded(NA.fuzzy(labels.select(wrong.alias("name")), labels.select(F.col("t").alias("alias"))), 9, "score")


_NEAR = "100.0 * (1 - list_min(list_transform(range(1, greatest(1, length(alias) - 5 + 1) + 1), lambda i: levenshtein(substr(alias, i, 5), 'WIDGE'))) / 5.0::DOUBLE)"


@query(f"SELECT alias, round(score, 9) AS score FROM (SELECT alias, {_NEAR} AS score FROM (SELECT DISTINCT upper(p_name) AS alias FROM part)) WHERE score >= 60 ORDER BY score DESC, length(alias), alias LIMIT 10")
def name_suggestions(spark, sf_dir):
    return _rounded(NA.suggestions("widge ", P.table(spark, sf_dir, "part").select(F.upper("p_name").alias("alias")), 10, 60), 9, "score")


@query(f"SELECT alias, round(score, 9) AS score FROM (SELECT alias, {_NEAR} AS score FROM (SELECT DISTINCT upper(p_name) || ' ' || p_partkey AS alias FROM part)) WHERE score >= 60 ORDER BY score DESC, length(alias), alias LIMIT 25")
def indexed_suggestions(spark, sf_dir):
    """The same by stored postings, over an alias a part."""
    path = f"{_stream_folder(spark)}-postings"
    NA.write_postings(P.table(spark, sf_dir, "part").select(F.concat(F.upper("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("alias")), path)
    return _rounded(NA.suggestions_from("widge ", spark.read.parquet(path), 25, 60), 9, "score")


@query(_sql(P.REPORTS, P.EXPOSURES, _TRAIN, _CELLS.format(r="train"), _LOOKUP, select="""SELECT report, CAST(count(DISTINCT e.dc_id) AS INTEGER) AS num_drugs, round(max(coalesce(ror, 1.0)), 9) AS max_ror, round(avg(ln(greatest(coalesce(ror, 1.0), 1e-12))), 9) AS mean_log_ror, count(*) FILTER (coalesce(ror, 1.0) > 2) AS high_ror_count
    FROM exposures e LEFT JOIN lookup l ON l.dc_id = e.dc_id AND l.dc_id % 2 = 0 GROUP BY report"""))  # fmt: skip
def case_features(spark, sf_dir):
    """New cases by the frozen lookup; every second drug is unknown to it."""
    e = P.exposures(spark, sf_dir)
    lookup = RI.risk_lookup(e, P.reports(spark, sf_dir), "dc_id").where("dc_id % 2 = 0")
    codes = spark.createDataFrame([], "dc_id bigint, atc_code string")
    out = SE.case_features(e.select("report").distinct(), e, lookup, codes)
    return _rounded(out.select("report", "num_drugs", "max_ror", "mean_log_ror", "high_ror_count"), 9, "max_ror", "mean_log_ror")


# --- graph tables ------------------------------------------------------------------------------------------------------

_SPLIT = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE -1 END"


@query(_sql(P.REPORTS, _LINKS, select=f"SELECT {_SPLIT} AS split_id, patient_index, node_index FROM links JOIN reports ON report = patient_index"))
def ordered_edges(spark, sf_dir):
    return GR.ordered_edges(_links(spark, sf_dir), P.reports(spark, sf_dir).select(F.col("report").alias("patient_index"), "split"))


@query(_sql(P.REPORTS, _LINKS, f"e AS (SELECT {_SPLIT} AS split_id, count(*) AS edges FROM links JOIN reports ON report = patient_index GROUP BY 1)", select="SELECT split_id, edges, CAST(sum(edges) OVER (ORDER BY split_id) - edges AS BIGINT) AS first FROM e"))
def split_offsets(spark, sf_dir):
    return GR.split_offsets(ordered_edges(spark, sf_dir))


@query(_sql(*_GRAPH, select="SELECT node_kind, count(*) AS n FROM nodes GROUP BY node_kind"))
def node_kinds(spark, sf_dir):
    return _graph(spark, sf_dir)[2].groupBy("node_kind").agg(F.count(F.lit(1)).alias("n"))


@query(_sql(_LINKS, select="SELECT patient_index, round(avg(node_index / 100.0), 6) AS a, round(avg(node_index % 7), 6) AS b FROM links GROUP BY patient_index"))
def one_hop_means(spark, sf_dir):
    links = _links(spark, sf_dir)
    nodes = links.select("node_index").distinct().withColumn("features", F.array(F.col("node_index") / 100.0, (F.col("node_index") % 7).cast("double")))
    out = GR.one_hop_means(links, links.select("patient_index").distinct(), nodes, 2)
    return out.select("patient_index", F.round(F.col("neighbours")[0], 6).alias("a"), F.round(F.col("neighbours")[1], 6).alias("b"))


@query(_sql(P.REPORTS, _LINKS, select=f"SELECT split_id, patient_index, (node_index + 1 + (42 * 1000003 + split_id * 97) % 399) % 400 AS node_index FROM (SELECT {_SPLIT} AS split_id, patient_index, node_index FROM links JOIN reports ON report = patient_index)"))
def rotated_edges(spark, sf_dir):
    return GR.rotated_within(ordered_edges(spark, sf_dir), 400, 42).select("split_id", "patient_index", "node_index")


@query(_sql(P.REPORTS, _LINKS, "w AS (SELECT patient_index % 16 AS cluster, node_index, count(*) AS weight FROM links GROUP BY ALL)", select="SELECT CAST(cluster AS INTEGER) AS cluster, node_index, weight FROM w QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, node_index) <= 10"))
def cluster_drug_edges(spark, sf_dir):
    links = _links(spark, sf_dir)
    clusters = links.select("patient_index").distinct().withColumn("cluster", (F.col("patient_index") % 16).cast("int"))
    return GR.cluster_drug_edges(links, clusters)


_PLACED = """points AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey % 97)::DOUBLE AS y FROM customer), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
    cells AS (SELECT id, x, y, CAST(least(floor((x - x0) * 4 / (x1 - x0)), 3) AS INTEGER) AS cx, CAST(least(floor((y - y0) * 4 / (y1 - y0)), 3) AS INTEGER) AS cy FROM points, box),
    halves AS (SELECT *, (x > median(x) OVER (PARTITION BY cx, cy))::INTEGER AS r FROM cells), quarters AS (SELECT *, r * 2 + (y > median(y) OVER (PARTITION BY cx, cy, r))::INTEGER AS q FROM halves)"""


@query(_sql(_PLACED, select="SELECT CAST((cx * 4 + cy) * 4 + q AS INTEGER) AS cluster, count(*) AS n, min(id) AS first, max(id) AS last FROM quarters GROUP BY 1"))
def layout_clusters(spark, sf_dir):
    points = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    return GR.clustered(points).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("""SELECT 'patient' AS kind, s_suppkey AS "index", round(sqrt(s_suppkey + 0.5) * cos(2.399963229728653 * s_suppkey), 9) AS x, round(sqrt(s_suppkey + 0.5) * sin(2.399963229728653 * s_suppkey), 9) AS y FROM supplier
    UNION ALL SELECT 'drug', n_nationkey, round(2.0 * sqrt(n_nationkey + 0.5) * cos(2.399963229728653 * n_nationkey), 9), round(2.0 * sqrt(n_nationkey + 0.5) * sin(2.399963229728653 * n_nationkey), 9) FROM nation""")  # fmt: skip
def disc_layout(spark, sf_dir):
    patients = P.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("patient_index"))
    nodes = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node_index"))
    return _rounded(GR.layout(patients, nodes), 9, "x", "y")


@query(_sql(*_GRAPH, select="SELECT node_index, coalesce(CASE WHEN node_kind = 'mapped' THEN (SELECT min(p_name) FROM part WHERE p_partkey = semantic_id AND p_partkey % 2 = 0) END, node_label) AS display_name FROM nodes"))
def node_names(spark, sf_dir):
    structures = P.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return GR.named_nodes(_graph(spark, sf_dir)[2], structures).select("node_index", "display_name")


# --- audits, evaluation, files -----------------------------------------------------------------------------------------


@query(_sql(P.REPORTS, _LINKS, select="SELECT split, count(*) AS patients, CAST(sum(CASE WHEN report IN (SELECT patient_index FROM links) THEN 1 ELSE 0 END) AS BIGINT) AS with_edges FROM reports GROUP BY split"))
def inductive_audit(spark, sf_dir):
    """Counts after the checks: splits exclusive, no orphans, dense indexes, messages from training patients only."""
    reports = P.reports(spark, sf_dir)
    index = GR.checkpointed(GR.dense_index(reports.select("report", "split"), [F.asc("report")], "patient_index"))
    links = _links(spark, sf_dir).withColumnRenamed("patient_index", "report").join(index.select("report", "patient_index"), "report")
    counts = GR.inductive_audit(links, index)
    QA.require_integer_ids(index, ["patient_index"])
    has = links.select("patient_index").distinct().join(index.select("patient_index", "split"), "patient_index").groupBy("split").agg(F.count(F.lit(1)).alias("with_edges"))
    return spark.createDataFrame(list(counts.items()), "split string, patients bigint").join(has, "split")


@query("SELECT count(*) AS rows, count(DISTINCT faers_raw) AS names, count(*) FILTER (dc_id = 0) AS unmapped FROM (SELECT DISTINCT p_name || ' ' || p_brand AS faers_raw, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 400 END AS dc_id FROM part)")
def linkage_audit(spark, sf_dir):
    d = P.dictionary(spark, sf_dir)
    QA.require_columns(d, ["faers_raw", "dc_id"], ["ror"])
    QA.require_unique(d, ["faers_raw", "dc_id"])
    QA.require_finite(d.withColumn("known", (F.col("dc_id") > 0).cast("int")), ["dc_id"], ["known"])
    QA.require_no_targets(["dc_id", "faers_raw"])
    return d.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("faers_raw").alias("names"), F.count_if(F.col("dc_id") == 0).alias("unmapped"))


@query("SELECT l_returnflag AS flag, l_orderkey AS report, l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS quantity, CAST(NULL AS VARCHAR) AS note FROM lineitem")
def staged_round_trip(spark, sf_dir):
    """Written in partitions, moved into place over an older output, read again by name with a column that no shard has."""
    import uuid

    path = f"{GR.shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows = P.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("quantity"))
    delimited.write_staged(rows.limit(5), path, by="flag")
    delimited.write_staged(rows, path, by="flag")
    QA.require_codec(spark, path)
    return delimited.staged(spark, path, ["flag", "report"], {"note": "string"}).select("flag", "report", "line", "quantity", "note")


@query("SELECT CAST(c_custkey AS VARCHAR) AS primaryid, nullif(c_name, '') AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' \"x' END AS segment, '2024Q1' AS quarter FROM customer")
def report_text_round_trip(spark, sf_dir):
    """A $-separated text without quoting, read with its header."""
    import uuid

    path = f"{GR.shared_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    rows = P.table(spark, sf_dir, "customer").select(k.cast("string").alias("PrimaryID"), F.col("c_name").alias("Name "), F.when(k % 3 != 0, F.concat("c_mktsegment", F.lit(' "x'))).alias("segment"))
    # each file has the header, as a source's parts have
    rows.write.option("header", True).option("sep", "$").option("quote", "").option("nullValue", "").option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.report_table(spark, path, "2024Q1")


@query()
def auc_bootstrap(spark, sf_dir):
    """The paired bootstrap of two scores: draws, so no SQL; held against numpy in tests."""
    d = P.scores(spark, sf_dir)
    rows = d.select("label", F.col("score").alias("score_a"), F.round(F.col("score") + F.col("label") * 0.05, 3).alias("score_b"))
    return spark.createDataFrame(EV.bootstrap_difference(rows, 100))


# --- streams -----------------------------------------------------------------------------------------------------------


@query("""WITH late AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_id % 2 = 1), w AS (SELECT date_trunc('hour', ts) AS start, event_id, event_type FROM events)
    SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM w, late WHERE event_id % 2 = 1 OR start + INTERVAL 1 HOUR > mark GROUP BY ALL""")  # fmt: skip
def stream_late_events(spark, sf_dir):
    """Two micro-batches in update mode: what the second one has of windows that the first one closed is too late."""
    from ..streaming import upsert

    folder = _stream_folder(spark)
    e = P.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for odd in (1, 0):
        e.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{folder}/in")
        counts = upsert.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), "ts", by=["event_type"])
        out = upsert.drained(counts, folder, "update", ["start", "end", "event_type"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(_sql("gone AS (SELECT c_custkey AS caseid FROM customer WHERE c_acctbal < 0)",
    "reports AS (SELECT o_orderkey AS report, CAST(o_orderdate AS DATE) AS report_date, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_serious FROM orders WHERE o_custkey NOT IN (SELECT caseid FROM gone) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1)",
    "train AS (SELECT * FROM reports WHERE year(report_date) < 2000)", P.EXPOSURES,
    "own AS (SELECT dc_id, report_date, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM exposures JOIN train USING (report) GROUP BY dc_id, report_date)",
    "days AS (SELECT report_date, count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM train GROUP BY report_date)",
    "own2 AS (SELECT dc_id, report_date, coalesce(sum(a) OVER w, 0) AS a, coalesce(sum(b) OVER w, 0) AS b FROM own WINDOW w AS (PARTITION BY dc_id ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "days2 AS (SELECT report_date, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(n) OVER w, 0) AS n FROM days WINDOW w AS (ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "cells AS (SELECT dc_id, report_date, a, b, s - a AS c, n - b AS d FROM own2 JOIN days2 USING (report_date))",
    select="SELECT dc_id, report_date, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round(CASE WHEN a + b = 0 OR a + c = 0 OR b + d = 0 THEN 1.0 ELSE ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)) END, 9) AS ror FROM cells"))
def incremental_temporal_ror(spark, sf_dir):
    """Orders are versions of their customer's case, customers in debt tombstones; three micro-batches of a stream, the
    tombstones in the second. The daily facts follow by differences."""
    from ..streaming.incremental import CaseState

    folder = _stream_folder(spark)
    drugs = P.exposures(spark, sf_dir).groupBy("report").agg(F.collect_set("dc_id").alias("dc_ids"))
    r = P.reports(spark, sf_dir).join(drugs, "report", "left")
    versions = r.select("caseid", "report", (F.col("report") % 5).alias("caseversion"), "report_date", "is_serious", F.when(F.year("report_date") < 2000, "train").alias("split"), "dc_ids", F.lit(False).alias("deleted"))
    gone = P.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("caseid"), F.lit(True).alias("deleted"))
    state = CaseState(spark, f"{folder}/cases", 8)
    for part in (versions.where("report % 3 = 0"), versions.where("report % 3 = 1").unionByName(gone, allowMissingColumns=True), versions.where("report % 3 = 2")):
        part.write.mode("append").parquet(f"{folder}/in")
        state.follow(spark.readStream.schema(versions.schema).parquet(f"{folder}/in"), f"{folder}/checkpoint")
    return _rounded(state.history(), 9, "ror")


# --- sources and names that only builders used ---------------------------------------------------------------------------


@query("""SELECT token AS caseid, '2024Q1' AS quarter FROM (SELECT trim(unnest(string_split(o_custkey || '$ ' || o_orderkey || ' $x' || o_custkey || '$' || o_orderstatus || '$', '$'))) AS token FROM orders) WHERE regexp_full_match(token, '[0-9]+')""")
def deletion_ids(spark, sf_dir):
    """Tokens of deletion lists over many files; duplicates stay, every fiftieth line begins with a byte order mark."""
    path = f"{_stream_folder(spark)}-deleted"
    k = F.col("o_orderkey")
    mark = F.when(k % 50 == 0, "\ufeff").otherwise("")
    P.table(spark, sf_dir, "orders").select(F.concat(mark, F.col("o_custkey").cast("string"), F.lit("$ "), k.cast("string"), F.lit(" $x"), F.col("o_custkey").cast("string"), F.lit("$"), "o_orderstatus", F.lit("$"))).write.text(path)
    return delimited.deleted_cases(spark, [path], "2024Q1")


@query("""SELECT DISTINCT s_name AS rxnorm_name, CAST(p_partkey % 100 AS BIGINT) AS struct_id, CAST(p_size AS VARCHAR) AS rxcui, 'drugcentral_identifier' AS source FROM part JOIN supplier ON p_size = s_suppkey % 60 WHERE s_suppkey % 7 <> 0""")
def rxnorm_rows(spark, sf_dir):
    """Lookup rows out of identifiers and the label mapping; names that are blank don't count."""
    identifiers = P.table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("rxcui"), (F.col("p_partkey") % 100).alias("struct_id"))
    labels = P.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).cast("string").alias("rxcui"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).otherwise("  ").alias("rxstring"))
    return NA.rxnorm_local(identifiers, labels).drop("query_name")


_CLEAN = "trim(regexp_replace(upper({}), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"""WITH known AS (SELECT {_CLEAN.format("p_name")} AS alias, list_sort(list(DISTINCT p_partkey % 7)) AS ids FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
    asked AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' / ' || p_brand END AS name FROM part UNION SELECT DISTINCT p_name || '+' || reverse(p_name) FROM part UNION SELECT DISTINCT p_name || ' + red bolt' FROM part),
    parts AS (SELECT name, unnest(regexp_split_to_array(upper(name), '\\s*(?:/|\\+)\\s*')) AS part FROM asked),
    per_name AS (SELECT name, bool_and(ids IS NOT NULL AND len(ids) = 1) AS every, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM parts LEFT JOIN known ON alias = {_CLEAN.format("part")} GROUP BY name)
    SELECT name, array_to_string(coalesce(k.ids, CASE WHEN every THEN b.ids END), ',') AS ids FROM asked LEFT JOIN known k ON k.alias = {_CLEAN.format("name")} JOIN per_name b USING (name)""")  # fmt: skip
def multi_id_names(spark, sf_dir):
    """Whole names with several ids first, else all their components, each with one."""
    p = P.table(spark, sf_dir, "part")
    known = p.where("p_partkey % 3 <> 0").select(C.drug_name(F.col("p_name")).alias("alias"), (F.col("p_partkey") % 7).alias("dc_id")).distinct()
    asked = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" / "), "p_brand")).alias("name"))
    asked = asked.unionByName(p.select(F.concat("p_name", F.lit("+"), F.reverse("p_name")).alias("name"))).unionByName(p.select(F.concat("p_name", F.lit(" + red bolt")).alias("name")))
    return NA.resolve(asked, "name", known).select("name", F.when(F.col("ids").isNotNull(), F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query(_sql(*_GRAPH, "links2 AS (SELECT DISTINCT patient_index AS report, node_index FROM links)",
    "cells AS (SELECT node_index, a, b, s - a AS c, n - b AS d FROM (SELECT node_index, count(*) FILTER (is_serious = 1) AS a, count(*) FILTER (is_serious = 0) AS b FROM links2 JOIN reports USING (report) WHERE split = 'train' GROUP BY node_index), (SELECT count(*) FILTER (is_serious = 1) AS s, count(*) FILTER (is_serious = 0) AS n FROM reports WHERE split = 'train'))",
    select="SELECT node_index, a, b, c, d, round(CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)) ELSE (a * d)::DOUBLE / (b * c) END, 9) AS ror FROM cells"))
def graph_drug_ror(spark, sf_dir):
    """RORs of the graph's nodes, from training reports only."""
    edges, unknown, nodes, dictionary = _graph(spark, sf_dir)
    train = P.reports(spark, sf_dir).where("split = 'train'").select(F.col("report").alias("patient_index"), "is_serious")
    cells = GR.node_counts(edges, dictionary, unknown, nodes, train)
    return _rounded(RI.with_ror(RI.with_totals(cells, train, ["node_index"]), "zero"), 9, "ror")


_TILE = "(cx & 1) | ((cy & 1) << 1) | ((cx >> 1 & 1) << 2) | ((cy >> 1 & 1) << 3)"


@query(f"""WITH points AS (SELECT c_custkey AS id, c_acctbal::DOUBLE AS x, (c_custkey % 97)::DOUBLE AS y FROM customer), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
    cells AS (SELECT id, x, y, CAST(least(floor((x - x0) * 4 / (x1 - x0)), 3) AS BIGINT) AS cx, CAST(least(floor((y - y0) * 4 / (y1 - y0)), 3) AS BIGINT) AS cy FROM points, box),
    tiles AS (SELECT id, x, y, {_TILE} AS tile FROM cells), placed AS (SELECT *, row_number() OVER (ORDER BY tile, id) - 1 AS place FROM tiles),
    edges AS (SELECT tile, row_number() OVER (ORDER BY tile, place, o_orderkey) - 1 AS at_edge FROM orders JOIN placed ON id = o_custkey),
    levels AS (SELECT unnest([0, 1, 2]) AS level)
    SELECT CAST(level AS INTEGER) AS level, tile >> (2 * (2 - level)) AS tile, min(place) AS first_point, count(*) AS points, any_value(e.first_edge) AS first_edge, coalesce(any_value(e.edges), 0) AS edges, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
    FROM placed, levels LEFT JOIN (SELECT level AS l, tile >> (2 * (2 - level)) AS t, min(at_edge) AS first_edge, count(*) AS edges FROM edges, levels GROUP BY ALL) e ON e.l = level AND e.t = tile >> (2 * (2 - level)) GROUP BY level, tile >> (2 * (2 - level))""")  # fmt: skip
def layout_tiles(spark, sf_dir):
    """The index of tiles of all levels over the records of points and edges."""
    points = P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    placed = GR.checkpointed(GR.dense_index(GR.tiled(points, 2), [F.asc("tile"), F.asc("id")], "place"))
    edges = P.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(placed.select("id", "place", "tile"), "id")
    return GR.tile_index(placed, GR.dense_index(edges, [F.asc("tile"), F.asc("place"), F.asc("o_orderkey")], "at"), 2)


@query(f"""WITH p AS (SELECT p_name || ' ' || p_brand AS faers_raw, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_type WHEN 2 THEN p_name || ' + ' WHEN 3 THEN 'nothing' ELSE p_name END AS prod_ai, * FROM part),
    own AS (SELECT {_CLEAN.format("p_type")} AS alias, length(p_type) AS id FROM part WHERE p_type <> 'PROMO' UNION SELECT {_CLEAN.format("faers_raw")}, 100 FROM p WHERE p_brand LIKE '%7'),
    rx AS (SELECT DISTINCT {_CLEAN.format("p_name")} AS alias, 200 + p_size % 2 AS id FROM part WHERE p_size % 3 = 0 OR p_name LIKE 'red%' UNION SELECT DISTINCT {_CLEAN.format("faers_raw")}, 300 FROM p WHERE p_brand LIKE '%5'),
    rxs AS (SELECT alias, list_sort(list(id)) AS ids FROM rx GROUP BY alias), o AS (SELECT alias, any_value(id) AS id FROM own GROUP BY alias),
    r AS (SELECT DISTINCT faers_raw, prod_ai FROM p),
    found AS (SELECT faers_raw, list(DISTINCT oa.id) FILTER (oa.id IS NOT NULL) AS oa, any_value(orw.id) AS orw, list(DISTINCT ra.ids) FILTER (ra.ids IS NOT NULL) AS ra, any_value(rr.ids) AS rr FROM r
        LEFT JOIN o oa ON oa.alias = {_CLEAN.format("prod_ai")} LEFT JOIN o orw ON orw.alias = {_CLEAN.format("faers_raw")} LEFT JOIN rxs ra ON ra.alias = CASE WHEN prod_ai LIKE '%+%' THEN '' ELSE {_CLEAN.format("prod_ai")} END OR (prod_ai LIKE '%+%' AND ra.alias = {_CLEAN.format("prod_ai")}) LEFT JOIN rxs rr ON rr.alias = {_CLEAN.format("faers_raw")} GROUP BY faers_raw)
    SELECT faers_raw, CASE WHEN len(oa) > 1 THEN NULL WHEN len(oa) = 1 THEN CAST(oa[1] AS VARCHAR) WHEN orw IS NOT NULL THEN CAST(orw AS VARCHAR) WHEN len(ra) > 1 THEN NULL WHEN len(ra) = 1 THEN array_to_string(ra[1], ',') ELSE array_to_string(rr, ',') END AS ids,
        CASE WHEN len(oa) > 1 THEN 1 WHEN len(oa) = 1 OR orw IS NOT NULL THEN 0 WHEN len(ra) > 1 THEN 1 ELSE 0 END AS conflict FROM found""")  # fmt: skip
def mapping_cascade(spark, sf_dir):
    """The order of the exact steps, conflicts included: own aliases of prod_ai and name, then RxNorm's."""
    raw = F.concat("p_name", F.lit(" "), "p_brand")
    k = F.col("p_partkey") % 5
    ai = F.when(k == 1, F.col("p_type")).when(k == 2, F.concat("p_name", F.lit(" + "))).when(k == 3, "nothing").when(k == 4, F.col("p_name"))
    p = P.table(spark, sf_dir, "part").withColumns({"faers_raw": raw, "prod_ai": ai})
    alias = lambda rows, c, id: rows.select(C.drug_name(F.col(c)).alias("alias"), id.cast("bigint").alias("dc_id"))
    own = alias(p.where("p_type <> 'PROMO'"), "p_type", F.length("p_type")).unionByName(alias(p.where("p_brand like '%7'"), "faers_raw", F.lit(100))).distinct()
    rx = alias(p.where("p_size % 3 = 0 or p_name like 'red%'"), "p_name", 200 + F.col("p_size") % 2).unionByName(alias(p.where("p_brand like '%5'"), "faers_raw", F.lit(300))).distinct()
    out = NA.exact_cascade(p.select("faers_raw", "prod_ai"), own, rx)
    return out.select("faers_raw", F.when(F.col("ids").isNotNull(), F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"), F.col("conflict").cast("int").alias("conflict"))
