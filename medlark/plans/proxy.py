"""Star-schema tables as the engine's inputs, in Spark and in SQL: orders are reports, parts are drugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import dealt, parts_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that line items are dealt to."""
    return parts_for(table(spark, sf_dir, "lineitem"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("report"), F.col("o_custkey").alias("caseid"), F.to_date("o_orderdate").alias("report_date"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("is_serious"),
        F.when(y < 2000, "train").when(y == 2000, "validation").otherwise("test").alias("split"),
    )


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_partkey").alias("dc_id")), "report", parts(spark, sf_dir)).distinct()


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures to 25 brands, coarse enough for pairs with support."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 2).cast("int").alias("dc_id"))
    return dealt(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("report")).join(part, "l_partkey").select("report", "dc_id"), "report", parts(spark, sf_dir)).distinct()


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dc_id, atc_code): codes of class letter, two digits and two more letters from type, size and name; every third
    part has two codes, every seventh a malformed one."""
    p = table(spark, sf_dir, "part")
    first = F.concat(F.substring("p_type", 1, 1), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.upper(F.substring("p_name", 1, 1)), F.upper(F.substring("p_name", -1, 1)))
    second = F.concat(F.lit("N02A"), F.substring("p_type", 2, 1))
    code = F.when(F.col("p_partkey") % 7 == 0, F.lower(first)).when(F.col("p_partkey") % 3 == 0, F.concat(first, F.lit("|"), second)).otherwise(first)
    return p.select(F.col("p_partkey").alias("dc_id"), code.alias("atc_code"))


def dose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dosed exposures: raw name, amount, unit, frequency, route, form. Rows aren't distinct; they are dealt by
    report with the reports that they meet."""
    n = parts(spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("faers_raw"), "p_name", "p_type")
    l = dealt(table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", n)
    l = l.join(reports(spark, sf_dir).select(F.col("report").alias("l_orderkey"), "split"), "l_orderkey")
    route = F.when(F.col("l_linenumber") == 1, "Intravenous drip").when(F.col("l_linenumber") == 2, "oral").when(F.col("l_linenumber") == 3, "iv").when(F.col("l_linenumber") == 4, "Subcutaneous").when(F.col("l_linenumber") == 5, " ")
    return l.select(
        F.col("l_orderkey").alias("primaryid"), "split", "faers_raw", "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("dose_amt"),
        F.when(F.col("l_returnflag") == "A", "µg").when(F.col("l_returnflag") == "N", " m.g ").otherwise("gm").alias("dose_unit"),
        F.when(F.col("l_linestatus") == "O", "QD").otherwise("bid").alias("dose_freq"), route.alias("route"),
        F.when(F.col("p_type") == "PROMO", "Tablet").when(F.col("p_type") == "SMALL", "Injection").otherwise(F.col("p_type")).alias("dose_form"), F.col("p_name").alias("drugname"),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(faers_raw, dc_id): a raw name may stand for several parts, and every fifth part is unmapped."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat("p_name", F.lit(" "), "p_brand").alias("faers_raw"), F.when(F.col("p_partkey") % 5 == 0, 0).otherwise(F.col("p_partkey") % 400).cast("bigint").alias("dc_id")).distinct()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score): quality against length, with ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.floor(F.coalesce("n_chars", F.lit(0)) / 50) / 100.0, F.lit(1.0)).cast("double").alias("score"))
    return table(spark, sf_dir, "labels").where("quality in (0, 1)").join(d, "doc_id").select(F.col("quality").alias("label"), "score")


# --- the same in SQL ---------------------------------------------------------------------------------------------------

REPORTS = """reports AS (SELECT o_orderkey AS report, o_custkey AS caseid, CAST(o_orderdate AS DATE) AS report_date,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_serious,
    CASE WHEN year(o_orderdate) < 2000 THEN 'train' WHEN year(o_orderdate) = 2000 THEN 'validation' ELSE 'test' END AS split FROM orders)"""
EXPOSURES = "exposures AS (SELECT DISTINCT l_orderkey AS report, l_partkey AS dc_id FROM lineitem)"
BRANDS = "exposures AS (SELECT DISTINCT l_orderkey AS report, CAST(substr(p_brand, 7, 2) AS INTEGER) AS dc_id FROM lineitem JOIN part ON p_partkey = l_partkey)"
CODES = """codes AS (SELECT p_partkey AS dc_id, CASE WHEN p_partkey % 7 = 0 THEN lower(f) WHEN p_partkey % 3 = 0 THEN f || '|N02A' || substr(p_type, 2, 1) ELSE f END AS atc_code
    FROM (SELECT *, substr(p_type, 1, 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || upper(substr(p_name, 1, 1)) || upper(right(p_name, 1)) AS f FROM part))"""
DOSES = """edges AS (SELECT l_orderkey AS primaryid, r.split, p_name || ' ' || p_brand AS faers_raw, l_partkey, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS dose_amt,
    CASE l_returnflag WHEN 'A' THEN 'µg' WHEN 'N' THEN ' m.g ' ELSE 'gm' END AS dose_unit, CASE l_linestatus WHEN 'O' THEN 'QD' ELSE 'bid' END AS dose_freq,
    CASE l_linenumber WHEN 1 THEN 'Intravenous drip' WHEN 2 THEN 'oral' WHEN 3 THEN 'iv' WHEN 4 THEN 'Subcutaneous' WHEN 5 THEN ' ' END AS route,
    CASE p_type WHEN 'PROMO' THEN 'Tablet' WHEN 'SMALL' THEN 'Injection' ELSE p_type END AS dose_form, p_name AS drugname
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN reports r ON r.report = l_orderkey)"""
DICTIONARY = "dictionary AS (SELECT DISTINCT p_name || ' ' || p_brand AS faers_raw, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 400 END AS BIGINT) AS dc_id FROM part)"
SCORES = "scores AS (SELECT quality AS label, least(floor(coalesce(n_chars, 0) / 50.0) / 100.0, 1.0)::DOUBLE AS score FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1))"
