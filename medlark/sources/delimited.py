"""Delimited report tables: $-separated text without quoting, all strings, with the quarter they came from."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import manifest


class SourceError(ValueError):
    """A source that doesn't have the shape it should have."""


def header(spark: SparkSession, path: str, sep: str = "$", encoding: str = "UTF-8") -> list[str]:
    line = spark.read.option("sep", sep).option("quote", "").option("encoding", encoding).csv(path).first()
    names = [(n or "").strip().lower().lstrip("\ufeff") for n in (line or [""])]
    if not all(names) or len(set(names)) != len(names):
        raise SourceError(f"the header of {path} has empty or repeated names: {names}")
    return names


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of the file is valid UTF-8; lines are looked at where they are read, as the bytes they are."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def report_table(spark: SparkSession, path: str, quarter: str, sep: str = "$") -> DataFrame:
    """Empty fields are null; files that aren't UTF-8 are read as Latin-1; rows of a wrong width fail."""
    encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in header(spark, path, sep, encoding)])
    reader = spark.read.schema(schema).option("sep", sep).option("quote", "").option("header", True).option("enforceSchema", True).option("encoding", encoding).option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "")
    return reader.csv(path).withColumn("quarter", F.lit(quarter))


def deleted_cases(spark: SparkSession, paths: list[str], quarter: str) -> DataFrame:
    """(caseid, quarter) of all tokens that are digits; duplicates stay. No paths: an empty table of that shape."""
    if not paths:
        return spark.createDataFrame([], "caseid string, quarter string")
    tokens = F.transform(F.split("value", r"\$"), lambda x: F.trim(F.regexp_replace(x, "^\uFEFF", "")))
    return spark.read.text(paths).select(F.explode(tokens).alias("caseid")).where(F.col("caseid").rlike("^[0-9]+$")).withColumn("quarter", F.lit(quarter))


def staged(spark: SparkSession, paths: list[str] | str, required: list[str] = (), optional: dict[str, str] | None = None) -> DataFrame:
    """Parquet shards by name; columns that some lack are null, and so are optional ones (by type) that all lack. Missing
    required columns fail."""
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    if missing := [c for c in required if c not in df.columns]:
        raise SourceError(f"columns are missing: {missing}")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (optional or {}).items() if c not in df.columns})


def write_staged(df: DataFrame, path: str, by: str | None = None) -> None:
    """Snappy Parquet, written whole to a folder beside and then moved into place: the output before it stays until then."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(by) if by else writer).parquet(staging)
    manifest.published(spark, staging, path)


def codecs(spark: SparkSession, path: str) -> dict[str, int]:
    """Column chunks of Parquet files by codec; footers are read by tasks."""
    names = [(n,) for n, _, _ in manifest.files(spark, path) if n.endswith(".parquet")]

    def run(batches):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in batches:
            found = []
            for name in pdf["name"]:
                store, where = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                meta = pq.read_metadata(store.open_input_file(where))
                found += [meta.row_group(g).column(c).compression for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
            yield pd.DataFrame({"codec": found}, dtype=object)

    if not names:
        return {}
    rows = spark.createDataFrame(names, "name string").mapInPandas(run, "codec string").groupBy("codec").count()
    return {r["codec"]: r["count"] for r in rows.collect()}
