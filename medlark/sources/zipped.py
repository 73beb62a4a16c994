"""Pipe-separated members of ZIP archives, found by the columns their header must have."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest
from .delimited import SourceError

#: Other names of columns.
ALIASES = {"setid": "spl_setid"}
#: Columns of the mapping tables.
TABLES = {
    "rxnorm": ("spl_setid", "spl_version", "rxcui", "rxstring", "rxtty"),
    "pharmacologic-class": ("spl_setid", "spl_version", "pharma_setid", "pharma_version"),
    "metadata": ("setid", "zip_file_name", "upload_date", "spl_version", "title"),
}


def name_of(raw: str, required: tuple) -> str:
    n = re.sub(r"[^a-z0-9]+", "_", raw.strip().lstrip("\ufeff").lower()).strip("_")
    return n if n in required else ALIASES.get(n, n)


def members(archive, required: tuple):
    """Rows of every member of an open archive whose first line has the required columns, as they are read; its header has
    to be the same in all of them."""
    known = None
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            with z.open(info) as f:
                rows = csv.reader(io.TextIOWrapper(f, encoding="utf-8", newline=""), delimiter="|", quotechar='"')
                names = [name_of(n, required) for n in next(rows, [])]
                if not set(required) <= set(names):
                    continue
                if known is not None and known != names:
                    raise SourceError(f"{info.filename} has another header")
                known = names
                places = [names.index(c) for c in required]
                for row in rows:
                    if any(x.strip() for x in row):
                        if len(row) != len(names):
                            raise SourceError(f"{info.filename} has a row of {len(row)} fields, its header has {len(names)}")
                        yield tuple(row[k] or None for k in places)
    if known is None:
        raise SourceError(f"no member has the columns {required}")


#: Rows that a task hands on at a time.
ROWS = 20_000


def zip_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All archives under path; each is read by one task, which keeps a block of rows and never an archive or a member."""
    required = TABLES[table]
    names = [(n,) for n, _, _ in manifest.files(spark, path)]

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for name in pdf["name"]:
                store, where = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                with store.open_input_file(where) as f:
                    rows = members(f, required)
                    while block := list(itertools.islice(rows, ROWS)):
                        yield pd.DataFrame(block, columns=list(required), dtype=object)

    files = spark.createDataFrame(names, "name string").repartition(max(1, len(names)))
    return files.mapInPandas(run, ", ".join(f"{c} string" for c in required)).withColumn("source_table", F.lit(table))
