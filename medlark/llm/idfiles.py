"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

write_ids() deals documents by ranges of doc_id to files, so that every file, and every stripe in it, holds one run of
ids in ascending doc_id order: min/max statistics and Bloom filters then let a lookup skip files, stripes and row groups,
and stripes are read in parallel. read_ids() puts each document's global start back from the files' totals.

Nulls: a null text is empty (the end id only); null doc_ids come first. Rows with equal doc_id stay together, ordered by
text. Empty table: no files with rows, an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, pick
from .tokens import encode_ids

#: Writer settings; sizes are in bytes, the stride in rows.
ORC = {
    "orc.compress": "SNAPPY",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Bytes of text whose ids go to one file.
FILE_BYTES = 128 << 20


def write_ids(docs: DataFrame, vocabulary: str, kind: str, end_id: int, folder: str, files: int | None = None) -> str:
    """Writes (part, doc_id, n_tokens, before, ids) rows; before: ids of the file ahead of the document's."""
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    if files is None:  # as many as tasks, and more where they would be large
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ranged = texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    # the running total is within the partition, whose rows are in order
    ids = encode_ids(ranged, vocabulary, kind, ["doc_id"], suffix=end_id, running=True)
    placed = ids.withColumn("part", F.spark_partition_id())
    writer = placed.write.format("orc")
    for k, v in ORC.items():
        writer = writer.option(k, v)
    writer.save(folder)
    return folder


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, base): ids in all files ahead. One row a file, whatever the documents: two columns of the files are read."""
    totals = spark.read.orc(folder).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files."""
    rows = spark.read.orc(folder)
    # one row a file: the task count of the writer bounds what is sent
    return rows.join(F.broadcast(file_starts(spark, folder)), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Chosen documents: the predicate reaches ORC, which skips stripes and row groups by statistics and Bloom filters."""
    return spark.read.orc(folder).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """ids_crc32 in place of ids: unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in rows.columns if c != "ids"]

    def run(batches):
        for b in batches:
            column = b.column("ids")
            flat = np.asarray(column.values).astype("<i4", copy=False)
            edges = np.asarray(column.offsets)
            crc = [zlib.crc32(flat[lo:hi].tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "ids").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids_crc32 long")


def id_files(spark: SparkSession, docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 1) -> DataFrame:
    """Writes the files in the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = write_ids(docs, vocabulary, kind, end_id, new_path(spark, "ids"))
    return digests(read_ids(spark, folder))
