"""Shared pieces: scratch tables in the cluster's shared folder and hot-key helpers."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. One of our own where it is unset, on a single machine only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/medlark-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so that a lost executor costs no more than the scan."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/medlark-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Spark deletes shuffle files once nobody holds the tables that were made of them: what nobody holds is let go of."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a screen: about 16 a key, at most so many (32 MB go to each executor then, however many keys there are).
SCREEN_BITS = 1 << 28


#: A hash sets the bits that these two stretches of it name.
SCREEN_SHIFTS = (0, 32)


def bits_of(keys: DataFrame, key: str) -> np.ndarray:
    """A bit map of a column of 64-bit hashes, built by the executors: of 16 bits a hash and more, about one other hash in 70
    has both its bits set. `keys` is counted first: hand in a written table."""
    size = min(SCREEN_BITS, max(1 << 16, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    places = F.explode(F.array(*[_place(F.col(key), k, size) for k in SCREEN_SHIFTS]))
    parts = keys.select(places.alias("p")).groupBy(F.expr("p div 32768").alias("block")).agg(F.bitmap_construct_agg(F.expr("cast(p % 32768 as long)")).alias("map")).collect()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in parts:
        at = int(r["block"]) * 4096
        got = np.frombuffer(bytes(r["map"]), dtype=np.uint8)
        bits[at : at + len(got)] = got
    return bits


def _place(column, shift: int, size: int):
    return F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(size - 1).cast("long"))


def may_have(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bit map; false only for hashes that aren't."""
    hit = np.ones(len(hashes), dtype=bool)
    for k in SCREEN_SHIFTS:
        p = (hashes.view(np.uint64) >> np.uint64(k)) & np.uint64(len(bits) * 8 - 1)
        hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit


def screen(keys: DataFrame, key: str):
    """A test of columns of 64-bit hashes against a table's: false only for hashes that aren't there.

    Beyond SCREEN_BITS / 16 keys more others pass; it keeps rows from a shuffle and decides nothing, so a join has to
    follow."""
    shared = keys.sparkSession.sparkContext.broadcast(bits_of(keys, key))

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(may_have(shared.value, h.fill_null(0).to_numpy(zero_copy_only=False)))

    return lambda column: test(column)


def untouched(keyed: DataFrame, touched: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely not among the touched ones, the others), by a column of 64-bit hashes that both tables have.
    The first go on where they were read; only the others need a join."""
    passes = screen(touched, key)
    return keyed.where(~passes(F.col(key))), keyed.where(passes(F.col(key)))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ...: names that clash, be it by case alone, can't be told apart otherwise."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


#: Bytes of an Arrow batch, on either side: texts are long, and two tasks share an executor.
ARROW_BYTES = 4 << 20


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of exactly these names, the first of each, whatever else the table has. Arrow batches of the session are
    held to ARROW_BYTES from here on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    plain, names = numbered(df)
    return plain.select(*[F.col(names[df.columns.index(c)]).alias(c) for c in columns])
