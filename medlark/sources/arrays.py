"""Numeric exports: dense .npy matrices by stripe, and binary shards for viewers, with checksums beside them."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ArrayError(ValueError):
    """An array that isn't what its manifest says."""


def save_matrix(df: DataFrame, index: str, values: list[str], path: str, dtype: str = "float32") -> tuple[int, int]:
    """Rows 0..n-1 by index into one .npy file, which has to be in a shared folder: tasks write the rows of their range of
    indexes in place; the driver makes the empty file and moves the full one into place. The index has to be dense."""
    i = F.col(index)
    n, lo, hi, some = df.agg(F.count(F.lit(1)), F.min(i), F.max(i), F.countDistinct(i)).first()
    if n and (lo, hi, some) != (0, n - 1, n):
        raise ArrayError(f"{n} rows, but {some} indexes from {lo} to {hi}")
    part = f"{path}.tmp"
    np.lib.format.open_memmap(part, mode="w+", dtype=dtype, shape=(n, len(values))).flush()

    def put(batches):
        import pandas as pd

        out = np.lib.format.open_memmap(part, mode="r+")
        seen = 0
        for pdf in batches:
            out[pdf[index].to_numpy(dtype=np.int64)] = pdf[values].to_numpy(dtype=out.dtype)
            seen += len(pdf)
        out.flush()
        yield pd.DataFrame({"n": [seen]})

    if n:
        seen = df.select(index, *values).repartitionByRange(index).mapInPandas(put, "n long").agg(F.sum("n")).first()[0]
        if seen != n:
            raise ArrayError(f"{seen} rows, {n} expected")
    os.replace(part, path)
    return n, len(values)


def load_matrix(spark: SparkSession, root: str, name: str, columns: list[str], dtype: str = "float32") -> DataFrame:
    """The matrix as (index, columns): memory-mapped by the tasks, each of which reads its rows only. root has to be shared."""
    path = os.path.realpath(os.path.join(root, name))
    if os.path.commonpath([path, os.path.realpath(root)]) != os.path.realpath(root):
        raise ArrayError("the path leaves its folder")
    a = np.load(path, mmap_mode="r", allow_pickle=False)
    if a.dtype != np.dtype(dtype) or a.ndim != 2 or a.shape[1] != len(columns):
        raise ArrayError(f"{name} is {a.dtype} {a.shape}")

    def run(batches):
        import pandas as pd

        m = np.load(path, mmap_mode="r", allow_pickle=False)
        for pdf in batches:
            at = pdf["id"].to_numpy()
            yield pd.DataFrame({"index": at, **{c: m[at, k].astype("float64") for k, c in enumerate(columns)}})

    return spark.range(len(a)).mapInPandas(run, "index long, " + ", ".join(f"`{c}` double" for c in columns))


def _mark(path: str) -> str:
    try:
        with open(path) as f:
            return f.read()
    except FileNotFoundError:
        return ""


def write_shards(df: DataFrame, folder: str, index: str, fields: list[tuple[str, str]], per_shard: int) -> list[dict]:
    """Binary shards of per_shard rows by index, fields as (column, dtype) one after the other, each with its checksum and a
    .done mark that holds it; a shard is kept if it is marked with the checksum of the same bytes. Shards of an earlier, larger
    export go. Each shard is one group of bounded size. folder has to be shared."""
    os.makedirs(folder, exist_ok=True)
    schema = "shard long, rows long, bytes long, sha256 string"

    def put(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(index)
        data = b"".join(np.ascontiguousarray(pdf[c].to_numpy(), dtype=d).tobytes() for c, d in fields)
        name = os.path.join(folder, f"shard-{int(key[0]):06d}.bin")
        digest = hashlib.sha256(data).hexdigest()
        if _mark(f"{name}.done") != digest or not os.path.exists(name):
            with open(f"{name}.tmp", "wb") as f:
                f.write(data)
            if os.path.exists(f"{name}.done"):  # what it marks is about to change
                os.remove(f"{name}.done")
            os.replace(f"{name}.tmp", name)
            with open(f"{name}.done", "w") as f:
                f.write(digest)
        return pd.DataFrame([(int(key[0]), len(pdf), len(data), digest)], columns=["shard", "rows", "bytes", "sha256"])

    shard = F.floor(F.col(index) / per_shard).cast("long").alias("_shard")
    made = df.select(index, *[c for c, _ in fields if c != index], shard).groupBy("_shard").applyInPandas(put, schema)
    found = [r.asDict() for r in made.orderBy("shard").collect()]
    names = {f"shard-{r['shard']:06d}.bin" for r in found}
    for n in os.listdir(folder):
        if n.startswith("shard-") and n.removesuffix(".done") not in names:
            os.remove(os.path.join(folder, n))
    with open(os.path.join(folder, "index.json.tmp"), "w") as f:
        json.dump({"fields": fields, "per_shard": per_shard, "shards": found}, f)
    os.replace(os.path.join(folder, "index.json.tmp"), os.path.join(folder, "index.json"))
    return found


def shard_estimate(rows: int, fields: list[tuple[str, str]], target: int = 32 << 20) -> dict[str, int]:
    """Rows of a shard, shards and bytes for a target size."""
    width = sum(np.dtype(d).itemsize for _, d in fields)
    per = max(1, target // width)
    return {"per_shard": per, "shards": -(-rows // per), "bytes": rows * width}


def read_range(folder: str, first: int, count: int) -> np.ndarray:
    """Records first to first + count - 1 of shards that write_shards made, by their index alone: only the shards that hold them
    are opened, and only those bytes are read. A reader's side, on one machine."""
    with open(os.path.join(folder, "index.json")) as f:
        index = json.load(f)
    kinds = [(c, np.dtype(d)) for c, d in index["fields"]]
    out, per, rows = np.empty(count, dtype=kinds), index["per_shard"], {s["shard"]: s["rows"] for s in index["shards"]}
    at = first
    while at < first + count:
        shard, inside = divmod(at, per)
        n = min(first + count - at, per - inside)
        with open(os.path.join(folder, f"shard-{shard:06d}.bin"), "rb") as f:
            start = 0  # a shard has its columns one after the other
            for c, d in kinds:
                f.seek(start + inside * d.itemsize)
                out[c][at - first : at - first + n] = np.frombuffer(f.read(n * d.itemsize), dtype=d)
                start += rows[shard] * d.itemsize
        at += n
    return out
