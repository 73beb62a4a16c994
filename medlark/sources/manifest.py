"""Build manifests: inputs by listing and checksum, parameters, and whether an output may be used again.

Folders are listed through Spark's own file systems, bytes are read by tasks; the driver sees names, sizes and digests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    """(path, file system) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _store(spark, path)
    return store.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern gives, in order."""
    where, store = _store(spark, pattern)
    return sorted(s.getPath().toString() for s in (store.globStatus(where) or []))


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of a file, or of all files below a folder but hidden ones."""
    where, store = _store(spark, path)
    if not store.exists(where):
        raise FileNotFoundError(path)
    found, out = store.listFiles(where, True), []
    while found.hasNext():
        s = found.next()
        if s.getPath().getName()[0] not in "._":
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def _digest(lines: Iterator[str]) -> str:
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode() + b"\n")
    return h.hexdigest()


def listing(spark: SparkSession, path: str) -> str:
    """A checksum of names, sizes and times: no byte of the files is read."""
    return _digest(f"{name} {size} {time}" for name, size, time in files(spark, path))


def sha256(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file, or one over those of all files below a folder. Tasks read the files, a block at a time."""
    names = [(name,) for name, _, _ in files(spark, path)]
    if not names:
        return _digest(iter(()))

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            out = []
            for name in pdf["name"]:
                store, where = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                h = hashlib.sha256()
                with store.open_input_stream(where, compression=None) as f:
                    while block := f.read(1 << 20):
                        h.update(block)
                out.append(h.hexdigest())
            yield pd.DataFrame({"sha256": out})

    found = spark.createDataFrame(names, "name string").repartition(min(len(names), 1000)).mapInPandas(run, "sha256 string")
    digests = sorted(r["sha256"] for r in found.collect())
    return digests[0] if len(digests) == 1 else _digest(iter(digests))


@dataclass(frozen=True)
class Manifest:
    """inputs: a listing or a checksum of each, by name."""

    build_version: str
    inputs: dict[str, str]
    parameters: dict
    rows: int = 0
    provenance: dict = field(default_factory=dict)

    def same_build(self, other: Manifest) -> bool:
        return (self.build_version, self.inputs, self.parameters) == (other.build_version, other.inputs, other.parameters)


def save(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Written beside and moved into place, so that no reader sees half of it."""
    where, store = _store(spark, path)
    beside, _ = _store(spark, f"{path}.tmp")
    out = store.create(beside, True)
    out.write(json.dumps(asdict(manifest), indent=2, sort_keys=True).encode())
    out.close()
    store.delete(where, False)
    if not store.rename(beside, where):
        raise OSError(f"{path} couldn't be put in place")


def load(spark: SparkSession, path: str) -> Manifest | None:
    where, store = _store(spark, path)
    if not store.exists(where):
        return None
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    return Manifest(**json.loads(text))


def reusable(spark: SparkSession, path: str, wanted: Manifest, output: str) -> Manifest | None:
    """The manifest of an equal build whose output is there, with the rows that it tells."""
    had = load(spark, path)
    if had is None or not had.same_build(wanted) or not exists(spark, f"{output}/_SUCCESS"):
        return None
    return had if spark.read.parquet(output).count() == had.rows else None


def published(spark: SparkSession, staging: str, output: str) -> None:
    """Moves a complete output into place. What was there is moved aside first and deleted last: a reader finds the old
    one or the new one, and a job that fails before leaves the old one."""
    (new, store), (place, _), (old, _) = _store(spark, staging), _store(spark, output), _store(spark, f"{staging}.old")
    had = store.exists(place)
    if had and not store.rename(place, old):
        raise OSError(f"{output} couldn't be moved aside")
    if not store.rename(new, place):
        raise OSError(f"{output} couldn't be put in place")
    if had:
        store.delete(old, True)
