"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

Texts are equal when they are identical after deleting the characters of [\\x20\\x09-\\x0D]. A snapshot is a written table of
classes (one row for every distinct text) with a binary-fuse filter for each of its digest buckets; it is immutable, and can
be opened from its folder in later sessions. A new batch is grouped by itself first; of its classes, those that the filters
of all snapshots deny are new, and no row of a snapshot is touched for them; the positives join their exact bucket, where
the normalised bytes are compared. What is new becomes a snapshot of its own.

Nulls: a null text is empty; a null doc_id counts as larger than all. Repeated rows are rows of their class, and one of
them stays. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, numbered, pick, remove, screen, tidy, untouched, written

#: The characters that don't count.
BLANKS = " \t\n\x0b\x0c\r"
#: Classes in a bucket, and so keys in a filter, are about so many.
BUCKET_CLASSES = 200_000


# --- the filter -------------------------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment and number of segments, by the sizes that the method's authors give for three hashes."""
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    length = min(length, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * factor / length)) - 2) + 2


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each key: in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64((segments - 2) * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> dict:
    """A filter of 8-bit prints over distinct unsigned 64-bit keys. Slots with one key are peeled in whole rounds; prints
    are then set round by round, last round first. Another seed is tried when a round finds nothing to peel."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 1) * length
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        at = _places(h, length, segments)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        lone = np.flatnonzero(count == 1)
        while len(lone):
            who, pick = np.unique(owner[lone], return_index=True)
            slot = lone[pick]
            rounds.append((who, slot))
            left -= len(who)
            touched = at[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(who, 3))
            touched = np.unique(touched)
            lone = touched[count[touched] == 1]
        if not left:
            break
    else:
        raise RuntimeError("no seed gives a filter")
    table, prints = np.zeros(size, dtype=np.uint8), _prints(h)
    for who, slot in reversed(rounds):
        table[slot] = 0
        a, b, c = at[:, who]
        table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c]
    return {"seed": seed, "length": length, "segments": segments, "table": table.tobytes()}


def fuse_has(part: dict, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: always true of its own keys, of one in 256 others."""
    table = np.frombuffer(part["table"], dtype=np.uint8)
    h = _mix(np.asarray(keys, dtype=np.uint64), part["seed"] * 0x9E3779B97F4A7C15 & (2**64 - 1))
    a, b, c = _places(h, part["length"], part["segments"])
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)


# --- tables -----------------------------------------------------------------------------------------------------------


def normalised(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def digest_of(norm):
    return F.sha2(norm, 256)


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, digest) of every row: all that later steps need but for byte checks."""
    return docs.select("doc_id", F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_chars"), digest_of(normalised(F.col("text"))).alias("digest"))


def best():
    """Of a class, the row that stays: most code points, then smallest doc_id (null: after all)."""
    return F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.col("n_chars"), F.col("doc_id").isNotNull(), F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(0)))))


def classes(rows: DataFrame) -> DataFrame:
    """One row for every digest of a batch, by sums within each task first, so a hot digest costs a row a task."""
    return rows.groupBy("digest").agg(best().alias("keep"), F.count(F.lit(1)).alias("n")).select("digest", F.col("keep.doc_id").alias("doc_id"), F.col("keep.n_chars").alias("n_chars"), "n")


def _key(column="digest"):
    """The first 64 bits of a digest, as a signed long."""
    return F.conv(F.substring(column, 1, 16), 16, -10).cast("long")


def _bucket(buckets: int):
    return F.pmod(F.conv(F.substring("digest", 17, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class Snapshot:
    """Classes of accepted texts and a filter for every bucket of their digests, written once under a folder and never
    changed; `open` reads it again in any later session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.classes = spark.read.parquet(f"{folder}/classes")
        self.filters = spark.read.parquet(f"{folder}/filters")
        self.folder = folder
        self.buckets = (self.filters.select("buckets").first() or [1])[0]

    open = classmethod(lambda cls, spark, folder: cls(spark, folder))

    @classmethod
    def write(cls, spark: SparkSession, rows: DataFrame, folder: str | None = None, docs: DataFrame | None = None) -> Snapshot:
        """rows: (digest, doc_id, n_chars, n), a row a class. The filters are written last. With `docs`, the normalised texts of
        the classes' keepers are kept beside them, so that later sessions can compare bytes; without, whoever compares has to
        have those documents."""
        folder = folder or new_path(spark, "snapshot")
        if docs is not None:
            _texts(docs).join(rows.select("digest", F.col("doc_id").alias("d")), "digest").where(F.col("id").eqNullSafe(F.col("d"))).groupBy("digest", "id").agg(F.min("norm").alias("norm")).write.parquet(f"{folder}/texts")
        rows.select("digest", "doc_id", "n_chars", "n").write.parquet(f"{folder}/classes")
        known = spark.read.parquet(f"{folder}/classes")
        buckets = max(1, -(-known.count() // BUCKET_CLASSES))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            part = fuse_build(pdf["key"].to_numpy().astype(np.uint64))
            return pd.DataFrame([part | {"bucket": pdf["bucket"].iloc[0], "buckets": buckets}])

        keyed = known.select(_bucket(buckets).alias("bucket"), _key().alias("key"))
        keyed.groupBy("bucket").applyInPandas(build, "seed int, length int, segments int, table binary, bucket int, buckets int").write.parquet(f"{folder}/filters")
        return cls(spark, folder)

    def screened(self, batch: DataFrame) -> DataFrame:
        """Classes of a batch with `maybe`: false if the snapshot surely lacks their digest. A bucket's classes meet its
        filter in one task: their number is bounded by BUCKET_CLASSES for each snapshot's worth of them, and copies have
        been counted away before."""

        def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            hit = fuse_has(right.iloc[0].to_dict(), left["key"].to_numpy().astype(np.uint64)) if len(right) and len(left) else np.zeros(len(left), dtype=bool)
            return left.drop(columns=["key", "bucket", "salt"]).assign(maybe=hit)

        # more classes than the snapshot has: a bucket is dealt to several tasks, each with a copy of its filter
        salts = max(1, -(-batch.count() // (self.buckets * BUCKET_CLASSES)))
        left = batch.withColumns({"key": _key(), "bucket": _bucket(self.buckets), "salt": F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int")})
        right = self.filters.drop("buckets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        schema = ", ".join(f"{c} {t}" for c, t in batch.dtypes) + ", maybe boolean"
        return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInPandas(probe, schema)

    def matches(self, fresh: DataFrame) -> DataFrame:
        """(digest, new_id, old_id) of the screened classes that stand in the exact buckets: a filter may be wrong."""
        return fresh.where("maybe").select("digest", F.col("doc_id").alias("new_id")).join(self.classes.select("digest", F.col("doc_id").alias("old_id")), "digest")


def _texts(docs: DataFrame) -> DataFrame:
    """(id, norm, digest) of documents."""
    return docs.select(F.col("doc_id").alias("id"), normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of(F.col("norm")))


def same_bytes(docs: DataFrame, found: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
    """(digest, same) for every row of the written table found (digest, new_id, old_id): whether the two texts' normalised
    bytes agree. Old texts come from the documents, or from a `snapshot` that keeps its own. Both texts have to be there, else
    the job fails: nothing is taken for equal that wasn't compared."""
    # of a class, the texts of two rows are wanted: those pass a screen before anything is shuffled
    wanted = written(found.select("digest", F.explode(F.array("new_id", "old_id")).alias("id")).distinct(), "wanted")
    row = lambda id_: F.xxhash64("digest", F.coalesce(id_.cast("long"), F.lit(-1)))
    passes = screen(wanted.select(row(F.col("id")).alias("key")), "key")
    texts = _texts(docs).where(passes(row(F.col("id")))).select(F.lit(False).alias("kept"), "id", "norm", "digest")
    if snapshot is not None:
        texts = texts.unionByName(docs.sparkSession.read.parquet(f"{snapshot.folder}/texts").select(F.lit(True).alias("kept"), "id", "norm", "digest"))
    # each text tells which of the two it is: a snapshot's is the old one, whatever documents came with it
    pairs = found.select(F.col("digest").alias("d"), "new_id", "old_id")
    new, old = ~F.col("kept") & F.col("id").eqNullSafe(F.col("new_id")), (F.col("kept") if snapshot is not None else F.lit(True)) & F.col("id").eqNullSafe(F.col("old_id"))
    picked = texts.join(pairs, (F.col("digest") == F.col("d")) & (new | old))
    compared = picked.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"), (F.bool_or(new) & F.bool_or(old)).alias("both"))
    missing = F.raise_error(F.concat(F.lit("no texts to compare for digest "), F.col("digest")))
    met = found.select("digest").join(compared, "digest", "left")
    return met.select("digest", F.when(F.coalesce("both", F.lit(False)), F.col("same")).otherwise(missing.cast("boolean")).alias("same"))


def dedup(spark: SparkSession, docs: DataFrame, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    The table comes in as `batches` parts dealt by doc_id. Each batch's classes are screened against all snapshots so far;
    what none of them has becomes one more snapshot, and the older ones stay as they are."""
    docs = pick(docs, "doc_id", "text")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    rows = written(digest_rows(docs).withColumn("part", part), "digests")
    known = [Snapshot.write(spark, classes(rows.where("part = 0")))]
    scratch: list[DataFrame] = []
    merged = known[0].classes.select("digest", F.lit(0).alias("variant"), "doc_id", "n_chars", "n")
    for k in range(1, batches):
        batch = classes(rows.where(F.col("part") == k))
        batch = batch if len(known) == 1 else written(batch, "batch")
        found = None
        for snapshot in known:  # a digest stands in one of them at most
            fresh = written(snapshot.screened(batch), "screened")
            scratch.append(fresh)
            hits = snapshot.matches(fresh)
            found = hits if found is None else found.unionByName(hits)
        found = written(found, "positives")
        checked = written(same_bytes(docs, found), "checked")
        scratch += [found, checked]
        # texts of one digest and other bytes (a collision) stay apart, as a variant of their own
        tagged = fresh.join(checked, "digest", "left").select("digest", F.when(F.col("same") == F.lit(False), k).otherwise(0).alias("variant"), "doc_id", "n_chars", "n")
        merged = merged.unionByName(tagged)
        if k + 1 < batches:
            known.append(Snapshot.write(spark, fresh.join(checked, "digest", "left_anti")))
    final = merged.groupBy("digest", "variant").agg(best().alias("keep"), F.sum("n").alias("group_size"))
    odd = written(merged.where("variant > 0").select("digest", F.col("variant").alias("part"), "variant").distinct(), "odd")
    final = written(final.select("digest", "variant", F.col("keep.doc_id").alias("keep_id"), "group_size"), "classes")
    for table in (*scratch, *[t for k in known for t in (k.classes, k.filters)]):
        remove(spark, table)
    placed = rows.join(odd, ["digest", "part"], "left").select("doc_id", "digest", F.coalesce("variant", F.lit(0)).alias("variant"))
    return placed.join(final, ["digest", "variant"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def kept_documents(spark: SparkSession, docs: DataFrame, batches: int = 2) -> DataFrame:
    """The rows that stay, with all their columns; of repeated rows, one. Rows of a class of their own, which are most, go on
    where they are read; the others meet their decisions."""
    tidy(spark)
    id_ = lambda c: F.coalesce(c.cast("long"), F.lit(-1))
    decided = dedup(spark, docs, batches).where("group_size > 1").groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("_copies"))
    decided = written(decided.select(F.col("doc_id").alias("_d"), "text_sha256", "kept", "_copies", F.xxhash64("text_sha256", id_(F.col("doc_id"))).alias("_h")), "decided")
    plain, names = numbered(docs)
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    keyed = plain.withColumn("_digest", digest_of(normalised(F.col(at["text"]))))
    keyed = keyed.withColumn("_h", F.xxhash64("_digest", id_(F.col(at["doc_id"]))))
    alone, met = untouched(keyed, decided, "_h")
    rows = met.join(decided.drop("_h"), F.col(at["doc_id"]).eqNullSafe(F.col("_d")) & (F.col("_digest") == F.col("text_sha256")), "left").where(F.coalesce("kept", F.lit(True)))
    # rows of one doc_id and one normalised text: the longest original, then the largest row, stays
    size = F.coalesce(F.length(F.col(at["text"]).cast("string")), F.lit(0))
    repeated = rows.where("_copies > 1").groupBy("_d", "_digest").agg(F.max(F.struct(size.alias("_size"), *names)).alias("row")).select(*[f"row.{n}" for n in names])
    return alone.select(*names).unionByName(rows.where("coalesce(_copies, 1) = 1").select(*names)).unionByName(repeated).toDF(*docs.columns)
