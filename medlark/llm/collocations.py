"""Phrase collocations: candidates from a count-min sketch, counted exactly by delimiter-guarded Aho-Corasick automata.

Texts are lower-cased (A to Z only) and split into pieces and words as the patterns below say; everything is per language.
1. Sketch: each task counts its word runs of one to MOST_WORDS in two rows of cells, saturated at the threshold; a run's
   cells never hold less than its occurrences, so a run is a candidate unless a cell, or one of its shorter runs, falls
   below the threshold. The summed rows leave a bit a cell, 2 x 8 MB whatever the corpus.
2. Count: each shard (bounded text of one language in a task) compiles the candidates that it holds into automata of bounded
   size, whose patterns begin and end with the delimiter, and counts all overlapping matches in its pieces. A candidate is
   one in every shard, so sums over shards are exact.
3. The threshold applies to the sums; cuts, scores and containment are joins and aggregates of the phrases left, with decimal
   arithmetic; the first ranks of a language are limited within tasks before they meet.

Nulls: a null text is empty, a null language is 'und'. Repeated rows count each. Empty texts and tables give no phrase. Extra
columns are ignored. Ties in score and count go to the phrase that is least in UTF-8.
"""

from __future__ import annotations

from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, remove, written
from .tokens import balanced

#: Words of a phrase at most.
MOST_WORDS = 4
#: Cells of each of the two rows of the sketch, and cells of a block that tasks hand on.
CELLS, BLOCK = 1 << 26, 1 << 18
#: Bytes of text of a shard, and patterns of an automaton.
SHARD_BYTES, PATTERNS = 16 << 20, 250_000
#: Shards hand on their counts in so many parts by phrase, as columns; rows of a part that are summed at once.
BUCKETS, MERGE = 1024, 1_000_000

#: Lower case and delimiters, byte by byte: bytes beyond ASCII stay. A piece ends with a line feed, words with blanks.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_U = np.uint64


class Shard:
    """The words of texts of one language, in order: `words`, the distinct ones, and `ids`, where 0 ends a piece."""

    def __init__(self, texts: list[bytes], lang: str):
        whole = b"\n".join([*texts, b""]).translate(_BYTES).replace(b"\n", b" \n ")
        found = pc.list_flatten(pc.split_pattern(pa.array([b"\n " + whole], pa.large_binary()), b" "))
        found = found.filter(pc.greater(pc.binary_length(found), 0)).dictionary_encode()
        self.words: list[bytes] = found.dictionary.to_pylist()
        self.ids = found.indices.to_numpy().astype(np.int64)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], dtype=_U)

    def hashes(self):
        """For each number of words: the hash of the run that begins at each place, and whether it stays in a piece."""
        h, inside = self.hash[self.ids], self.ids != 0
        value, ok = h, inside
        for n in range(1, MOST_WORDS + 1):
            yield n, value, ok
            value = value[:-1] * _U(0x9E3779B97F4A7C15) + h[n:]
            value ^= value >> _U(31)
            value *= _U(0xBF58476D1CE4E5B9)
            ok = ok[:-1] & inside[n:]

    def text(self) -> str:
        """The words between delimiters: a blank on each side, and a line feed for the end of a piece."""
        return (b" " + b" ".join([self.words[i] for i in self.ids.tolist()]) + b" ").decode("utf-8", "surrogateescape")

    def candidates(self, bits: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Numbers of words whose cells reach the threshold, and the distinct runs of two and more that do, as numbers of words."""
        runs, before, rank = [], None, None
        for n, value, ok in self.hashes():
            if n == 1:
                known = _heavy(bits, self.hash)
                known[0] = False
                before, rank = known[self.ids], self.ids
                single = known
                continue
            at = np.flatnonzero(ok & before[:-1] & before[1:])
            at = at[_heavy(bits, value[at])]
            # numbers of the two runs of n - 1 words name the run: no hash decides which runs are the same
            pair, first, number = np.unique(rank[at] << 32 | rank[at + 1], return_index=True, return_inverse=True)
            runs += [tuple(r) for r in self.ids[at[first][:, None] + np.arange(n)].tolist()]
            before, rank = np.zeros(len(ok), bool), np.zeros(len(ok), np.int64)
            before[at], rank[at] = True, number
        return single, runs


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The cell of each hash in the first and the second row."""
    return [(hashes >> _U(38)).astype(np.uint32), (hashes & _U(CELLS - 1)).astype(np.uint32) + np.uint32(CELLS)]


def _heavy(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, second = _cells(hashes)
    return ((bits[first >> 3] >> (first & 7).astype(np.uint8)) & (bits[second >> 3] >> (second & 7).astype(np.uint8)) & 1).astype(bool)


def shards(batches, lang: str = "lang", text: str = "text"):
    """(language, Shard) of bounded bytes each; a longer text stands in one of its own."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in balanced(batches, text, SHARD_BYTES):
        for k, t in zip(b.column(lang).to_pylist(), b.column(text).cast(pa.binary()).to_pylist(), strict=True):
            if t:
                held.setdefault(k, []).append(t)
                size += len(t)
        if size >= SHARD_BYTES:
            for k in list(held):
                yield k, Shard(held.pop(k), k)
            size = 0
    for k in list(held):
        yield k, Shard(held.pop(k), k)


def _source(docs: DataFrame) -> DataFrame:
    return pick(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def heavy_cells(docs: DataFrame, least: int) -> np.ndarray:
    """A bit a cell of the sketch: whether it may hold a run of `least` occurrences."""
    top = min(least, 255)

    def count(batches):
        cells = np.zeros(2 * CELLS, dtype=np.uint8)
        used = np.zeros(2 * CELLS // BLOCK, dtype=bool)
        for _, shard in shards(batches):
            for _, value, ok in shard.hashes():
                for row in _cells(value[ok]):
                    found, n = np.unique(row, return_counts=True)
                    cells[found] = np.minimum(cells[found] + np.minimum(n, top), top)
                    used[np.unique(found // BLOCK)] = True
        packer = zstandard.ZstdCompressor(level=1)
        for b in np.flatnonzero(used).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "cells": pa.array([packer.compress(cells[b * BLOCK : (b + 1) * BLOCK])], pa.binary())})

    def add(batches):
        unpacker, at, total = zstandard.ZstdDecompressor(), None, None

        def done():
            bits = np.packbits(total >= top, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "bits": pa.array([bits], pa.binary())})

        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("cells").to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, total = block, np.zeros(BLOCK, dtype=np.uint16)
                total = np.minimum(total + np.frombuffer(unpacker.decompress(packed), dtype=np.uint8), top).astype(np.uint16)
        if at is not None:
            yield done()

    parts = _source(docs).mapInArrow(count, "block int, cells binary").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(2 * CELLS // 8, dtype=np.uint8)
    for r in parts.mapInArrow(add, "block int, bits binary").collect():  # 512 blocks, whatever the corpus
        at = r["block"] * BLOCK // 8
        bits[at : at + BLOCK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def _matches(shard: Shard, runs: list[tuple[int, ...]]) -> np.ndarray:
    """Occurrences of each run, overlapping ones included."""
    counts, text = np.zeros(len(runs), dtype=np.int64), shard.text() if runs else ""
    for lo in range(0, len(runs), PATTERNS):
        part = runs[lo : lo + PATTERNS]
        automaton = ahocorasick.Automaton()
        for k, run in enumerate(part):
            automaton.add_word((b" " + b" ".join([shard.words[i] for i in run]) + b" ").decode("utf-8", "surrogateescape"), k)
        automaton.make_automaton()
        hits = np.fromiter(map(itemgetter(1), automaton.iter(text)), dtype=np.int64)
        counts[lo : lo + len(part)] = np.bincount(hits, minlength=len(part))
    return counts


def counted(spark: SparkSession, docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f) of all runs of one to MOST_WORDS words with `least` occurrences, and a row without phrase
    (0 words) that holds the occurrences of all words of the language."""
    shared = spark.sparkContext.broadcast(heavy_cells(docs, least))

    def run(batches):
        for lang, shard in shards(batches):
            single, runs = shard.candidates(shared.value)
            per_word = np.bincount(shard.ids, minlength=len(shard.words))
            known = np.flatnonzero(single)
            phrases = [*[shard.words[i] for i in known.tolist()], *[b" ".join([shard.words[i] for i in r]) for r in runs]]
            f = np.concatenate([per_word[known], _matches(shard, runs)])
            sizes = np.concatenate([np.ones(len(known), np.int64), [len(r) for r in runs]]).astype(np.int32)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(p) % BUCKETS for p in phrases), dtype=np.int32, count=len(phrases))
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            edges = pa.array(np.append(first, len(order)).astype(np.int32))
            at = pa.array(order)
            lists = [pa.ListArray.from_arrays(edges, c.take(at)) for c in (pa.array(phrases, pa.binary()), pa.array(sizes), pa.array(f))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), *lists], names=["lang", "bucket", "phrase", "words", "f"])
            total = [[lang], [BUCKETS], [[None]], [[0]], [[len(shard.ids) - int(per_word[0])]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(total, kinds, strict=True)], names=["lang", "bucket", "phrase", "words", "f"])

    def add(batches):
        at, held, size = None, [], 0

        def together():
            return pa.concat_tables(held).group_by(["phrase", "words"]).aggregate([("f", "sum")]).rename_columns(["phrase", "words", "f"])

        def done():
            t = together()
            t = t.filter(pc.or_(pc.equal(t["words"], 0), pc.greater_equal(t["f"], least))).combine_chunks()
            for part in t.to_batches(1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(part), pa.string()), *[part.column(c) for c in ("phrase", "words", "f")]], names=["lang", "phrase", "words", "f"])

        for b in batches:
            for k, key in enumerate(zip(b.column("lang").to_pylist(), b.column("bucket").to_pylist(), strict=True)):
                if at is not None and key != at:
                    yield from done()
                    held, size = [], 0
                at = key
                held.append(pa.table({c: b.column(c)[k].values for c in ("phrase", "words", "f")}))
                size += len(held[-1])
                if size > MERGE:  # as many as there are distinct phrases stay
                    held = [together()]
                    size = 0
        if at is not None:
            yield from done()

    kinds = [pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    parts = _source(docs).mapInArrow(run, "lang string, bucket int, phrase array<binary>, words array<int>, f array<long>")
    rows = parts.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(add, "lang string, phrase binary, words int, f long")
    return rows.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 30, top: int = 2000, contained: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to MOST_WORDS words.

    The score is that of the weakest cut, floor(2,000,000 a / (l + r)); a phrase goes if a longer candidate around it has at
    least `contained` percent of its occurrences."""
    f = written(counted(spark, docs, least), "phrases")
    known = f.where("words > 0").select("lang", "phrase", "f")
    long = f.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = long.withColumn("w", F.split("phrase", " ", -1))
    some = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")  # noqa: E731  n words from number lo, counted from 1
    # both parts of every cut look for their occurrences; each is a candidate or a word as frequent as the phrase
    cut = split.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), some(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), some(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    met = sides.join(known.withColumnRenamed("phrase", "part"), ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r) as long)")
    scored = met.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("m")).select("lang", "phrase", "a", "m.*")
    # what a longer candidate holds, with the most occurrences of any of them
    windows = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda lo: some(lo, n))))
    around = split.where("words > 2").select("lang", F.explode(F.array_distinct(windows)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(contained)}"))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    totals = f.where("words = 0").select("lang", F.col("f").alias("n"))  # a row a language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
