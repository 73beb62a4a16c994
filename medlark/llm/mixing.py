"""Mixing sources to target weights by pivotal dependent rounding.

Targets: a budget of `share` times all words goes to the sources by weight; a source takes at most `most` times its own
words, and what lies above is shared again by weight among the others (water filling). A source's rate r = target / words
gives each of its documents floor(r) copies and a fraction of another one. Fractions are rounded by pivotal sampling on
words: two fractional documents are paired, and one of two transfers of words between them is drawn so that one fraction
becomes 0 or 1 and each fraction keeps its expectation; the words of the pair stay as they were. A task rounds a bucket of
a source's documents, large documents first, and passes on the one residual; residuals meet in the same way in a tree of
fan-in FAN until each source has one, which is rounded to the nearer side. So a source's words miss its target by at most
half of one document.

Draws depend on seed, source, level and bucket alone, so reruns agree. Nulls: a null text has no words, a null source is a
source of its own, the last one, a null doc_id is dealt by its text. Documents without words take none. Repeated rows are
rounded each by itself. Empty table: empty result. Extra columns are kept by copies() and ignored by mixture().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, pick, remove, tidy, written

#: Fixed by the contract: what separates words, and the weights of sources by rank, repeating.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents in a bucket, about, and residuals that meet in a node of the tree.
BUCKET, FAN = 4_000, 64
_EVEN = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long"))


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> dict:
    """Target of each source, from (source, words). Sources rank by code point, null last."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    limit = {s: most * n for s, n in ranked}
    left, open_, out = share * sum(n for _, n in ranked), [s for s, _ in ranked], {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] >= limit[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = limit[s]
            left -= limit[s]
        open_ = [s for s in open_ if s not in out]
        left = max(left, 0.0)
    return out


def pivot(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Fractions after one pass of pairwise transfers, in the order given, and the place of the one left fractional."""
    size, p, draw = size.tolist(), p.tolist(), draw.tolist()
    held = None
    for i in range(len(p)):
        if not _EVEN < p[i] < 1 - _EVEN:
            p[i] = float(round(p[i]))
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        # words that can go from b to a, and from a to b
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        move = up if draw[i] * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        held = None
        for k in (a, b):
            if _EVEN < p[k] < 1 - _EVEN:
                held = k
            else:
                p[k] = float(round(p[k]))
    return np.array(p), held


def mixture(spark: SparkSession, docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row, and the columns to carry along."""
    carry = carry or []
    docs = pick(docs, "doc_id", "text", "source", *carry)
    # by the whole row, so that many rows of one doc_id are dealt as others are
    deal = F.xxhash64("doc_id", F.col("text").cast("string"))
    rows = sized(docs.withColumn("source", F.col("source").cast("string"))).select("doc_id", "source", "size", deal.alias("deal"), *[c for c in carry if c not in ("doc_id", "source", "size")])
    rows = written(rows, "sizes")
    # one row a source
    by_source = [(r["source"], r["n"] or 0, r["docs"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()]
    target = targets([(s, n) for s, n, _ in by_source], share, most, weights)
    plan = spark.createDataFrame([(s, n, float(target[s]), float(target[s] / n) if n else 0.0, max(1, -(-d // BUCKET))) for s, n, d in by_source], "s string, source_size long, target double, rate double, buckets long")
    # a row a source: the join is broadcast where that is small, and else shuffled by the engine
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("bucket", F.pmod("deal", F.col("buckets")))
    depth = max([0, *[int(np.ceil(np.log(max(1, -(-d // BUCKET))) / np.log(FAN) - 1e-9)) for _, _, d in by_source]])
    kinds = dict(placed.dtypes)
    kept = [*dict.fromkeys(["doc_id", "source", "size", "deal", "source_size", "target", "rate", "bucket", *carry])]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", copies long, part double, open boolean"

    def round_group(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "deal", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
            source, bucket = pdf["source"].iloc[0], int(pdf["bucket"].iloc[0])
            rng = np.random.default_rng([seed, level, bucket, *(b"" if pd.isna(source) else source.encode())])
            part, held = pivot(pdf["size"].to_numpy(), pdf["part"].to_numpy(), rng.random(len(pdf)))
            if held is not None and level == depth:
                part[held], held = float(part[held] >= 0.5), None
            pdf["part"] = part
            pdf["open"] = np.arange(len(pdf)) == (-1 if held is None else held)
            return pdf

        return run

    whole = F.floor("rate").cast("long")
    at = placed.select(*kept, F.when(F.col("size") > 0, whole).otherwise(0).alias("copies"), F.when(F.col("size") > 0, F.col("rate") - whole).otherwise(0.0).alias("part"), F.lit(False).alias("open"))
    result = None
    for level in range(depth + 1):
        done = written(at.groupBy("source", "bucket").applyInPandas(round_group(level), schema), "rounded")
        closed = done.where("not open")
        result = closed if result is None else result.unionByName(closed)
        at = done.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast(kinds["bucket"])).withColumn("open", F.lit(False))
    remove(spark, rows)
    copies = (F.col("copies") + F.col("part").cast("long")).alias("copies")
    return result.select("doc_id", "size", "source_size", "target", copies, *[c for c in carry if c not in ("doc_id", "size")]).withColumn("taken", F.col("copies") * F.col("size"))


#: Decisions of up to so many rows are sent to all tasks, a bit a row and copy (16 MB a copy), and joined by a shuffle beyond.
BROADCAST_ROWS = 1 << 27


def copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs.

    Rows get a key that is written with them, so that repeated rows stay apart when decisions meet them again. Decisions
    come to the rows: as bit maps over the keys, so that no text is shuffled, unless there are too many of them."""
    tidy(spark)
    plain, names = numbered(docs)
    keyed = written(plain.withColumn("row", F.monotonically_increasing_id()), "keyed")
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text", "source")}
    mixed = mixture(spark, keyed.select("row", *[F.col(n).alias(c) for c, n in at.items()]), carry=["row"], **options)
    taken = written(mixed.where("copies > 0").select("row", F.col("copies").cast("int").alias("_copies")), "taken")
    if taken.count() <= BROADCAST_ROWS:
        rows = keyed.withColumn("_copies", _decisions(taken)(F.col("row"))).where("_copies > 0")
    else:
        rows = keyed.join(taken, "row")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*names).toDF(*docs.columns)


def _decisions(taken: DataFrame):
    """A column function: copies of a row by its key. Keys count up within a partition, so blocks of them are well filled."""
    spark = taken.sparkSession
    each = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    blocks = each.groupBy("copy", F.expr("row div 32768").alias("block")).agg(F.bitmap_construct_agg(F.expr("row % 32768")).alias("bits"))
    shared = spark.sparkContext.broadcast({(r["block"], r["copy"]): np.frombuffer(bytes(r["bits"]), dtype=np.uint8) for r in blocks.toLocalIterator()})

    @F.arrow_udf("int")
    def test(row: pa.Array) -> pa.Array:
        known, row = shared.value, row.to_numpy(zero_copy_only=False)
        block, place, out = row >> 15, row & 32767, np.zeros(len(row), dtype=np.int32)
        for b in np.unique(block).tolist():
            here, copy = np.flatnonzero(block == b), 1
            while (bits := known.get((b, copy))) is not None:
                p = place[here]
                out[here] += bits[p >> 3] >> (p & 7).astype(np.uint8) & 1
                copy += 1
        return pa.array(out)

    return test
