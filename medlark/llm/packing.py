"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most `room` tokens (only the first may be shorter if there are several). Whole pieces are
sequences of their own; the others are dealt at random to islands of about ISLAND pieces. On an island, solutions are sets
of bins. Crossover injects well-filled bins of one parent whole into the other, drops the bins there that hold any of the
same pieces, and puts displaced pieces into the best-fitting bins, largest first;
a mutation opens the least-filled bins and some others and fits their pieces anew. An island stops at its lower bound,
ceil(tokens / room). Islands that aren't there keep their whole population from epoch to epoch and exchange elites: fill
patterns of their fullest bins go to the next island, which builds bins of its own pieces after them. At the end each island's few least-filled bins are opened, and their pieces are
packed together with those of FAN islands, in a tree up to one island, so that waste doesn't grow with the islands.

Nulls: a null text is empty (the end id only). Repeated rows, and rows with null doc_id, give pieces of their own. Empty
table: empty result. Very long texts give many pieces, none of which is held back. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, remove, tidy, written
from .tokens import balanced, encoder

#: Pieces of an island; islands that a node of the tree joins; bins that an island opens; solutions; generations in an
#: epoch; epochs; openings of a mutation; elites sent; fill from which a bin is well filled.
ISLAND, FAN, OPENED, POPULATION, GENERATIONS, EPOCHS, TRIES, ELITES, WELL = 4096, 64, 16, 3, 2, 2, 20, 64, 0.995


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= room:
        return [(0, n)]
    first = n % room or room
    return [(0, first), *[(s, room) for s in range(first, n, room)]]


def pieces(docs: DataFrame, path: str, room: int, end_id: int, kind: str = "space") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; ids leave the function as a checksum only."""
    source = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path, kind)
        for b in balanced(batches, "text", encoding=True):
            rows, counts = [], []
            for ids in enc.batch(b.column("text").to_pylist()):
                ids += end
                found = cut(len(ids) >> 2, room)
                counts.append(len(found))
                rows += [(k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(found)]
            n = np.array(rows, dtype=np.int64).reshape(-1, 4)
            at = pa.array(np.repeat(np.arange(b.num_rows), counts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(n[:, 0].astype(np.int32)), *[pa.array(n[:, c]) for c in (1, 2, 3)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


# --- one island -------------------------------------------------------------------------------------------------------


class Bins:
    """Bins by free room: a bit map says which amounts of room there are, so the best fit is one look."""

    def __init__(self, room: int, bins: list[tuple[int, ...]], size: list[int]):
        self.room, self.size = room, size
        self.bins = [list(b) for b in bins]
        self.free = [room - sum(size[i] for i in b) for b in bins]
        self.at: list[list[int]] = [[] for _ in range(room + 1)]
        self.map = 0
        for k, f in enumerate(self.free):
            self.at[f].append(k)
            self.map |= 1 << f

    def put(self, item: int) -> None:
        n = self.size[item]
        fits = self.map >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            k = self.at[f].pop()
            if not self.at[f]:
                self.map &= ~(1 << f)
            self.bins[k].append(item)
            left = f - n
        else:
            k, left = len(self.bins), self.room - n
            self.bins.append([item])
            self.free.append(left)
        self.free[k] = left
        self.at[left].append(k)
        self.map |= 1 << left


def best_fit(room: int, size: list[int], order: list[int], start: list | None = None) -> list[tuple[int, ...]]:
    bins = Bins(room, start or [], size)
    for i in order:
        bins.put(i)
    return [tuple(b) for b in bins.bins]


def subset_fit(room: int, size: list[int]) -> list[tuple[int, ...]]:
    """Bins around the largest piece left, each with the pieces whose sum comes nearest to the gap, larger pieces first. Sums
    that can be reached are bits of a number; for some hundred pieces at most."""
    left = sorted(range(len(size)), key=lambda i: size[i])
    mask, out = (1 << (room + 1)) - 1, []
    while left:
        seed = left.pop()
        gap, reach = room - size[seed], [1]
        for i in left:
            reach.append(reach[-1] | reach[-1] << size[i] & mask)
        target = (reach[-1] & ((1 << (gap + 1)) - 1)).bit_length() - 1
        chosen = []
        for k in range(len(left) - 1, -1, -1):
            n = size[left[k]]
            if n <= target and reach[k] >> (target - n) & 1:
                chosen.append(k)
                target -= n
        out.append((seed, *[left[k] for k in chosen]))
        for k in chosen:
            del left[k]
    return out


def reopened(room: int, size: list[int], bins: list, rng: np.random.Generator, low: int = 8, others: int = 25) -> list[tuple[int, ...]]:
    """TRIES times, the least-filled bins and some others are opened and their pieces fitted anew, best fit by
    falling length and by nearest sums; the best is taken if it isn't worse in bins, then in squared fills."""
    bins = list(bins)
    fills = np.array([sum([size[i] for i in b]) for b in bins])
    for _ in range(TRIES):
        at = {*np.argsort(fills, kind="stable")[:low].tolist(), *rng.integers(0, len(bins), others).tolist()}
        items = [i for k in at for i in bins[k]]
        lengths = [size[i] for i in items]
        found = []
        for fit in (best_fit(room, lengths, sorted(range(len(items)), key=lambda j: -lengths[j])), subset_fit(room, lengths)):
            fill = [sum([lengths[j] for j in b]) for b in fit]
            found.append((-len(fit), sum([f * f for f in fill]), fit, fill))
        n, squares, fit, fill = max(found, key=lambda x: x[:2])
        if (n, squares) >= (-len(at), int((fills[list(at)] ** 2).sum())):
            keep = [k for k in range(len(bins)) if k not in at]
            bins = [bins[k] for k in keep] + [tuple(items[j] for j in b) for b in fit]
            fills = np.concatenate([fills[keep], np.array(fill)])
    return bins


def crossed(room: int, size: list[int], into: list, injected: list) -> list[tuple[int, ...]]:
    """Bins of `into` with the injected bins: bins with pieces twice are dropped, their other pieces fitted in."""
    there = {i for b in injected for i in b}
    kept, displaced = list(injected), []
    for b in into:
        if there.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in there]
    displaced.sort(key=lambda i: -size[i])
    return best_fit(room, size, displaced, kept)


def after_patterns(room: int, size: list[int], patterns: list[list[int]]) -> list[tuple[int, ...]]:
    """Bins of own pieces that have the lengths of migrated ones, as far as there are such pieces."""
    stock: dict[int, list[int]] = {}
    for i, n in enumerate(size):
        stock.setdefault(n, []).append(i)
    out = []
    for p in patterns:
        need = {n: p.count(n) for n in p}
        if all(len(stock.get(n, ())) >= c for n, c in need.items()):
            out.append(tuple(stock[n].pop() for n in p))
    return out


def evolve(room: int, size: list[int], rng: np.random.Generator, first: list | None = None, migrants: list | None = None) -> list[list[tuple[int, ...]]]:
    """The population, best solution first: fewer bins win, then the larger sum of squared fills. `first` is the population
    of the epoch before. A solution at the lower bound stands alone."""
    bound = -(-sum(size) // room)
    fill = lambda b: sum([size[i] for i in b])
    worth = lambda s: (-len(s), sum(fill(b) ** 2 for b in s))
    group = list(first) if first else [best_fit(room, size, sorted(range(len(size)), key=lambda i: -size[i]))]
    if len(group[0]) <= bound:
        return group[:1]
    if migrants:
        group.append(crossed(room, size, group[0], after_patterns(room, size, migrants)))
    while len(group) < POPULATION:
        noise = np.array(size) * rng.uniform(0.7, 1.3, len(size))
        group.append(best_fit(room, size, np.argsort(-noise).tolist()))
    group = sorted(group, key=worth, reverse=True)
    for _ in range(GENERATIONS):
        if len(group[0]) <= bound:
            break
        children = []
        for _ in range(POPULATION):
            a, b = rng.choice(min(4, len(group)), 2, replace=False)
            well = [x for x in group[b] if fill(x) >= WELL * room]
            take = rng.random(len(well)) < rng.uniform(0.2, 0.8)
            child = crossed(room, size, group[a], [x for x, t in zip(well, take, strict=True) if t])
            children.append(reopened(room, size, child, rng))
        group = sorted(group + children, key=worth, reverse=True)[:POPULATION]
    return group[:1] if len(group[0]) <= bound else group[:POPULATION]


# --- islands ----------------------------------------------------------------------------------------------------------

#: others: a piece's bins in the other solutions of its island's population.
_ROWS = "uid long, doc_id {}, piece int, start long, length long, ids_crc32 long, island long, bin int, offset long, fill long, others array<int>, pattern array<int>"


def _numbers(bins: list[tuple[int, ...]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[list(b)] = k
    return out


def _bins(numbers: np.ndarray) -> list[tuple[int, ...]]:
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order])) + 1
    return [tuple(g.tolist()) for g in np.split(order, cuts)]


def _pack(room: int, seed: int, level: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf[pdf["pattern"].isna()].sort_values("uid", ignore_index=True)
        island = int(pdf["island"].iloc[0])
        if items.empty:
            return items
        size = [int(n) for n in items["length"]]
        rng = np.random.default_rng([seed, level, epoch, island])
        first = None
        if epoch:
            others = np.array([list(x) for x in items["others"]], dtype=np.int64).reshape(len(size), -1)
            first = [_bins(items["bin"].to_numpy().astype(np.int64)), *[_bins(others[:, k]) for k in range(others.shape[1])]]
        migrants = [[int(n) for n in p] for p in pdf.loc[pdf["pattern"].notna(), "pattern"]]
        fill_of = lambda b: sum([size[i] for i in b])
        best, *rest = evolve(room, size, rng, first, migrants)
        bins = sorted(best, key=lambda b: (fill_of(b), b))
        offset, fill = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for b in bins:
            at = 0
            for i in b:
                offset[i] = at
                at += size[i]
            fill[list(b)] = at
        more = epoch + 1 < EPOCHS and len(bins) > -(-sum(size) // room)
        kept = np.stack([_numbers(b, len(size)) for b in rest], axis=1).tolist() if more and rest else [[]] * len(size)
        out = items.assign(bin=_numbers(bins, len(size)), offset=offset, fill=fill, others=kept)
        if more:  # an island that isn't finished always sends elites, full or not: they tell so
            sent = pd.DataFrame({"island": island, "pattern": [[size[i] for i in b] for b in bins[::-1][:ELITES]]})
            out = pd.concat([out, sent.reindex(columns=out.columns)], ignore_index=True)
            out = out.assign(**{c: pd.Series([x if isinstance(x, list) else None for x in out[c]], dtype=object) for c in ("others", "pattern")}).astype({"piece": "Int32", "bin": "Int32", **{c: "Int64" for c in ("uid", "start", "length", "ids_crc32", "island", "offset", "fill")}})
        return out

    return run


def _evolved(at: DataFrame, schema: str, room: int, seed: int, level: int) -> DataFrame:
    """The islands' rows after all epochs, written. Only islands above their bound go on to a further epoch."""
    done = written(at.groupBy("island").applyInPandas(_pack(room, seed, level, 0), schema), "islands")
    for epoch in range(1, EPOCHS):
        elites = done.where("pattern is not null")
        unfinished = elites.select("island").distinct()
        if unfinished.isEmpty():
            break
        islands = F.broadcast(unfinished) if unfinished.count() <= 100_000 else unfinished
        ring = done.agg(F.max("island")).first()[0] + 1
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ring))).join(islands, "island", "left_semi").select(*done.columns)
        again = done.where("pattern is null").join(islands, "island", "left_semi").select(*done.columns).unionByName(moved)
        settled = done.where("pattern is null").join(islands, "island", "left_anti").select(*done.columns)
        after = written(settled.unionByName(again.groupBy("island").applyInPandas(_pack(room, seed, level, epoch), schema)), "islands")
        remove(done.sparkSession, done)
        done = after
    return done


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, room: int = 1024, end_id: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    tidy(spark)
    table = written(pieces(docs, vocabulary, room, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    kind = dict(table.dtypes)["doc_id"]
    schema = _ROWS.format(kind)
    whole = table.where(F.col("length") == room).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = table.where(F.col("length") < room)
    islands = max(1, -(-loose.count() // ISLAND))
    empty = {"bin": F.lit(None).cast("int"), "offset": F.lit(None).cast("long"), "fill": F.lit(None).cast("long"), "others": F.lit(None).cast("array<int>"), "pattern": F.lit(None).cast("array<int>")}
    columns = [c.split()[0] for c in schema.split(", ")]
    at = loose.withColumn("island", F.pmod(F.xxhash64("uid"), F.lit(islands))).withColumns(empty).select(*columns)
    result, level = whole, 0
    while True:
        done = _evolved(at, schema, room, seed, level)
        last = islands == 1
        # bins are numbered by fill: an island opens its first ones, unless they are full
        opened = F.lit(False) if last else (F.col("bin") < OPENED) & (F.col("fill") < room)
        # level, island and bin make a number that no other sequence has; those of whole pieces are even
        number = (F.lit(level).cast("long") * (1 << 56) + F.col("island") * (1 << 20) + F.col("bin")) * 2 + 1
        result = result.unionByName(done.where(F.col("pattern").isNull() & ~opened).select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset"))
        if last:
            return result
        islands = -(-islands // FAN)
        at = done.where(F.col("pattern").isNull() & opened).withColumn("island", F.floor(F.col("island") / FAN).cast("long")).withColumns(empty).select(*columns)
        level += 1
