"""Near-duplicates by Order MinHash, verified by banded alignment.

Shingles are five consecutive words (lower case, punctuation left out), each labelled with its number of occurrence. For
each of BANDS hash functions a text's TUPLE least labelled shingles are taken and kept in their order in the text; the
hash of that ordered tuple is a bucket, so texts with the same shingles in another order part. Equal texts are first
brought together as one class each. Leaders come first: a bucket's classes are compared with the text that shares its
buckets with most, which gives as many pairs as there are members and joins large groups. What then still is apart is
settled exactly: of all texts of open buckets (several components, more than a pair), every pair across components that a
prefix filter can't rule out is compared, text against text. With shingles in one order for all, rare ones first, two texts
of similarity 0.8 or more share one so early that the rest of either is long enough; so every pair of a bucket ends in one
component, or was compared, or is proven to be below 0.8. The texts that share an early shingle with a large component are
compared with one central text of it before that, as most of them are joined by it. The numbers of leader rounds change the
cost, not the classes.

A pair is a link if its similarity is 0.8 or more: shingles that a banded alignment matches in order, over all shingles of
both. The band is as wide as that similarity allows gaps, so nothing that reaches it is lost. Links' connected components
are the classes; class_id is the smallest doc_id.

Nulls: a null text is empty; texts without words are alike to nothing and are classes of their own row, with class_id the
doc_id. Texts of fewer than five words are one shingle. Null doc_ids come after all others in the choice of class_id.
Repeated rows are equal texts. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, pick, remove, screen, tidy, untouched, written
from .tokens import balanced

SHINGLE, SIMILAR, BANDS, TUPLE, LEADERS, ROUNDS, CENTRAL = 5, 0.8, 20, 4, 4, 1, 2
#: Slots of the table of shingle counts, a byte each, that puts rare shingles first. Any table gives the same pairs in the end.
SLOTS = 1 << 22
#: Shingles of a text that gets exact buckets as well.
FEW = 9
#: Members that are compared with a leader in one go.
TOGETHER = 64
_WORDS = re.compile(r"\w+")
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACES = _mix(np.arange(1, SHINGLE + 1, dtype=_U)) | _U(1)


class Hasher:
    """Hashes of words, kept between texts in a bounded cache."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        found = _WORDS.findall(text.lower())
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(found) - known.keys() if len(found) > len(known) else [w for w in set(found) if w not in known]:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), dtype=_U, count=len(found))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of runs of five words; a shorter text is one run."""
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=_U)
    for i in range(k):
        h += words[i : i + n] * _PLACES[i]
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes that count how often the same shingle stood before."""
    order = np.argsort(h, kind="stable")
    same = h[order]
    start = np.concatenate([[True], same[1:] != same[:-1]])
    if start.all():
        return h
    at = np.arange(len(h))
    number = np.empty(len(h), dtype=_U)
    number[order] = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(_U)
    return np.where(number > 0, _mix(h + number * _U(0x9E3779B97F4A7C15)), h)


def sketch(h: np.ndarray) -> np.ndarray:
    """One bucket a band."""
    h = labelled(h)
    n = len(h)
    keys = np.zeros(BANDS, dtype=_U)
    step = max(1, (1 << 20) // n)
    for lo in range(0, BANDS, step):
        value = _mix(h[None, :] ^ _SEEDS[lo : lo + step, None])
        least = np.argpartition(value, TUPLE - 1, axis=1)[:, :TUPLE] if n > TUPLE else np.tile(np.arange(n), (len(value), 1))
        least = np.sort(least, axis=1)
        key = np.zeros(len(value), dtype=_U)
        for j in range(least.shape[1]):
            key = _mix(key * _U(31) + h[least[:, j]])
        keys[lo : lo + step] = _mix(key ^ _SEEDS[lo : lo + step])
    return keys


def short_keys(h: np.ndarray) -> np.ndarray:
    """Exact buckets of a text of few shingles: itself, and itself without each one. Two such texts of similarity 0.8 or more
    have one in common, as up to FEW shingles allow for one gap on either side only."""
    if not 0 < len(h) <= FEW:
        return np.zeros(0, dtype=_U)
    keys = set()
    for gone in range(-1, len(h) if len(h) > 1 else 0):
        key = _U(len(h) - (gone >= 0))
        for i in range(len(h)):
            if i != gone:
                key = _mix(np.array([key * _U(31) + h[i]], dtype=_U))[0]
        keys.add(int(key))
    return np.array(sorted(keys), dtype=_U)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Similarity M / (|a| + |b| - M) of two shingle sequences, M being the longest common subsequence within the band
    that a similarity of `least` allows; 0 if it can't reach that. Bit-parallel over the band, in blocks of columns."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    need = int(np.ceil(least / (1 + least) * (na + nb) - 1e-9))
    width = na + nb - 2 * need  # more gaps than that can't be
    short = min(na, nb)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    tail = 0
    if head < short:
        differ = np.flatnonzero(a[na - short + head :][::-1] != b[nb - short + head :][::-1])
        tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : na - tail].tolist(), b[head : nb - tail].tolist()
    common = head + tail + _banded(x, y, width)
    return common / (na + nb - common)


def _banded(x: list, y: list, width: int, block: int = 256) -> int:
    """Longest common subsequence of x and y along pairs of places at most `width` apart."""
    if not x or not y:
        return 0
    low = high = 0
    zeros, v = 0, 0  # v: a bit for each x[low:high], cleared where the row rises
    for start in range(0, len(y), block):
        end = min(start + block, len(y))
        lo, hi = max(low, start - width), min(len(x), end + width)
        if lo >= len(x):
            break
        gone = lo - low
        if gone:
            passed = v & ((1 << gone) - 1)
            zeros += min(gone, high - low) - passed.bit_count()
            v >>= gone
        have = max(0, high - lo)
        v |= ((1 << (hi - lo)) - 1) & ~((1 << have) - 1)
        low, high = lo, hi
        masks: dict = {}
        for k in range(low, high):
            masks[x[k]] = masks.get(x[k], 0) | 1 << (k - low)
        full = (1 << (high - low)) - 1
        for s in y[start:end]:
            m = masks.get(s)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
    return zeros + (high - low) - v.bit_count()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, t1, t2, n, keys) of every row: a hash of the text, one of its words, shingles, buckets. n is 0 and keys
    is empty for a text without words."""
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def run(batches):
        hasher = Hasher()
        for b in balanced(batches, "text"):
            rows, keys = [], []
            for t in b.column("text").to_pylist():
                w = hasher.words(t or "")
                h = shingles(w)
                d = xxhash.xxh3_128_intdigest(w.tobytes())
                rows.append(((d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63), len(h)))
                keys.append(np.concatenate([sketch(h), short_keys(h)]).view(np.int64) if len(h) else np.zeros(0, np.int64))
            n = np.array(rows, dtype=np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *[pa.array(n[:, c]) for c in range(3)], lists], names=["doc_id", "key", "t1", "t2", "n", "keys"])

    return source.mapInArrow(run, "doc_id long, key long, t1 long, t2 long, n long, keys array<long>")


def _pairs(buckets: DataFrame, component: DataFrame | None, round_: int) -> DataFrame:
    """Distinct (leader, member): in each bucket, one text of each component against the bucket's leader of this round. In
    every other round that is the text which shares its buckets with most, near the middle of a group; else one by chance."""
    chance = lambda c: F.xxhash64(c, F.col("band") % LEADERS, F.lit(round_))
    drawn = (lambda c: F.struct(-F.col("company"), F.xxhash64(c))) if round_ % 2 == 0 else chance
    rows = buckets.withColumn("component", F.col("uid"))
    if component is not None:
        rows = buckets.join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    if component is not None:
        rows = rows.groupBy("band", "bucket", "component").agg(F.min_by(F.struct("uid", "n", "company"), drawn("uid")).alias("one")).select("band", "bucket", "component", "one.uid", "one.n", "one.company")
    # one row a bucket, summed within tasks first; a bucket's members are then met by key, and a large one is split
    lead = rows.groupBy("band", "bucket").agg(F.min_by(F.struct("uid", "n"), drawn("uid")).alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "bucket", F.col("leader.uid").alias("leader"), F.col("leader.n").alias("ln"))
    found = rows.join(lead, ["band", "bucket"]).where(F.col("uid") != F.col("leader")).where(F.least("n", "ln") >= SIMILAR * F.greatest("n", "ln"))
    return found.select("leader", F.col("uid").alias("member")).distinct()


def _open(buckets: DataFrame, component: DataFrame | None) -> DataFrame:
    """(uid, n, company) of the texts in buckets that leaders haven't settled: of several components, and more than two
    members, as the first leader meets every other member."""
    rows = buckets.withColumn("component", F.col("uid"))
    if component is not None:
        rows = buckets.join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    apart = rows.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("members > 2 and lo < hi").select("band", "bucket")
    return rows.join(apart, ["band", "bucket"]).select("uid", "n", "company").distinct()


def _rarity(rows: DataFrame) -> np.ndarray:
    """A byte for each slot of shingle hashes, growing with the logarithm of how many of the rows' shingles fall there."""

    def run(batches):
        hasher, counts = Hasher(), np.zeros(SLOTS, dtype=np.int64)
        for b in balanced(batches, "text"):
            for t in b.column("text").to_pylist():
                np.add.at(counts, (labelled(shingles(hasher.words(t or ""))) % _U(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "c"])

    level = F.least(F.lit(255), F.floor(8 * F.log2(F.sum("c") + 1))).cast("int").alias("level")
    slots = rows.select("text").mapInArrow(run, "slot int, c long").groupBy("slot").agg(level)
    # a few MB at most: the slots of a block as a string of slots and levels
    blocks = slots.groupBy(F.expr("slot div 4096").alias("block")).agg(F.collect_list(F.expr("(slot % 4096) * 256 + level")).alias("levels"))
    out = np.zeros(SLOTS, dtype=np.uint8)
    for r in blocks.toLocalIterator():
        got = np.array(r["levels"], dtype=np.int64)
        out[int(r["block"]) * 4096 + (got >> 8)] = got & 255
    return out


def _prefixes(rows: DataFrame) -> DataFrame:
    """(uid, n, company, shingle, place) of the first shingles of each text, the rare ones of all rows first: as many as it
    takes for two texts that are similar enough to share one."""
    shared = rows.sparkSession.sparkContext.broadcast(_rarity(rows))

    def run(batches):
        hasher, level = Hasher(), shared.value
        for b in balanced(batches, "text"):
            found, counts = [np.zeros(0, _U)], []
            for t in b.column("text").to_pylist():
                h = labelled(shingles(hasher.words(t or "")))
                keep = len(h) - int(np.ceil(SIMILAR * len(h) - 1e-9)) + 1
                found.append(h[np.lexsort((h, level[(h % _U(SLOTS)).astype(np.int64)]))[:keep]])
                counts.append(len(found[-1]))
            at = np.repeat(np.arange(b.num_rows), counts)
            place = np.concatenate([np.zeros(0, np.int32), *[np.arange(c, dtype=np.int32) for c in counts]])
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(at)) for c in ("uid", "n", "company")], pa.array(np.concatenate(found).view(np.int64)), pa.array(place)], names=["uid", "n", "company", "shingle", "place"])

    return rows.select("uid", "n", "company", "text").mapInArrow(run, "uid long, n long, company long, shingle long, place int")


def _placed(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """rows with the component of each uid: its own where no link has been found."""
    if component is None:
        return rows.withColumn("component", F.col("uid"))
    return rows.join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))


def _met(early: DataFrame, component: DataFrame | None) -> DataFrame:
    """The rows of shingles that several components have early, with the shingle's largest component and its central text."""
    rows = _placed(early, component)
    parts = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"), F.max_by(F.struct("uid", "n", "place"), F.struct("company", "uid")).alias("central"))
    heads = parts.groupBy("shingle").agg(F.max_by(F.struct("component", "central"), F.struct("c", "component")).alias("head"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("shingle", F.col("head.component").alias("major"), "head.central")
    return written(rows.join(heads, "shingle"), "met")


def _near(n, place, n_, place_):
    """Whether two texts that share a shingle at these places, and none before, may be similar enough."""
    least = F.least(n - place, n_ - place_)
    return (F.least(n, n_) >= SIMILAR * F.greatest(n, n_) - 1e-6) & (least >= SIMILAR / (1 + SIMILAR) * (n + n_) - 1e-6)


def _central(met: DataFrame) -> DataFrame:
    """Distinct (leader, member): a text against the central text of the largest component that shares an early shingle."""
    c = F.col
    found = met.where((c("component") != c("major")) & _near(c("n"), c("place"), c("central.n"), c("central.place")))
    return found.select(F.least("uid", "central.uid").alias("leader"), F.greatest("uid", "central.uid").alias("member")).distinct()


def _left(met: DataFrame) -> DataFrame:
    """Distinct (leader, member) of different components that may be similar enough: a shared shingle in both prefixes, and
    behind it enough shingles in either text. Pairs within a shingle's largest component are never met."""
    c = F.col
    minor = met.where("component != major").select("shingle", *[c(x).alias(f"{x}_") for x in ("uid", "component", "n", "place")])
    apart = (c("component") != c("component_")) & ((c("component") == c("major")) | (c("uid") > c("uid_")))
    found = minor.join(met.select("shingle", "uid", "component", "major", "n", "place"), "shingle").where(apart & _near(c("n"), c("place"), c("n_"), c("place_")))
    return found.select(F.least("uid", "uid_").alias("leader"), F.greatest("uid", "uid_").alias("member")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, member, similarity) of the pairs that reach the least similarity. A leader's text goes to its members in
    groups of about TOGETHER; rows stream, the leader's first."""
    groups = pairs.groupBy("leader").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / TOGETHER)).alias("groups"))
    dealt = pairs.join(groups, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("groups"))).select("leader", "salt", "member")
    leaders = dealt.select("leader", "salt").distinct().join(texts.withColumnRenamed("uid", "leader"), "leader").select("leader", "salt", F.lit(None).cast("long").alias("member"), "text")
    members = dealt.join(texts.withColumnRenamed("uid", "member"), "member").select("leader", "salt", "member", "text")
    rows = leaders.unionByName(members).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]):
        hasher, held = Hasher(), (None, None)
        for b in balanced(batches, "text"):
            out = []
            for leader, member, text in zip(*[b.column(c).to_pylist() for c in ("leader", "member", "text")], strict=True):
                h = shingles(hasher.words(text or ""))
                if member is None:
                    held = (leader, h)
                elif held[0] == leader and (s := aligned(held[1], h)) >= SIMILAR:
                    out.append((leader, member, s))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["leader", "member", "similarity"])

    return rows.select("leader", "member", "text").mapInArrow(run, "leader long, member long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(uid, component) of all ends of links (a, b): component is the smallest uid. Large and small stars in turn until
    nothing changes; each turn is written, so lineage stays short and nothing is collected."""
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        small = large.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(own).where("a != b").distinct()
        after = written(small, "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(links.sparkSession, links)
        links = after
        if state == before:
            break
        before = state
    roots = links.select("b").distinct().select(F.col("b").alias("uid"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("uid"), F.col("b").alias("component")).unionByName(roots)


def joined(component: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """(uid, component) after more links (leader, member): only the components that these touch are worked on."""
    ends = fresh.select(F.col("leader").alias("a"), F.col("member").alias("b"))
    if component is None:
        return written(components(ends), "components")
    for end in ("a", "b"):
        ends = ends.join(component.select(F.col("uid").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    further = components(ends).select(F.col("uid").alias("component"), F.col("component").alias("further"))
    fresh_ends = fresh.select(F.explode(F.array("leader", "member")).alias("uid")).distinct().join(component, "uid", "left_anti")
    every = component.unionByName(fresh_ends.withColumn("component", F.col("uid")))
    return written(every.join(further, "component", "left").select("uid", F.coalesce("further", "component").alias("component")), "components")


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_size, links and kept of every row. links: verified links of the row's text."""
    docs = pick(docs, "doc_id", "text")
    rows = written(sketches(docs), "sketches")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    texts_ = rows.where("n > 0").groupBy("t1", "t2").agg(F.min(one).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    uniq = written(texts_.select("t1", "t2", "one.doc_id", "one.key", "n", "keys", "copies").withColumn("uid", F.monotonically_increasing_id()), "texts")
    every = uniq.select("uid", "n", F.posexplode("keys").alias("band", "bucket")).withColumn("band", F.least("band", F.lit(BANDS)))
    shared = written(every.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "bucket", "members"), "shared")
    passes = screen(shared, "bucket")
    # company: how often a text meets another in its buckets; a text has some 30 of them at most
    company = F.sum("members").over(Window.partitionBy("uid")).alias("company")
    buckets = written(every.where(passes(F.col("bucket"))).join(shared, ["band", "bucket"]).select("uid", "n", "band", "bucket", company), "buckets")
    involved = written(buckets.select("uid").distinct().join(uniq.select("uid", "doc_id", "key"), "uid"), "wanted")
    passes = screen(involved, "key")
    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("k"), text.alias("text")).where(passes(F.col("k")))
    texts = found.join(involved, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).groupBy("uid").agg(F.first("text").alias("text"))
    texts = written(texts, "involved")
    links = component = tried = None

    def linked(pairs: DataFrame) -> bool:
        """Compares the pairs that haven't been compared yet; whether that gave any link."""
        nonlocal links, component, tried
        if tried is not None:
            ways = tried.unionByName(tried.select(F.col("member").alias("leader"), F.col("leader").alias("member")))
            pairs = pairs.join(ways, ["leader", "member"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if pairs.isEmpty():
            return False
        fresh = written(verified(pairs, texts), "verified")
        if fresh.isEmpty():
            return False
        links = fresh if links is None else links.unionByName(fresh)
        component = joined(component, fresh)
        return True

    for round_ in range(ROUNDS):
        linked(_pairs(buckets, component, round_))
    open_ = written(texts.join(_open(buckets, component), "uid"), "open")
    if not open_.isEmpty():
        every = written(_prefixes(open_), "prefixes")
        remove(spark, open_)
        # a shingle that one text has shows no pair
        early = written(every.join(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle"), "shingle"), "early")
        remove(spark, every)
        met = _met(early, component)
        for _ in range(CENTRAL):
            if not linked(_central(met)):
                break
            remove(spark, met)
            met = _met(early, component)
        linked(_left(met))
        remove(spark, early)
        remove(spark, met)
    tidy(spark)
    remove(spark, texts)
    if component is None:
        placed = uniq.withColumn("component", F.col("uid")).withColumn("links", F.lit(0).cast("long"))
    else:
        ends = links.select(F.col("leader").alias("uid")).unionByName(links.select(F.col("member").alias("uid"))).groupBy("uid").agg(F.count(F.lit(1)).alias("links"))
        placed = uniq.join(component, "uid", "left").join(ends, "uid", "left").withColumn("component", F.coalesce("component", "uid")).withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    placed = written(placed.select("t1", "t2", "doc_id", "key", "copies", "component", "links"), "placed")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    heads = placed.groupBy("component").agg(F.min(best).alias("head"), F.sum("copies").alias("class_size")).select("component", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), "class_size")
    full = written(placed.join(heads, "component").select("t1", "t2", "class_id", "class_key", "class_size", "links"), "classes")
    for table in (uniq, shared, buckets, involved, placed, *[t for t in (tried, links, component) if t is not None]):
        remove(spark, table)
    inner = rows.where("n > 0").join(full, ["t1", "t2"]).select("doc_id", "key", "class_id", "class_key", "class_size", "links")
    alone = rows.where("n = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"))
    out = inner.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))).drop("class_key")


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns; of repeated rows one, too. Texts without words all stay. Rows of a class
    of their own, which are most, go on where they are read; the others meet their decisions."""
    tidy(spark)
    id_ = lambda c: F.coalesce(c.cast("long"), F.lit(-1))
    decided = classes(spark, docs).where("class_size > 1").groupBy("doc_id", "key", "kept").agg(F.count(F.lit(1)).alias("_copies"))
    decided = written(decided.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "kept", "_copies", F.xxhash64("key", id_(F.col("doc_id"))).alias("_h")), "decided")
    plain, names = numbered(docs)
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    keyed = plain.withColumn("_key", F.xxhash64(F.col(at["text"]).cast("string")))
    keyed = keyed.withColumn("_h", F.xxhash64("_key", id_(F.col(at["doc_id"]))))
    alone, met = untouched(keyed, decided, "_h")
    rows = met.join(decided.drop("_h"), F.col(at["doc_id"]).eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").where(F.coalesce("kept", F.lit(True)))
    repeated = rows.where("_copies > 1").groupBy("_d", "_k").agg(F.max(F.struct(*names)).alias("row")).select("row.*")
    return alone.select(*names).unionByName(rows.where("coalesce(_copies, 1) = 1").select(*names)).unionByName(repeated).toDF(*docs.columns)
