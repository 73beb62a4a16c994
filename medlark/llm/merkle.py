"""Document fingerprints: a Merkle tree over paragraphs and sections.

Tokens (up to TOKEN code points and the white space behind them) are the lowest nodes. A node of level k ends where a token's
own hash ends in 2k zero bits, so about four nodes make one of the next level and an edit moves no boundary elsewhere;
sentences, paragraphs and sections end nodes of the levels SENTENCE, PARAGRAPH and SECTION at least, so nodes of those levels
are (parts of) paragraphs and sections. FANOUT nodes without such an end make a node, too, as words that repeat may have none.
A node's hash covers those of its children in order. The root is the hash of the whole text with the top node's: equal roots
mean equal texts.

A fingerprint is a string: root, number of its lowest level, and from there to the top the nodes of each level, as code
points and hash. The lowest level is the first one with at most NODES nodes, by one rule for texts of every size. Two
fingerprints are compared from the lowest level that both have on. `likeness` is the share of the longer text's code points
in branches that both have; `differing` goes from the top down, passes over equal branches whole, aligns the others in order
and gives their places in either text, moved and repeated ones included.

Null text: empty. The empty text has a root and no nodes; two empty texts are alike, 1.0, an empty and another 0.0. A null
doc_id comes before all others; rows of equal doc_id follow each other by text. A sole document is its own next. Empty
table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

TOKEN, FANOUT, NODES, HASH_BITS = 12, 16, 128, 40
#: Levels at which nodes end with sentences, paragraphs and sections (paragraphs before an empty line).
SENTENCE, PARAGRAPH, SECTION = 2, 4, 6
#: Bytes of text in a range of documents.
RANGE_BYTES = 64 << 20
_TOKENS = re.compile(rf"\S{{1,{TOKEN}}}\s*|\s+")
_STOPS = {".", "!", "?"}
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Tokens(dict):
    """Numbers of tokens, and by number their hash, the level that they end and their code points; kept between texts in a
    bounded cache."""

    MOST = 200_000

    def __init__(self):
        self.rows = array("Q")

    def __missing__(self, token: str) -> int:
        h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) or 1
        level = (h & -h).bit_length() - 1 >> 1
        if "\n" in token:
            level = max(level, SECTION if token.count("\n") > 1 else PARAGRAPH)
        elif token.rstrip()[-1:] in _STOPS:
            level = max(level, SENTENCE)
        self.rows.extend((h, level, len(token)))
        k = self[token] = len(self)
        return k

    def of(self, text: str) -> np.ndarray:
        """(hash, level, code points) of each token of a text."""
        if len(self) > self.MOST:
            self.clear()
            self.rows = array("Q")
        found = _TOKENS.findall(text)
        numbers = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        return np.frombuffer(self.rows, dtype=_U).reshape(-1, 3)[numbers]


def levels(tokens: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, code points) of the nodes of each level, tokens first, up to one node."""
    h, end, n = tokens[:, 0], tokens[:, 1].astype(np.int64), tokens[:, 2].astype(np.int64)
    out = [(h, n)]
    level = 0
    while len(h) > 1:
        level += 1
        last = end >= level
        last[-1] = True
        ends = np.flatnonzero(last) + 1
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        place = np.arange(len(h)) - np.repeat(starts, sizes)
        if sizes.max() > FANOUT:
            last |= place % FANOUT == FANOUT - 1
            starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            place %= FANOUT
        h = _mix(np.add.reduceat(_mix(h + _PLACES[place]), starts) + _U(level))
        n = np.add.reduceat(n, starts)
        end = end[last]
        out.append((h, n))
    return out


_PLACES = _mix(np.arange(1, FANOUT + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


@dataclass
class Tree:
    """A fingerprint taken apart: root, number of the lowest level, and the nodes of each level from there on, each one number
    of code points and HASH_BITS of its hash."""

    root: str
    low: int
    levels: list[list[int]]

    @property
    def size(self) -> int:
        return sum(x >> HASH_BITS for x in self.levels[0]) if self.levels else 0

    def __str__(self) -> str:
        body = "|".join([",".join(["%x" % x for x in level]) for level in self.levels])
        return f"{self.root}|{self.low}|{body}"

    @classmethod
    def parse(cls, text: str) -> Tree:
        root, low, *body = text.split("|")
        return cls(root, int(low), [[int(x, 16) for x in level.split(",")] for level in body if level])


def tree(text: str | None, tokens: Tokens | None = None) -> Tree:
    text = text or ""
    every = levels((Tokens() if tokens is None else tokens).of(text)) if text else []
    low = next((k for k, (h, _) in enumerate(every) if len(h) <= NODES), 0)
    top = int(every[-1][0][0]).to_bytes(8, "little") if every else b""
    root = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, key=top).hexdigest()
    mask = _U((1 << HASH_BITS) - 1)
    return Tree(root, low, [((n.astype(_U) << _U(HASH_BITS)) | (h & mask)).tolist() for h, n in every[low:]])


def fingerprint(text: str | None, tokens: Tokens | None = None) -> str:
    return str(tree(text, tokens))


def _levels_of_both(a: Tree, b: Tree) -> tuple[list[list[int]], list[list[int]]] | None:
    """The levels that both have, lowest first; None if one has none, or is below the other's lowest level as a whole."""
    low, top = max(a.low, b.low), min(a.low + len(a.levels), b.low + len(b.levels))
    if not a.levels or not b.levels or top <= low:
        return None
    return a.levels[low - a.low : top - a.low], b.levels[low - b.low : top - b.low]


def alike(a: Tree, b: Tree) -> float:
    """Share of the longer text's code points in branches of both; 1 for equal roots. Equal branches have equal nodes in the
    lowest common level, so that level counts them all, each as often as both have it."""
    if a.root == b.root:
        return 1.0
    both = _levels_of_both(a, b)
    if both is None or set(both[0][0]).isdisjoint(both[1][0]):
        return 0.0
    common = sum((x >> HASH_BITS) * c for x, c in (Counter(both[0][0]) & Counter(both[1][0])).items())
    return common / max(a.size, b.size)


def likeness(a: str, b: str) -> float:
    return alike(Tree.parse(a), Tree.parse(b))


def differing(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """(start, end, other start, other end) in code points of the first and of the second text: the branches that an
    alignment in order leaves over, from the first one on. It goes from the top down: equal branches are passed over whole, and
    only nodes below differing ones are looked at. Of a pair of stretches one may be empty (something was put in or left
    out)."""
    one, two = Tree.parse(a), Tree.parse(b)
    if one.root == two.root:
        return []
    both = _levels_of_both(one, two)
    if both is None:
        return [(0, one.size, 0, two.size)]
    la, lb = both
    starts = lambda level: list(itertools.accumulate((x >> HASH_BITS for x in level), initial=0))
    sa, sb = [starts(x) for x in la], [starts(x) for x in lb]
    gaps = [(0, len(la[-1]), 0, len(lb[-1]))]
    for k in range(len(la) - 1, -1, -1):
        finer = []
        for a0, a1, b0, b1 in gaps:
            i = j = 0
            for m in SequenceMatcher(None, la[k][a0:a1], lb[k][b0:b1], autojunk=False).get_matching_blocks():
                if m.a > i or m.b > j:
                    finer.append((a0 + i, a0 + m.a, b0 + j, b0 + m.b))
                i, j = m.a + m.size, m.b + m.size
        gaps = finer
        if k:  # the same stretches in nodes of the level below
            below_a, below_b = ({at: i for i, at in enumerate(s[k - 1])} for s in (sa, sb))
            gaps = [(below_a[sa[k][p]], below_a[sa[k][q]], below_b[sb[k][r]], below_b[sb[k][s]]) for p, q, r, s in finer]
    return [(sa[0][p], sa[0][q], sb[0][r], sb[0][s]) for p, q, r, s in gaps]


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _bounds(docs: DataFrame, parts: int | None) -> list[int]:
    """At most parts - 1 doc_ids that cut the table into ranges of about equal size; by default of about RANGE_BYTES."""
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    if parts < 2:
        return []
    quantiles = F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))
    return sorted(set(docs.agg(quantiles.alias("q")).first()["q"] or []))


def fingerprints(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Documents are dealt by ranges of doc_id and pass through each range in order, one looking ahead to the next; the first
    document of a range (one a range) is sent to the range before as well, as what follows its last one."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = np.array(_bounds(docs, parts), dtype=np.int64)

    @F.arrow_udf("int")
    def range_of(doc_id: pa.Array) -> pa.Array:
        known = doc_id.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, doc_id.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(known, at, 0).astype(np.int32))

    ranged = docs.withColumn("part", range_of("doc_id"))
    # one row a range: which doc_id it starts with, and the range before, in which the first document also ends. The table
    # goes round: ahead of the first range stands the last
    starts = sorted((r["part"], None if r["nulls"] else r["least"]) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("least"), (F.count("doc_id") < F.count(F.lit(1))).alias("nulls")).collect())
    lent = [(p, k, least, (k - 1) % len(starts)) for k, (p, least) in enumerate(starts)]
    table = F.broadcast(spark.createDataFrame(lent, "p int, own int, least long, before int"))
    both = F.array(F.struct(F.col("own").alias("to"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("to"), F.lit(True).alias("extra")))
    ranged = ranged.join(table, F.col("part") == F.col("p")).withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("least")), both).otherwise(F.slice(both, 1, 1)))).select("doc_id", "text", "at.to", "at.extra")
    # a range a task
    dealt = ranged.repartitionById(max(1, len(starts)), F.col("to")).sortWithinPartitions("to", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches):
        tokens = Tokens()
        held = None  # (part, doc_id, text, tree): waits for what follows it
        rows, size = [], 0

        def give(one, following, next_tree):
            nonlocal size
            _, doc_id, text, own = one
            changed = edited(text, following)
            new = tree(changed, tokens)
            rows.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(new), alike(own, new), alike(own, next_tree)))
            size += len(rows[-1][3]) + len(rows[-1][4])

        def batch():
            nonlocal rows, size
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, KINDS, strict=True)], names=NAMES)
            rows, size = [], 0
            return got

        for b in batches:
            for doc_id, text, to, extra in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "to", "extra")], strict=True):
                text = text or ""
                if extra and (held is None or held[0] != to):
                    continue
                here = tree(text, tokens)
                if held is not None and held[0] == to:
                    give(held, text, here)
                    held = None
                if not extra:
                    held = (to, doc_id, text, here)
                if size > 4 << 20:
                    yield batch()
        if held is not None:  # only a table of one range that nothing was lent to
            give(held, held[2], held[3])
        if rows:
            yield batch()

    return dealt.select("doc_id", "text", "to", "extra").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
