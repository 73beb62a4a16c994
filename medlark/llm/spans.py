"""Substring dedup by sliding spans of sentences.

A text is cut into sentences after . ! ? and at line ends, and, by one rule for all of them, behind words whose own hash says
so (one in CUT), so that a passage is cut alike wherever it starts and whatever stands around it; a sentence without such a
word ends after MANY words. Every run of RUN consecutive sentences is hashed (128 bits); a run of fewer than LEAST_WORDS
words grows by further sentences, once forwards from its first and once backwards from its last one, so that both edges of
a passage are met. The first occurrence of a hash is that of smallest (doc_id, key, place), key being a hash of the text;
every sentence that another occurrence covers is removed. Case, white space and punctuation don't count.

Texts are cut and hashed once, a row of hashes each. Hashes alone are counted; only runs whose hash comes again (and a few
that a screen lets pass) are carried with their places, and only texts that lose something are cut again.

Nulls: a null text is empty and stays null; a null doc_id comes first. Repeated rows count as one document, and each gets
its result; equal texts of other doc_ids are copies, of which the first stays. Texts of fewer than LEAST_WORDS words have
no run and stay. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_of, may_have, pick, remove, screen, written
from .tokens import balanced

#: Sentences in a run and words that it has at least; a sentence ends behind one word in CUT, and after MANY words.
RUN, LEAST_WORDS, CUT, MANY = 2, 20, 5, 32
_WORDS = re.compile(r"[^\W_]+[\W_]*")
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?\n\u3002\uff01\uff1f]")
_U = np.uint64
#: Odd factors of the two polynomials over word hashes, and their inverses modulo 2 ** 64.
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_INVERSES = [pow(f, -1, 1 << 64) for f in _FACTORS]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=_U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words(dict):
    """Numbers of words with what follows them, and by number the word's hash, whether a sentence ends there, and the code
    points; kept between texts in a bounded cache."""

    MOST = 200_000

    def __init__(self):
        self.rows = array("Q")
        self.powers = [_powers(f, 1024) for f in (*_FACTORS, *_INVERSES)]

    def __missing__(self, token: str) -> int:
        word = token.rstrip()
        if not word.isalnum():
            word = _WORD.match(word)[0]
        h = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        self.rows.extend((h, (h >> 20) % CUT == 0 or (token[-1] != " " or len(token) > len(word) + 1) and _STOP.search(token, len(word)) is not None, len(token)))
        k = self[token] = len(self)
        return k

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Code points before the first word, and (hash, end, code points) of each word."""
        if len(self) > self.MOST:
            self.clear()
            self.rows = array("Q")
        found = _WORDS.findall(text)
        numbers = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        rows = np.frombuffer(self.rows, dtype=_U).reshape(-1, 3)[numbers] if len(found) else np.zeros((0, 3), _U)
        return len(text) - int(rows[:, 2].sum()), rows

    def power(self, which: int, n: int) -> np.ndarray:
        if len(self.powers[which]) < n:
            self.powers[which] = _powers([*_FACTORS, *_INVERSES][which], 2 * n)
        return self.powers[which][:n]


def _ends(rows: np.ndarray) -> np.ndarray:
    """0 and the number of words up to the end of each sentence."""
    if not len(rows):
        return np.zeros(1, dtype=np.int64)
    last = rows[:, 1] != 0
    last[-1] = True
    ends = np.concatenate([[0], np.flatnonzero(last) + 1])
    sizes = np.diff(ends)
    if sizes.max() > MANY:
        place = np.arange(len(rows)) - np.repeat(ends[:-1], sizes)
        last |= place % MANY == MANY - 1
        ends = np.concatenate([[0], np.flatnonzero(last) + 1])
    return ends


class Cut:
    """A text cut into sentences: `ends`, 0 and the number of words up to the end of each, and the words' rows."""

    def __init__(self, text: str, words: Words | None = None):
        self.words = Words() if words is None else words
        self.size = len(text)
        self.before, self.rows = self.words.of(text)
        self.ends = _ends(self.rows)

    def places(self) -> np.ndarray:
        """0 and the code points up to the end of each sentence; together the sentences are the text."""
        if not len(self.rows):
            return np.array([0, self.size] if self.size else [0])
        upto = np.concatenate([[0], np.cumsum(self.rows[:, 2].astype(np.int64))]) + self.before
        out = upto[self.ends]
        out[0] = 0
        return out

    def spans(self) -> np.ndarray:
        """(first, end) of every run, in order: forwards, the least end for each first sentence; backwards, the last first
        sentence for each end."""
        ends, n = self.ends, len(self.ends) - 1
        if len(self.rows) < LEAST_WORDS:
            return np.zeros((0, 2), dtype=np.int64)
        at = np.arange(n + 1)
        end = np.maximum(np.searchsorted(ends, ends + LEAST_WORDS), at + RUN)
        first = np.minimum(np.searchsorted(ends, ends - LEAST_WORDS, side="right") - 1, at - RUN)
        found = np.unique(np.concatenate([(at << 32 | end)[end <= n], (first << 32 | at)[first >= 0]]))
        found = found if len(found) else np.array([n])
        return np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)

    def hashes(self, spans: np.ndarray) -> np.ndarray:
        """Two columns of 64 bits a run."""
        out = np.empty((len(spans), 2), dtype=np.int64)
        if not len(spans):
            return out
        n_words, lo, hi = len(self.rows), self.ends[spans[:, 0]], self.ends[spans[:, 1]]
        for k in range(2):
            h = _mix(self.rows[:, 0] + _U(k))
            upto = np.concatenate([np.zeros(1, _U), np.cumsum(h * self.words.power(k, n_words), dtype=_U)])
            value = (upto[hi] - upto[lo]) * self.words.power(2 + k, n_words)[lo]
            out[:, k] = _mix(value + (hi - lo).astype(_U)).view(np.int64)
        return out


def sentences(text: str) -> list[str]:
    at = Cut(text).places().tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def runs(text: str, words: Words | None = None) -> np.ndarray:
    """Rows (first, end, hash, hash) of every run."""
    cut = Cut(text, words)
    spans = cut.spans()
    return np.concatenate([spans, cut.hashes(spans)], axis=1)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def run_lists(docs: DataFrame) -> DataFrame:
    """(doc_id, key, h1, h2) of every row: the hashes of its runs in their order."""

    def run(batches):
        words = Words()
        for b in balanced(batches, "text"):
            found, counts = [np.zeros((0, 2), np.int64)], []
            for t in b.column("text").to_pylist():
                cut = Cut(t or "", words)
                found.append(cut.hashes(cut.spans()))
                counts.append(len(found[-1]))
            edges = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            h = np.concatenate(found)
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(h[:, k]))) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *lists], names=["doc_id", "key", "h1", "h2"])

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, h1 array<long>, h2 array<long>")


def run_rows(lists: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, key, run, h1, h2) of the runs whose h1 passes the bit map `known`; run is their number in the text."""
    shared = lists.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            column = b.column("h1")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            h1, h2 = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            hit = np.flatnonzero(may_have(shared.value, np.ascontiguousarray(h1)))
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            number = hit - (np.cumsum(sizes) - sizes)[row]
            at = pa.array(row)
            for lo in range(0, len(hit), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at[part]), b.column("key").take(at[part]), pa.array(number[part].astype(np.int32)), pa.array(h1[hit[part]]), pa.array(h2[hit[part]])], names=["doc_id", "key", "run", "h1", "h2"])

    return lists.select("doc_id", "key", "h1", "h2").mapInArrow(run, "doc_id long, key long, run int, h1 long, h2 long")


def removals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, key, covered): for each document that loses any, the numbers of its runs that stand earlier as well."""
    lists = written(run_lists(docs), "hashes")
    # sums within a task first: a passage in a third of all texts costs a row a task
    again = written(lists.select(F.explode("h1").alias("h1")).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "again")
    every = written(run_rows(lists, bits_of(again, "h1")), "runs")
    remove(spark, again)
    remove(spark, lists)
    place = F.struct("doc_id", "key", "run")
    repeated = every.groupBy("h1", "h2").agg(F.min(place).alias("origin"), F.max(place).alias("last")).where("origin != last").select("h1", "h2", "origin")
    later = every.join(written(repeated, "repeated"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("origin")))
    out = written(later.groupBy("doc_id", "key").agg(F.collect_set("run").alias("covered")), "covered")
    remove(spark, every)
    return out


def cleaned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (sentences), removed (start, end in code points of the text, not overlapping) and the text left."""
    lost = removals(spark, docs)
    rows = _keyed(docs)
    passes = screen(lost, "key")
    touched = rows.where(passes(F.col("key"))).join(lost.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "covered")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        words = Words()
        for b in balanced(batches, "text"):
            out = []
            for t, covered in zip(b.column("text").to_pylist(), b.column("covered"), strict=True):
                if not covered.is_valid:
                    out.append((0, [], t))
                    continue
                cut = Cut(t, words)
                chosen = cut.spans()[covered.values.to_numpy(zero_copy_only=False)]
                step = np.zeros(len(cut.ends) + 1, dtype=np.int64)  # one to the right, and nothing gone on either side
                np.add.at(step, chosen[:, 0] + 1, 1)
                np.add.at(step, chosen[:, 1] + 1, -1)
                gone = np.cumsum(step) > 0
                edges = cut.places()[np.flatnonzero(gone[1:] != gone[:-1])].reshape(-1, 2).tolist()
                left = "".join([t[x:y] for x, y in zip([0, *[e for _, e in edges]], [*[a for a, _ in edges], len(t)], strict=True)])
                out.append((int(gone.sum()), [{"start": x, "end": y} for x, y in edges], left))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.string())], names=["doc_id", "n_removed", "removed", "text"])

    schema = "doc_id long, n_removed long, removed array<struct<start: long, end: long>>, text string"
    others = rows.where(~passes(F.col("key"))).select("doc_id", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start: long, end: long>>").alias("removed"), "text")
    return touched.mapInArrow(run, schema).unionByName(others)
