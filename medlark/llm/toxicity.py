"""Toxic passages by maximum-scoring segments over token log-odds.

Learning: over all labelled training rows, texts with each word are counted by label; equal texts of one label count once,
as copies would make their rare words look telling. A word's log-odds between labels are taken under an informative
Dirichlet prior, whose mass is dealt to the labels as the training texts are; its score is their bound (Z standard errors)
on the side of zero: positive if the lower bound reaches LEAST, negative if the upper bound is below -DRIFT. Words that
either label may go with score -DRIFT. Words seen in fewer than KNOWN texts take the score of their longest prefix that is
seen in so many. The model has every word that is told apart, however many there are.

Scanning: one linear pass over a text's tokens finds all maximal segments of positive score. Under the background (texts
labelled 0), the number of segments of score S or more in n tokens is about K n exp(-lambda S); lambda solves
sum p_i exp(lambda s_i) = 1 over the scores of all background tokens, K is the segments of all background tokens. That law
needs a negative mean: where the background's isn't, DRIFT is doubled until it is. A document's best segment so has an
extreme-value p-value, and a logistic curve over -log10 p and the number of significant segments, fitted on at most
CALIBRATION labelled training rows, gives the score. Everything else is counted over all rows.

A model of up to BROADCAST_TERMS terms is sent to all tasks; the words of texts meet a larger one in a join.

Nulls: a null text is empty; an empty text has the score of a text without hits; rows of labels with null doc_id or null
toxic are not used. Repeated rows each give a row; a document labelled twice counts twice. Without any labelled training
row of either class, every score is 0. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, pick, remove, screen, written
from .tokens import balanced

#: Parameters of the model: prior documents, standard errors, documents of a known word, least log-odds of a term that
#: counts, penalty of words that either label may go with, bound of a negative score, prefix lengths, rows that the last
#: curve is fitted on, E-value of a significant segment.
PRIOR, Z, KNOWN, LEAST, DRIFT, FLOOR, PREFIXES, CALIBRATION, SIGNIFICANT = 1.0, 3.0, 10, 1.0, 0.1, -1.0, (6, 5, 4), 20_000, 0.01
#: Labels are sent to all tasks up to so many rows (16 bytes each), and joined by a shuffle beyond; so are terms.
BROADCAST_LABELS, BROADCAST_TERMS = 1_000_000, 400_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass
class Model:
    """Terms (prefixes end with *; 0 for those that tell nothing, but stand before a prefix that does), and the calibration.
    `table` has them as (term, s) where they are too many to be sent along."""

    terms: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    k: float = 1e-3
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    table: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def score_of(self, word: str) -> float:
        """0 stands for -drift."""
        for key in keys_of(word):
            if (got := self.terms.get(key)) is not None:
                return got
        return 0.0

    def expected(self, score: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-self.rate * score)

    def hits(self, tokens: list[str], memo: dict) -> list[tuple[int, float]]:
        """(place, score) of the tokens that don't score -drift."""
        out = []
        for i, w in enumerate(tokens):
            s = memo.get(w)
            if s is None:
                if len(memo) > 200_000:
                    memo.clear()
                s = memo[w] = self.score_of(w)
            if s:
                out.append((i, s))
        return out

    def weighed(self, n: int, found: list) -> tuple[float, int]:
        """(-log10 p of the best segment, significant segments) of a text of n tokens."""
        if not found:
            return 0.0, 0
        p = -math.expm1(-self.expected(max(s for _, _, s in found), n))
        return min(-math.log10(max(p, 1e-300)), 30.0), sum(self.expected(s, n) <= SIGNIFICANT for _, _, s in found)

    def document(self, tokens: list[str], memo: dict) -> tuple[float, int, list]:
        """(-log10 p of the best segment, significant segments, segments as (first token, end, score))."""
        found = maximal_segments(self.hits(tokens, memo), self.drift)
        return *self.weighed(len(tokens), found), found

    def score(self, evidence: float, segments: int) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * evidence + c * math.log1p(segments)))))


def keys_of(word: str) -> list[str]:
    """The terms that may give a word its score, the first one that there is."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence whose tokens score -drift but for hits (place, score): those that no longer
    or shorter one beats, disjoint, in order. Linear in the hits (candidates kept with their running sums)."""
    stack: list[list] = []  # [first, end, sum before, sum at the end, nearest candidate to the left with a lower sum before]
    total, at = 0.0, 0
    for place, score in hits:
        total -= drift * (place - at)
        at = place + 1
        if score < 0:
            total += score
            continue
        here = [place, at, total, total + score, -1]
        total += score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= here[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= here[3]:
                here[4] = j
                stack.append(here)
                break
            here[0], here[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(term, y0, y1): documents of either label with each word; summed in each batch, then over all."""

    def run(batches):
        for b in balanced(batches, "text"):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for w in set(words(text)):
                    got = seen.get(w)
                    if got is None:
                        got = seen[w] = [0, 0]
                    got[toxic] += 1
            n = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["term", "y0", "y1"])

    counted = labelled.mapInArrow(run, "term string, y0 long, y1 long")
    return counted.groupBy("term").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))


def _bounded_log_odds(n0: int, n1: int):
    """Score of a term, as a column over y0 and y1: the bound of its log-odds on the side of zero, 0 if it tells nothing."""
    a0, a1 = F.lit(PRIOR * n0 / (n0 + n1)), F.lit(PRIOR * n1 / (n0 + n1))
    p1 = (F.col("y1") + a1) / (n1 + PRIOR)
    p0 = (F.col("y0") + a0) / (n0 + PRIOR)
    delta = F.log(p1) - F.log(p0)
    wide = Z * F.sqrt(1 / (F.col("y1") + a1) + 1 / (F.col("y0") + a0))
    return F.when(delta - wide >= LEAST, delta - wide).when(delta + wide < -DRIFT, F.greatest(delta + wide, F.lit(FLOOR))).otherwise(0.0)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the training rows."""
    known = pick(labels, "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    return pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id")


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """One row of each text and label: the smallest doc_id. Only hashes and ids are grouped."""
    first = written(labelled.select("doc_id", "toxic", F.xxhash64("text").alias("h")).groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("toxic").alias("label")), "distinct")
    first = F.broadcast(first) if first.count() <= BROADCAST_LABELS else first
    return labelled.join(first, (labelled["doc_id"] == first["doc_id"]) & (labelled["toxic"] == first["label"])).select(labelled["doc_id"], "text", "toxic")


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    labelled = written(distinct_texts(labelled_rows(docs, labels)), "labelled")
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model()
    table = written(_word_counts(labelled.select("text", "toxic")), "words")
    known = (F.col("y0") + F.col("y1")) >= KNOWN
    prefixes = None
    for k in PREFIXES:
        part = table.where(F.length("term") > k).groupBy(F.concat(F.substring("term", 1, k), F.lit("*")).alias("term")).agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
        prefixes = part if prefixes is None else prefixes.unionByName(part)
    scored = written(table.where(known).unionByName(prefixes.where(known)).select("term", _bounded_log_odds(n0, n1).alias("s")), "scored")
    telling = scored.where("s <> 0")
    # terms that tell nothing but keep a longer known term from taking a prefix's score
    lead = written(telling.where(F.col("term").endswith("*")).select(F.rtrim(F.col("term"), F.lit("*")).alias("lead")).distinct(), "lead")
    lead = F.broadcast(lead) if lead.count() <= BROADCAST_TERMS else lead
    plain = scored.where("s = 0").withColumn("lead", F.explode(F.array(*[F.substring("term", 1, k) for k in PREFIXES])))
    terms = written(telling.unionByName(plain.join(lead, "lead").select("term", "s").distinct()), "terms")
    remove(spark, table)
    remove(spark, scored)
    model = Model()
    if terms.count() > BROADCAST_TERMS:
        model.table = terms
    else:
        model.terms = {r["term"]: r["s"] for r in terms.collect()}
    quiet = labelled.where("toxic = 0")
    share = [(r["s"], r["n"]) for r in _score_counts(quiet, model).collect()]
    model.drift, model.rate = _solve_rate(share)
    found = scanned(quiet, model, []).agg(F.sum("n_segments").alias("s"), F.sum("n_tokens").alias("n")).first()
    model.k = ((found["s"] or 0) + 1) / ((found["n"] or 0) + 1)
    # the last curve: a bounded sample of training rows, those of least hash
    wanted = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION)
    found = evidence(labelled.join(F.broadcast(wanted), "doc_id"), model, ["toxic"]).collect()
    model.curve = _fit([(r["evidence"], r["significant"], r["toxic"]) for r in found])
    remove(spark, labelled)
    return model


def _score_counts(rows: DataFrame, model: Model) -> DataFrame:
    """(s, n): tokens of the rows by score, to three places; 0 stands for -drift."""
    if model.table is not None:
        scores = _joined_hits(rows.select("text"), model)
        hits = scores.select(F.explode("hits").alias("h")).groupBy(F.round("h.score", 3).alias("s")).agg(F.count(F.lit(1)).alias("n"))
        return hits.unionByName(scores.agg(F.lit(0.0).alias("s"), F.coalesce(F.sum(F.col("n_tokens") - F.size("hits")), F.lit(0)).alias("n")))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, memo, counts = shared.value, {}, Counter()
        for b in balanced(batches, "text"):
            for w, n in Counter(itertools.chain.from_iterable(words(t) for t in b.column("text").to_pylist())).items():
                s = memo.get(w)
                if s is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    s = memo[w] = round(m.score_of(w), 3)
                counts[s] += n
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.float64()), pa.array(counts.values(), pa.int64())], names=["s", "n"])

    return rows.select("text").mapInArrow(run, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))


def _joined_hits(rows: DataFrame, model: Model) -> DataFrame:
    """rows with n_tokens and hits, by a join of their words with the model's table. Words of no term are kept from the
    shuffle by a screen; of a word in many texts the sort-merge join is split by the engine."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    passes = screen(model.table.select(F.xxhash64("term").alias("h")), "h")
    kept = rows.select("_row", F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in balanced(batches, "text"):
            for i, text in zip(b.column("_row").to_pylist(), b.column("text").to_pylist(), strict=True):
                places: dict[str, list[int]] = {}
                for k, w in enumerate(words(text)):
                    places.setdefault(w, []).append(k)
                for lo in range(0, max(len(places), 1), 10_000):
                    part = list(places.items())[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int64()), pa.array([w for w, _ in part], pa.string()), pa.array([p for _, p in part], pa.list_(pa.int64()))], names=["_row", "word", "places"])

    spread = written(kept.mapInArrow(run, "_row long, word string, places array<long>"), "words")
    keys = F.array("word", *[F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES])
    asked = spread.select("word").distinct().select("word", F.posexplode(keys).alias("rank", "term")).where("term is not null").where(passes(F.xxhash64("term")))
    scored = asked.join(model.table, "term").groupBy("word").agg(F.min_by("s", "rank").alias("score")).where("score <> 0")
    hits = spread.join(scored, "word").select("_row", "score", F.explode("places").alias("place")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("hits"))
    sizes = spread.groupBy("_row").agg(F.sum(F.size("places")).alias("n_tokens"))
    empty = F.array().cast("array<struct<place: long, score: double>>")
    return rows.join(sizes, "_row", "left").join(hits, "_row", "left").withColumns({"n_tokens": F.coalesce("n_tokens", F.lit(0)), "hits": F.coalesce("hits", empty)}).drop("_row")


def _solve_rate(counts: list[tuple[float, int]]) -> tuple[float, float]:
    """(drift, lambda): lambda > 0 with sum p exp(lambda s) = 1, by bisection. It exists if a score is positive and the mean
    isn't; the drift is doubled until that holds. Without any positive score there are no segments, and lambda is 1."""
    total = sum(n for _, n in counts)
    share = [(s, n / total) for s, n in counts if n and s]
    if not any(s > 0 for s, _ in share):
        return DRIFT, 1.0
    drift, rest = DRIFT, max(1 - sum(p for _, p in share), 1 / total)
    while sum(p * s for s, p in share) - rest * drift >= 0:
        drift *= 2
    excess = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in share) + rest * math.exp(-x * drift) - 1
    lo, hi = 1e-9, 1.0
    while excess(hi) < 0:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return drift, lo


def _fit(rows: list[tuple[float, int, int]]) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.array([[1.0, e, math.log1p(s)] for e, s, _ in rows])
    y = np.array([float(t) for _, _, t in rows])
    if len(rows) < 10 or y.min() == y.max():
        return (-3.0, 1.0, 1.0)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


SEGMENTS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scanned(rows: DataFrame, model: Model, carry: list[str], weigh: bool = False, segments: bool = False) -> DataFrame:
    """The carried columns, n_tokens, n_segments, with `weigh` evidence, significant and score, and the segments if asked for."""
    kinds = dict(rows.dtypes)
    rows = rows.select(*carry, F.col("text").cast("string").alias("text"))
    told = model.table is not None
    rows = _joined_hits(rows, model) if told else rows
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "n_segments", *(["evidence", "significant", "score"] if weigh else []), *(["segments"] if segments else [])]
    types = [pa.int64(), pa.int64(), *([pa.float64(), pa.int64(), pa.float64()] if weigh else []), SEGMENTS]

    def run(batches):
        m, memo = shared.value, {}
        for b in balanced(batches, "text"):
            out = []
            given = zip(b.column("n_tokens").to_pylist(), b.column("hits").to_pylist(), strict=True) if told else None
            for text in b.column("text").to_pylist():
                if told:
                    n, hits = next(given)
                    hits = [(h["place"], h["score"]) for h in hits]
                else:
                    tokens = words(text)
                    n, hits = len(tokens), m.hits(tokens, memo)
                found = maximal_segments(hits, m.drift)
                row = [n, len(found)]
                if weigh:
                    e, s = m.weighed(n, found)
                    row += [e, s, m.score(e, s)]
                out.append([*row, [{"first": x, "end": y, "score": z} for x, y, z in found]] if segments else row)
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], names=[*carry, *names])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in carry) + "n_tokens long, n_segments long" + (", evidence double, significant long, score double" if weigh else "") + (", segments array<struct<first: long, end: long, score: double>>" if segments else "")
    return rows.mapInArrow(run, schema)


def evidence(rows: DataFrame, model: Model, carry: list[str], segments: bool = False) -> DataFrame:
    """The carried columns, n_tokens, n_segments, evidence, significant, score and, if asked for, the segments."""
    return scanned(rows, model, carry, True, segments)


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, segments: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, with n_tokens and the number of segments."""
    model = learn(spark, docs, labels)
    out = evidence(pick(docs, "doc_id", "text"), model, ["doc_id"], segments)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_segments", "significant", *(["segments"] if segments else []))


def clean_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that aren't predicted toxic, with their columns. Rows are scored where they stand: nothing is joined back."""
    model = learn(spark, docs, labels)
    plain, names = numbered(docs)
    rows = plain.withColumn("text", F.col(names[docs.columns.index("text")]))
    return evidence(rows, model, names).where(F.col("score") < threshold).select(*names).toDF(*docs.columns)
