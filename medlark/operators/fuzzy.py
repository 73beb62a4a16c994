"""Exact joins of names by similarity, over an inverted index; no pair that can reach the score is lost.

Where only the plain letters can reach it, the score and the lengths bound the edits between two names, to d. Where these are
no more than an exchanged letter, names meet by what is left of them: whole, with a letter less, or, if one is two letters
longer, without two of PIECES pieces. What many names have in common (boilerplate) is not enough for
most pairs to meet.
Where more edits are allowed, a name cut into d + 1 segments has one that no edit touches, and it stands in the other name at
most d places away: names meet by length, segment and its letters.
Where words in another order can reach it too, names meet by grams: a word's first letter with a blank ahead, or two
neighbouring letters of a word, numbered where they come again, so a name has a set of grams that the order of its words
doesn't change. How many two names must share follows from lengths and score, so each name looks for partners by its rarest
grams only, as many as must hit one of them.
Names meet within their first letter, as the mapping rules want it; no block of a letter is met whole.

Names without letters have no partner. Repeated names count once. A name may be of any length; ties are left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - insertions and deletions / both lengths), by a bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain, the token-sorted (x 0.95) and the token-set ratio (x 0.95). Close to, not equal to, the scorer
    of the library that isn't installed here; above 95 both are the plain ratio."""
    ta, tb = sorted(a.split()), sorted(b.split())
    common = sorted(set(ta) & set(tb))
    rest_a, rest_b = [t for t in ta if t not in common], [t for t in tb if t not in common]
    base = " ".join(common)
    joined = [" ".join([base, *r]).strip() for r in (rest_a, rest_b)]
    token_set = max(indel_ratio(base, joined[0]), indel_ratio(base, joined[1]), indel_ratio(*joined)) if common else indel_ratio(*joined)
    return max(indel_ratio(a, b), TOKENS * indel_ratio(" ".join(ta), " ".join(tb)), TOKENS * token_set)


#: Weight of the ratios that look at words.
TOKENS = 0.95


@F.pandas_udf(T.DoubleType())
def weighted_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_score(a, b) -> Column:
    """100 (1 - edit distance / the longer length), all JVM-side."""
    return 100.0 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


@dataclass(frozen=True)
class Measure:
    """A score and what it takes to reach `r` (0 to 1) of it: the least and largest length of a partner, and the edits between
    names of two lengths at most, of which an exchanged letter takes `swap`. `words`: whether names whose words are mostly in
    common may reach it whatever their edits."""

    score: Callable[[Column, Column], Column]
    lengths: Callable[[Column, float], tuple[Column, Column]]
    edits: Callable[[Column, Column, float], Column]
    swap: int
    words: Callable[[float], bool] = lambda r: False


#: The weighted ratio, by its Arrow function; edits are insertions and deletions.
WEIGHTED = Measure(weighted_score, lambda n, r: (F.ceil(n * r / (2 - r) - 1e-9), F.floor(n * (2 - r) / r + 1e-9)), lambda a, b, r: F.floor((1 - r) * (a + b) + 1e-9), 2, lambda r: r <= TOKENS)
#: The edit distance.
EDITS = Measure(edit_score, lambda n, r: (F.ceil(n * r - 1e-9), F.floor(n / r + 1e-9)), lambda a, b, r: F.floor((1 - r) * F.greatest(a, b) + 1e-9), 1)


def grams(name: Column) -> Column:
    """The grams of a name, sorted, each with how often it came before."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    plain = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit(" "), w).substr(i, F.lit(2)))))
    # inside an array of one, so that the sorted grams are made once and not for each of them
    return F.transform(F.array(F.array_sort(plain)), lambda p: F.transform(p, lambda g, i: F.concat(g, (i - F.array_position(p, g)).cast("string"))))[0]


def _blanks(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit("")))


def _sequence(lo: Column, hi: Column) -> Column:
    return F.sequence(lo.cast("int"), F.greatest(lo, hi).cast("int"))


def candidates(names: DataFrame, aliases: DataFrame, r: float, measure: Measure = WEIGHTED) -> DataFrame:
    """(name, alias) of all pairs of one first letter whose score may be 100 r or more, and few others; tables of (name) and
    (alias)."""
    from .ranges import dealt

    one = lambda t, c: t.select(F.col(c).alias("name")).where(F.trim("name") != "")
    own = lambda t: t.distinct().select("name", F.substring("name", 1, 1).alias("initial"), F.length("name").alias("n"))
    left, right = one(names, "name"), one(aliases, "alias")
    if measure.words(r):
        return by_grams(own(left), own(right), r, measure)
    # a name has some eighty keys, of which tasks that are coalesced by the size of names don't know
    left, right = (own(dealt(t, "name")).withColumn("bag", _bag(F.col("name"))) for t in (left, right))
    return by_letters(left, right, r, measure).unionByName(by_segments(left, right, r, measure)).distinct()


#: Pieces that a name is cut into where its partner is two letters longer, and the two that are left out.
PIECES = 7
PAIRS = list(combinations(range(PIECES), 2))


def _bag(name: Column) -> Column:
    """A bit a letter (by its number modulo 64): whether it comes an odd number of times."""
    return F.aggregate(F.split(name, ""), F.lit(0).cast("bigint"), lambda bits, letter: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(letter))))


def _near(measure: Measure) -> Column:
    """Whether no more than e edits part name and alias, JVM-side: an insertion or deletion turns one bit of the bag, which is
    cheaper to tell than a banded distance. No score takes fewer edits than the edit distance."""
    return (F.bit_count(F.col("bag").bitwiseXOR(F.col("bag_alias"))) <= F.col("e") * (2 // measure.swap)) & (F.expr("levenshtein(name, alias, e)") >= 0)


def _most(n: Column, m: Column, r: float, measure: Measure) -> Column:
    """The most edits between names of two lengths; insertions and deletions alone are odd if the lengths' difference is."""
    e = measure.edits(n, m, r).cast("int")
    return e - F.pmod(e - (n - m), F.lit(2)) if measure.swap == 2 else e


def by_letters(names: DataFrame, aliases: DataFrame, r: float, measure: Measure) -> DataFrame:
    """Pairs whose lengths allow no more than `swap` edits: see above.

    An insertion is a deletion from the other name. So an edit or an exchanged letter leaves both alike once each has lost one
    letter at most. Two deletions from one name fall into two pieces of the other, or into one and a neighbour: the rest
    stands in the longer name where it stood, one place on between the two, and two places on behind them."""

    n, most = F.col("n"), lambda more: _most(F.col("n"), F.col("n") + more, r, measure)

    def letters(rows: DataFrame) -> DataFrame:
        one = most(-1).between(1, measure.swap) | (most(0) == measure.swap)
        cut = rows.select("name", "initial", "n", "bag", F.explode(F.sequence(F.lit(0), F.when(one, n).otherwise(0))).alias("at"))
        # of equal neighbours it doesn't matter which one goes
        at, letter = F.col("at"), lambda at: F.substr("name", at, F.lit(1))
        cut = cut.where((at == 0) | (at == n) | (letter(at) != letter(at + 1)))
        return cut.select(F.xxhash64("initial", F.lit(0), F.concat(F.substr("name", F.lit(1), at - 1), F.substr("name", at + 1))).alias("key"), "name", "bag")

    def pieces(rows: DataFrame, own: int) -> DataFrame:
        """`own` tells the names' keys from the aliases': a longer name meets shorter aliases only, and the reverse."""
        pair = lambda long, k: F.struct(F.lit(1 + k + len(PAIRS) * (long == own)).alias("kind"), F.lit(long).alias("long"), F.lit(PAIRS[k][0]).alias("u"), F.lit(PAIRS[k][1]).alias("v"))
        pairs = [F.array(*[pair(long, k) for k in range(len(PAIRS))]) for long in (0, 1)]
        none = F.array().cast("array<struct<kind:int,long:int,u:int,v:int>>")
        each = F.concat(F.when(most(2) == 2, pairs[0]).otherwise(none), F.when((n > 2) & (most(-2) == 2), pairs[1]).otherwise(none))
        long, u, v = (F.col(f"p.{c}") for c in ("long", "u", "v"))
        m = n - 2 * long
        start = lambda x: F.floor(x * m / PIECES).cast("int")  # noqa: E731  0-based
        rest = F.concat(F.substr("name", F.lit(1), start(u)), F.substr("name", start(u + 1) + long + 1, start(v) - start(u + 1)), F.substr("name", start(v + 1) + 2 * long + 1))
        return rows.select("name", "initial", "n", "bag", F.explode(each).alias("p")).select(F.xxhash64("initial", "p.kind", m, rest).alias("key"), "name", "bag")

    # apart, as the engine doesn't compile the code of both at once; where an exchange is an edit, segments do the rest
    keyed = lambda rows, own: letters(rows).unionByName(pieces(rows, own)) if measure.swap == 2 else letters(rows)
    # keys are many to a name: neither side may go to all tasks by the driver
    met = keyed(names, 1).join(keyed(aliases, 0).select("key", F.col("name").alias("alias"), F.col("bag").alias("bag_alias")).hint("merge"), "key")
    # what clashes falls to the distance
    met = met.select("name", "alias", "bag", "bag_alias", measure.edits(F.length("name"), F.length("alias"), r).cast("int").alias("e"))
    return met.where(F.startswith("alias", F.substring("name", 1, 1)) & _near(measure)).select("name", "alias")


def by_segments(names: DataFrame, aliases: DataFrame, r: float, measure: Measure) -> DataFrame:
    """Pairs whose lengths allow more than `swap` edits and that share a segment in place: see above. An alias of length m is
    cut for the most edits that any partner allows."""
    most = lambda m: F.greatest(F.lit(0), F.least(measure.edits(m, measure.lengths(m, r)[1], r), m - 1)).cast("int")
    start = lambda k, d, m: F.floor(k * m / (d + 1)).cast("int")  # noqa: E731  0-based
    # nothing where no partner allows more
    listed = lambda n, values: F.when(measure.edits(n, measure.lengths(n, r)[1], r) > measure.swap, values).otherwise(F.array().cast("array<int>"))
    cut = aliases.select("name", "initial", "bag", F.col("n").alias("m"), most(F.col("n")).alias("d")).select("*", F.explode(listed(F.col("m"), F.sequence(F.lit(0), F.col("d")))).alias("k"))
    lo, hi = start(F.col("k"), F.col("d"), F.col("m")), start(F.col("k") + 1, F.col("d"), F.col("m"))
    # length, segment and its letters as one number: what clashes falls to the distance below
    key = lambda letters: F.xxhash64("m", "k", letters).alias("key")
    index = cut.select(F.col("name").alias("alias"), F.col("bag").alias("bag_alias"), "initial", key(F.substr("name", lo + 1, hi - lo)))
    # a name asks for each length that a partner may have, each segment, and each place that the edits may have moved it to
    least, largest = measure.lengths(F.col("n"), r)
    asked = names.select("name", "initial", "n", "bag", F.explode(listed(F.col("n"), _sequence(F.greatest(F.lit(1), least), largest))).alias("m")).withColumn("d", most(F.col("m")))
    asked = asked.withColumn("e", F.least("d", measure.edits(F.col("n"), F.col("m"), r)).cast("int")).where(F.abs(F.col("n") - F.col("m")) <= F.col("e")).where(_most(F.col("n"), F.col("m"), r, measure) > measure.swap)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k"))
    asked = asked.select("*", F.explode(F.sequence(-F.col("e"), F.col("e"))).alias("move"))
    place, size = start(F.col("k"), F.col("d"), F.col("m")) + F.col("move"), start(F.col("k") + 1, F.col("d"), F.col("m")) - start(F.col("k"), F.col("d"), F.col("m"))
    asked = asked.where((place >= 0) & (place + size <= F.col("n"))).select("name", "initial", "bag", "e", key(F.substr("name", place + 1, size)))
    # a name asks some sixty times, which no estimate of sizes knows of: neither side may go to all tasks by the driver
    met = asked.join(index.hint("merge"), ["initial", "key"])
    # before anything is shuffled
    return met.where(_near(measure)).select("name", "alias")


def by_grams(names: DataFrame, aliases: DataFrame, r: float, measure: Measure) -> DataFrame:
    """Pairs that share grams enough for the plain or the sorted ratio, or for words in common: see above."""
    seen = aliases.select(F.explode(grams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))

    def listed(rows: DataFrame) -> DataFrame:
        each = rows.select("name", F.explode(grams(F.col("name"))).alias("gram")).join(seen, "gram", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram")))
        # as words are compared as sets too, a name also has the length that it has without repeated words
        own = each.groupBy("name").agg(F.transform(order, lambda x: x["gram"]).alias("grams"))
        return own.select("name", "grams", F.substring("name", 1, 1).alias("initial"), F.length("name").alias("n"), _blanks(F.col("name")).alias("blanks"), F.length(F.array_join(F.array_distinct(F.split("name", " ")), " ")).alias("least"))

    def first(rows: DataFrame, needed: Column) -> DataFrame:
        """The rarest grams, of which one must be shared if `needed` are (a first letter is shared anyway)."""
        size = F.size("grams") - F.greatest(F.lit(1), needed) + 1
        return rows.select("name", "initial", F.explode(F.slice("grams", F.lit(1), F.greatest(F.lit(1), size).cast("int"))).alias("gram"))

    def shared(a: Column, b: Column) -> Column:
        # a common subsequence of L letters; a deletion breaks two grams at most, an insertion one
        return 3 * F.ceil(F.lit(r) * (a + b) / 2 - 1e-9) - a - b

    def letters(rows: DataFrame) -> DataFrame:
        n, least = F.col("n"), F.col("least")
        lengths = _sequence(F.greatest(F.lit(1), measure.lengths(least, r)[0]), measure.lengths(n, r)[1])
        return first(rows, F.array_min(F.transform(lengths, lambda m: F.least(shared(n, m), shared(least, m)))) - F.col("blanks") - (n - least))

    # words in common reach the score if they are such a share of one of the names
    share = r / TOKENS / (2 - r / TOKENS)
    words = lambda rows: first(rows, F.ceil(F.lit(share) * F.col("least") - 1e-9) - F.col("blanks"))
    every = lambda rows: rows.select("name", "initial", F.explode("grams").alias("gram"))
    left, right = listed(names), listed(aliases)
    found = None
    for a, b in ((letters(left), letters(right)), (words(left), every(right)), (every(left), words(right))):
        # grams are many to a name: neither side may go to all tasks by the driver
        met = a.join(b.withColumnRenamed("name", "alias").hint("merge"), ["initial", "gram"]).select("name", "alias")
        found = met if found is None else found.unionByName(met)
    return found.distinct()
