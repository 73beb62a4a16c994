"""The gram index against all pairs: nothing that reaches a score is lost, and few pairs are scored."""

from __future__ import annotations

import itertools
import random

import pytest

from medlark.operators import fuzzy as FZ
from medlark.operators import names as NA

WORDS = ["SODIUM", "ACID", "ACETYL", "SALICYLIC", "CHLORIDE", "OF", "VITAMIN", "B", "B12", "HYDRO", "METFORMIN", "É", "SALT"]


def edited(name: str, n: int) -> str:
    s = list(name)
    for _ in range(n):
        k = random.randrange(len(s) + 1)
        random.choice([lambda k=k: s.insert(k, random.choice("ABXS ")), lambda k=k: s and s.pop(min(k, len(s) - 1)), lambda k=k: s and s.__setitem__(min(k, len(s) - 1), "Q")])()
    return "".join(s)


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(2)
    aliases = [" ".join(random.choices(WORDS, k=random.randint(1, 5))) for _ in range(160)] + ["A", "AB", "SS", "S" * 60, "SODIUM  SODIUM", "", None]
    names = [edited(random.choice(aliases[:160]), random.randint(0, 4)) for _ in range(160)] + [" ".join(random.sample(a.split(), len(a.split()))) for a in aliases[:60]] + ["A", "S", "SS", "S" * 59, "SODIUM", " ", "", None]
    names, aliases = [n if not n or n[0] != " " else n.strip() for n in names], aliases
    return names, aliases, spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a,) for a in aliases + aliases[:9]], "alias string")


@pytest.mark.parametrize("least", [97, 90, 75])
def test_no_pair_is_lost(tables, least):
    names, aliases, n, a = tables
    found = {(r["name"], r["alias"]) for r in FZ.candidates(n, a, least / 100).collect()}
    pairs = {(x, y) for x, y in itertools.product(set(names), set(aliases)) if x and y and x[0] == y[0]}
    want = {p for p in pairs if FZ.weighted_ratio(*p) >= least}
    assert want and want <= found <= pairs
    if least > 95:
        assert len(found) < 3 * len(want) + 20 < len(pairs) / 5


@pytest.mark.parametrize("least", [95, 87, 70])
def test_no_pair_is_lost_by_edit_distance(tables, least):
    names, aliases, n, a = tables

    def score(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return 100 * (1 - row[-1] / max(len(x), len(y)))

    found = {(r["name"], r["alias"]) for r in FZ.candidates(n, a, least / 100, FZ.EDITS).collect()}
    assert {(x, y) for x, y in itertools.product(set(names), set(aliases)) if x and y and x[0] == y[0] and score(x, y) >= least} <= found


def test_few_edits_of_names_of_few_letters(spark):
    # every length at which nothing, a letter, an exchange, two letters or more are allowed; runs of equal letters
    random.seed(5)
    aliases = ["A" + "".join(random.choices("AB", k=n)) for n in (0, 1, 2, 7, 15, 16, 17, *range(30, 54))]
    names = {edited(a, k) for a in aliases for k in (0, 1, 1, 2, 2, 3)} | {a[:i] + a[i + 1 : j] + a[j + 1 :] for a in aliases for i, j in itertools.combinations(range(1, len(a)), 2) if (i + j) % 5 == 0}
    names = sorted(n for n in names | {a[: len(a) // 3] + "A" + a[len(a) // 3 :] + "B" for a in aliases} if n.strip() and n[0] == "A")
    found = {(r["name"], r["alias"]) for r in FZ.candidates(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(a,) for a in aliases], "alias string"), 0.97).collect()}
    want = {p for p in itertools.product(names, aliases) if FZ.indel_ratio(*p) >= 97}
    assert want <= found and len({len(a) - len(n) for n, a in want}) >= 5 and len(found) < 2 * len(want)


def test_default_match_and_rivals(spark, tables):
    names, aliases, n, a = tables
    want = {}
    for x in {x for x in names if x}:
        scores = sorted(((FZ.weighted_ratio(x, y), y) for y in {y for y in aliases if y} if y[0] == x[0]), reverse=True)
        scores = [s for s in scores if s[0] >= 97]
        if scores and scores[0][0] - (scores[1][0] if len(scores) > 1 else 0) >= 3:
            want[x] = (scores[0][1], round(scores[0][0], 9))
    assert {r["name"]: (r["alias"], round(r["score"], 9)) for r in NA.fuzzy(n, a).collect()} == want and len(want) > 10
    assert NA.fuzzy(n.where("false"), a).count() == NA.fuzzy(n, a.where("false")).count() == 0
    # a rival counts from the cutoff on, or from where it is told to
    known = spark.createDataFrame([("ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJ",), ("ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLM",)], "alias string")
    asked = spark.createDataFrame([("ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJK",)], "name string")
    assert NA.fuzzy(asked, known, 98, 3).count() == 1 and NA.fuzzy(asked, known, 98, 3, rivals=95).count() == 0


def test_no_letter_block_is_met_whole(spark):
    aliases = spark.range(3000).selectExpr("concat('S', upper(md5(cast(id as string)))) as alias")
    names = aliases.selectExpr("concat(alias, 'A') as name")
    assert FZ.candidates(names, aliases, 0.97).count() < 3100


@pytest.mark.parametrize(("query", "cutoff"), [("sodium", 70), ("acet", 60), ("metformin hydro", 80), ("b", 100), ("zzzz", 30), ("SS", 90)])
def test_postings_give_what_a_scan_gives(spark, tables, tmp_path, query, cutoff):
    known = tables[3]
    NA.write_postings(known, f"file://{tmp_path}/p")
    postings = spark.read.parquet(f"file://{tmp_path}/p")
    plain = lambda df: [(r["alias"], round(r["score"], 9)) for r in df.collect()]
    assert plain(NA.suggestions_from(query, postings, 12, cutoff)) == plain(NA.suggestions(query, known, 12, cutoff))
