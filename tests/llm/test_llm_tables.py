"""Operators over small tables, against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medlark.llm import exact_dedup, idfiles, merkle, mixing, order_minhash, packing, queries, spans, tokens, toxicity, warc

WORD, BYTE = tokens.vocabulary("word_bpe_49k.json"), tokens.vocabulary("byte_bpe_50k.json")
LONG = " ".join(f"long{i % 977} text{i}" for i in range(9000))
BASE = " ".join(f"w{i}" for i in range(150))
TEXTS = [
    (1, "One two three. Four five!\nSix.", "a"), (2, None, "a"), (3, "", None), (4, "One two  three.\tFour five!\nSix.", "b"), (5, LONG, "b"), (6, BASE, None),
    (7, BASE.replace("w75", "x75"), "c"), (8, BASE, "c"), (9, " \t\n ", "a"), (None, "nobody's text", "a"), (11, "é\U0001f44d ß", "d"), (12, " ".join(f"v{i}" for i in range(150)), "a"),
    (12, " ".join(f"v{i}" for i in range(150)), "a"), (13, "One two three. Four five!\nSix.", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Also with extra columns whose names clash with ours, by case alone too."""
    rows = [(d, t, "en", s, len(t or ""), "x", 1, 2, 3, "y") for d, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, key int, size int, part int, _copies string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(WORD)
    got = Counter(map(tuple, tokens.count_tokens(docs, WORD).collect()))
    want = Counter()
    for d, t, _ in TEXTS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(d, len((t or "").encode()), n, n > 2048)] += 1
    assert got == want and tokens.count_tokens(empty, WORD).count() == 0


def test_id_files(spark, docs, empty):
    library = Tokenizer.from_file(WORD)
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for d, t, _ in ordered:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, idfiles.id_files(spark, docs, WORD).collect()), key=lambda r: r[1]) == want
    assert idfiles.id_files(spark, empty, WORD).count() == 0


def test_id_files_look_up_by_predicate(spark, docs, tmp_path):
    folder = idfiles.write_ids(docs, WORD, "word", 1, f"file://{tmp_path}/ids", files=3)
    one = idfiles.lookup(spark, folder, [5, 7])
    assert {r["doc_id"] for r in one.collect()} == {5, 7}
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "In(doc_id" in one._jdf.queryExecution().toString()


def test_fingerprints(spark, docs, empty):
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = Counter()
    for k, (d, t, _) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        e = merkle.edited(t, following)
        f = merkle.fingerprint(t)
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, merkle.fingerprint(e), merkle.likeness(f, merkle.fingerprint(e)), merkle.likeness(f, merkle.fingerprint(following)))] += 1
    for parts in (1, 2, 5):
        assert Counter(map(tuple, merkle.fingerprints(spark, docs, parts).collect())) == want
    assert merkle.fingerprints(spark, empty).count() == 0
    assert merkle.fingerprints(spark, docs.where("doc_id = 5")).first()["near_next"] == 1.0


def test_mixture(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 3)
    monkeypatch.setattr(mixing, "FAN", 2)
    rows = mixing.mixture(spark, docs, carry=["lang"]).collect()
    again = mixing.mixture(spark, docs, carry=["lang"]).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == len(TEXTS)
    size = Counter()
    for _, t, s in TEXTS:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = mixing.targets(list(size.items()))
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sum(r["target"] for r in {(r["source_size"], r["target"]): r for r in rows}.values()) == pytest.approx(sum(target.values()))
    assert mixing.mixture(spark, empty).count() == 0


def test_mix_keeps_columns_and_comes_near(spark, monkeypatch):
    rows = [(i, " ".join("w" * (1 + i % 7)), f"s{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.copies(spark, docs)
    assert mixed.columns == docs.columns
    size, taken = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    target = mixing.targets(list(size.items()))
    assert all(abs(taken[s] - target[s]) <= 7 for s in size)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # decisions that are joined give the same
    assert Counter(map(tuple, mixing.copies(spark, docs).collect())) == Counter(map(tuple, mixed.collect()))


def test_exact_dedup(spark, docs, empty):
    rows = exact_dedup.dedup(spark, docs, batches=3).collect()
    groups = defaultdict(list)
    for d, t, _ in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((len(t or ""), d))
    want = Counter()
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[0], m[1] is None, m[1] or 0))[1]
        for _, d in members:
            want[(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(map(tuple, rows)) == want
    kept = exact_dedup.kept_documents(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(spark, empty).count() == 0 and exact_dedup.kept_documents(spark, empty).count() == 0


def test_exact_dedup_across_snapshots(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 37).cast("string")).alias("text"))
    rows = exact_dedup.dedup(spark, docs, 4).collect()
    assert len(rows) == 400 and all(r["keep_id"] == r["doc_id"] % 37 and r["kept"] == (r["doc_id"] < 37) for r in rows)


def test_mixture_targets_by_hand():
    """Water is poured in small amounts, by weight, into sources that aren't full."""
    from fractions import Fraction

    sizes = [("b", 40), ("a", 300), ("d", 7), (None, 120), ("c", 0), ("é", 55)]
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(["a", "b", "c", "d", "é", None])}
    size = dict(sizes)
    left, level = Fraction(3 * sum(size.values()), 2), dict.fromkeys(size, Fraction(0))
    while left:
        open_ = [x for x in size if level[x] < 2 * size[x]]
        step = min([left / sum(weight[x] for x in open_), *((2 * size[x] - level[x]) / weight[x] for x in open_)])
        for x in open_:
            level[x] += step * weight[x]
            left -= step * weight[x]
    assert mixing.targets(sizes) == pytest.approx({x: float(v) for x, v in level.items()})


def test_empty_tables_and_clashing_columns(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int")
    assert toxicity.scores(spark, empty, labels).count() == 0
    for made in (toxicity.clean_documents(spark, empty, labels), mixing.copies(spark, empty)):
        assert made.columns == docs.columns and made.count() == 0
    assert toxicity.clean_documents(spark, docs, labels).columns == mixing.copies(spark, docs).columns == docs.columns
    assert spans.cleaned(spark, docs).count() == tokens.count_tokens(docs, WORD).count() == len(TEXTS)


def test_snapshots_open_again_and_checks_may_not_be_missing(spark):
    from medlark.llm.common import new_path, written

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    folder = new_path(spark, "snapshot-test")
    exact_dedup.Snapshot.write(spark, exact_dedup.classes(exact_dedup.digest_rows(docs.where("doc_id < 200"))), folder)
    known = exact_dedup.Snapshot.open(spark, folder)
    fresh = written(known.screened(exact_dedup.classes(exact_dedup.digest_rows(docs.where("doc_id >= 150")))), "t")
    assert fresh.count() == 150 and fresh.where("doc_id < 200 and not maybe").count() == 0 and fresh.where("doc_id >= 200 and maybe").count() < 10
    found = known.matches(fresh)
    assert {(r["new_id"], r["old_id"]) for r in found.collect()} == {(k, k) for k in range(150, 200)}
    assert {r["same"] for r in exact_dedup.same_bytes(docs, written(found, "t")).collect()} == {True}
    with pytest.raises(Exception, match="no texts to compare"):
        exact_dedup.same_bytes(docs.where("doc_id <> 160"), written(found, "t")).collect()


def test_bytes_are_compared_only_where_both_texts_are_there(spark):
    from medlark.llm.common import new_path, written

    docs = spark.createDataFrame([(1, "Same text."), (7, "Same  text."), (9, "Other.")], "doc_id long, text string")
    digest = exact_dedup.digest_rows(docs.where("doc_id = 7")).first()["digest"]
    found = written(spark.createDataFrame([(digest, 7, 1)], "digest string, new_id long, old_id long"), "t")
    assert exact_dedup.same_bytes(docs, found).first()["same"] is True
    for lost in (1, 7):
        with pytest.raises(Exception, match="no texts to compare"):
            exact_dedup.same_bytes(docs.where(f"doc_id <> {lost}"), found).collect()
    # a snapshot that keeps its texts is compared in a later session, when its documents are gone
    folder = new_path(spark, "snapshot-test")
    old = docs.where("doc_id <> 7")
    exact_dedup.Snapshot.write(spark, exact_dedup.classes(exact_dedup.digest_rows(old)), folder, old)
    known, now = exact_dedup.Snapshot.open(spark, folder), docs.where("doc_id = 7")
    positives = written(known.matches(written(known.screened(exact_dedup.classes(exact_dedup.digest_rows(now))), "t")), "t")
    assert [tuple(r) for r in positives.collect()] == [(digest, 7, 1)] and exact_dedup.same_bytes(now, positives, known).first()["same"] is True
    with pytest.raises(Exception, match="no texts to compare"):
        exact_dedup.same_bytes(docs.where("doc_id = 1"), positives, known).collect()


def test_texts_of_one_digest_and_other_bytes_stay_apart(spark, monkeypatch):
    part = spark.range(60).select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("p")).collect()
    a, b = (next(r["id"] for r in part if r["p"] == p) for p in (0, 1))
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.sha2(F.substring(norm, 1, 3), 256))
    got = {r["doc_id"]: r for r in exact_dedup.dedup(spark, spark.createDataFrame([(a, "abc one"), (b, "abc other")], "doc_id long, text string")).collect()}
    assert {d: (r["keep_id"], r["group_size"], r["kept"]) for d, r in got.items()} == {a: (a, 1, True), b: (b, 1, True)}
    same = {r["doc_id"]: r for r in exact_dedup.dedup(spark, spark.createDataFrame([(a, "abc one"), (b, "abc  one ")], "doc_id long, text string")).collect()}
    assert {d: (r["keep_id"], r["group_size"]) for d, r in same.items()} == {a: (b, 2), b: (b, 2)}


def test_many_rows_of_one_document_are_dealt_over_buckets(spark, monkeypatch):
    """By hand: sizes, targets and words near them, when one doc_id has nearly all rows."""
    rows = [(7, " ".join(["w"] * (1 + k % 9)) + f" x{k}", "a") for k in range(600)] + [(k, "one two three", "b") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BUCKET", 50)
    got = mixing.mixture(spark, table).collect()
    sizes = Counter(s for _, t, s in rows for _ in t.split())
    assert Counter(r["size"] for r in got) == Counter(len(t.split()) for _, t, _ in rows)
    goal = {r["source_size"]: r["target"] for r in got}
    # a has weight 5 and b 2 of 7 parts of 150 %, at most twice their sizes
    both, want = 1.5 * sum(sizes.values()), {}
    want["a"] = min(2 * sizes["a"], both * 5 / 7)
    want["b"] = min(2 * sizes["b"], both - want["a"])
    want["a"] = min(2 * sizes["a"], both - want["b"])
    assert goal == pytest.approx({sizes[s]: want[s] for s in sizes})
    for s in sizes:
        taken = [r for r in got if r["source_size"] == sizes[s]]
        assert abs(sum(r["taken"] for r in taken) - want[s]) <= max(r["size"] for r in taken)
        assert all(r["taken"] in {c * r["size"] for c in (0, 1, 2)} for r in taken)


def test_spans(spark, docs, empty):
    passage = " ".join(f"Sentence number {i} of a passage that is shared." for i in range(9))
    rows = [(d, t) for d, t, _ in TEXTS] + [(50, f"Own start one. {passage} Own end one."), (51, f"A different start. {passage} Another end."), (52, passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in spans.cleaned(spark, table).collect():
        got[r["doc_id"]].append(r)
    # by brute force: every run of sentences as text, from their definition
    plain = lambda p: re.findall(r"[^\W_]+", p.lower())
    occurrences, pieces = defaultdict(set), {}
    for d, t in set(rows):
        key = spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t").alias("k")).first()["k"]
        pieces[(d, t)] = parts = spans.sentences(t or "")
        assert "".join(parts) == (t or "") and not any(re.search(r"[.!?\n][\W_]*[^\W_]", p[re.search(r"[^\W_]|$", p).start() :]) for p in parts)
        words = [plain(p) for p in parts]
        count = lambda i, j: sum(map(len, words[i:j]))  # noqa: B023, E731
        n = len(parts)
        found = {(i, next((j for j in range(i + 2, n + 1) if count(i, j) >= 20), 0)) for i in range(n)} | {(next((i for i in range(j - 2, -1, -1) if count(i, j) >= 20), -1), j) for j in range(n + 1)}
        found = {(i, j) for i, j in found if 0 <= i < j} or ({(0, n)} if n and count(0, n) >= 20 else set())
        for i, j in found:
            occurrences[" ".join(w for p in words[i:j] for w in p)].add(((d is not None, d or 0, key, i), d, t, i, j))
    gone = defaultdict(set)
    for found in occurrences.values():
        for _, d, t, i, j in sorted(found, key=lambda f: f[0])[1:]:
            gone[(d, t)].update(range(i, j))
    for d, t in rows:
        r = next(x for x in got[d] if True)
        left = t if t is None else "".join(p for k, p in enumerate(pieces[(d, t)]) if k not in gone[(d, t)])
        assert r["text"] == left and r["n_removed"] == len(gone[(d, t)])
        assert t is None or left == "".join(t[x:y] for x, y in zip([0, *[c["end"] for c in r["removed"]]], [*[c["start"] for c in r["removed"]], len(t)], strict=True))
    assert got[51][0]["text"].strip() == "A different start. Another end." and got[50][0]["n_removed"] == 0 and got[52][0]["text"] == ""
    assert len(got[12]) == 2 and spans.cleaned(spark, empty).count() == 0


@pytest.mark.parametrize("stops", [True, False])
def test_spans_find_passages_of_over_50_words_anywhere(spark, stops):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) + (r.choice([".", "", "", "", "", "", ",", ""]) if stops else "")
    prose = lambda n: [word() for _ in range(n)]
    rows, planted = [], {}
    for k in range(200):
        passage = prose(r.randint(51, 70))
        for d in (2 * k, 2 * k + 1):
            own = prose(r.randint(60, 200))
            at = r.randint(0, len(own))
            before = " ".join(own[:at]) + " " * (at > 0)
            rows.append((d, before + " ".join([*passage, *own[at:]])))
            planted[d] = (len(before), len(before) + len(" ".join(passage)))
    rows += [(1000 + k, " ".join(prose(150))) for k in range(100)]
    got = {x["doc_id"]: x for x in spans.cleaned(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[d]["n_removed"] for d in got if d >= 1000 or d % 2 == 0)
    later = [d for d in planted if d % 2]
    assert sum(got[d]["n_removed"] > 0 for d in later) / len(later) > 0.97
    share = [sum(min(c["end"], planted[d][1]) - max(c["start"], planted[d][0]) for c in got[d]["removed"]) / (planted[d][1] - planted[d][0]) for d in later]
    assert sum(share) / len(share) > 0.75 and all(c["start"] >= planted[d][0] - 1 and c["end"] <= planted[d][1] + 1 for d in later for c in got[d]["removed"])


def test_near_duplicates(spark, docs, empty):
    rows = order_minhash.classes(spark, docs).collect()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["class_id"], r["class_size"]))
    assert by[6] == by[7] == by[8] == {(6, 3)} and by[12] == {(12, 2)} and by[2] == {(2, 1)} and by[3] == {(3, 1)} and by[13] == by[1] == by[4] == {(1, 3)}
    assert len(rows) == len(TEXTS) and by[None] == {(None, 1)}
    kept = order_minhash.kept_documents(spark, docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 9, 11, 12]
    assert order_minhash.classes(spark, empty).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    import random

    r = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"{g}q{r.randint(0, 400)}" for _ in range(r.randint(30, 160))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _classes_by_hand([t for _, t in rows])


def _likeness_by_hand(a: list, b: list) -> float:
    """Longest common subsequence of five-word runs over all runs of both, by the textbook."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def _classes_by_hand(texts: list[str]) -> dict[int, int]:
    """Index -> smallest index of its class, over all pairs of texts."""
    w = [re.findall(r"\w+", t.lower()) for t in texts]
    s = [[tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))] for x in w]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if min(len(s[i]), len(s[j])) >= 0.8 * max(len(s[i]), len(s[j])) and len(set(s[i]) & set(s[j])) >= 0.6 * max(len(set(s[i])), len(set(s[j]))) and _likeness_by_hand(s[i], s[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_in_a_large_group(spark):
    """One group of several hundred edited copies, most pairs of which are below 0.8, in the same buckets."""
    import random

    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[r.randrange(100)] = f"e{r.randint(0, 10**6)}"
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = _classes_by_hand(texts)
    lost = sum(got[i] != want[i] for i in want)
    assert all(want[got[i]] == want[i] for i in want) and lost <= 0.02 * len(want)


def _tail(name: str, n: int) -> str:
    return " ".join(f"{name}x{i}" for i in range(n))


#: 174 shingles that all texts of a family have, in the same buckets. Two texts with 22 own shingles are alike if they share 2 more.
TEMPLATE = _tail("t", 178)


def test_near_duplicates_of_a_template_family(spark):
    rows = [(2 * c + k, f"{TEMPLATE} {_tail(f'c{c}', 2)} {_tail(f'd{c}e{k}', 22)}") for c in range(60) for k in range(2)]
    h = order_minhash.Hasher()
    s = [order_minhash.shingles(h.words(t)) for _, t in rows]
    assert all((order_minhash.aligned(s[i], s[j]) >= 0.8) == (i // 2 == j // 2) for i in range(len(s)) for j in range(i))
    got = {x["doc_id"]: (x["class_id"], x["class_size"]) for x in order_minhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (d - d % 2, 2) for d, _ in rows}


def test_near_duplicates_joined_by_one_link(spark):
    rows = []
    for f in range(8):  # families of two groups, joined by one pair
        template = _tail(f"t{f}", 178)
        rows += [(1000 * f + 100 * g + k, f"{template} {_tail(f'c{f}g{g}', 2)} {_tail(f'd{f}g{g}e{k}', 22)}") for g in range(2) for k in range(1, 20)]
        rows += [(1000 * f + 100 * g, f"{_tail(f'p{f}', 2)} {template} {_tail(f'c{f}g{g}', 2)} {_tail(f'd{f}g{g}e0', 20)}") for g in range(2)]
    h = order_minhash.Hasher()
    s = {d: order_minhash.shingles(h.words(t)) for d, t in rows}
    assert [(a, b) for a in range(20) for b in range(100, 120) if order_minhash.aligned(s[a], s[b]) >= 0.8] == [(0, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["class_id"], x["class_size"]) for x in order_minhash.classes(spark, docs).collect()} == {(1000 * f, 40) for f in range(8)}


def test_near_duplicates_of_few_shingles(spark):
    rows = [(2 * c + k, _tail(f"s{c}", 9 - k)) for c in range(1500) for k in range(2)]
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["uid"]: r["component"] for r in order_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)}


def test_packing(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 5)
    monkeypatch.setattr(packing, "FAN", 2)
    rows = packing.pack(spark, docs, BYTE).collect()
    library, want = Tokenizer.from_file(BYTE), Counter()
    for d, t, _ in TEXTS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in by.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(spark, empty, BYTE).count() == 0


def test_toxicity_learns_held_out_documents(spark, monkeypatch):
    import random

    r = random.Random(2)
    plain = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(r.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vile", "nasty", f"zorgq{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}"]))
        rows.append((i, " ".join(w), "x"))
        marks.append((i, int(toxic), 1))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "vile nasty vile", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.scores(spark, docs, labels).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 900]
    assert sum(x["predicted"] == int(x["doc_id"] % 6 == 0) for x in held) / len(held) > 0.95
    assert all(not x["predicted"] for x in got if x["doc_id"] in (1000, 1001))
    clean = toxicity.clean_documents(spark, docs, labels)
    assert clean.columns == docs.columns and 700 < clean.count() < 790
    # a model too large to be sent along gives the same through joins
    monkeypatch.setattr(toxicity, "BROADCAST_TERMS", 0)
    large = toxicity.scores(spark, docs, labels, segments=True).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 9), r["predicted"], r["significant"])
    assert sorted(map(key, large)) == sorted(map(key, got)) and any(r["segments"] for r in large)


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.scores(spark, docs, none).collect()} == {0}
    assert toxicity.scores(spark, empty, none).count() == 0


def test_toxicity_model_by_brute_force(spark):
    import math
    import random

    r = random.Random(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        w = [r.choice(vocabulary[: 120 + 80 * (i % 5 != 0)]) for _ in range(r.randint(5, 60))] + ["foul"] * (i % 5 == 0 or i % 50 == 1) + ["calm"] * (i % 5 != 0 or i % 20 == 0)
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(spark, docs, labels)
    train = {(t, y): 1 for (d, t), (_, y) in zip(rows, marks, strict=True) if zlib.crc32(str(d).encode()) % 4 != 2}
    n = Counter(y for _, y in train)
    seen = {y: Counter(w for t, z in train if z == y for w in set(t.split())) for y in (0, 1)}
    for w in {*seen[0], *seen[1]}:
        y0, y1 = seen[0][w], seen[1][w]
        if y0 + y1 < toxicity.KNOWN:
            continue
        a0, a1 = (n[y] / (n[0] + n[1]) for y in (0, 1))
        delta = math.log((y1 + a1) / (n[1] + 1)) - math.log((y0 + a0) / (n[0] + 1))
        wide = 3 * math.sqrt(1 / (y1 + a1) + 1 / (y0 + a0))
        want = delta - wide if delta - wide >= 1 else max(delta + wide, -1.0) if delta + wide < -0.1 else 0.0
        assert model.score_of(w) == pytest.approx(want)
    assert any(s < 0 for s in model.terms.values()) and model.score_of("foul") > 1
    tokens_ = Counter(round(model.score_of(w), 3) or -model.drift for t, y in train if y == 0 for w in t.split())
    total = sum(tokens_.values())
    assert sum(c * s for s, c in tokens_.items()) < 0 and sum(c / total * math.exp(model.rate * s) for s, c in tokens_.items()) == pytest.approx(1, abs=0.01)
    segments = sum(len(model.document(t.split(), {})[2]) for t, y in train if y == 0)
    assert model.k == pytest.approx((segments + 1) / (total + 1))


def test_warc(spark):
    big = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://a", big), (2, None, big), (3, "u", big + "."), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (2, None, big), (8, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, payload int, KEY int")
    got = Counter(map(tuple, warc.archive_round_trip(spark, pages).collect()))
    want = Counter()
    for p, _, t in rows:
        b = (t or "").encode()
        again = b == big.encode() and p != 2
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 2 if again else None)] += 1
    assert got == want and warc.archive_round_trip(spark, pages.where("false")).count() == 0


def test_chunk_table(spark):
    from medlark.llm.common import new_path

    pages = spark.createDataFrame([(1, "u", "ab" * 100_000)], "page_id long, url string, html string")
    index = warc.write_archives(warc.with_decisions(pages), new_path(spark, "t"))
    chunks = warc.read_chunks(spark, index).orderBy("chunk").collect()
    assert len(chunks) == -(-200_000 // warc.CHUNK) and b"".join(c["data"] for c in chunks) == b"ab" * 100_000
    assert all(hashlib.sha1(b"".join(c["data"] for c in chunks[: k + 1])).hexdigest() == x["sha1"] for k, x in enumerate(chunks))


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
