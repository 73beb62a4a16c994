"""Units of the training-data operators: tokens, WARC, filters, segments, alignment, packing, rounding, Merkle trees."""

from __future__ import annotations

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from medlark.llm import exact_dedup, merkle, mixing, order_minhash, packing, spans, tokens, toxicity, warc

PIECES = ["a", "The", "the,", "Straße", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "é", "\xa0", "\x1c", "1", "23", "!?", "<|endoftext|>", "<|startoftext|>", "İ", "ß", "中文", "👍", "Σ", "\r\n", "x" * 70, "foo.\nBar", " "]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "space")])
def test_units_give_the_library_s_ids(name, kind):
    path = tokens.vocabulary(name)
    library, enc, r = Tokenizer.from_file(path), tokens.UnitEncoder(path, kind), random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", " ", "\n"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == e.ids, repr(t)
    assert enc.ids(None) == b""


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    enc = tokens.UnitEncoder(tokens.vocabulary("word_bpe_49k.json"), "word")
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    first = enc.ids(text)
    for _ in range(3):
        assert enc.ids(text) == first and len(enc) <= 50


@pytest.mark.parametrize("size", [0, 1, 999, 1000, warc.CHUNK - 1, warc.CHUNK, warc.CHUNK + 1, 3 * warc.CHUNK + 17])
def test_warc_record_round_trip(size):
    payload = bytes(random.Random(size).randbytes(size)) + b"\r\n\r\n" * (size > 10)
    data = b"".join(gzip.compress(b"".join(bytes(x) for x in warc._record(p, "http://x/ y", memoryview(payload), r))) for p, r in ((5, None), (4, 5), (None, None)))
    rows = list(warc.parse(io.BytesIO(data)))
    first = [x for x in rows if x["page_id"] == 5]
    assert b"".join(x["data"] for x in first) == payload and max(len(x["data"]) for x in first) <= warc.CHUNK
    assert [x["chunk"] for x in first] == list(range(len(first))) and [x["last"] for x in first].count(True) == 1 and first[-1]["last"]
    assert first[-1]["sha1"] == hashlib.sha1(payload).hexdigest()
    again = next(x for x in rows if x["page_id"] == 4)
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["sha1"]) == ("revisit", 5, len(payload), first[-1]["sha1"])
    assert rows[-1]["page_id"] is None


def test_warc_notices_damage():
    data = gzip.compress(b"".join(bytes(x) for x in warc._record(1, None, memoryview(b"hello"), None)).replace(b"hello", b"jello"))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(data)))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    part = exact_dedup.fuse_build(np.concatenate([keys, keys[:1]]))
    assert exact_dedup.fuse_has(part, keys).all()
    others = rng.integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64)
    assert exact_dedup.fuse_has(part, others).mean() < 0.01
    assert len(part["table"]) < 1.4 * n + 2000


def _segments_by_definition(values):
    """Maximal segments: split recursively around the best one (the definition of the linear-time method)."""
    if not values or max(values, default=0) <= 0:
        return []
    best, at = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    i, j = at
    return _segments_by_definition(values[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in _segments_by_definition(values[j:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1.03, 0.57, 0.21, 2.11, -0.83, -0.13]), max_size=24))
def test_maximal_segments(scores):
    hits = [(i, s) for i, s in enumerate(scores) if s]
    got = toxicity.maximal_segments(hits, drift=0.5)
    want = _segments_by_definition([s if s else -0.5 for s in scores])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_rate_of_the_law():
    import math

    drift, rate = toxicity._solve_rate([(1.5, 10), (-0.7, 100), (0.0, 890)])
    assert drift == toxicity.DRIFT and abs(0.01 * math.exp(1.5 * rate) + 0.1 * math.exp(-0.7 * rate) + 0.89 * math.exp(-drift * rate) - 1) < 1e-6
    drift, rate = toxicity._solve_rate([(2.0, 500), (0.0, 500)])  # the drift grows until the mean is negative
    assert drift == 3.2 and rate > 0
    assert toxicity._solve_rate([(0.0, 5)]) == (toxicity.DRIFT, 1.0)


def _lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
        p = q
    return p[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=80), st.lists(st.tuples(st.integers(0, 79), st.integers(0, 2), st.integers(0, 60)), max_size=8), st.integers(1, 40))
def test_banded_alignment_is_exact_above_the_threshold(a, edits, block):
    b = list(a)
    for at, kind, value in edits:
        at = min(at, len(b) - 1) if b else 0
        if kind == 0 and b:
            b.pop(at)
        elif kind == 1 and b:
            b[at] = value
        else:
            b.insert(at, value)
    assert order_minhash._banded(a, b, 10**6, block) == _lcs(a, b)
    if b:
        m = _lcs(a, b)
        want = m / (len(a) + len(b) - m)
        got = order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or abs(got - want) < 1e-12)


def test_order_minhash_heeds_order_and_occurrence():
    h = order_minhash.Hasher()
    words = [f"w{i}" for i in range(120)]
    a = order_minhash.sketch(order_minhash.shingles(h.words(" ".join(words))))
    b = order_minhash.sketch(order_minhash.shingles(h.words(" ".join(words[60:] + words[:60]))))
    c = order_minhash.sketch(order_minhash.shingles(h.words(" ".join([*words[:119], "other"]))))
    assert (a == c).sum() > (a == b).sum()
    twice = order_minhash.labelled(order_minhash.shingles(h.words("a b c d e " * 4)))
    assert len(set(twice.tolist())) == len(twice)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120), st.integers(0, 5))
def test_packing_keeps_pieces_and_room(size, seed):
    group = packing.evolve(64, size, np.random.default_rng(seed))
    again = packing.evolve(64, size, np.random.default_rng(seed + 1), group, [[40, 24], [10]])
    for bins in [*group, *again]:
        assert sorted(i for b in bins for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 64 for b in bins)
        assert sorted(packing._bins(packing._numbers(bins, len(size)))) == sorted(tuple(sorted(b)) for b in bins)
    bins = group[0]
    assert len(again[0]) <= len(bins)
    assert sorted(i for b in bins for i in b) == list(range(len(size)))
    assert all(sum(size[i] for i in b) <= 64 for b in bins) and len(bins) <= len(packing.best_fit(64, size, sorted(range(len(size)), key=lambda i: -size[i])))
    fit = packing.subset_fit(64, size)
    assert sorted(i for b in fit for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 64 for b in fit)


def _least_bins(room, size):
    """The fewest bins, by trying all ways."""
    best = [len(size)]

    def go(left, free):
        if len(free) >= best[0]:
            return
        if not left:
            best[0] = len(free)
            return
        n, tried = left[0], set()
        for k, f in enumerate(free):
            if f >= n and f not in tried:
                tried.add(f)
                go(left[1:], free[:k] + [f - n] + free[k + 1 :])
        go(left[1:], [*free, room - n])

    go(sorted(size, reverse=True), [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(8, 40), min_size=1, max_size=11), st.integers(0, 5))
def test_packing_finds_the_fewest_bins_of_few_pieces(size, seed):
    assert len(packing.evolve(64, size, np.random.default_rng(seed))[0]) == _least_bins(64, size)


def test_unfinished_islands_without_full_bins_go_on():
    import pandas as pd

    r = np.random.default_rng(1)
    size = r.integers(260, 340, 900)  # three in a bin, none of them full
    rows = pd.DataFrame({"uid": range(900), "doc_id": range(900), "piece": 0, "start": 0, "length": size, "ids_crc32": 0, "island": 3, "bin": None, "offset": None, "fill": None, "others": None, "pattern": None})
    one = packing._pack(1024, 1, 0, 0)(rows)
    elites = one[one["pattern"].notna()]
    own = one[one["pattern"].isna()]
    assert len(elites) == packing.ELITES and set(elites["island"]) == {3} and max(own["fill"]) <= 1024 and len(own) == 900
    two = packing._pack(1024, 1, 0, 1)(one)
    assert two["pattern"].isna().all() and two["bin"].nunique() <= own["bin"].nunique()


def test_crossover_and_migration():
    size = [40, 24, 30, 34, 20, 20, 24]
    child = packing.crossed(64, size, [(0, 4), (1, 2), (3, 5), (6,)], [(0, 1)])
    assert (0, 1) in child and sorted(i for b in child for i in b) == list(range(7))
    assert packing.after_patterns(64, size, [[40, 24], [40, 24], [30, 34]]) == [(0, 6), (2, 3)]


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, want):
    assert packing.cut(n, 1024) == want


def test_targets_fill_like_water():
    t = mixing.targets([("b", 100), ("a", 10), (None, 1000)])
    assert t["a"] == 20 and t["b"] == 200 and t[None] == pytest.approx(1.5 * 1110 - 220)
    assert mixing.targets([]) == {} and mixing.targets([("x", 0)]) == {"x": 0.0}


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 50, 400)
    part = np.full(400, 0.3)
    taken = np.zeros(400)
    for k in range(200):
        out, held = mixing.pivot(size, part, np.random.default_rng(k).random(400))
        fractional = np.flatnonzero((out > 0) & (out < 1))
        assert fractional.tolist() == ([] if held is None else [held])
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6 * size.sum() + 1e-3
        taken += out
    assert abs(taken.mean() / 200 - 0.3) < 0.01 and np.abs(taken / 200 - 0.3).max() < 0.2


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!\né\U0001f44d", max_size=300), st.text(alphabet="ab .!\n", max_size=200))
def test_merkle(a, b):
    for t in (a, b):
        assert "".join(merkle._TOKENS.findall(t)) == t
    fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
    assert (fa == fb) == (a == b) and (fa.split("|")[0] == fb.split("|")[0]) == (a == b)
    assert 0 <= merkle.likeness(fa, fb) <= 1 and merkle.likeness(fa, fa) == 1 and merkle.likeness(fa, fb) == merkle.likeness(fb, fa)
    known = merkle.Tokens()
    assert merkle.fingerprint(b, known) == fb and merkle.fingerprint(a, known) == fa and merkle.fingerprint(None) == merkle.fingerprint("")
    for start, end, other, other_end in merkle.differing(fa, fb):
        assert 0 <= start <= end <= len(a) and 0 <= other <= other_end <= len(b)
    assert (merkle.differing(fa, fb) == []) == (a == b)
    # what isn't told to differ is the same text in both, in order
    rest = lambda t, cuts: "".join(t[e:s] for e, s in zip([0, *[c[1] for c in cuts]], [*[c[0] for c in cuts], len(t)], strict=True))
    cuts = merkle.differing(fa, fb)
    assert rest(a, [c[:2] for c in cuts]) == rest(b, [c[2:] for c in cuts])


LINES = [f"Line {i} says {i * i}. And so on it goes.\n" for i in range(200)]


def test_merkle_levels_are_nested_and_few():
    for text in ("".join(LINES), "spam " * 5000, "x" * 9000, "one two. three"):
        tree = merkle.levels(merkle.Tokens().of(text))
        assert all(sum(n.tolist()) == len(text) for _, n in tree) and len(tree[-1][0]) == 1 and len(tree) < 40
        for (_, fine), (_, coarse) in zip(tree, tree[1:], strict=False):
            assert set(np.cumsum(coarse).tolist()) <= set(np.cumsum(fine).tolist()) and len(coarse) <= len(fine)
        kept = merkle.Tree.parse(merkle.fingerprint(text))
        assert str(kept) == merkle.fingerprint(text) and kept.size == len(text) and all(len(level) <= merkle.NODES for level in kept.levels)


def test_merkle_locates_an_edit():
    text = "".join(LINES)
    changed = text.replace("Line 120 says", "Line 120 SAYS")
    where = merkle.differing(merkle.fingerprint(text), merkle.fingerprint(changed))
    assert len(where) == 1 and where[0][0] <= text.index("Line 120 says") + 9 < where[0][1] and where[0][:2] == where[0][2:] and where[0][1] - where[0][0] < len(text) / 8
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed)) > 0.85


def test_merkle_locates_moved_and_repeated_paragraphs():
    paragraphs = ["".join(LINES[10 * k : 10 * k + 10]) + "\n" for k in range(12)]
    plain = "".join(paragraphs)
    moved = "".join([*paragraphs[:3], paragraphs[7], *paragraphs[3:7], *paragraphs[8:]])
    twice = "".join([*paragraphs[:5], paragraphs[4], *paragraphs[5:]])
    f = merkle.fingerprint(plain)
    for text in (moved, twice):
        g = merkle.fingerprint(text)
        for cuts in (merkle.differing(f, g), merkle.differing(g, f)):
            assert cuts and sum(e - s + x - o for s, e, o, x in cuts) < len(plain) / 2
    assert merkle.likeness(f, merkle.fingerprint(moved)) > 0.8


@pytest.mark.parametrize("words", [8, 30, 120, 700, 6000])
def test_likeness_is_near_the_share_that_stays(words):
    r, off = random.Random(words), []
    for _ in range(30):
        text, other = (" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", "", ".", ","]) for _ in range(words)) for _ in range(2))
        changed = merkle.edited(text, other)
        off.append(merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed)) - 0.75)
        assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) < 0.2
    assert -0.12 < sum(off) / len(off) <= 0.03 and min(off) > -0.35


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n\"é", max_size=300))
def test_sentences_are_the_text(t):
    assert "".join(spans.sentences(t)) == t


def test_runs_meet_a_passage_in_other_surroundings():
    passage = " ".join(f"Part {i} of the passage has seven words." for i in range(8))
    one = {tuple(r[2:]) for r in spans.runs(f"Some start here. {passage} An end of one.").tolist()}
    text = f"Quite another beginning! {passage} And what else?"
    covered = {k for i, j, *h in spans.runs(text).tolist() if tuple(h) in one for k in range(i, j)}
    assert "".join(p for k, p in enumerate(spans.sentences(text)) if k in covered).strip() == passage
    # case, white space and punctuation don't count, but the order of words does
    same = "some START here\n" + passage.upper().replace(" ", "  ") + " an end of one"
    assert {tuple(r[2:]) for r in spans.runs(same).tolist()} == one
    words = [f"w{i}" for i in range(25)]
    assert not {tuple(r[2:]) for r in spans.runs(" ".join(words)).tolist()} & {tuple(r[2:]) for r in spans.runs(" ".join(words[::-1])).tolist()}
    assert len(spans.runs("one two three")) == 0 and [r[:2] for r in spans.runs("same " * 30).tolist()] == [[0, len(spans.sentences("same " * 30))]]
