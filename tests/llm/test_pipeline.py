"""The pipeline over the smallest tables against a brute-force version, stage by stage and as a whole."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as CP
from medlark.llm import mixing, order_minhash, packing, tokens, toxicity
from medlark.llm.common import read_table, written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """(name, rows) after every stage."""
    docs, out = read_table(spark, FOLDER, "documents"), []
    out.append(("documents", docs.collect()))
    for name, stage in CP.STAGES:
        docs = written(stage(spark, docs, FOLDER), f"test-{name}")
        out.append((name, docs.collect()))
        if name != "packing":
            assert docs.columns == read_table(spark, FOLDER, "documents").columns
    return dict(out)


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_are_named():
    assert [n for n, _ in CP.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and CP.ORACLE_SQL is None


def test_toxicity(spark, kept):
    docs = read_table(spark, FOLDER, "documents")
    model = toxicity.learn(spark, docs, read_table(spark, FOLDER, "labels"))
    want = [r["doc_id"] for r in kept["documents"] if model.score(*model.document(toxicity.words(r["text"]), {})[:2]) < 0.3]
    assert ids(kept["toxicity"]) == sorted(want)


def test_exact_dedup(kept):
    groups = defaultdict(list)
    for r in kept["toxicity"]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert ids(kept["exact_dedup"]) == sorted(min(g)[1] for g in groups.values())


def test_near_dedup(kept):
    rows = sorted(kept["exact_dedup"], key=lambda r: r["doc_id"])
    h = order_minhash.Hasher()
    s = [order_minhash.shingles(h.words(r["text"] or "")) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if order_minhash.aligned(s[i], s[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert ids(kept["near_dedup"]) == sorted({rows[find(i)]["doc_id"] for i in range(len(rows))})


def test_mixing(kept):
    size, taken, words = Counter(), Counter(), {}
    for r in kept["near_dedup"]:
        words[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        size[r["source"]] += words[r["doc_id"]]
    copies = Counter(ids(kept["mixing"]))
    for r in kept["mixing"]:
        taken[r["source"]] += words[r["doc_id"]]
    target = mixing.targets(list(size.items()))
    longest = max(words.values())
    assert max(copies.values()) <= 2 and set(copies) <= set(words) and all(abs(taken[s] - target[s]) <= longest for s in size)
    full = {s for s in size if target[s] == 2 * size[s]}
    assert all(copies[r["doc_id"]] == 2 for r in kept["near_dedup"] if r["source"] in full and words[r["doc_id"]])


def test_packing(kept):
    library, want, by = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")), Counter(), defaultdict(list)
    for r in kept["mixing"]:
        own = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((r["doc_id"], k, s, n, zlib.crc32(own[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(own), 1024)))
    rows = kept["packing"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in by.values():
        ends = 0
        for offset, n in sorted(b):
            assert offset == ends
            ends += n
        assert ends <= 1024
    assert len(by) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 1


def test_run_is_the_chain(spark, kept):
    got = CP.run(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept["packing"])
