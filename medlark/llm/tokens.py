"""Token counts and token ids of whole texts, in Arrow batches.

A text is cut at boundaries that no token of the vocabulary can cross, units are encoded by the tokenizers library, and
lengths or ids are put together again. Units that come again are kept in a bounded cache between batches, which are
balanced by bytes. Results equal those of encoding the whole text in one call.

Nulls count as empty texts. Rows are never merged, so repeated rows each give a row. Only the id and text columns are
read: extra columns, whatever their names, do no harm.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Units in a worker's cache; it is emptied when full.
CACHE_UNITS = 500_000
#: Longer units are encoded each time.
LONGEST_CACHED = 48
#: Bytes of text in one Arrow batch that we build.
OUT_BYTES = 2 << 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space beside white space, or at an end: units are then cut before spaces behind other characters only.
_RUN = re.compile(r"\s\s|^\s|\s$")
_BEFORE_RUN = re.compile(r"(?<=\S)(?= )")
#: Units that are one pre-token of letters, or two with marks behind, and that normalisation only puts in lower case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]{0,8})")
#: Runs of marks that are remembered.
MARKS = 2_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on, in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder(dict):
    """A cache from unit to little-endian unsigned 32-bit ids that encodes what it lacks.

    Plain units go to the library's BPE model itself, since what its normalizer and pre-tokenizer make of them is plain;
    all other units go through the whole library. A unit is kept when it is met a second time (a bit map of fixed size
    tells), so that units seen once don't crowd out the others.

    Kind "word": the pre-tokenizer drops white space; no token and no normalisation crosses ASCII white space, of which
    bytes.split() knows just the six characters. Keys are bytes.

    Kind "space": a byte-level vocabulary that keeps white space. A match of its pattern that holds a character other than
    white space holds at most one space, its first character; so a cut before a space is safe if the character on either
    side of that space isn't white space, and so is one on either side of a line end between other characters. Keys are
    what stands behind a space; kind "bare" has units with none before. Runs of white space stay whole."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.words = kind == "word"
        self.letters = _byte_letters()
        self.before = " " if kind == "space" else ""
        self.space = self.letters[0x20] if kind == "space" else ""
        self.bare = UnitEncoder(path, "bare") if kind == "space" else self
        self.met = bytearray(1 << 22)
        self.marks = {m: self._whole(m) if m else b"" for m in ("", *".,;:!?\n")}
        self.line_end = self.marks["\n"]

    def _whole(self, text: str) -> bytes:
        e = self.library.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.asarray(e.ids, dtype="<u4").tobytes()

    def __missing__(self, unit):
        words = self.words
        text = unit.decode("utf-8", "surrogatepass") if words else unit
        m = _PLAIN.fullmatch(text)
        if m is None:
            ids = self._whole(self.before + text)
        else:
            w, mark = m.groups()
            if words and not w.islower():
                ids = self[(w.lower() + mark).encode()]
            elif mark:
                behind = self.marks.get(mark)
                if behind is None:
                    behind = self._whole(mark)
                    if len(self.marks) < MARKS:
                        self.marks[mark] = behind
                ids = self[w.encode() if words else w] + behind
            else:
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [k.id for k in self.tokenize(self.space + w)]).tobytes()
        h = hash(unit) & 0x1FFFFFF
        byte, bit = h >> 3, 1 << (h & 7)
        if not self.met[byte] & bit:
            self.met[byte] |= bit
        elif len(unit) <= LONGEST_CACHED:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def _spaced(self, text: str) -> bytes:
        if _RUN.search(text):
            return b"".join([self[u[1:]] if u[0] == " " and u[1:2] != " " else self._whole(u) for u in _BEFORE_RUN.split(text)])
        look, bare, out = self.__getitem__, self.bare, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(bare[first])
            out += map(look, rest)
            out.append(self.line_end)
        return b"".join(out[:-1])

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each text, four bytes each."""
        if not self.words:
            return [self._spaced(t) if t else b"" for t in texts]
        look = self.__getitem__
        return [b"".join(map(look, t.encode("utf-8", "surrogatepass").split())) if t else b"" for t in texts]

    def ids(self, text: str | None) -> bytes:
        return self.batch([text])[0]


_ENCODERS: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, kind: str) -> UnitEncoder:
    """One encoder for each worker process and vocabulary."""
    key = (path, kind)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = UnitEncoder(path, kind)
    return _ENCODERS[key]


def _give_back() -> None:
    """Memory that is free goes back to the machine: workers wait for further tasks, beside others that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def balanced(batches: Iterator[pa.RecordBatch], text: str, limit: int = OUT_BYTES, encoding: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about `limit` bytes of text (a longer text stands alone). A worker that goes on to
    something other than encoding drops its encoders and their caches."""
    if not encoding and _ENCODERS:
        _ENCODERS.clear()
        _give_back()
    try:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0)).astype(np.int64)
            part = np.cumsum(sizes) // limit
            cuts = np.flatnonzero(np.diff(part)) + 1
            edges = [0, *cuts.tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield b.slice(lo, hi - lo)
    finally:
        _give_back()


def count_tokens(docs: DataFrame, path: str, kind: str = "word", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; lengths only leave the Arrow function. Null text: 0 and 0.
    A null id stays null. An empty table gives an empty result."""
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        enc = encoder(path, kind)
        for b in balanced(batches, "text", encoding=True):
            texts = b.column("text").to_pylist()
            lengths = np.fromiter((len(x) >> 2 for x in enc.batch(texts)), dtype=np.int64, count=len(texts))
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), sizes, pa.array(lengths)], names=["id", "n_bytes", "n_tokens"])

    kind_of = dict(source.dtypes)["id"]
    out = source.mapInArrow(count, f"id {kind_of}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))


def encode_ids(docs: DataFrame, path: str, kind: str, carry: list[str], text_col: str = "text", suffix: int | None = None, running: bool = False) -> DataFrame:
    """The carried columns and `ids`, an array<int> of each row's ids, with `suffix` as the last one if given. With
    `running`, also n_tokens and `before`: ids of all rows ahead in the partition."""
    fields = {f.name: f for f in docs.schema.fields}
    source = docs.select(*carry, F.col(text_col).cast("string").alias("_text"))
    end = b"" if suffix is None else np.array([suffix], dtype="<u4").tobytes()

    def run(batches):
        enc, before = encoder(path, kind), 0
        for b in balanced(batches, "_text", encoding=True):
            rows = [x + end for x in enc.batch(b.column("_text").to_pylist())]
            n = np.fromiter((len(x) >> 2 for x in rows), dtype=np.int64, count=len(rows))
            edges = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
            more = {"n_tokens": pa.array(n), "before": pa.array(before + edges[:-1])} if running else {}
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], *more.values(), ids], names=[*carry, *more, "ids"])
            before += int(edges[-1])

    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in carry)
    return source.mapInArrow(run, f"{schema}, {'n_tokens long, before long, ' if running else ''}ids array<int>")
