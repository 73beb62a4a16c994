"""Secret scans through nested encodings: a worklist of decoded layers, each scanned, each span mapped to the original text.

The base scan finds three kinds in a text, leftmost and non-overlapping by kind; a match that is too short is dropped after
it was found. Then layers are unwrapped until nothing new comes: percent escapes and Unicode escapes rewrite a whole layer
(so a key outside an escape and a value inside one still meet), base64 runs and compressed bytes (gzip, zlib, bzip2, xz,
zstandard) give a layer each. A layer whose content and place were seen before isn't taken up again, so archives that hold
themselves end. Every code point of a layer knows the code points of the original it came from; those of a compressed layer
come from all of it.

Nulls: a null text is empty, a null doc_id stays null. Repeated rows are scanned each. Empty tables give empty results.
Extra columns are ignored. A text is scanned whole, however long; what a compressed layer gives is held whole up to WHOLE
bytes, and read in windows cut behind a blank beyond that. Base64 that is broken over lines is read line by line.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .tokens import balanced

#: The kinds, in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex")
#: Characters that the value of an assignment, an access key and a hex run need.
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Bytes of a decompressed layer that are held whole; more are read in windows of so many.
WHOLE = 32 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~-]){12,}")
_UNICODE = re.compile(
    r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|[\\%]u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|&(quot|apos|amp|lt|gt);|([！-～])"
)
_WIDE = re.compile("[！-～]")
_ENTITIES = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">"}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PARTS = re.compile(r"[A-Za-z0-9]{16,}")
#: What compressed bytes begin with.
_MAGIC = (b"\x1f\x8b\x08", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00", b"(\xb5/\xfd")
_MAGIC_CHARS = re.compile("\x1f\x8b\x08|x[\x01\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\\(\xb5/\xfd")
_BLANK = re.compile(rb"[\t-\r ](?=[^\t-\r ]*\Z)")


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base scan of one text."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text, and for each of its code points the first and the end of the original ones that it came from."""

    def __init__(self, text: str, lo: np.ndarray, hi: np.ndarray, path: str = ""):
        self.text, self.lo, self.hi, self.path = text, lo, hi, path

    @classmethod
    def spread(cls, text: str, lo: int, hi: int, path: str) -> Layer:
        """All of it came from all of a span."""
        return cls(text, np.broadcast_to(np.int64(lo), (len(text),)), np.broadcast_to(np.int64(hi), (len(text),)), path)

    def named(self, step: str) -> str:
        return f"{self.path}>{step}" if self.path else step

    def rewritten(self, step: str, found: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
        """The layer with stretches replaced: (start, end, new text, first and end of each new code point in this layer)."""
        text, lo, hi, at = [], [], [], 0
        for a, b, new, first, last in found:
            text += [self.text[at:a], new]
            lo += [self.lo[at:a], self.lo[first]]
            hi += [self.hi[at:a], self.hi[last - 1]]
            at = b
        return Layer("".join([*text, self.text[at:]]), np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]]), self.named(step))

    def key(self) -> tuple[bytes, int, int]:
        n = len(self.text)
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(self.lo[0]) if n else 0, int(self.hi[-1]) if n else 0


def _sizes(text: str) -> np.ndarray:
    """UTF-8 bytes up to the end of each code point, with a 0 ahead."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])


def _urls(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    found = []
    for m in _URL.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            new = raw.decode()
            upto = _sizes(new)
        except UnicodeDecodeError:
            new, upto = raw.decode("latin-1"), np.arange(len(raw) + 1)
        found.append((m.start(), m.end(), new, m.start() + 3 * upto[:-1], m.start() + 3 * upto[1:]))
    if found:
        yield layer.rewritten("url", found)
    for m in _URL_BYTES.finditer(layer.text):
        if "%" in m[0]:
            raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0].encode())
            if raw.startswith(_MAGIC):
                yield from _unpacked(raw, int(layer.lo[m.start()]), int(layer.hi[m.end() - 1]), layer.named("url"))


def _unicodes(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if not ("\\" in text or "&" in text or "%u" in text or (not text.isascii() and _WIDE.search(text))):
        return
    found = []
    for m in _UNICODE.finditer(text):
        high, low, plain, long, braced, byte, hexed, number, name, wide = m.groups()
        if high:
            code = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00
        elif name:
            code = ord(_ENTITIES[name])
        elif wide:
            code = ord(wide) - 0xFEE0
        else:
            code = int(number) if number else int(plain or long or braced or byte or hexed, 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        found.append((m.start(), m.end(), chr(code), np.array([m.start()]), np.array([m.end()])))
    if found:
        yield layer.rewritten("unicode", found)


def _decoded(run: str) -> bytes | None:
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    return binascii.a2b_base64(plain + "=" * (-len(plain) % 4))


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text.translate({9: None, 10: None, 11: None, 12: None, 13: None}).isprintable() else None


def _base64s(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        for a, b in [m.span(), *((m.start() + p.start(), m.start() + p.end()) for p in _PARTS.finditer(m[0]) if p.span() != (0, len(m[0])))]:
            raw = _decoded(layer.text[a:b])
            if not raw:
                continue
            if raw.startswith(_MAGIC):
                yield from _unpacked(raw, int(layer.lo[a]), int(layer.hi[b - 1]), layer.named("base64"))
            text = _readable(raw)
            if text:
                upto = _sizes(text)
                first, last = a + upto[:-1] * 8 // 6, np.minimum(a - (-upto[1:] * 8 // 6), b)
                yield Layer(text, layer.lo[first], layer.hi[last - 1], layer.named("base64"))
                break  # the run is one text; its parts aren't runs of their own


def _compressed(layer: Layer) -> Iterator[Layer]:
    """Compressed bytes that stand in the text as characters below 256."""
    for m in _MAGIC_CHARS.finditer(layer.text):
        end = re.compile("[\x00-\xff]+").match(layer.text, m.start()).end()
        yield from _unpacked(layer.text[m.start() : end].encode("latin-1"), int(layer.lo[m.start()]), int(layer.hi[end - 1]), layer.path)


def _chunks(raw: bytes | io.RawIOBase) -> Iterator[bytes]:
    """What compressed bytes give, at most a megabyte at once; it ends where they are damaged."""
    step = 1 << 20
    if raw.startswith(_MAGIC[-1]):
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
        while got := reader.read(step):
            yield got
    elif raw.startswith((b"BZh", b"\xfd7zXZ")):
        d = bz2.BZ2Decompressor() if raw.startswith(b"BZh") else lzma.LZMADecompressor()
        got = d.decompress(raw, step)
        while got or not (d.eof or d.needs_input):
            yield got
            if d.eof:
                return
            got = d.decompress(b"", step)
    else:
        d = zlib.decompressobj(47)
        got = d.decompress(raw, step)
        while got:
            yield got
            got = b"" if d.eof else d.decompress(d.unconsumed_tail, step)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """All that compressed bytes give, in one piece up to WHOLE bytes, in pieces cut behind a blank beyond."""
    held, size = [], 0
    try:
        for c in _chunks(raw):
            held.append(c)
            size += len(c)
            if size >= WHOLE:
                whole = b"".join(held)
                cut = _BLANK.search(whole, size - (1 << 20))
                cut = cut.end() if cut else size
                yield whole[:cut]
                held, size = [whole[cut:]], size - cut
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass  # damaged: what came before counts
    if size:
        yield b"".join(held)


def _unpacked(raw: bytes, lo: int, hi: int, path: str) -> Iterator[Layer]:
    """The texts within compressed bytes, through any number of compressions."""
    work, seen = [(raw, path)], {hashlib.blake2b(raw, digest_size=16).digest()}
    while work:
        raw, path = work.pop()
        path = f"{path}>compressed" if path else "compressed"
        for piece in _pieces(raw):
            if piece.startswith(_MAGIC):
                digest = hashlib.blake2b(piece, digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    work.append((piece, path))
            yield Layer.spread(piece.decode("utf-8", "replace"), lo, hi, path)


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, path) of every secret, the base ones first (their path is empty); a span that several layers show
    is listed once, by the first of them."""
    found = {s: "" for s in find(text)}
    n = len(text)
    layer = Layer(text, np.arange(n), np.arange(1, n + 1))
    work, seen = [layer], {layer.key()}
    while work:
        layer = work.pop()
        for children in (_urls, _unicodes, _base64s, _compressed):
            for child in children(layer):
                if (key := child.key()) in seen:
                    continue
                seen.add(key)
                work.append(child)
                for kind, a, b in find(child.text):
                    found.setdefault((kind, int(child.lo[a:b].min()), int(child.hi[a:b].max())), child.path)
    return [(*s, path) for s, path in found.items()]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) of every row: an array of (kind, start, end, path), in code points of the text, end exclusive; path names
    the layers that were unwrapped, empty in the text itself."""
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])

    def run(batches):
        for b in balanced(batches, "text"):
            rows = [[dict(zip(("kind", "start", "end", "path"), s, strict=True)) for s in scan(t)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(item))], names=["id", "found"])

    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, found array<struct<kind: string, start: long, end: long, path: string>>")
    return out.withColumnRenamed("id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """Of secrets(): counts by kind of the base scan, the SHA-256 of its list of spans, all spans, and the number that only
    decoding shows."""
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])

    def listed(column):
        ordered = F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    base = F.filter("found", lambda s: s["path"] == "")
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_decoded"))
