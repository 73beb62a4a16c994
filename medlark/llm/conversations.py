"""Repair of turn structure: the cheapest edits that make a conversation's roles read (s?(ua)+)?, by a rank-compressed DP.

Rows come by turn (null first), rows of one turn by the MD5 of role and text; a role or text that is null is one space. The
first fault of a row counts: blank (no character outside [\\x20\\x09-\\x0D]), duplicate (the same role and text earlier in the
conversation), truncated (the last such character isn't one of .!?). Edits and their costs are those of COSTS; a blank or
duplicate row must go. Of edits that cost the least, those whose initials are least in ASCII are taken.

The DP has a layer a row and a state a role that the output may end with. An edit of a layer is a macro: a run of insertions
and what happens to the row, D, IK, IIR and so on. No macro's code is the beginning of another's, so initials of whole audits
compare as their macros do, one by one, and a layer needs no strings: a state keeps its cost, the rank of its audit among the
layer's states and a pointer to its parent; audits are rebuilt from the pointers. Costs relative to the cheapest state are
bounded, so layers are few: each step is computed once a worker and looked up from then on.

A conversation may be of any length: its rows are cut into chunks in order, over as many tasks as range partitioning gives;
a chunk is summed up for every state it may begin with, the chunks of a conversation are met as these summaries, and each is
rebuilt by itself from the states that were chosen. Only the hash of the repaired text, which has no parts, passes a
conversation through one task, as a stream of sorted rows.

Nulls: a null conversation id is one conversation; null turns don't count for gaps. Equal rows: all but one are duplicates. A
conversation none of whose rows are left has zeros and empty results. Empty tables give empty results. Extra columns are
ignored. Gaps of more than a long holds are the largest long.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, remove, written

#: Of each edit, and of a truncated row that isn't deleted.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3, "truncated": 3}
#: Rows of a chunk at most.
CHUNK = 1 << 16
#: Blanks at the end of a text that don't count.
BLANKS = " \t\n\x0b\x0c\r"

ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, and the role that the output ends with. The output may end in the first and the last one.
STATES = ("", "s", "u", "a")
_NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
#: How far a state's cost may be above another's: whatever it goes on with, the other can too for so much more (at most three
#: insertions or a change of role), so one that is further above is in no cheapest audit.
SLACK = 9


def _step(state: str, made: str) -> str | None:
    return _NEXT.get((state, made))


@lru_cache(maxsize=None)
def macros(role: str, fault: str) -> list[tuple[int, int, str, int]]:
    """(state before, state after, code, cost) of all macros for a row: role is s, u, a or another, fault '' or b (must go) or t.

    Runs of more than two insertions come back to a state they left, at a cost."""
    out = []
    for k, start in enumerate(STATES):
        state, code, cost = start, "", 0
        for n in range(3):
            out.append((k, STATES.index(state), code + "D", cost + COSTS["D"]))
            if fault != "b":
                more = COSTS["truncated"] if fault == "t" else 0
                for letter, made in [("K", role), ("R", "u"), ("R", "a")]:
                    after = _step(state, made)
                    if after is not None:
                        out.append((k, STATES.index(after), code + letter, cost + COSTS[letter] + more))
            made = "a" if state == "u" else "u"
            state, code, cost = _step(state, made), code + "I", (n + 1) * COSTS["I"]
    return out


#: A layer: for each state its cost above the cheapest and the rank of its audit, or None where it can't be reached cheaply.
Layer = tuple


def first(state: int) -> Layer:
    return tuple((0, 0) if k == state else None for k in range(len(STATES)))


class Automaton:
    """Layers and steps that were met, by number; the same for all conversations of a worker."""

    def __init__(self):
        self.layers: list[Layer] = []
        self.number: dict[Layer, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int, tuple]] = {}

    def of(self, layer: Layer) -> int:
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer]

    def step(self, layer: int, symbol: int) -> tuple[int, int, tuple]:
        """(next layer, cost that it is above this one, for each state the parent's and the macro's code)."""
        got = self.steps.get((layer, symbol))
        if got is None:
            got = self.steps[(layer, symbol)] = self._made(self.layers[layer], symbol)
        return got

    def _made(self, layer: Layer, symbol: int):
        best: list = [None] * len(STATES)
        for before, after, code, cost in macros(*SYMBOLS[symbol]):
            if layer[before] is not None:
                found = (layer[before][0] + cost, layer[before][1], code, before)
                if best[after] is None or found < best[after]:
                    best[after] = found
        least = min(b[0] for b in best if b is not None)
        best = [b if b is not None and b[0] <= least + SLACK else None for b in best]
        order = sorted({(b[1], b[2]) for b in best if b is not None})
        made = tuple(None if b is None else (b[0] - least, order.index((b[1], b[2]))) for b in best)
        return self.of(made), least, tuple(None if b is None else (b[3], b[2]) for b in best)


#: What the DP sees of a row, as one byte: role s, u, a or another, and its fault.
SYMBOLS = [(r, f) for r in "sua?" for f in ("", "b", "t")]

_AUTOMATON = Automaton()


def summed(symbols: bytes) -> list[list[tuple[int, int] | None]]:
    """For each state to begin with, and each to end with, the cost and the rank of the audit."""
    auto, out = _AUTOMATON, []
    for state in range(len(STATES)):
        layer, total = auto.of(first(state)), 0
        for s in symbols:
            layer, cost, _ = auto.step(layer, s)
            total += cost
        out.append([None if x is None else (x[0] + total, x[1]) for x in auto.layers[layer]])
    return out


def rebuilt(symbols: bytes, begin: int, end: int) -> list[str]:
    """The macros' codes of the audit from state to state, by the parent pointers."""
    auto, layer, steps = _AUTOMATON, _AUTOMATON.of(first(begin)), []
    for s in symbols:
        layer, _, parents = auto.step(layer, s)
        steps.append(parents)
    codes, state = [], end
    for parents in reversed(steps):
        state, code = parents[state]
        codes.append(code)
    return codes[::-1]


#: Insertions at the very end that each state needs.
_TAILS = {"": 0, "s": 2, "u": 1, "a": 0}


def chosen(chunks: list[list[list[tuple[int, int] | None]]]) -> tuple[int, int, list[tuple[int, int]]]:
    """Of a conversation's summaries in order: its cost, insertions at the end, and the states each chunk begins and ends with."""
    now: list = [(0, 0), None, None, None]
    parents = []
    for table in chunks:
        best: list = [None] * len(STATES)
        for k, have in enumerate(now):
            for e, got in enumerate(table[k] if have is not None else ()):
                if got is not None:
                    found = (have[0] + got[0], have[1], got[1], k)
                    if best[e] is None or found < best[e]:
                        best[e] = found
        order = sorted({b[1:3] for b in best if b is not None})
        now = [None if b is None else (b[0], order.index(b[1:3])) for b in best]
        parents.append(best)
    cost, _, tail, state = min((x[0] + _TAILS[STATES[k]] * COSTS["I"], x[1], _TAILS[STATES[k]], k) for k, x in enumerate(now) if x is not None)
    path = []
    for best in reversed(parents):
        path.append((best[state][3], state))
        state = best[state][3]
    return cost, tail, path[::-1]


# --- Spark ------------------------------------------------------------------------------------------------------------

_LARGEST = (1 << 63) - 1
#: A row's place: conversation (null flag first, as ids come after nulls), turn, and the digest of role and text.
_KEY = ("cn", "c", "tn", "t", "digest")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with the faults that crc32(conv_id:turn) % 20 says; rows to drop have 0 copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    u = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = pick(rows, "conv_id", "turn", "role", "text").withColumn("u", u)
    new = F.when(F.col("u") == 1, "").when(F.col("u") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(F.col("u") == 4, "user").otherwise(text("role"))
    return rows.select("conv_id", "turn", role.alias("role"), new.alias("text"), F.when(F.col("u") == 0, 0).when(F.col("u") == 3, 2).otherwise(1).alias("copies"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their key: equal rows of a turn have the same one."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    value = lambda c: (F.col(c).isNotNull().cast("int"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")))
    (cn, c), (tn, t) = value("conv_id"), value("turn")
    return rows.select(cn.alias("cn"), c.alias("c"), tn.alias("tn"), t.alias("t"), digest.alias("digest"), "role", "text", "copies")


def _lean(rows: DataFrame) -> DataFrame:
    """Of placed rows, a row a key without text: role initial, whether a new text, and the number of equal rows."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(2)
    role = F.substring("role", 1, 1)
    symbol = (F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3) * 3 + fault).cast("int")
    lean = rows.where("copies > 0").groupBy(*_KEY, symbol.alias("symbol")).agg(F.sum("copies").alias("copies"))
    # a text that stands in several turns is new in the first of them only
    turn = F.struct("tn", "t")
    several = lean.groupBy("cn", "c", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where("first != last").drop("last")
    known = lean.join(several, ["cn", "c", "digest"], "left")
    return known.select(*_KEY, "symbol", "copies", (F.col("first").isNull() | (F.col("first") == turn)).alias("new"))


_CHUNKS = "cn int, c long, part int, chunk long, symbols binary, rows array<struct<at: int, tn: int, t: long, digest: binary>>, table array<long>, facts array<long>"


def _chunked(lean: DataFrame) -> DataFrame:
    """Chunks of conversations in order, each with its summary: `rows` are those that may stay, with their places in `symbols`;
    facts are blank, duplicate, truncated and illegal ones, first and last role, and the turns: whether any, least, largest, how
    many."""

    def run(batches):
        part, chunk, conv = TaskContext.get().partitionId(), 0, None
        symbols, rows, counts, turns = bytearray(), [], [0, 0, 0, 0], [0, 0, 0, 0]

        def done():
            nonlocal chunk, symbols, rows, counts, turns
            roles = [s // 3 for s in (symbols[0], symbols[-1])]
            table = [v for row in summed(bytes(symbols)) for x in row for v in (x or (-1, -1))]
            out = {"cn": conv[0], "c": conv[1], "part": part, "chunk": chunk, "symbols": bytes(symbols), "rows": rows, "table": table, "facts": [*counts, *roles, *turns]}
            chunk, symbols, rows, counts, turns = chunk + 1, bytearray(), [], [0, 0, 0, 0], [0, 0, 0, 0]
            return out

        def all_chunks():
            nonlocal conv
            for b in batches:
                for cn, c, tn, t, digest, symbol, copies, new in zip(*[b.column(k).to_pylist() for k in (*_KEY, "symbol", "copies", "new")], strict=True):
                    if symbols and (cn, c) != conv:
                        yield done()
                    conv = (cn, c)
                    for k in range(copies):
                        if len(symbols) >= CHUNK:
                            yield done()
                        role, fault = divmod(symbol, 3)
                        if fault != 1 and (k or not new):
                            fault = 1
                            counts[1] += 1
                        elif fault:
                            counts[0 if fault == 1 else 2] += 1
                        if symbols:
                            counts[3] += not _legal(symbols[-1] // 3, role)
                        if tn and not (turns[0] and turns[2] == t):
                            turns[:] = [1, turns[1] if turns[0] else t, t, turns[3] + 1]
                        if fault != 1:
                            rows.append({"at": len(symbols), "tn": tn, "t": t, "digest": digest})
                        symbols.append(role * 3 + fault)
            if symbols:
                yield done()

        return _batches(all_chunks(), _CHUNKS_ARROW, 256)

    return lean.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, _CHUNKS)


def _legal(before: int, after: int) -> bool:
    return "sua?"[before] + "sua?"[after] in ("su", "ua", "au")


_ROWS_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("tn", pa.int32()), ("t", pa.int64()), ("digest", pa.binary())]))
_CHUNKS_ARROW = pa.schema([("cn", pa.int32()), ("c", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("symbols", pa.binary()), ("rows", _ROWS_ARROW), ("table", pa.list_(pa.int64())), ("facts", pa.list_(pa.int64()))])


def _batches(rows, schema: pa.Schema, most: int = 4096):
    """Rows as record batches of at most so many."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_CHOICE = "cn int, c long, part int, chunk long, begin int, end int, tail int, totals array<long>"
_CHOICE_ARROW = pa.schema([("cn", pa.int32()), ("c", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("tail", pa.int32()), ("totals", pa.list_(pa.int64()))])


def _choices(chunks: DataFrame) -> DataFrame:
    """The states of each chunk; a conversation's last one also has the insertions behind it, and its totals."""

    def conversation(parts):
        tables = [[[tuple(p["table"][8 * k + 2 * e : 8 * k + 2 * e + 2]) for e in range(4)] for k in range(4)] for p in parts]
        cost, tail, path = chosen([[[None if x == (-1, -1) else x for x in row] for row in t] for t in tables])
        counts, turns, last = [0, 0, 0, 0], None, None
        for p in parts:
            f = p["facts"]
            counts = [a + b for a, b in zip(counts, f, strict=False)]
            if last is not None:
                counts[3] += not _legal(last, f[4])
            last = f[5]
            if f[6]:
                turns = (turns[0], f[8], turns[2] + f[9] - (turns[1] == f[7])) if turns else (f[7], f[8], f[9])
        gaps = min(turns[1] - turns[0] + 1 - turns[2], _LARGEST) if turns else 0
        for k, (p, (begin, end)) in enumerate(zip(parts, path, strict=True)):
            final = k == len(parts) - 1
            yield {**{c: p[c] for c in ("cn", "c", "part", "chunk")}, "begin": begin, "end": end, "tail": tail if final else 0, "totals": [gaps, *counts, cost] if final else None}

    def run(batches):
        def all_rows():
            held = []
            for b in batches:
                for r in b.to_pylist():
                    if held and (r["cn"], r["c"]) != (held[0]["cn"], held[0]["c"]):
                        yield from conversation(held)
                        held = []
                    held.append(r)
            if held:
                yield from conversation(held)

        return _batches(all_rows(), _CHOICE_ARROW)

    small = chunks.select("cn", "c", "part", "chunk", "table", "facts")
    return small.repartition("cn", "c").sortWithinPartitions("cn", "c", "part", "chunk").mapInArrow(run, _CHOICE)


#: What the last pass merges, in the order of a conversation: kind 0 says that it exists, 1 what becomes of a row, 2 the row.
_STREAM = "cn int, c long, tn int, t long, digest binary, kind int, role string, text string, totals array<long>"
_STREAM_ARROW = pa.schema([("cn", pa.int32()), ("c", pa.int64()), ("tn", pa.int32()), ("t", pa.int64()), ("digest", pa.binary()), ("kind", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("totals", pa.list_(pa.int64()))])
#: Values of tn behind all turns: insertions at the end with the totals, and pieces of the audit.
_END, _AUDIT = 2, 3


def _decisions(chunks: DataFrame, choices: DataFrame) -> DataFrame:
    """For each row that stays: roles to insert ahead (in `text`) and its own role if it changes; for each chunk its piece of the
    audit; for each conversation what is inserted at its end and its totals."""

    def rows(r):
        base = {"cn": r["cn"], "c": r["c"], "kind": 1, "totals": None}
        codes, state, places = rebuilt(r["symbols"], r["begin"], r["end"]), STATES[r["begin"]], iter(r["rows"])
        known = next(places, None)
        for at, code in enumerate(codes):
            row = None
            if known is not None and known["at"] == at:
                row, known = known, next(places, None)
            ahead = ""
            for letter in code:
                made = "a" if state == "u" else "u"
                if letter == "I":
                    ahead, state = ahead + made, _step(state, made)
                elif letter == "R":
                    state = _step(state, made)
                elif letter == "K":
                    state = _step(state, SYMBOLS[r["symbols"][at]][0])
            if code[-1] != "D":
                yield {**base, "tn": row["tn"], "t": row["t"], "digest": row["digest"], "role": ROLES[state] if code[-1] == "R" else None, "text": ahead}
        if r["totals"] is not None:
            ahead = ""
            for _ in range(r["tail"]):
                state = "a" if state == "u" else "u"
                ahead += state
            yield {**base, "tn": _END, "t": 0, "digest": b"", "role": None, "text": ahead, "totals": r["totals"]}
        yield {**base, "tn": _AUDIT, "t": r["part"], "digest": r["chunk"].to_bytes(8), "role": None, "text": "".join(codes) + "I" * r["tail"]}

    def run(batches):
        return _batches((x for b in batches for r in b.to_pylist() for x in rows(r)), _STREAM_ARROW)

    met = chunks.select("cn", "c", "part", "chunk", "symbols", "rows").join(choices, ["cn", "c", "part", "chunk"])
    return met.mapInArrow(run, _STREAM)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired text. Rows are
    (conv_id, turn, role, text, copies); a row with 0 copies only says that its conversation exists."""
    placed = _placed(rows)
    chunks = written(_chunked(_lean(placed)), "chunks")
    decisions = written(_decisions(chunks, _choices(chunks)), "decisions")
    remove(spark, chunks)
    none = F.lit(None)
    exist = placed.groupBy("cn", "c").agg(F.lit(0).alias("tn")).select("cn", "c", F.lit(-1).alias("tn"), F.lit(0).cast("long").alias("t"), F.lit(b"").alias("digest"), F.lit(0).alias("kind"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("array<long>").alias("totals"))
    texts = placed.where("copies > 0").select(*_KEY, F.lit(2).alias("kind"), "role", "text", none.cast("array<long>").alias("totals"))
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in _NAMES], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        conv, wanted, lines, totals, audit, digest = None, None, 0, [0] * 6, [], hashlib.sha256()

        def put(*parts):
            nonlocal lines
            for p in parts:
                digest.update((b"\n" if lines else b"") + p.encode())
                lines += 1

        def done():
            return {"conv_id": conv[1] if conv[0] else None, **dict(zip(_NAMES, totals, strict=True)), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        def all_rows():
            nonlocal conv, wanted, lines, totals, audit, digest
            for b in batches:
                for cn, c, tn, t, key, kind, role, text, facts in zip(*[b.column(k).to_pylist() for k in b.schema.names], strict=True):
                    if (cn, c) != conv:
                        if conv is not None:
                            yield done()
                        conv, wanted, lines, totals, audit, digest = (cn, c), None, 0, [0] * 6, [], hashlib.sha256()
                    if kind == 1 and tn == _AUDIT:
                        audit.append(text)
                    elif kind == 1:
                        put(*[f"{ROLES[x]}:" for x in text])
                        wanted = (tn, t, key, role)
                        totals = totals if facts is None else facts
                    elif kind == 2 and wanted is not None and (tn, t, key) == wanted[:3]:
                        put(f"{wanted[3] or role}:{text}")
                        wanted = None
            if conv is not None:
                yield done()

        return _batches(all_rows(), schema, 256)

    stream = exist.unionByName(decisions).unionByName(texts)
    return stream.repartition("cn", "c").sortWithinPartitions("cn", "c", "tn", "t", "digest", "kind").mapInArrow(run, _RESULT)
