"""COPY blocks of a PostgreSQL dump. A plain dump is read by byte ranges: one pass over all of them finds where the blocks
begin and end, and a table's rows come from the ranges of its block only. A gzip dump can't be split, so a data source reads it
in one task: spark.read.format("copydump").option("table", ...).load(path).

Paths of plain dumps may be of any file system that pyarrow opens (file, hdfs, s3); all tasks have to reach them."""

from __future__ import annotations

import gzip
import io
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .delimited import SourceError

_START = re.compile(r"^COPY\s+(?:\w+\.)?\"?(\w+)\"?\s*\(([^)]*)\)\s+FROM\s+stdin;\s*$", re.IGNORECASE)
#: Single-letter escapes of the COPY text format.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", re.DOTALL)


def _unescaped(m: re.Match) -> str:
    c = m[1]
    if c[0] == "x" and len(c) > 1:
        return chr(int(c[1:], 16))
    if c[0] in "01234567":
        return chr(int(c, 8) & 0xFF)
    return ESCAPES.get(c, c)


def value(text: str) -> str | None:
    """A field: \\\\N is null; escapes only where there is a backslash."""
    if text == r"\N":
        return None
    return _ESCAPE.sub(_unescaped, text) if "\\" in text else text


def _lines(path: str):
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt", encoding="utf-8", newline="\n") as f:
        yield from (line.rstrip("\n") for line in f)


def _names(columns: str) -> list[str]:
    return [c.strip().strip('"').lower() for c in columns.split(",")]


def blocks(path: str, wanted: list[str]) -> dict[str, list[str]]:
    """Columns of the COPY blocks of some tables, in one pass up to the last of them."""
    left, out = set(wanted), {}
    for line in _lines(path):
        if (m := _START.match(line)) and m[1].lower() in left:
            out[m[1].lower()] = _names(m[2])
            left.discard(m[1].lower())
            if not left:
                return out
    raise SourceError(f"{path} has no COPY block of {', '.join(sorted(left))}")


def rows(path: str, chosen: dict[str, list[str]]):
    """(table, fields) of every row of the chosen tables' blocks, as they come."""
    table, seen, places, width = None, set(), [], 0
    for n, line in enumerate(_lines(path), 1):
        if table is not None:
            if line == r"\.":
                table = None
                continue
            fields = line.split("\t")
            if len(fields) != width:
                raise SourceError(f"line {n} has {len(fields)} fields, {table} has {width} columns")
            yield table, [value(fields[k]) for k in places]
        elif (m := _START.match(line)) and m[1].lower() in chosen:
            table = m[1].lower()
            if table in seen:
                raise SourceError(f"{table} has more than one COPY block")
            seen.add(table)
            there = _names(m[2])
            places, width = [there.index(c) for c in chosen[table]], len(there)
    if table is not None:
        raise SourceError(f"the COPY block of {table} doesn't end")


class CopyReader(DataSourceReader):
    def __init__(self, path: str, chosen: dict[str, list[str]], several: bool):
        self.path, self.chosen, self.several = path, chosen, several

    def partitions(self):
        return [InputPartition(self.path)]  # a gzip stream can't be split

    def read(self, partition):
        for table, fields in rows(partition.value, self.chosen):
            yield (table, fields) if self.several else tuple(fields)


class CopyDump(DataSource):
    """Options: path, and table with columns (a comma-separated choice), or tables: several in one pass, as rows of
    source_table and fields."""

    @classmethod
    def name(cls) -> str:
        return "copydump"

    def _chosen(self) -> dict[str, list[str]]:
        split = lambda x: [c.strip().lower() for c in x.split(",") if c.strip()]
        tables = split(self.options.get("tables", "")) or [self.options["table"].lower()]
        there = blocks(self.options["path"], tables)
        if "tables" not in self.options and (some := split(self.options.get("columns", ""))):
            if missing := set(some) - set(there[tables[0]]):
                raise SourceError(f"{tables[0]} lacks {sorted(missing)}")
            return {tables[0]: some}
        return there

    def schema(self) -> StructType:
        if "tables" in self.options:
            return StructType([StructField("source_table", StringType()), StructField("fields", ArrayType(StringType()))])
        return StructType([StructField(c, StringType()) for names in self._chosen().values() for c in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        if "tables" in self.options:
            return CopyReader(self.options["path"], self._chosen(), True)
        return CopyReader(self.options["path"], {self.options["table"].lower(): schema.names}, False)


#: Bytes of a range of a plain dump.
RANGE = 64 << 20


def _opened(path: str):
    """(file, size) of a path or URI, to be read at any place."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return io.BufferedReader(system.open_input_file(place), 1 << 20), system.get_file_info(place).size


def _lines_from(path: str, lo: int, hi: int):
    """(offset, line) of the lines that begin in a range of bytes; the one before its first byte's ends is another range's."""
    f, size = _opened(path)
    with f:
        at = lo
        if lo:
            f.seek(lo - 1)
            at = lo - 1 + len(f.readline())
        else:
            f.seek(0)
        while at < min(hi, size):
            line = f.readline()
            yield at, line.rstrip(b"\n")
            at += len(line)


def _spread(spark, lo: int, hi: int, read, schema: str):
    """Rows that read(lo, hi) gives, over ranges of bytes, each in a task."""
    n = max(1, -(-(hi - lo) // RANGE))
    step = RANGE

    def run(batches):
        import pandas as pd

        for b in batches:
            for k in b["id"]:
                held = []
                for row in read(lo + int(k) * step, min(hi, lo + (int(k) + 1) * step)):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    names = [c.split(" ")[0].strip("`") for c in schema.split(", ")]
    return spark.range(0, n, 1, n).mapInPandas(run, schema)


def extents(spark, path: str) -> dict[str, list[tuple[list[str], int, int]]]:
    """(columns, first byte, end) of each table's blocks, by one distributed pass. Few lines come to the driver: those that look
    like the begin or the end of a block; which of them are so follows from their order, as rows may look like either begin."""
    f, size = _opened(path)
    f.close()

    def look(lo: int, hi: int):
        for at, line in _lines_from(path, lo, hi):
            if line == b"\\.":
                yield at, at + 3, None, None
            elif line[:4].upper() == b"COPY" and (m := _START.match(line.decode("utf-8", "replace"))):
                yield at, at + len(line) + 1, m[1].lower(), m[2]

    out, block = {}, None
    for at, end, table, columns in sorted(_spread(spark, 0, size, look, "at long, next long, name string, columns string").collect()):
        if table is None and block is not None:
            out.setdefault(block[0], []).append((block[1], block[2], at))
            block = None
        elif table is not None and block is None:
            block = (table, _names(columns), end)
    if block is not None:
        raise SourceError(f"the COPY block of {block[0]} doesn't end")
    return out


def plain_tables(spark, path: str, columns: dict[str, list[str] | None]) -> dict:
    """`copy_tables` of a plain dump."""
    there, out = extents(spark, path), {}
    if missing := sorted(set(columns) - set(there)):
        raise SourceError(f"{path} has no COPY block of {', '.join(missing)}")
    for table, some in columns.items():
        if len(there[table]) > 1:
            raise SourceError(f"{table} has more than one COPY block")
        own, lo, hi = there[table][0]
        if lacking := set(some or ()) - set(own):
            raise SourceError(f"{table} lacks {sorted(lacking)}")
        chosen = some or own

        def read(a: int, b: int, own=own, chosen=chosen, table=table, lo=lo):
            # the byte before the block's first is the end of a line, so its first line is the range's own
            for at, line in _lines_from(path, a, b):
                fields = line.decode().split("\t")
                if len(fields) != len(own):
                    raise SourceError(f"the row at byte {at} has {len(fields)} fields, {table} has {len(own)} columns")
                yield [value(fields[own.index(c)]) for c in chosen]

        out[table] = _spread(spark, lo, hi, read, ", ".join(f"`{c}` string" for c in chosen)) if hi > lo else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in chosen))
    return out


def copy_table(spark, path: str, table: str, columns: list[str] | None = None):
    if not path.endswith(".gz"):
        return plain_tables(spark, path, {table.lower(): columns})[table.lower()]
    spark.dataSource.register(CopyDump)
    reader = spark.read.format("copydump").option("table", table)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def copy_tables(spark, path: str, columns: dict[str, list[str] | None]) -> dict:
    """Several tables of a dump (None: all columns). Of a gzip dump, with one pass over its rows: they are written by table to a
    folder of their own, from which each is read."""
    import uuid

    from pyspark.sql import functions as F

    from ..operators.graph import shared_dir

    if not path.endswith(".gz"):
        return plain_tables(spark, path, columns)
    spark.dataSource.register(CopyDump)
    there = blocks(path, list(columns))
    for table, some in columns.items():
        if missing := set(some or ()) - set(there[table]):
            raise SourceError(f"{table} lacks {sorted(missing)}")
    folder = f"{shared_dir(spark).rstrip('/')}/dump-{uuid.uuid4().hex}"
    spark.read.format("copydump").option("tables", ",".join(columns)).load(path).write.partitionBy("source_table").parquet(folder)
    every = spark.read.schema("fields array<string>, source_table string").parquet(folder)
    return {t: every.where(F.col("source_table") == t).select(*[F.col("fields")[there[t].index(c)].alias(c) for c in some or there[t]]) for t, some in columns.items()}


def rxnorm_names(spark, path: str):
    """(rxcui, struct_id) of identifiers whose type says RxNorm, out of the dump's identifier and id_type blocks."""
    from pyspark.sql import functions as F

    both = copy_tables(spark, path, {"id_type": ["id", "type"], "identifier": ["identifier", "id_type", "struct_id"]})
    kinds, ids = both["id_type"].where(F.lower("type").like("%rxnorm%") | F.lower("type").like("%rxcui%")), both["identifier"]
    # dumps name the type by its id or by its name
    match = ids.join(kinds.select(F.explode(F.array("id", "type")).alias("id_type")).distinct(), "id_type")
    return match.select(F.col("identifier").alias("rxcui"), F.col("struct_id").cast("bigint").alias("struct_id")).distinct()
