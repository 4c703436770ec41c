"""A Spark data source for tracefiles: one row per parsed record.

What is sequential within a file (sections, pending test names, the current function line, the first error) is settled
where the file is read; rows leave in Arrow batches. Large files are read in ranges of lines, each primed with the few lines that
set the state it begins in; small ones share a task. Lines are streamed, so no file or section is held as a whole.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracemill.functions.paths import PathRules
from tracemill.sources.inputs import byte_ranges, file_sizes, filesystem_of, numbered_lines, packed

RECORDS = (
    "input_id bigint, origin_line bigint, path string, kind tinyint, a decimal(20,0), b decimal(20,0), c decimal(20,0), "
    "value decimal(20,0), text string, extra string, flags int, error string, note string"
)
# fixed values: record kinds and flag bits of the record table
TN, SECTION, GROUP, FN, FNDA, BRDA, MCDC, DA, EXT = range(1, 10)
NEW, NUMERIC, TEXT, DASH, EXCEPTION, FALLTHROUGH, UNREACHABLE, SENSE, MCDC_UNREACHABLE = 1, 1, 2, 4, 8, 16, 32, 64, 128
U64_MAX = 2**64 - 1
MAX_LINE = 1 << 20
RANGE_BYTES = 32 << 20
# fixed values: tags of summaries, which are made anew
SUMMARIES = frozenset(("FNF", "FNH", "LF", "LH", "BRF", "BRH", "MCF", "MCH"))


@dataclass
class TraceRange(InputPartition):
    """Ranges of files read by one task: (input_id, name, start, end, lines that set the state the range begins in)."""

    ranges: list[tuple[int, str, int, int, list[str]]]


def last_marks(lines: Iterator[tuple[int, bytes]]) -> tuple[bool, list[bytes]]:
    """Whether a section begins or ends in a range, and the lines that a reader of what follows has to have seen.

    Those are the last start of a section that is still open with its last FNL, or the last TN outside of one.
    """
    closed, marks = False, []
    for _, raw in lines:
        if raw[:1] in b"SKe" and raw.startswith((b"SF:", b"KF:", b"end_of_record")):
            joined = raw.removeprefix(b"end_of_record")
            closed, marks = True, [joined] if joined.startswith((b"SF:", b"KF:")) else []
        elif raw.startswith((b"FNL:", b"TN:")):
            marks = [m for m in marks if m[:3] != raw[:3]] + [raw]
    return closed, marks


def range_states(spark: SparkSession, ranges: list[tuple[int, str, int, int]]) -> dict[tuple[int, int], list[str]]:
    """(input_id, start) -> the lines that set the state of each range of large files; every range is scanned once, on the workers."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for input_id, name, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                filesystem, path = filesystem_of(name)
                with filesystem.open_input_file(path) as f:
                    closed, marks = last_marks(numbered_lines(f, start, end, MAX_LINE))
                yield pa.RecordBatch.from_arrays([pa.array([input_id], pa.int64()), pa.array([start], pa.int64()), pa.array([closed]), pa.array([[m.decode("utf-8", "replace") for m in marks]], pa.list_(pa.string()))], ["input_id", "start", "closed", "marks"])

    asked = spark.createDataFrame(ranges, "input_id bigint, name string, start bigint, stop bigint").repartition(len(ranges))
    states, before, current = {}, [], None
    for row in sorted(asked.mapInArrow(scan, "input_id bigint, start bigint, closed boolean, marks array<string>").collect()):
        if row.input_id != current:
            current, before = row.input_id, []
        states[row.input_id, row.start] = before
        tags = {m[:3] for m in row.marks}
        before = row.marks if row.closed else [m for m in before if m[:3] not in tags] + row.marks
    return states


class Malformed(Exception):
    """What is wrong with a record."""


def number(text: str | None) -> int:
    """ASCII digits up to 2^64-1, leading zeros allowed."""
    if text is None or not text.isascii() or not text.isdigit():
        raise Malformed
    if len(text) > 19:
        text = text.lstrip("0") or "0"
        if len(text) > 20 or int(text) > U64_MAX:
            raise Malformed
    return int(text)


class Section:
    """The rows of records within one section: (kind, a, b, c, value, text, extra, flags)."""

    def __init__(self, functions: bool = True, branches: bool = True):
        self.current: tuple[int, int, int] | None = None
        skipped = {*(("FN", "FNDA", "FNL", "FNA") if not functions else ()), *(("BRDA",) if not branches else ())}
        self.parsers = {tag: (self.skip if tag in skipped else getattr(self, tag.lower())) for tag in ("DA", "FN", "FNDA", "FNL", "FNA", "BRDA", "MCDC")}

    def skip(self, fields: str) -> tuple:
        return ()

    def da(self, fields: str) -> tuple:
        line, _, rest = fields.partition(",")
        count, _, checksum = rest.partition(",")
        return ((DA, number(line), 0, 0, number(count), "", checksum, 0),)

    def fnl(self, fields: str) -> tuple:
        index, start, end, *_ = *fields.split(","), None, None
        self.current = number(index), number(start), 0 if end is None else number(end)
        return ((GROUP, self.current[1], self.current[2], self.current[0], 0, "", "", NEW),)

    def fna(self, fields: str) -> tuple:
        index, count, name = (*fields.split(",", 2), None, None)[:3]
        at, hits = number(index), number(count)
        if name is None or self.current is None or self.current[0] != at:
            raise Malformed("FNA that doesn't follow its FNL")
        _, start, end = self.current
        return (GROUP, start, end, at, 0, "", "", NEW), (FN, start, end, at, hits, name, "", NEW)

    def fn(self, fields: str) -> tuple:
        start, *rest = fields.split(",", 2)
        if not rest:
            raise Malformed
        end, name = (number(rest[0]) if len(rest) == 2 else 0), rest[-1]
        line = number(start)
        return (GROUP, line, end, 0, 0, name, name, 0), (FN, line, end, 0, 0, name, name, 0)

    def fnda(self, fields: str) -> tuple:
        count, comma, name = fields.partition(",")
        if not comma:
            raise Malformed
        return ((FNDA, 0, 0, 0, number(count), name, name, 0),)

    def brda(self, fields: str) -> tuple:
        line, block, rest = (*fields.split(",", 2), "", "")[:3]
        branch, comma, count = rest.rpartition(",")
        if not comma:
            raise Malformed
        digits = block.lstrip("efU")
        marks = block[: len(block) - len(digits)]
        flags = EXCEPTION * ("e" in marks) | FALLTHROUGH * ("f" in marks) | UNREACHABLE * ("U" in marks)
        try:
            third, flags = number(branch), flags | NUMERIC
        except Malformed:
            third, flags = 0, flags | TEXT
        hits = 0 if count == "-" else number(count)
        return ((BRDA, number(line), number(digits), third, hits, branch, "", flags | DASH * (count == "-")),)

    def mcdc(self, fields: str) -> tuple:
        parts = fields.split(",", 5)
        if len(parts) < 6 or parts[2] not in ("t", "f"):
            raise Malformed
        line, group, sense, count, index, expression = parts
        flags = SENSE * (sense == "t") | MCDC_UNREACHABLE * group.startswith("U")
        return ((MCDC, number(line), number(group.removeprefix("U")), number(index), number(count), expression, "", flags),)


def lines_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The lines of a whole file with their positions."""
    at = 0
    for raw in data.split(b"\n"):
        yield at, raw
        at += len(raw) + 1


def tokenize(lines: Iterator[tuple[int, bytes]], input_id: int, rules: PathRules, functions: bool = True, branches: bool = True) -> Iterator[tuple]:
    """Record rows of numbered lines. The first error ends the file: its row has only an error.

    Rows of unselected sources are checked but not given. A row with only a note is a warning. ``origin_line`` is a byte position.
    """
    path = tn = None
    inside = keep = False
    cache: dict[str, tuple[str, bool]] = {}
    section = Section(functions, branches)
    blank = (None,) * 8

    for at, raw in lines:
        error = None
        if len(raw) > MAX_LINE + (raw[-1:] == b"\r"):
            yield (input_id, at, None, *blank, "a line of more than 1 MiB", None)
            return
        if raw[-1:] == b"\r":
            raw = raw[:-1]
        if not raw or raw[:1] == b"#":
            continue
        try:
            line = raw.decode("utf-8")
        except UnicodeDecodeError:
            line = "\0"
        if "\0" in line:
            yield (input_id, at, None, *blank, "a line that isn't UTF-8 text", None)
            return
        tag, colon, payload = line.partition(":")
        if line == "end_of_record":
            if not inside:
                yield (input_id, at, None, *blank, "end_of_record with no open source", None)
                return
            inside = False
            continue
        if inside and tag in ("end_of_recordSF", "end_of_recordKF") and colon:
            yield (input_id, at, path, *blank, None, "a section began on the line that ended the one before")
            inside, tag = False, tag[-2:]
        if tag in ("SF", "KF") and colon:
            if payload and payload not in cache:
                rewritten = rules.rewrite(payload)
                cache[payload] = (rewritten, bool(rewritten) and rules.selects(rewritten))
            path, keep = cache.get(payload, ("", False))
            if inside or not path:
                yield (input_id, at, None, *blank, "a source begins while another is still open" if inside else "a source without a path", None)
                return
            inside, section.current = True, None
            if keep:
                yield (input_id, at, path, TN, 0, 0, 0, 0, tn or "", "", 0, None, None)
                yield (input_id, at, path, SECTION, 0, 0, 0, 0, "", "", 0, None, None)
            tn = None
            continue
        if not inside:
            if tag == "TN" and colon and tn is None:
                tn = payload
                continue
            yield (input_id, at, None, *blank, "a second TN for the next source" if tag == "TN" and colon else "a record before a source", None)
            return
        parse = section.parsers.get(tag) if colon else None
        try:
            if parse is not None:
                rows = parse(payload)
                if keep and tag == "FNA" and rows and not rows[1][5]:
                    raise Malformed("FNA without a name")
            elif tag in SUMMARIES and colon:
                number(payload)
                continue
            elif not colon or not tag or tag == "TN":
                raise Malformed("no record of a section")
            else:
                rows = ((EXT, 0, 0, 0, 0, line, "", 0),)
                if keep and tag != "VER":
                    yield (input_id, at, path, *blank, None, f"kept an unknown record {tag}")
        except Malformed as e:
            error = str(e) or f"bad {tag} record"
        if error:
            yield (input_id, at, None, *blank, error, None)
            return
        if keep:
            for row in rows:
                yield (input_id, at, path, *row, None, None)


def _columns():
    import pyarrow as pa

    whole = pa.decimal128(20, 0)
    return [("input_id", pa.int64()), ("origin_line", pa.int64()), ("path", pa.string()), ("kind", pa.int8()), ("a", whole), ("b", whole), ("c", whole), ("value", whole),
            ("text", pa.string()), ("extra", pa.string()), ("flags", pa.int32()), ("error", pa.string()), ("note", pa.string())]


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = _columns()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


class LcovReader(DataSourceReader):
    def __init__(self, options: dict):
        self.names = json.loads(options["inputs"])
        self.piece = int(options.get("rangebytes", RANGE_BYTES))
        given = json.loads(options.get("rules", "{}"))
        self.rules = PathRules(tuple(map(tuple, given.get("rebases", ()))), given.get("strip"), tuple(given.get("includes", ())), tuple(given.get("excludes", ())))

        self.functions, self.branches = given.get("functions", True), given.get("branches", True)

        self.states = {(input_id, start): lines for input_id, start, lines in json.loads(options.get("states", "[]"))}

    def partitions(self) -> list[TraceRange]:
        sizes = file_sizes(self.names)
        found = []
        for group in packed(sizes, self.piece):
            if len(group) == 1:
                k = group[0]
                found += [TraceRange([(k, self.names[k], a, b, self.states.get((k, a), []))]) for a, b in byte_ranges(sizes[k], self.piece)]
            else:
                found.append(TraceRange([(k, self.names[k], 0, sizes[k], []) for k in group]))
        return found

    def read(self, partition: TraceRange) -> Iterator:
        rows: list[tuple] = []
        for input_id, name, start, end, state in partition.ranges:
            filesystem, path = filesystem_of(name)
            with filesystem.open_input_file(path) as f:
                # lines at position -1 only set the state
                lines = itertools.chain(((-1, x.encode()) for x in state), numbered_lines(f, start, end, MAX_LINE + 1))
                for row in tokenize(lines, input_id, self.rules, self.functions, self.branches):
                    if row[1] < 0:
                        continue
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield _batch(rows)
                        rows.clear()
        if rows:
            yield _batch(rows)


class LcovSource(DataSource):
    """Format ``lcov``; options ``inputs`` (a JSON list: a file named twice counts twice), ``rules``, ``rangeBytes`` and ``states`` (of ``range_states``)."""

    @classmethod
    def name(cls) -> str:
        return "lcov"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> LcovReader:
        return LcovReader(self.options)


def load_records(spark: SparkSession, names: list[str], rules: PathRules = PathRules(), functions: bool = True, branches: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records, errors and notes of the listed files; ``input_id`` is the place in the list. Executors must see the same files.

    Families that are switched off are skipped without a look at their fields.
    """
    if not names:
        return spark.createDataFrame([], RECORDS)
    spark.dataSource.register(LcovSource)
    names = [n if "://" in n else os.path.abspath(n) for n in names]
    large = [(k, names[k], a, b) for k, size in enumerate(file_sizes(names)) if size > range_bytes for a, b in byte_ranges(size, range_bytes)]
    states = [[*key, lines] for key, lines in range_states(spark, large).items() if lines] if large else []
    given = json.dumps({"rebases": rules.rebases, "strip": rules.strip, "includes": rules.includes, "excludes": rules.excludes, "functions": functions, "branches": branches})
    return spark.read.format("lcov").option("inputs", json.dumps(names)).option("rules", given).option("states", json.dumps(states)).option("rangeBytes", str(range_bytes)).load()


def records_from_table(df: DataFrame, id_col: str = "input_id", body_col: str = "body", rules: PathRules = PathRules(), functions: bool = True, branches: bool = True) -> DataFrame:
    """Records of tracefiles held in a column; null and empty bodies are empty files."""

    def parse(batches):
        for batch in batches:
            rows: list[tuple] = []
            for input_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.extend(tokenize(lines_of((body or "").encode("utf-8")), input_id, rules, functions, branches))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return df.select(df[id_col].cast("bigint"), df[body_col]).mapInArrow(parse, RECORDS)
