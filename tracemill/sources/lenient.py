"""The recovering reader of the testcase-preserving merge: typed rows, and problems as rows of their own."""

from __future__ import annotations

import gzip
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.functions.paths import PathRules
from tracemill.sources.inputs import file_sizes, filesystem_of, numbered_lines, packed
from tracemill.sources.lcov import MAX_LINE, SUMMARIES, U64_MAX

ROWS = ("input_id bigint, section bigint, ordinal bigint, source string, testcase string, family string, line decimal(20,0), stop decimal(20,0), block decimal(20,0), idx decimal(20,0), "
        "hits decimal(20,0), name string, kind string, unreachable boolean, checksum string, problem string, message string")
# fixed values: the record tags of this merge
FAMILIES = ("DA", "FN", "FNDA", "FNL", "FNA", "BRDA", "MCDC")
I64_MAX = 2**63 - 1
#: Bytes of input files that a task takes; a larger file is a task of its own.
TASK_BYTES = 32 << 20
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


class Problem(Exception):
    """A record that can't be taken as it is; ``zero`` tells that it counts as zero if the kind may be ignored."""

    def __init__(self, kind: str, message: str, zero: bool = False):
        super().__init__(message)
        self.kind, self.zero = kind, zero


def whole(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise Problem("format", "no whole number")
    text = text.lstrip("0") or "0"
    if len(text) > 20 or int(text) > U64_MAX:
        raise Problem("count", "a number beyond 64 bits")
    return int(text)


def count_of(text: str) -> int:
    digits = text.removeprefix("+")
    if digits.isascii() and digits.isdigit():
        digits = digits.lstrip("0") or "0"
        return min(int(digits[:20]), I64_MAX) if len(digits) < 20 else I64_MAX
    if not _FLOAT.fullmatch(text) or abs(number := float(text)) == float("inf"):
        raise Problem("format", "no count")
    if number < 0:
        raise Problem("negative", "a count below zero", zero=True)
    return min(int(number), I64_MAX)


def testcase_name(payload: str) -> str:
    name, _, suffix = payload.partition(",")
    clean = "".join(chr(b) if chr(b).isalnum() and b < 128 or b == 95 else "_" for b in name.encode())
    return clean + (",diff" if suffix.startswith("diff") else "")


def _positive(value: int, what: str, kind: str = "format") -> int:
    if not value:
        raise Problem(kind, f"{what} of zero")
    return value


def _fields(tag: str, payload: str, keep_sums: bool, counted) -> dict:
    """The columns of one record; ``counted`` parses a count and may turn a negative one into 0."""
    if tag == "DA":
        parts = payload.split(",")
        line = _positive(whole(parts[0]), "a line")
        hits = counted(parts[1] if len(parts) > 1 else "")
        if len(parts) > 3 or (len(parts) == 3 and (not parts[2] or any(c.isspace() for c in parts[2]))):
            raise Problem("format", "bad DA record")
        return {"line": line, "hits": hits, "checksum": parts[2] if keep_sums and len(parts) == 3 else None}
    if tag == "FN":
        parts = payload.split(",", 2)
        if len(parts) < 2:
            raise Problem("format", "bad FN record")
        if len(parts) == 3 and parts[1].isascii() and parts[1].isdigit():
            return {"line": whole(parts[0]), "stop": whole(parts[1]), "name": parts[2]}
        return {"line": whole(parts[0]), "name": ",".join(parts[1:])}
    if tag == "FNDA":
        text, comma, name = payload.partition(",")
        if not comma:
            raise Problem("format", "bad FNDA record")
        # a negative count drops the row and leaves the declaration without hits
        return {"hits": count_of(text), "name": name}
    if tag == "FNL":
        parts = payload.split(",")
        if len(parts) not in (2, 3):
            raise Problem("format", "bad FNL record")
        return {"idx": whole(parts[0]), "line": whole(parts[1]), "stop": whole(parts[2]) if len(parts) == 3 else None}
    if tag == "FNA":
        parts = payload.split(",", 2)
        if len(parts) < 3 or not parts[2]:
            raise Problem("format", "bad FNA record")
        return {"idx": whole(parts[0]), "hits": counted(parts[1]), "name": parts[2]}
    if tag == "BRDA":
        parts = payload.split(",", 2)
        expression, comma, count = (parts[2] if len(parts) == 3 else "").rpartition(",")
        if not comma or not expression:
            raise Problem("format", "bad BRDA record")
        line = _positive(whole(parts[0]), "a branch line", "branch")
        kind = parts[1][:1] if parts[1][:1] in ("e", "f") else "v"
        rest = parts[1][kind != "v":]
        return {"line": line, "block": whole(rest.removeprefix("U")), "kind": kind, "unreachable": rest.startswith("U"), "hits": None if count == "-" else counted(count), "name": expression}
    parts = payload.split(",", 5)
    if len(parts) < 6 or parts[2] not in ("t", "f") or not parts[5]:
        raise Problem("format", "bad MCDC record")
    line = _positive(whole(parts[0]), "a condition line")
    return {"line": line, "block": _positive(whole(parts[1].removeprefix("U")), "a condition group"), "kind": parts[2], "unreachable": parts[1].startswith("U"), "hits": counted(parts[3]), "idx": whole(parts[4]), "name": parts[5]}


_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def rows_of(lines: Iterable[bytes], input_id: int, rules: PathRules, families: frozenset[str], keep_sums: bool, forget: bool) -> Iterator[dict]:
    """Rows of one input as if every problem were ignored; each problem is a row with its kind, in order."""
    testcase = current = ""
    source, inside, section = None, False, 0
    for number, raw in enumerate(lines, 1):
        at = {"input_id": input_id, "section": section, "ordinal": number}

        def problem(kind: str, message: str, at=at) -> dict:
            return at | {"problem": kind, "message": message}

        if len(raw) > MAX_LINE + 1:
            yield problem("format", "a line of more than 1 MiB")
            continue
        try:
            line = raw.decode("utf-8").rstrip(" \t\n\x0b\x0c\r")
        except UnicodeDecodeError:
            yield problem("format", "a line that isn't UTF-8 text")
            continue
        if "\0" in line:
            yield problem("format", "a NUL byte")
            continue
        if not line or line.startswith("#"):
            continue
        tag, colon, payload = line.partition(":")
        if tag == "TN" and colon:
            if inside:
                yield problem("format", "a test name while a source is open")
            else:
                testcase = testcase_name(payload)
            continue
        if tag in ("SF", "KF") and colon:
            if inside:
                yield problem("format", "a source begins while another is still open")
            inside, section, source = True, section + 1, None
            current = "" if forget else testcase
            if not payload:
                yield problem("format", "a source without a path")
                continue
            rewritten = rules.rewrite(payload)
            if rules.selects(rewritten):
                source = rewritten
                yield at | {"section": section, "source": source, "testcase": current, "family": "SF"}
            continue
        if line.startswith("end_of_record"):
            if not inside:
                yield problem("format", "end_of_record with no open source")
            inside, source = False, None
            continue
        if not inside:
            yield problem("format", "a record before a source")
            continue
        if source is None or (tag in SUMMARIES and colon):
            continue
        own = at | {"source": source, "testcase": current, "family": tag}
        if tag == "VER" and colon:
            yield own | {"name": payload}
        elif tag not in FAMILIES or not colon:
            yield problem("format", "no record of a section")
        elif tag in families:
            negative = []

            def counted(text: str, negative=negative) -> int:
                try:
                    return count_of(text)
                except Problem as e:
                    if not e.zero:
                        raise
                    negative.append(str(e))
                    return 0

            try:
                fields = _fields(tag, payload, keep_sums, counted)
            except Problem as e:
                yield problem(e.kind, str(e))
                continue
            for message in negative:
                yield problem("negative", message)
            yield own | fields
    if inside:
        yield {"input_id": input_id, "section": section, "ordinal": 1 << 60, "problem": "format", "message": "the last section isn't closed"}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    wholes, longs = ("line", "stop", "block", "idx", "hits"), ("input_id", "section", "ordinal")
    kinds = {n: pa.int64() if n in longs else pa.bool_() if n == "unreachable" else pa.decimal128(20, 0) if n in wholes else pa.string() for n in _NAMES}
    while part := list(itertools.islice(rows, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], k) for n, k in kinds.items()], list(kinds))


def load_rows(spark: SparkSession, inputs: list[str], rules: PathRules, families: frozenset[str], keep_sums: bool = False, forget: bool = False) -> DataFrame:
    """Rows of all inputs; gzip by extension; an input named twice counts twice. Files must be visible to the executors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for group in part.column(0).to_pylist():
                for one in group:
                    filesystem, path = filesystem_of(one["path"])
                    with filesystem.open_input_file(path) as f:
                        stream = gzip.GzipFile(fileobj=f) if path.lower().endswith(".gz") else f
                        yield from _batches(rows_of((raw for _, raw in numbered_lines(stream, 0, None, MAX_LINE + 1)), one["input_id"], rules, families, keep_sums, forget))

    names = [n if "://" in n else os.path.abspath(n) for n in inputs]
    groups = [([(k, names[k]) for k in group],) for group in packed(file_sizes(names), TASK_BYTES)]
    tasks = spark.createDataFrame(groups, "files array<struct<input_id: bigint, path: string>>")
    return tasks.repartition(max(1, len(groups))).mapInArrow(read, ROWS)


def rows_from_table(df: DataFrame, rules: PathRules, families: frozenset[str], keep_sums: bool = False, forget: bool = False) -> DataFrame:
    """Rows of tracefiles held in a table with input_id and body; null bodies are empty files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            bodies = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            yield from _batches(row for input_id, body in bodies for row in rows_of((body or "").encode().split(b"\n"), input_id, rules, families, keep_sums, forget))

    return df.select(df["input_id"].cast("bigint"), df["body"]).mapInArrow(read, ROWS)
