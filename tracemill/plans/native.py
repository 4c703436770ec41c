"""The literal-key merge: records, merged records, summaries, and the rendered tracefile.

One grouping by the literal key merges all families at once. Texts that the merge has to choose between (checksums,
expressions, test names) are part of a first grouping, so that it stays a hash aggregation over fixed-width buffers and
combines before the shuffle; a second, much smaller grouping chooses among them.
"""

from __future__ import annotations

import os
import shutil
import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.numbers import NUMBER, saturated_sum
from tracemill.functions.paths import PathRules
from tracemill.session import clear_scratch, scratch_path
from tracemill.sources.inputs import check_regular, expand_lists, filesystem_of, numbered_lines, stage_stdin
from tracemill.sources.lcov import BRDA, DA, DASH, EXCEPTION, EXT, FALLTHROUGH, FN, FNDA, GROUP, MAX_LINE, MCDC, MCDC_UNREACHABLE, NEW, NUMERIC, SECTION, SENSE, TEXT, TN, UNREACHABLE, load_records

#: Copies of an extension row made at a time.
COPIES = 4096
SUMMARY_ORDER = ("fnf", "fnh", "brf", "brh", "mcf", "mch", "lf", "lh")


@dataclass(frozen=True)
class Options:
    """Settings of the merge; what only sizes a single machine's memory or threads has no counterpart here."""

    rules: PathRules = field(default_factory=PathRules)
    branches: bool = True
    functions: bool = True
    strict_checksum: bool = False
    warn_unknown: bool = False


class TraceError(Exception):
    """The first malformed record in the order of inputs and lines."""

    def __init__(self, message: str, input_id: int | None = None, pos: int | None = None):
        super().__init__(message)
        self.status, self.input_id, self.pos = 2, input_id, pos


def _zero() -> Column:
    return F.lit(0).cast(NUMBER)


def merge_records(records: DataFrame) -> DataFrame:
    """One row per literal key: path, kind, a, b, c, name, flags, and the merged measures.

    ``name`` is the textual part of a key (function name, textual branch, extension row). ``value`` is the saturating sum of counts, null
    where every branch count is ``-``; ``copies`` how many rows met (extension rows are kept that often; a column ``copies`` of the
    records says how many a row stands for); ``chosen`` and ``most`` are the least and the greatest in byte order of the texts that
    aren't part of the key (expressions, non-empty checksums, test names with '' as a name); ``conflict`` tells whether they differ.
    Rows with a null path belong to no source and are left out; null numbers count as 0, null texts as ''.
    """
    kind, flags = F.col("kind"), F.coalesce("flags", F.lit(0))
    text, extra = F.coalesce("text", F.lit("")), F.coalesce("extra", F.lit(""))
    numeric = (kind == BRDA) & (flags.bitwiseAND(NUMERIC) != 0)
    name = F.when(kind.isin(FN, FNDA, EXT) | ((kind == BRDA) & ~numeric), text).when((kind == GROUP) & (flags.bitwiseAND(NEW) == 0), extra).otherwise("")
    kept_bits = F.when(kind == BRDA, flags.bitwiseAND(NUMERIC + TEXT + EXCEPTION + FALLTHROUGH + UNREACHABLE)).when(kind == MCDC, flags.bitwiseAND(SENSE + MCDC_UNREACHABLE)).when(kind.isin(GROUP, FN), flags.bitwiseAND(NEW)).otherwise(0)
    chosen = F.when(kind.isin(TN, MCDC), text).when(kind == DA, extra).otherwise("")
    number = lambda c: F.coalesce(F.col(c), _zero()).cast(NUMBER)
    third = F.when((kind == BRDA) & ~numeric, _zero()).otherwise(number("c"))
    counted = F.when((kind == BRDA) & (flags.bitwiseAND(DASH) != 0), F.lit(None).cast(NUMBER)).otherwise(number("value"))
    keys = ["path", "kind", "a", "b", "c", "name", "flags"]
    rows = records.filter("path IS NOT NULL").select("path", kind, number("a").alias("a"), number("b").alias("b"), third.cast(NUMBER).alias("c"), name.alias("name"), kept_bits.cast("int").alias("flags"), chosen.alias("chosen"), counted.alias("value"), (F.col("copies") if "copies" in records.columns else F.lit(1)).alias("copies"))
    first = rows.groupBy(*keys, "chosen").agg(saturated_sum(F.col("value")).alias("value"), F.sum("copies").alias("copies"))
    full = F.when((kind != DA) | (F.col("chosen") != ""), F.col("chosen"))
    merged = first.groupBy(*keys).agg(saturated_sum(F.col("value")).alias("value"), F.sum("copies").alias("copies"), F.min(full).alias("least"), F.max(full).alias("most"))
    return merged.select(*keys, "value", "copies", F.coalesce("least", F.lit("")).alias("chosen"), F.coalesce("most", F.lit("")).alias("most"), F.coalesce(F.col("least") != F.col("most"), F.lit(False)).alias("conflict"))


def parse_counters(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """input_id, bytes, records, errors of every row of ``inputs`` (input_id, bytes); an input without records has none."""
    counted = records.groupBy("input_id").agg(F.count("kind").alias("records"), F.count("error").alias("errors"))
    return inputs.select("input_id", "bytes").join(counted, "input_id", "left").select("input_id", "bytes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "errors")])


def source_summaries(merged: DataFrame) -> DataFrame:
    """path and the eight summary counts; a function group and each function name with hits count towards ``fnh``."""
    kind, flags, hit = F.col("kind"), F.col("flags"), F.coalesce(F.col("value") > 0, F.lit(False))
    # aliases of a group collapse first; all other rows are groups of their own
    group_hit = (kind == FN) & (flags.bitwiseAND(NEW) != 0) & hit
    marked = merged.select("path", "kind", F.when(group_hit, F.struct("a", "b", "c")).alias("hit_group"), hit.alias("hit"),
                           (((kind == BRDA) & (flags.bitwiseAND(UNREACHABLE) == 0)) | ((kind == MCDC) & (flags.bitwiseAND(MCDC_UNREACHABLE) == 0))).alias("reachable"))
    groups = marked.filter("hit_group IS NOT NULL").select("path", "hit_group").distinct().groupBy("path").agg(F.count("*").alias("hit_groups"))
    count = lambda condition: F.count_if(condition)
    counts = marked.groupBy("path").agg(
        count(kind == GROUP).alias("fnf"), count((kind == FNDA) & F.col("hit")).alias("hit_names"),
        count((kind == BRDA) & F.col("reachable")).alias("brf"), count((kind == BRDA) & F.col("reachable") & F.col("hit")).alias("brh"),
        count((kind == MCDC) & F.col("reachable")).alias("mcf"), count((kind == MCDC) & F.col("reachable") & F.col("hit")).alias("mch"),
        count(kind == DA).alias("lf"), count((kind == DA) & F.col("hit")).alias("lh"))
    return counts.join(groups, "path", "left").select("path", "fnf", (F.col("hit_names") + F.coalesce("hit_groups", F.lit(0))).alias("fnh"), "brf", "brh", "mcf", "mch", "lf", "lh")


def grand_totals(summaries: DataFrame) -> DataFrame:
    return summaries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMARY_ORDER])


def rendered_lines(merged: DataFrame, summaries: DataFrame) -> DataFrame:
    """path, the sort columns and ``line``: every output line of every source, not yet ordered."""
    kind, flags = F.col("kind"), F.col("flags")
    s = lambda c: F.col(c).cast("string")
    bit = lambda b: flags.bitwiseAND(b) != 0
    new = kind.isin(GROUP, FN) & bit(NEW)
    end = F.when(F.col("b") != 0, F.concat(F.lit(","), s("b"))).otherwise("")
    count = F.coalesce(s("value"), F.lit("-"))
    line = (
        F.when(kind == TN, F.when(~F.col("conflict") & (F.col("chosen") != ""), F.concat(F.lit("TN:"), "chosen")))
        .when(kind == SECTION, F.concat(F.lit("SF:"), "path"))
        .when((kind == GROUP) & bit(NEW), F.concat(F.lit("FNL:"), s("c"), F.lit(","), s("a"), end))
        .when((kind == FN) & bit(NEW), F.concat(F.lit("FNA:"), s("c"), F.lit(","), s("value"), F.lit(","), "name"))
        .when(kind == FN, F.concat(F.lit("FN:"), s("a"), end, F.lit(","), "name"))
        .when(kind == FNDA, F.concat(F.lit("FNDA:"), s("value"), F.lit(","), "name"))
        .when(kind == BRDA, F.concat(F.lit("BRDA:"), s("a"), F.lit(","), F.when(bit(EXCEPTION), "e").otherwise(""), F.when(bit(FALLTHROUGH), "f").otherwise(""), F.when(bit(UNREACHABLE), "U").otherwise(""),
                                     s("b"), F.lit(","), F.when(bit(NUMERIC), s("c")).otherwise(F.col("name")), F.lit(","), count))
        .when(kind == MCDC, F.concat(F.lit("MCDC:"), s("a"), F.lit(","), F.when(bit(MCDC_UNREACHABLE), "U").otherwise(""), s("b"), F.lit(","), F.when(bit(SENSE), "t").otherwise("f"), F.lit(","), s("value"), F.lit(","), s("c"), F.lit(","), "chosen"))
        .when(kind == DA, F.concat(F.lit("DA:"), s("a"), F.lit(","), s("value"), F.when(F.col("chosen") != "", F.concat(F.lit(","), "chosen")).otherwise("")))
        .when(kind == EXT, F.col("name")))
    rank = F.when(kind == TN, 0).when(kind == SECTION, 1).when(new, 3).when(kind.isin(GROUP, FN), 4).when(kind == FNDA, 5).when(kind == DA, 6).when(kind == BRDA, 7).when(kind == MCDC, 8).otherwise(9)
    body = merged.select("path", rank.alias("rank"), "a", "b", F.when(kind == BRDA, F.when(bit(NUMERIC), 0).otherwise(1).cast(NUMBER)).otherwise(F.col("c")).alias("k1"),
                         F.when(kind == BRDA, F.col("c")).when((kind == FN) & new, 1).otherwise(0).cast(NUMBER).alias("k2"), "name", "flags", line.alias("line"), F.when(kind == EXT, F.col("copies")).otherwise(1).alias("copies"))
    # repeated in two steps, so that no array grows with the copies of a row that stands in every input
    body = body.filter("line IS NOT NULL").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))))
    body = body.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies") - F.col("_block") * COPIES, F.lit(COPIES)).cast("int")))).drop("copies", "_block", "_copy")
    ending = F.concat_ws("\n", *[F.concat(F.lit(f"{c.upper()}:"), F.col(c).cast("string")) for c in SUMMARY_ORDER], F.lit("end_of_record"))
    zero = _zero()
    tail = summaries.select("path", F.lit(10).alias("rank"), zero.alias("a"), zero.alias("b"), zero.alias("k1"), zero.alias("k2"), F.lit("").alias("name"), F.lit(0).alias("flags"), ending.alias("line"))
    return body.unionByName(tail)


ORDER = ("path", "rank", "a", "b", "k1", "k2", "name", "flags")


def ordered_lines(merged: DataFrame, summaries: DataFrame) -> DataFrame:
    return rendered_lines(merged, summaries).orderBy(*ORDER).select("line")


def diagnostics(records: DataFrame, merged: DataFrame, options: Options) -> DataFrame:
    """Warnings: joined boundaries and (on demand) unknown records by place, differing checksums and expressions by merged key."""
    kind, place = F.col("kind"), F.concat_ws(":", "path", F.col("a").cast("string"))
    notes = records.filter(F.col("note").isNotNull() & (F.lit(options.warn_unknown) | ~F.col("note").startswith("kept"))).select("input_id", "origin_line", F.col("note").alias("message"))
    text = F.when(kind == DA, F.concat(F.lit("differing checksums at "), place)).otherwise(F.concat(F.lit("differing expressions at "), place, F.lit(" group "), F.col("b").cast("string"), F.lit(" index "), F.col("c").cast("string")))
    differing = merged.filter(kind.isin(DA, MCDC) & F.col("conflict")).select(F.lit(None).cast("bigint").alias("input_id"), F.lit(None).cast("bigint").alias("origin_line"), text.alias("message"))
    return notes.unionByName(differing)


def write_ordered(lines: DataFrame, output: str) -> None:
    """Write ordered lines as one file beside its place and rename it; a failure leaves an earlier file as it was."""
    staged = f"{output}.staged-{os.getpid()}"
    try:
        lines.write.mode("overwrite").text(staged + ".parts", compression="none")
        with open(staged, "wb") as out:
            for part in sorted(os.listdir(staged + ".parts")):
                if part.startswith("part-"):
                    with open(f"{staged}.parts/{part}", "rb") as f:
                        shutil.copyfileobj(f, out)
        if output.endswith(".gz"):
            import gzip

            with open(staged, "rb") as f, gzip.open(staged + ".gz", "wb") as g:
                shutil.copyfileobj(f, g)
            os.replace(staged + ".gz", staged)
        os.replace(staged, output)
    finally:
        shutil.rmtree(staged + ".parts", ignore_errors=True)
        for left in (staged, staged + ".gz"):
            if os.path.exists(left):
                os.remove(left)


@dataclass
class Merge:
    """A planned merge: its parts are DataFrames, nothing has run yet."""

    records: DataFrame
    options: Options = field(default_factory=Options)

    def __post_init__(self) -> None:
        self.merged = merge_records(self.records.filter("kind IS NOT NULL"))
        self.summaries = source_summaries(self.merged)

    def lines(self) -> DataFrame:
        return ordered_lines(self.merged, self.summaries)

    def check(self) -> None:
        """Raise the first error in the order of inputs and positions."""
        first = self.records.filter("error IS NOT NULL").agg(F.min(F.struct("input_id", "origin_line", "error")).alias("e")).collect()[0].e
        if first:
            raise TraceError(first.error, first.input_id, first.origin_line)
        if self.options.strict_checksum and not self.merged.filter((F.col("kind") == DA) & F.col("conflict")).isEmpty():
            raise TraceError("differing checksums")


def plan_merge(spark: SparkSession, inputs: list[str], options: Options = Options(), **reader: int) -> Merge:
    return Merge(load_records(spark, inputs, options.rules, options.functions, options.branches, **reader), options)


def run(spark: SparkSession, inputs: list[str], output: str, options: Options = Options(), quiet: bool = False, stats: bool = False, stream=None) -> int:
    """Merge tracefiles into one; 0, or raises InputError or TraceError. ``-`` reads standard input or writes standard output."""
    given = expand_lists(inputs)
    names = stage_stdin(given, stream, scratch_path(spark, "stdin"))
    check_regular(names)
    # read and parsed once for the check, the warnings and the output
    records = load_records(spark, names, options.rules, options.functions, options.branches).persist()
    merge = Merge(records, options)
    try:
        try:
            merge.check()
        except TraceError as e:
            if e.input_id is not None:
                filesystem, path = filesystem_of(names[e.input_id])
                with filesystem.open_input_file(path) as f:
                    line = sum(1 for _ in numbered_lines(f, 0, e.pos, MAX_LINE)) + 1
                raise TraceError(f"{given[e.input_id]}:{line}: {e}", e.input_id, e.pos) from None
            raise
        if output == "-":
            for row in merge.lines().toLocalIterator():
                sys.stdout.write(row.line + "\n")
        else:
            write_ordered(merge.lines(), output)
        if not quiet:
            for row in diagnostics(records, merge.merged, options).orderBy("input_id", "origin_line", "message").toLocalIterator():
                sys.stderr.write(f"tracemill: {row.message}\n")
        if stats:
            t = grand_totals(merge.summaries).collect()[0]
            sys.stderr.write(f"stats LF={t.lf} LH={t.lh} FNF={t.fnf} FNH={t.fnh} BRF={t.brf} BRH={t.brh}\n")
    finally:
        records.unpersist()
        clear_scratch(spark)
    return 0
