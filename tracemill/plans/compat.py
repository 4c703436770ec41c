"""The testcase-preserving merge: one section per source and testcase, consistency checks, optional recovery.

The plan is written as if every problem were ignored; problems come out beside it as rows (kind, message), and ``check``
raises the first kind that may not be ignored. Steps run in a fixed order: functions are checked against the lines of
their own input before conditions add lines; branches and the merged functions are checked after that.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.numbers import I64_MAX, NUMBER, extension, saturated_sum
from tracemill.functions.paths import PathRules
from tracemill.operators import coverage as op
from tracemill.session import materialize
from tracemill.sources.inputs import filesystem_of, numbered_lines
from tracemill.sources.lcov import MAX_LINE
from tracemill.sources.lenient import load_rows, rows_from_table

# fixed values: kinds of problems that may be named to be ignored, and extensions with a special treatment
IGNORABLE = frozenset("inconsistent version mismatch format empty source unused negative".split())
C_FAMILY = "c h i C H I icc cpp cc cxx hh hpp hxx".split()
ENDS_DERIVED, PERL = [*C_FAMILY, "java", "pl", "pm"], ["pl", "pm"]


@dataclass(frozen=True)
class Options:
    rules: PathRules = field(default_factory=PathRules)
    functions: bool = True
    branches: bool = False
    mcdc: bool = False
    checksum: bool = False
    forget_names: bool = False
    consistency: bool = True
    derive_ends: bool = True
    ignore: frozenset[str] = frozenset()
    keep_going: bool = False

    def families(self) -> frozenset[str]:
        return frozenset(["DA", *(["FN", "FNDA", "FNL", "FNA"] if self.functions else []), *(["BRDA"] if self.branches else []), *(["MCDC"] if self.mcdc else [])])


class CompatError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind, self.status = kind, 1


def _problem(df: DataFrame, condition: Column | None, kind: str, message: str) -> DataFrame:
    found = df if condition is None else df.filter(condition)
    return found.select(F.lit(kind).alias("kind"), F.lit(message).alias("message"))


def _sum(column: str) -> Column:
    return saturated_sum(F.col(column), I64_MAX)


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _is(path: str, extensions: list[str]) -> Column:
    return extension(F.col(path)).isin(*extensions)


def _lambda() -> Column:
    name = F.col("name")
    return F.when(extension(F.col("source")) == "java", name.contains(".lambda$")).otherwise(_is("source", C_FAMILY) & name.contains("{lambda("))


class CompatMerge:
    """A planned merge of files, or of the (input_id, body) rows of a table."""

    def __init__(self, spark: SparkSession, inputs: list[str] | DataFrame, options: Options = Options()):
        self.spark, self.options = spark, options
        reading = (options.rules, options.families(), options.checksum, options.forget_names)
        rows = load_rows(spark, inputs, *reading) if isinstance(inputs, list) else rows_from_table(inputs, *reading)
        self.rows = materialize(rows, "rows")
        self.problems: list[DataFrame] = [self.rows.filter("problem IS NOT NULL").select(F.col("problem").alias("kind"), "message")]
        self.da = self.rows.filter("family = 'DA'").select("source", "testcase", "input_id", "section", "ordinal", "line", F.col("hits").alias("count"), "checksum")
        self.has_da = materialize(self.da.select("source", "input_id", "testcase").distinct(), "eligible")
        self.alive = self.has_da.select("source", "input_id").distinct()
        all_inputs = spark.range(len(inputs)).withColumnRenamed("id", "input_id") if isinstance(inputs, list) else inputs.select("input_id").distinct()
        self._note(op.lacking(all_inputs, self.alive, ["input_id"]), None, "empty", "an input has no source with lines")
        self._versions()
        self._conditions()
        if options.functions:
            self._functions_by_input()
        self._branches()
        self._output_lines()
        if options.functions:
            self._functions_merged()
        self._presence()

    def _note(self, df: DataFrame, condition: Column | None, kind: str, message: str) -> None:
        self.problems.append(_problem(df, condition, kind, message))

    def _family(self, *names: str) -> DataFrame:
        return self.rows.filter(F.col("family").isin(*names))

    # -- versions ----------------------------------------------------------------------------------------------------

    def _versions(self) -> None:
        versions = self._family("VER")
        within = op.first_by(versions, ["source", "input_id"], "name", ["section", "ordinal"])
        self._note(within, F.col("conflict"), "version", "versions differ within an input")
        self.versions = op.first_by(op.having(versions, self.alive, ["source", "input_id"]), ["source"], "name", ["input_id", "section", "ordinal"])
        self._note(self.versions, F.col("conflict"), "version", "versions differ between inputs")

    # -- conditions --------------------------------------------------------------------------------------------------

    def _fold_conditions(self, rows: DataFrame, owner: list[str], note: bool) -> DataFrame:
        point = [*owner, "line", "block", "idx"]
        first = rows.groupBy(*point).agg(F.min_by("name", F.struct("input_id", "section", "ordinal")).alias("first"), F.count_distinct("name").alias("names"))
        if note:
            self._note(first, F.col("names") > 1, "mismatch", "expressions of a condition differ")
        same = rows.join(first, point).filter(F.col("name") == F.col("first"))
        return op.complete_senses(same, [*point, "name"], "kind", "hits", "unreachable")

    def _conditions(self) -> None:
        if not self.options.mcdc:
            self.condition_lines = self.condition_member_lines = self.spark.createDataFrame([], "source string, input_id bigint, testcase string, line decimal(20,0), count decimal(20,0)")
            return
        rows = op.having(self._family("MCDC"), self.alive, ["source", "input_id"])
        public = op.having(rows, self.has_da, ["source", "input_id", "testcase"])
        self.master_conditions = materialize(self._fold_conditions(rows, ["source", "input_id"], True), "conditions")
        self.conditions = self._fold_conditions(public, ["source", "testcase"], True)
        self.conditions = op.renumber(self.conditions, ["source", "testcase", "line", "block"], ["idx"], "idx")
        key = ["source", "input_id", "line"]
        reachable = self.master_conditions.withColumn("hits", F.when(~F.col("unreachable"), F.col("hits")))
        lines = op.synthesized_lines(reachable, self.da, key, "hits").withColumn("count", F.col("count").cast(NUMBER))
        self.condition_lines = lines if self.options.consistency else lines.limit(0)
        self.condition_member_lines = op.members(self.condition_lines, public, key, "testcase")

    # -- functions ---------------------------------------------------------------------------------------------------

    def _linked(self) -> DataFrame:
        """Hits with the first declaration of their symbol before them; legacy declarations count as zero hits."""
        family = F.when(F.col("family").isin("FN", "FNDA"), "old").otherwise("new")
        symbol = F.when(family == "old", F.col("name")).otherwise(F.col("idx").cast("string"))
        rows = self._family("FN", "FNDA", "FNL", "FNA").withColumn("declares", F.col("family").isin("FN", "FNL")).withColumn("old", family == "old").withColumn("symbol", symbol)
        rows = rows.withColumn("declared", F.when(F.col("declares"), F.struct("line", "stop")))
        linked = op.first_declaration(rows, ["source", "testcase", "input_id", "section", "old", "symbol"], "ordinal", "declared").withColumnRenamed("current", "place")
        later = F.col("declares") & (F.col("ordinal") > F.col("declared_at"))
        linked = materialize(linked.withColumn("again", later & ~F.col("place").eqNullSafe(F.struct("line", "stop"))).withColumn("second", later & ~F.col("old")), "linked")
        self._note(linked, ~F.col("declares") & F.col("place").isNull(), "mismatch", "hits of a function that isn't declared")
        self._note(linked, F.col("second"), "format", "a function index is declared twice")
        self._note(linked, F.col("again") & F.col("old"), "inconsistent", "a function is declared again elsewhere")
        named = linked.filter(F.col("place").isNotNull() & ~F.col("again") & (F.col("old") | ~F.col("declares")))
        return named.select("source", "testcase", "input_id", "name", F.col("place.line").alias("line"), F.col("place.stop").alias("stop"), F.when(F.col("declares"), 0).otherwise(F.col("hits")).cast(NUMBER).alias("hits"))

    def _check_ranges(self, groups: DataFrame, lines: DataFrame, owner: list[str], derive: bool) -> DataFrame:
        """Function groups (owner, line, stop, hit, lambda) against lines: owner, line, stop, addition; groups of sources without lines go."""
        o, own = self.options, groups
        if derive:
            starts = groups.filter("NOT lambda").select(*owner, "line")
            ends = op.derived_ends(starts, lines, owner, "line", "line").select(*owner, "line", "derived_end")
            own = groups.join(ends, [*owner, "line"], "left").withColumn("stop", F.coalesce("stop", F.when(_is("source", ENDS_DERIVED), F.col("derived_end")))).drop("derived_end")
        last = lines.groupBy(*owner).agg(F.max("line").alias("last_line"))
        own = own.join(last, owner)
        exempt = F.col("lambda") & ~F.col("hit")
        own = own.withColumn("first", F.when(exempt, F.col("line") + 1).otherwise(F.col("line")).cast(NUMBER))
        own = materialize(own, "ranges")
        usable = F.col("stop").isNotNull() & (F.col("stop") >= F.col("line")) & (F.lit(not o.consistency) | (F.col("last_line") >= F.col("line"))) & (F.col("first") <= F.col("stop"))
        self._note(own, F.col("stop") < F.col("line"), "inconsistent", "a function ends before it starts")
        self._note(own, F.lit(o.consistency) & (F.col("last_line") < F.col("line")), "inconsistent", "a function starts after the last line")
        if derive:
            self._note(own, F.col("stop").isNull() & _is("source", ENDS_DERIVED), "inconsistent", "the end of a function can't be derived")
        found = op.first_hit_in_range(lines, own.filter(usable), owner, "line", "count", "first", "stop")
        checked = materialize(op.function_line_state(found, "hit"), "checked")
        wrong = ~F.col("agrees")
        self._note(checked, F.lit(o.consistency) & wrong, "inconsistent", "a function and its lines disagree on having been hit")
        at = lines.select(*owner, F.col("line").alias("first_hit"), F.col("count").alias("addition"))
        added = checked.filter(F.lit(o.consistency) & wrong & ~F.col("hit")).join(at, [*owner, "first_hit"]).select(*owner, "line", "addition")
        return own.select(*owner, "line", "stop").join(added, [*owner, "line"], "left").withColumn("addition", F.coalesce("addition", F.lit(0).cast(NUMBER)))

    def _grouped(self, rows: DataFrame, owner: list[str]) -> DataFrame:
        return op.group_hits(rows.withColumn("lambda", _lambda()), [*owner, "line"], "hits", "stop", "lambda")

    def _functions_by_input(self) -> None:
        linked = op.having(self._linked(), self.alive, ["source", "input_id"])
        bad = (F.col("line") == 0) | (F.coalesce("stop", F.lit(1)) == 0)
        self._note(linked, bad, "format", "function lines must be positive")
        folded = linked.filter(~bad).groupBy("source", "input_id", "line", "testcase", "name").agg(_sum("hits").alias("hits"), F.max("stop").alias("stop"), (F.min("stop") != F.max("stop")).alias("conflict"))
        self._note(folded, F.col("conflict"), "inconsistent", "ends of a function differ")
        folded = materialize(folded.drop("conflict"), "functions")
        owner = ["source", "input_id"]
        groups = self._grouped(folded, owner)
        self._note(groups, F.col("conflict"), "inconsistent", "ends of a function's aliases differ")
        lines = op.merge_counts(self.da, [*owner, "line"], limit=I64_MAX)
        corrections = self._check_ranges(groups, lines, owner, self.options.derive_ends).withColumnRenamed("stop", "end_of")
        fixed = folded.join(corrections, [*owner, "line"]).withColumn("stop", F.coalesce("end_of", "stop")).withColumn("hits", F.least(F.col("hits") + F.col("addition"), F.lit(I64_MAX)).cast(NUMBER)).drop("end_of", "addition")
        self.functions = materialize(fixed, "corrected")

    def _functions_merged(self) -> None:
        o = self.options
        public = op.having(self.functions, self.has_da, ["source", "input_id", "testcase"])
        ghosts = op.lacking(self.functions, self.has_da, ["source", "input_id", "testcase"])
        place = F.min(F.struct("input_id", "line", "stop"))
        merged = public.groupBy("source", "testcase", "name").agg(place.alias("first"), _sum("hits").alias("hits"), F.count_distinct(F.struct("line", F.coalesce("stop", F.lit(0).cast(NUMBER)))).alias("places"))
        self._note(merged, F.col("places") > 1, "inconsistent", "a function's location differs between inputs")
        merged = merged.select("source", "testcase", "name", F.col("first.line").alias("line"), F.col("first.stop").alias("stop"), "hits")
        same_start = Window.partitionBy("source", "testcase", "line")
        merged = merged.withColumn("differs", F.min("stop").over(same_start) != F.max("stop").over(same_start)).withColumn("stop", F.max("stop").over(same_start))
        self._note(merged, F.col("differs"), "inconsistent", "ends of aliases differ")
        merged = materialize(merged.drop("differs"), "merged-functions")
        everyone = merged.select("source", "line", "stop", "name", "hits").unionByName(ghosts.select("source", "line", "stop", "name", "hits"))
        checked_lines = _union(self.da.select("source", "line", "count"), self.unserialized_lines.select("source", "line", "count"), self.condition_lines.select("source", "line", "count"))
        lines = op.merge_counts(checked_lines, ["source", "line"], limit=I64_MAX)
        additions = self._check_ranges(self._grouped(everyone, ["source"]), lines, ["source"], False).select("source", "line", "addition")
        final = merged.join(additions, ["source", "line"], "left").withColumn("hits", F.least(F.col("hits") + F.coalesce("addition", F.lit(0)), F.lit(I64_MAX)).cast(NUMBER)).drop("addition")
        if o.derive_ends:
            ends = op.derived_ends(final.select("source", "testcase", "line"), self.da, ["source", "testcase"], "line", "line").select("source", "testcase", "line", "derived_end")
            final = final.join(ends, ["source", "testcase", "line"], "left").withColumn("stop", F.coalesce("stop", F.when(_is("source", ENDS_DERIVED), F.col("derived_end")))).drop("derived_end")
        alias = F.min("name").over(Window.partitionBy("source", "testcase", "line"))
        final = op.renumber(final.withColumn("alias", alias), ["source", "testcase"], ["line", "alias", "stop"], "idx")
        self.final_functions = materialize(final, "final-functions")

    # -- branches ----------------------------------------------------------------------------------------------------

    def _branches(self) -> None:
        if not self.options.branches:
            self.unserialized_lines = self.branch_member_lines = self.spark.createDataFrame([], "source string, input_id bigint, testcase string, line decimal(20,0), count decimal(20,0)")
            return
        o, origin = self.options, ["input_id", "section"]
        rows = op.having(self._family("BRDA"), self.alive, ["source", "input_id"]).select("source", "testcase", *origin, "ordinal", "line", "block", "kind", "unreachable", "hits", "name")
        point = ["source", "testcase", "line"]
        placed = materialize(op.placed_branches(rows, origin, point, "block", "ordinal", "kind", "unreachable", "hits", "name"), "branches")
        own = ["source", "input_id", "line"]
        present = op.merge_counts(_union(self.da.select(*own, "count"), self.condition_lines.select(*own, "count")), own, limit=I64_MAX)
        points = placed.groupBy(*own, "signature", "occurrence", "position").agg(F.max("hits").alias("hits"))
        state = materialize(op.branch_line_state(present, points, own, "count", "hits"), "branch-lines")
        testcases = placed.groupBy(*own).agg(F.count_distinct("testcase").alias("testcases"), F.min("testcase").alias("testcase"))
        self._branch_notes(state)
        self.branch_states = state
        repaired = state.filter((F.col("state") == "no line") & F.lit(o.consistency)).join(testcases, own).select(*own, "testcase", F.col("repaired").cast(NUMBER).alias("count"), (F.col("testcases") == 1).alias("serialized"))
        repaired = materialize(repaired, "repaired")
        self.unserialized_lines = repaired.filter("NOT serialized")
        self.branch_member_lines = op.having(repaired.filter("serialized"), self.has_da, ["source", "input_id", "testcase"])
        merged_lines = op.merge_counts(_union(present.select("source", "line", "count"), repaired.select("source", "line", "count")), ["source", "line"], limit=I64_MAX)
        merged_points = placed.groupBy("source", "line", "signature", "occurrence", "position").agg(F.max("hits").alias("hits"))
        self._branch_notes(op.branch_line_state(merged_lines, merged_points, ["source", "line"], "count", "hits"))
        public = op.having(placed, self.has_da, ["source", "input_id", "testcase"])
        self.branches = op.folded_branches(public, origin, point, "ordinal", "hits", ["kind", "name"], ["unreachable"])
        self.master_branches = placed

    def _branch_notes(self, state: DataFrame) -> None:
        exempt = _is("source", PERL) & (F.col("state") == "hit line without hit branch")
        self._note(state, F.lit(self.options.consistency) & (F.col("state") != "ok") & ~exempt, "inconsistent", "branches and lines disagree")

    # -- lines, presence ---------------------------------------------------------------------------------------------

    def _output_lines(self) -> None:
        key = ["source", "testcase", "line"]
        parts = _union(*[df.select(*key, "count") for df in (self.da, self.condition_member_lines, self.branch_member_lines)])
        self.lines = op.merge_counts(parts, key, limit=I64_MAX)
        if self.options.checksum:
            place = ["source", "line"]
            chosen = op.first_by(self._with_digests(), place, "checksum", ["input_id", "section", "ordinal"])
            self._note(chosen, F.col("conflict"), "version", "checksums of a line differ")
            self.lines = self.lines.join(chosen.select(*place, "checksum"), place, "left")
        else:
            self.lines = self.lines.withColumn("checksum", F.lit(None).cast("string"))
        self.lines = materialize(self.lines, "lines")

    def _with_digests(self) -> DataFrame:
        """Lines with their checksum, filled from the source text; for the C family it is verified too."""
        digests = source_digests(self.da.select("source").distinct())
        unread = digests.filter("line IS NULL")
        self._note(unread, None, "source", "a source file can't be read")
        joined = self.da.join(digests.filter("line IS NOT NULL"), ["source", "line"], "left").join(unread.select("source", F.lit(True).alias("unread")), "source", "left")
        wrong = _is("source", C_FAMILY) & F.col("unread").isNull() & (F.col("checksum").isNull() | ~F.col("checksum").eqNullSafe(F.col("digest")))
        self._note(joined, wrong, "version", "a checksum doesn't fit the source")
        return joined.withColumn("checksum", F.coalesce("checksum", "digest"))

    def _presence(self) -> None:
        checks = ((self.options.functions, "functions"), (self.options.branches, "master_branches"), (self.options.mcdc, "master_conditions"))
        for enabled, what in checks:
            if enabled:
                rows = getattr(self, what)
                rows = rows.filter("NOT unreachable") if what == "master_branches" else rows
                self._note(rows.agg(F.count("*").alias("n")), F.col("n") == 0, "empty", f"no {what.removeprefix('master_')} in the inputs")
        self._note(self.lines.agg(F.count("*").alias("n")), F.col("n") == 0, "empty", "no output")

    def problem_kinds(self) -> list[tuple[str, str, int]]:
        found = _union(*self.problems).groupBy("kind").agg(F.min("message").alias("message"), F.count("*").alias("n"))
        return sorted(tuple(r) for r in found.collect())

    def check(self) -> list[tuple[str, str, int]]:
        """Raise a problem that may not be ignored; the ignored ones otherwise."""
        found = self.problem_kinds()
        for kind, message, _ in found:
            if not (self.options.keep_going or kind in self.options.ignore):
                raise CompatError(kind, message)
        return found

    # -- rendering ---------------------------------------------------------------------------------------------------

    def rendered(self) -> DataFrame:
        s = lambda c: F.col(c).cast("string")
        own = ["source", "testcase"]
        none, zero = F.lit("").alias("k4"), F.lit(0).cast(NUMBER)

        def lines(df: DataFrame, rank: int, text: Column, *keys: Column, name: Column = none) -> DataFrame:
            keys = [*[k.cast(NUMBER) for k in keys], zero, zero, zero, zero][:4]
            return df.select(*own, F.lit(rank).alias("rank"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], name.alias("k4"), text.alias("line"))

        def pair(df: DataFrame, rank: int, found: str, hit: str) -> DataFrame:
            return lines(df, rank, F.concat(F.lit(f"{found}:"), s("found"), F.lit(f"\n{hit}:"), s("hit")))

        c = F.col
        sections = self.lines.select(*own).distinct()
        head = lines(sections, 0, F.concat(F.lit("TN:"), "testcase", F.lit("\nSF:"), "source"))
        parts = [head, lines(sections.join(self.versions, "source"), 1, F.concat(F.lit("VER:"), "name"))]
        if self.options.functions:
            f = op.having(self.final_functions, sections, own)
            groups = f.groupBy(*own, "idx", "line", "stop").agg(F.bool_or(c("hits") > 0).alias("hit"))
            stop = F.when(c("stop").isNotNull(), F.concat(F.lit(","), s("stop"))).otherwise("")
            parts.append(lines(groups, 2, F.concat(F.lit("FNL:"), s("idx"), F.lit(","), s("line"), stop), c("idx"), zero))
            parts.append(lines(f, 2, F.concat(F.lit("FNA:"), s("idx"), F.lit(","), s("hits"), F.lit(","), "name"), c("idx"), F.lit(1), name=c("name")))
            counts = groups.groupBy(*own).agg(F.count("*").alias("found"), F.count_if("hit").alias("hit"))
            parts.append(pair(sections.join(counts, own, "left").na.fill(0, ["found", "hit"]), 3, "FNF", "FNH"))
        if self.options.branches:
            b = op.having(self.branches, sections, own)
            text = F.concat(F.lit("BRDA:"), s("line"), F.lit(","), F.when(c("kind") == "v", "").otherwise(c("kind")), F.when(c("unreachable"), "U").otherwise(""), s("block"), F.lit(","), "name", F.lit(","), F.coalesce(s("hits"), F.lit("-")))
            parts.append(lines(b, 4, text, c("line"), c("block"), c("position")))
            counts = b.filter("NOT unreachable").groupBy(*own).agg(F.count("*").alias("found"), F.count_if(c("hits") > 0).alias("hit"))
            parts.append(pair(counts, 5, "BRF", "BRH"))
        if self.options.mcdc:
            m = op.having(self.conditions, sections, own)
            text = F.concat(F.lit("MCDC:"), s("line"), F.lit(","), F.when(c("unreachable"), "U").otherwise(""), s("block"), F.lit(","), "kind", F.lit(","), s("hits"), F.lit(","), s("idx"), F.lit(","), "name")
            parts.append(lines(m, 6, text, c("line"), c("block"), c("idx"), F.when(c("kind") == "t", 0).otherwise(1)))
            parts.append(pair(m.groupBy(*own).agg(F.count("*").alias("found"), F.count_if(c("hits") > 0).alias("hit")), 7, "MCF", "MCH"))
        checksum = F.when(c("checksum").isNotNull(), F.concat(F.lit(","), "checksum")).otherwise("")
        parts.append(lines(self.lines, 8, F.concat(F.lit("DA:"), s("line"), F.lit(","), s("count"), checksum), c("line")))
        counts = self.lines.groupBy(*own).agg(F.count("*").alias("found"), F.count_if(c("count") > 0).alias("hit"))
        parts.append(lines(counts, 9, F.concat(F.lit("LF:"), s("found"), F.lit("\nLH:"), s("hit"), F.lit("\nend_of_record"))))
        return _union(*parts)

    def ordered(self) -> DataFrame:
        return self.rendered().orderBy("source", "testcase", "rank", "k0", "k1", "k2", "k3", "k4").select("line")


def source_digests(sources: DataFrame) -> DataFrame:
    """source, line, digest of every line of the named files; a row with a null line for a file that can't be read.

    A file counts as unreadable, too, if a line is longer than 1 MiB or if it changes while it is read. Lines are streamed.
    """

    def read(batches):
        import base64
        import hashlib
        import itertools

        import pyarrow as pa

        for batch in batches:
            for source in batch.column(0).to_pylist():
                whole = True
                try:
                    filesystem, path = filesystem_of(source)
                    before = filesystem.get_file_info(path)
                    with filesystem.open_input_file(path) as f:
                        lines = ((k, raw) for k, (_, raw) in enumerate(numbered_lines(f, 0, None, MAX_LINE + 1), 1))
                        while part := list(itertools.islice(lines, 20_000)):
                            whole = whole and all(len(raw) <= MAX_LINE + 1 for _, raw in part)
                            digests = [base64.b64encode(hashlib.md5(raw.rstrip(b"\r\n")).digest()).decode().rstrip("=") for _, raw in part]
                            yield pa.RecordBatch.from_arrays([pa.array([source] * len(part)), pa.array([k for k, _ in part], pa.int64()), pa.array(digests)], ["source", "line", "digest"])
                    after = filesystem.get_file_info(path)
                    whole = whole and (before.size, before.mtime_ns) == (after.size, after.mtime_ns)
                except (OSError, pa.ArrowInvalid):
                    whole = False
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([None], pa.int64()), pa.array([None], pa.string())], ["source", "line", "digest"])

    return sources.mapInArrow(read, "source string, line bigint, digest string").withColumn("line", F.col("line").cast(NUMBER))


def merge(spark: SparkSession, inputs: list[str], output: str, options: Options = Options()) -> list[tuple[str, str, int]]:
    """Merge into ``output`` (gzip by extension) and give the problems that were ignored."""
    from tracemill.plans.native import write_ordered

    plan = CompatMerge(spark, inputs, options)
    ignored = plan.check()
    write_ordered(plan.ordered(), output)
    return ignored
