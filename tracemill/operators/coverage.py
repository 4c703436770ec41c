"""Relational operators on coverage rows, written for any table with the named columns.

Every operator states its result for nulls, ties, repeated rows and empty tables; columns it doesn't name are ignored, so
extra columns with clashing names do no harm. Unless said otherwise a null in a grouping column is a value of its own, rows
with a null in a joined column don't match, null counts don't add up to anything, repeated rows count again, and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.numbers import I64_MAX, NUMBER, U64_MAX, saturated_sum


# -- aggregations ----------------------------------------------------------------------------------------------------

def merge_counts(df: DataFrame, keys: Sequence[str], count: str = "count", limit: int = U64_MAX) -> DataFrame:
    """keys and the saturating sum of ``count``; null where all counts of a key are."""
    return df.groupBy(*keys).agg(saturated_sum(F.col(count), limit).alias(count))


def merge_lines(df: DataFrame, keys: Sequence[str], count: str = "count", checksum: str = "checksum") -> DataFrame:
    """keys, saturating sum, least non-empty checksum ('' without one) and whether several differ.

    The checksum takes part in a first grouping, which leaves hash aggregation and map-side combining intact.
    """
    given = F.coalesce(F.col(checksum), F.lit(""))
    first = df.select(*keys, F.col(count).alias("_count"), given.alias("_sum")).groupBy(*keys, "_sum").agg(saturated_sum(F.col("_count")).alias("_count"))
    some = F.when(F.col("_sum") != "", F.col("_sum"))
    merged = first.groupBy(*keys).agg(saturated_sum(F.col("_count")).alias(count), F.min(some).alias("_least"), F.max(some).alias("_most"))
    return merged.select(*keys, count, F.coalesce("_least", F.lit("")).alias(checksum), F.coalesce(F.col("_least") != F.col("_most"), F.lit(False)).alias("conflict"))


def single_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """key and its label if there is exactly one and it isn't empty, else ''; a missing label counts as the label ''."""
    labels = df.select(key, F.coalesce(F.col(label), F.lit("")).alias("_label")).distinct()
    return labels.groupBy(key).agg(F.when(F.min("_label") == F.max("_label"), F.max("_label")).otherwise("").alias(label))


def first_by(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys, the first non-null ``value`` by the producer order, and whether different ones occur. Ties go to the least value."""
    known = df.filter(F.col(value).isNotNull())
    best = F.min(F.struct(*order, value))
    return known.groupBy(*keys).agg(best.alias("_first"), (F.min(value) != F.max(value)).alias("conflict")).select(*keys, F.col(f"_first.{value}").alias(value), "conflict")


def group_hits(df: DataFrame, keys: Sequence[str], hits: str, end: str, *every: str) -> DataFrame:
    """Per function group: whether any alias was hit, the largest end, whether known ends differ, and for ``every`` flag whether all aliases have it."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(hits) > 0), F.lit(False)).alias("hit"), F.max(end).alias(end), F.coalesce(F.min(end) != F.max(end), F.lit(False)).alias("conflict"),
                                 *[F.coalesce(F.bool_and(c), F.lit(False)).alias(c) for c in every])


def eligibility(lines: DataFrame, keys: Sequence[str], testcase: str) -> DataFrame:
    """keys with any line, and whether several testcases have some (a null testcase isn't counted)."""
    return lines.select(*keys, testcase).distinct().groupBy(*keys).agg((F.count_distinct(testcase) > 1).alias("multiple"))


def rollup_summary(points: DataFrame, key: str, count: str) -> DataFrame:
    """key, lf, lh and the total in one pass; the total's row has a null key, so null keys come out as ''."""
    hit = F.col(count) > 0
    keyed = points.select(F.coalesce(F.col(key), F.lit("")).alias(key), count)
    return keyed.rollup(key).agg(F.count("*").alias("lf"), F.count_if(hit).alias("lh"))


# -- windows ---------------------------------------------------------------------------------------------------------

def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased tables, nulls equal."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def first_declaration(events: DataFrame, group: Sequence[str], order: str, declared: str) -> DataFrame:
    """Each row with the first non-null ``declared`` of its group if that is at or before it, as ``current``, and its place as ``declared_at``.

    Null group values are equal; a null order comes before all others. One grouping and a join, so a group with most rows isn't ordered in one task.
    """
    first = events.filter(F.col(declared).isNotNull()).groupBy(*group).agg(F.min(F.struct(F.col(order).alias("at"), F.col(declared).alias("value"))).alias("_first"))
    joined = events.alias("_e").join(first.alias("_d"), _same("_e", "_d", group), "left")
    reached = F.col("_d._first").isNotNull() & (F.col("_d._first.at").isNull() | F.coalesce(F.col("_d._first.at") <= F.col(f"_e.{order}"), F.lit(False)))
    return joined.select("_e.*", F.when(reached, F.col("_d._first.value")).alias("current"), F.when(reached, F.col("_d._first.at")).alias("declared_at"))


#: Lines whose hits are ordered together.
SPAN = 1024


def first_hit_in_range(lines: DataFrame, ranges: DataFrame, keys: Sequence[str], line: str, count: str, start: str, end: str) -> DataFrame:
    """Each range with the first line in [start, end] that was hit, or null.

    No range join: distinct hit lines and range starts share ordered windows of SPAN lines; a range whose span holds no later hit takes
    the first one of the next span that has any. No task orders all lines of a source. ``lines`` may repeat; ranges keep their columns; null keys are equal.
    """
    span = lambda c: F.floor(F.col(c) / SPAN).alias("_span")
    kind = lines.schema[line].dataType
    distinct = lines.filter(F.col(count) > 0).select(*keys, F.col(line).alias("_at")).distinct()
    hit = distinct.select(*keys, span("_at"), "_at", F.lit(None).cast(ranges.schema.simpleString()).alias("_range"), F.col("_at").alias("_hit"))
    asked = ranges.select(*keys, F.floor(F.col(start) / SPAN).alias("_span"), F.col(start).alias("_at"), F.struct(*ranges.columns).alias("_range"), F.lit(None).cast(kind).alias("_hit"))
    # ranges come first among rows at the same place, so a hit on the first line counts
    w = Window.partitionBy(*keys, "_span").orderBy("_at", F.col("_hit").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = hit.unionByName(asked)
    nearest = both.withColumn("_next", F.first("_hit", ignorenulls=True).over(w)).filter("_range IS NOT NULL")
    spans = both.groupBy(*keys, "_span").agg(F.min("_hit").alias("_hit"))
    after = Window.partitionBy(*keys).orderBy("_span").rowsBetween(1, Window.unboundedFollowing)
    later = spans.withColumn("_later", F.first("_hit", ignorenulls=True).over(after))
    joined = nearest.alias("_n").join(later.alias("_l"), _same("_n", "_l", [*keys, "_span"]), "left")
    first = F.coalesce("_n._next", "_l._later")
    return joined.select("_n._range.*", F.when(first <= F.col(f"_n._range.{end}"), first).alias("first_hit"))


def derived_ends(starts: DataFrame, lines: DataFrame, keys: Sequence[str], start: str, line: str) -> DataFrame:
    """Each distinct start with the next greater start and the last line in [start, next), or null."""
    w = Window.partitionBy(*keys).orderBy("_at", F.desc("_is_start"))
    marks = starts.select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_is_start")).distinct()
    rows = marks.unionByName(lines.select(*keys, F.col(line).alias("_at"), F.lit(0).alias("_is_start")).distinct())
    spans = rows.withColumn("_start", F.last(F.when(F.col("_is_start") == 1, F.col("_at")), ignorenulls=True).over(w)).filter("_start IS NOT NULL")
    ends = spans.groupBy(*keys, F.col("_start").alias(start)).agg(F.max(F.when(F.col("_is_start") == 0, F.col("_at"))).alias("derived_end"))
    return ends.withColumn("next_start", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def block_signatures(branches: DataFrame, block: Sequence[str], order: str, kind: str) -> DataFrame:
    """Per block its kinds in order of appearance, ``v`` written as ``b``, and how many there are."""
    letters = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(F.col(kind) == "v", "b").otherwise(F.col(kind)).alias("k"))))
    return branches.groupBy(*block).agg(letters.alias("_s")).select(*block, F.array_join(F.transform("_s", lambda x: x["k"]), "").alias("signature"), F.size("_s").alias("size"))


def signature_ranks(signatures: DataFrame) -> DataFrame:
    """Distinct signatures with their dense rank by length, then bytes. Signatures are few; all others are joined back to them."""
    distinct = signatures.select("signature").distinct()
    return distinct.select("signature", F.dense_rank().over(Window.orderBy(F.length("signature"), "signature")).alias("rank"))


def occurrences(blocks: DataFrame, within: Sequence[str], block: str) -> DataFrame:
    """0-based order of a block id among those with the same signature."""
    return blocks.withColumn("occurrence", F.dense_rank().over(Window.partitionBy(*within, "signature").orderBy(block)) - 1)


def placed_branches(rows: DataFrame, origin: Sequence[str], point: Sequence[str], block: str, order: str, kind: str, *kept: str) -> DataFrame:
    """Branches with their position in their block, the block's signature and its occurrence among blocks with the same one.

    The result has point, origin, order, kind, ``kept`` and those three. Rows at the same place in a block are ordered by kind and ``kept``.
    One exchange on point and origin serves the grouping into blocks and the window over them.
    """
    near = rows.repartition(*point, *origin)
    own = F.array_sort(F.collect_list(F.struct(order, kind, *kept))).alias("_rows")
    letter = lambda x: F.when(x[kind] == "v", "b").otherwise(x[kind])
    blocks = near.groupBy(*point, *origin, block).agg(own).withColumn("signature", F.array_join(F.transform("_rows", letter), ""))
    ranked = occurrences(blocks, [*point, *origin], block)
    return ranked.select(*point, *origin, "signature", "occurrence", F.posexplode("_rows").alias("position", "_row")).select(*point, *origin, "signature", "occurrence", "position", "_row.*")


def folded_branches(placed: DataFrame, origin: Sequence[str], point: Sequence[str], order: str, hits: str, kept: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Placed branches merged by signature, occurrence and position: point, block, position, hits, flags (of any) and ``kept`` (of the first producer).

    Blocks are numbered from 0 per point by signature (length, then bytes) and occurrence; hits are a null-ignoring saturating sum.
    """
    folded = placed.groupBy(*point, "signature", "occurrence", "position").agg(
        saturated_sum(F.col(hits), I64_MAX).alias(hits), *[F.bool_or(c).alias(c) for c in flags], F.min(F.struct(*origin, order, *kept)).alias("_first"))
    rank = F.dense_rank().over(Window.partitionBy(*point).orderBy(F.length("signature"), "signature", "occurrence")) - 1
    return folded.select(*point, rank.alias("block"), "position", hits, *flags, *[F.col(f"_first.{c}").alias(c) for c in kept])


def canonical_branches(rows: DataFrame, origin: Sequence[str], point: Sequence[str], block: str, order: str, kind: str, hits: str, expr: str) -> DataFrame:
    """Branches merged by block signature, occurrence and position instead of block id.

    ``origin`` names what produced a block (input, section), ``point`` the merged place (source, testcase, line). Rows at the same
    place in a block are ordered by kind, expression and hits.
    """
    return folded_branches(placed_branches(rows, origin, point, block, order, kind, expr, hits), origin, point, order, hits, [expr])


def renumber(df: DataFrame, within: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """0-based dense number by ``by`` within a group."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*within).orderBy(*by)) - 1)


# -- joins and repairs -----------------------------------------------------------------------------------------------

def having(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def lacking(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a match; rows with a null key have none and stay."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def complete_senses(conditions: DataFrame, key: Sequence[str], sense: str, hits: str, *flags: str) -> DataFrame:
    """Every condition with both senses; a missing one has no hits and no flags. Null senses are neither and go."""
    of = lambda s, c: F.when(F.col(sense) == s, F.col(c))
    sides = [x for s in "tf" for x in (saturated_sum(of(s, hits), I64_MAX).alias(f"_{s}"), F.count_if(F.col(sense) == s).alias(f"_n{s}"), *[F.max(of(s, c)).alias(f"_{s}{c}") for c in flags])]
    merged = conditions.filter(F.col(sense).isNotNull()).groupBy(*key).agg(*sides)
    both = F.array(*[F.struct(F.lit(s).alias(sense), F.coalesce(f"_{s}", F.lit(0).cast(NUMBER)).alias(hits), (F.col(f"_n{s}") == 0).alias("added"), *[F.coalesce(f"_{s}{c}", F.lit(False)).alias(c) for c in flags]) for s in "tf"])
    return merged.select(*key, F.explode(both).alias("_b")).select(*key, "_b.*")


def synthesized_lines(conditions: DataFrame, lines: DataFrame, key: Sequence[str], hits: str) -> DataFrame:
    """key, count: for places with conditions but no line, as many as conditions were hit."""
    counted = conditions.groupBy(*key).agg(F.count_if(F.col(hits) > 0).alias("count"))
    return lacking(counted, lines, key)


def members(synthesized: DataFrame, conditions: DataFrame, key: Sequence[str], testcase: str) -> DataFrame:
    """Each synthesized line once per testcase that has conditions there."""
    return synthesized.join(conditions.select(*key, testcase).distinct(), list(key))


def propagate_first(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Every row with the first non-null ``value`` of its key, as ``selected``; one grouping and a join, so a key with most rows
    isn't ordered in one task."""
    chosen = first_by(df, keys, value, order).select(*keys, F.col(value).alias("selected"))
    return df.join(chosen, list(keys), "left")


def branch_line_state(lines: DataFrame, branches: DataFrame, key: Sequence[str], count: str, hits: str) -> DataFrame:
    """Per place with branches: ``ok``, ``no line``, ``hit branch on unhit line`` or ``hit line without hit branch``; and the repaired count."""
    own = lines.groupBy(*key).agg(F.sum(count).alias("_lines"))
    points = branches.groupBy(*key).agg(F.count_if(F.col(hits) > 0).alias("hit_points"))
    joined = points.join(own, list(key), "left")
    state = (F.when(F.col("_lines").isNull(), "no line").when((F.col("_lines") == 0) & (F.col("hit_points") > 0), "hit branch on unhit line")
             .when((F.col("_lines") > 0) & (F.col("hit_points") == 0), "hit line without hit branch").otherwise("ok"))
    return joined.select(*key, "hit_points", state.alias("state"), F.when(F.col("_lines").isNull(), F.col("hit_points")).alias("repaired"))


def function_line_state(checked: DataFrame, hit: str) -> DataFrame:
    """Ranges with ``first_hit``: whether the function's flag ``hit`` and its lines agree on having been hit."""
    return checked.withColumn("agrees", F.col(hit) == F.col("first_hit").isNotNull())


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value_a, value_b where two merged tables (unique keys) differ; null equals null."""
    left = a.select(*keys, F.col(value).alias("value_a"), F.lit(True).alias("_a"))
    right = b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("_b"))
    joined = left.join(right, list(keys), "full_outer")
    return joined.filter(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("value_a").eqNullSafe(F.col("value_b"))).select(*keys, "value_a", "value_b")


def union_inputs(*parts: DataFrame) -> DataFrame:
    """All rows of all inputs, each with its place in the list: an input named twice counts twice."""
    result = None
    for k, part in enumerate(parts):
        part = part.withColumn("input_no", F.lit(k))
        result = part if result is None else result.unionByName(part)
    return result


def out_of_order(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose ``value`` is below that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_before", before).filter(F.col("_before") > F.col(value)).drop("_before")

