"""Differences between two copies of a table by content-defined chunking.

Both copies fall into the same buckets by key and are sorted by key within them. A copy is cut where a rolling hash over its last
keys meets a condition, so that the same rows give the same chunks again after an inserted or missing row. Chunks whose
fingerprints occur on both sides are equal and are dropped by anti-joins on the fingerprint alone; only the rows of the
chunks left over are compared field by field.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import materialize

#: Keys in the rolling hash, and the mean number of rows in a chunk.
ROLL, MEAN = 3, 32
#: Sorted buckets per shuffle partition; a window buffers one bucket of one copy.
BUCKETS = 8


def latest(df: DataFrame, keys: Sequence[str], measures: Sequence[str], version: str) -> DataFrame:
    """The row with the greatest ``version`` of each key; identical rows count once.

    Of several different rows with the same greatest version the one that is greatest in field order stands (nulls are least).
    Rows with a null key field are kept: a null key is a key.
    """
    newest = F.max(F.struct(F.col(version).alias("_version"), *measures)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{m}").alias(m) for m in measures])


def _tagged(df: DataFrame, copy: int, keys: Sequence[str], measures: Sequence[str], buckets: int) -> DataFrame:
    """Rows with their copy, bucket, key hash and two independent 64-bit hashes of the whole row."""
    null_marks = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in (*keys, *measures)])
    key_hash, row = F.xxhash64(*keys), F.struct(null_marks, *keys, *measures)
    return df.select(F.lit(copy).cast("tinyint").alias("_copy"), *keys, *measures, F.pmod(F.xxhash64(F.lit("bucket"), *keys), F.lit(buckets)).alias("_bucket"),
                     key_hash.alias("_key"), F.xxhash64(F.lit("one"), row).alias("_one"), F.xxhash64(F.lit("two"), row).alias("_two"))


def chunked(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows of both copies with the number of their chunk within copy and bucket."""
    partitions = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = _tagged(a, 0, keys, measures, partitions * BUCKETS).unionByName(_tagged(b, 1, keys, measures, partitions * BUCKETS))
    in_order = Window.partitionBy("_bucket", "_copy").orderBy(*keys)
    # wrapping products of the last keys' hashes; the first rows of a bucket roll over fewer keys in both copies alike
    rolling = reduce(Column.bitwiseXOR, [F.shiftleft(F.coalesce(F.lag("_key", back).over(in_order) if back else F.col("_key"), F.lit(0)), 7 * back) for back in range(ROLL)])
    placed = both.withColumn("_cut", F.when(F.pmod(F.xxhash64(rolling), F.lit(MEAN)) == 0, 1).otherwise(0))
    # the row that meets the condition ends its chunk
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_chunk", F.coalesce(F.sum("_cut").over(before), F.lit(0))).drop("_cut", "_key")


def differing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The rows of both copies (unique by key in each) that lie in chunks without a match; every differing row is among them."""
    rows = materialize(chunked(a, b, keys, measures), "chunks")
    place, same = ["_copy", "_bucket", "_chunk"], ["_bucket", "_one", "_two", "n"]
    # keys are unique within a copy, so the exclusive ors of their rows' hashes tell sets of rows apart
    prints = rows.groupBy(*place).agg(F.bit_xor("_one").alias("_one"), F.bit_xor("_two").alias("_two"), F.count("*").alias("n"))
    prints = materialize(prints, "prints")
    sides = [prints.filter(F.col("_copy") == k) for k in (0, 1)]
    only = reduce(DataFrame.unionByName, [mine.join(other, same, "left_anti").select(*place) for mine, other in (sides, sides[::-1])])
    return rows.join(only, place, "left_semi").select("_copy", *keys, *measures)


def copy_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str], version: str) -> DataFrame:
    """keys, field, value_a, value_b: every difference between the copies, field by field.

    ``field`` is ``only_a`` or ``only_b`` for a key in one copy (values null), else the measure whose values differ; null
    equals null and differs from every number. Within a copy the latest row of a key stands and rows repeated in full count
    once; ``version`` isn't compared. Extra columns of either copy are ignored. Empty copies give every key of the other.
    """
    rows = differing_rows(latest(a, keys, measures, version), latest(b, keys, measures, version), keys, measures)
    left = rows.filter("_copy = 0").select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*measures).alias("_a"))
    right = rows.filter("_copy = 1").select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*measures).alias("_b"))
    match: Column = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    joined = left.join(right, match, "full_outer")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    fields = F.filter(F.array(*[F.struct(F.lit(m).alias("field"), F.col(f"_a.{m}").cast("string").alias("value_a"), F.col(f"_b.{m}").cast("string").alias("value_b")) for m in measures]),
                      lambda x: ~x["value_a"].eqNullSafe(x["value_b"]))
    none = F.lit(None).cast("string")
    alone = F.array(F.struct(F.when(in_a, F.lit("only_a")).otherwise(F.lit("only_b")).alias("field"), none.alias("value_a"), none.alias("value_b")))
    differences = F.when(in_a & in_b, fields).otherwise(alone)
    key_columns = [F.when(in_a, F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys]
    return joined.select(*key_columns, F.explode(differences).alias("d")).select(*keys, "d.field", "d.value_a", "d.value_b")
