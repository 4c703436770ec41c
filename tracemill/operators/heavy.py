"""Per-key results where a few keys hold most rows, by value-frequency compression.

Rows are grouped by key *and value* first; everything per key (row counts, exact distinct counts, modes, percentiles) then
comes from the weighted values. The first grouping combines on the map side, so a key with a third of all rows reaches its
reducers as its distinct values only, spread over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import materialize


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): how often each value occurs under each key; null keys and null values are kept."""
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def key_weights(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"))


def heavy_keys(weighted: DataFrame, percent: int = 1) -> DataFrame:
    """Non-null keys with at least ``percent`` percent of all rows, rows with a null key counted in the total."""
    # written, so that keys and total come from one reading of the rows
    keys = materialize(key_weights(weighted), "key-weights")
    total = keys.agg(F.sum("n_rows").alias("total")).scalar()
    return keys.filter(F.col("key").isNotNull() & (F.col("n_rows") * 100 >= total * percent))


def plan_ranges(splitters: DataFrame) -> DataFrame:
    """One row per non-null plan with its distinct non-null splitters; a plan may have none. The table of splitters is of fixed size."""
    return splitters.filter("plan_id IS NOT NULL").groupBy("plan_id").agg(F.array_sort(F.collect_set("splitter")).alias("bounds"))


def with_ranges(keys: DataFrame, splitters: DataFrame) -> DataFrame:
    """Each key once per plan, with the number of the range it falls in (how many splitters are at or below it, in byte order)."""
    plans = plan_ranges(splitters).agg(F.collect_list(F.struct("plan_id", "bounds")).alias("plans")).scalar()
    each = keys.withColumn("plan", F.explode(plans))
    return each.select("*", F.col("plan.plan_id").alias("plan_id"), F.size(F.filter("plan.bounds", lambda b: b <= F.col("key"))).alias("range_no")).drop("plan")


def profile(df: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Per key: n_rows, n_null, n_distinct, mode (the smallest of the most frequent) and discrete percentiles pNN.

    ``value`` holds whole numbers from 0 to 2^64-1 or null; nulls count in n_rows and n_null only. The percentile p is the
    smallest value whose cumulated weight reaches p % of the non-null rows. Null keys form a key of their own. A key without
    non-null values has null percentiles and mode. The weighted values are cut into ranges of (key, value), so a key with most values
    is spread over many of them; the weight before a range comes from the sums of the ranges, and no task orders all values of a key.
    """
    compressed = compress(df.select(key, F.col(value).cast("decimal(20,0)").alias(value)), key, value)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(materialize(compressed, "weighted").repartitionByRange(pieces, "key", "value").withColumn("piece", F.spark_partition_id()), "ranges")
    by_piece = ranged.groupBy("key", "piece").agg(
        F.sum("weight").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("weight"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("n_distinct"),
        F.max(F.when(F.col("value").isNotNull(), F.struct(F.col("weight"), (-F.col("value")).alias("negative")))).alias("top"),
    )
    by_piece = materialize(by_piece, "pieces")
    stats = by_piece.groupBy("key").agg(F.sum("rows").alias("n_rows"), F.sum("nulls").alias("n_null"), F.sum("n_distinct").alias("n_distinct"), F.max("top").alias("top"))
    stats = stats.select("key", "n_rows", "n_null", "n_distinct", (-F.col("top.negative")).cast("decimal(20,0)").alias("mode"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("rows") - F.col("nulls")
    whole = Window.partitionBy("key")
    ranks = [F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.col("known") * p / F.lit(100)), F.lit(1)).cast("bigint").alias("rank")) for p in percents]
    targets = by_piece.select("key", "piece", F.coalesce(F.sum(known).over(earlier), F.lit(0)).alias("before"), known.alias("own"), F.sum(known).over(whole).alias("known")).withColumn("t", F.explode(F.array(*ranks)))
    # each rank is looked for in the one range that holds it
    targets = targets.filter((F.col("t.rank") > F.col("before")) & (F.col("t.rank") <= F.col("before") + F.col("own"))).groupBy("key", "piece", "before").agg(F.collect_list("t").alias("ts"))
    targets = targets.select(F.col("key").alias("k"), F.col("piece").alias("at"), "before", "ts")
    order = Window.partitionBy("key", "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.filter("value IS NOT NULL").join(targets, F.col("key").eqNullSafe(F.col("k")) & (F.col("piece") == F.col("at"))).withColumn("upto", F.col("before") + F.sum("weight").over(order))
    hit = F.filter("ts", lambda t: (t["rank"] <= F.col("upto")) & (t["rank"] > F.col("upto") - F.col("weight")))
    found = ranked.select("key", "value", F.explode(F.transform(hit, lambda t: t["p"])).alias("p"))
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    return stats.join(wide.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left").drop("k")
