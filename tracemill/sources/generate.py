"""Synthetic tracefiles for measurements: sorted shards that share their sources, and files with very many sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _count(*parts: Column) -> Column:
    """A count from 0 to 99 that depends on ``parts`` alone, every fourth one 0."""
    h = F.pmod(F.xxhash64(*parts), F.lit(400))
    return F.when(h >= 300, 0).otherwise(h % 100).cast("string")


def sections(spark: SparkSession, shards: int, sources: int, lines: int, functions: int = 0, branches: int = 0) -> DataFrame:
    """shard, source_no, text: one section per shard and source with ``lines`` DA rows, functions and branches; the same for the same numbers."""
    rows = spark.range(shards * sources, numPartitions=max(1, min(shards, 8 * spark.sparkContext.defaultParallelism))).select(F.floor(F.col("id") / sources).alias("shard"), (F.col("id") % sources).alias("source_no"))
    path = F.concat(F.lit("/work/pkg"), (F.col("source_no") % 97).cast("string"), F.lit("/file_"), F.lpad(F.col("source_no").cast("string"), 8, "0"), F.lit(".c"))

    def each(n: int, text) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), text)
        return F.when(F.lit(n > 0), F.concat(F.array_join(own, "\n"), F.lit("\n"))).otherwise("")

    s = lambda c: c.cast("string")
    body = F.concat(
        F.lit("TN:\nSF:"), path, F.lit("\n"),
        each(functions, lambda i: F.concat(F.lit("FN:"), s(i), F.lit(",fn"), s(i), F.lit("\nFNDA:"), _count(F.col("shard"), F.col("source_no"), F.lit("fn"), i), F.lit(",fn"), s(i))),
        each(branches, lambda i: F.concat(F.lit("BRDA:"), s(i), F.lit(",0,0,"), _count(F.col("shard"), F.col("source_no"), F.lit("br"), i))),
        each(lines, lambda i: F.concat(F.lit("DA:"), s(i), F.lit(","), _count(F.col("shard"), F.col("source_no"), i))),
        F.lit("end_of_record"))
    return rows.select("shard", "source_no", body.alias("text"))


def write_shards(spark: SparkSession, folder: str, shards: int, sources: int, lines: int, functions: int = 0, branches: int = 0) -> None:
    """Write ``shards`` tracefiles of ``sources`` sections each below ``folder``, in the order of their sources."""
    made = sections(spark, shards, sources, lines, functions, branches)
    made.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "source_no").select("text").write.mode("overwrite").text(folder)
