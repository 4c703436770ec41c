"""Literal-key merge of shards that keep arriving.

Sums of counts, least and greatest texts and distinct keys don't depend on the order of arrival, so each batch of new files is merged on its
own, written under its batch id (a retry replaces it), and the merged state is the merge of the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.native import Merge, TraceError, merge_records
from tracemill.sources.lcov import records_from_table

_RECORDS = "path string, kind tinyint, a decimal(20,0), b decimal(20,0), c decimal(20,0), value decimal(20,0), text string, extra string, flags int, copies bigint"


def as_records(merged: DataFrame) -> DataFrame:
    """Merged rows in the shape of records again, so that merging them with others gives what merging all at once gives.

    ``copies`` says how many rows a row stands for; a null branch count becomes the dash flag. Of differing texts the least and the
    greatest are kept, the second in a row without hits, so that later batches still see the conflict.
    """
    kind, c = F.col("kind"), F.col
    dash = (kind == 6) & c("value").isNull()
    one = F.array(F.struct(c("chosen").alias("text"), c("value"), c("copies")))
    two = F.array(F.struct(c("chosen").alias("text"), c("value"), (c("copies") - 1).alias("copies")), F.struct(c("most").alias("text"), F.lit(0).cast("decimal(20,0)").alias("value"), F.lit(1).cast("bigint").alias("copies")))
    rows = merged.withColumn("_r", F.explode(F.when(c("conflict"), two).otherwise(one)))
    text = F.when(kind.isin(4, 5, 9) | ((kind == 6) & (c("flags").bitwiseAND(1) == 0)), c("name")).when(kind.isin(1, 7), c("_r.text")).otherwise("")
    extra = F.when(kind == 8, c("_r.text")).when((kind == 3) & (c("flags").bitwiseAND(1) == 0), c("name")).otherwise("")
    return rows.select("path", "kind", "a", "b", "c", F.coalesce("_r.value", F.lit(0)).cast("decimal(20,0)").alias("value"), text.alias("text"), extra.alias("extra"),
                       (c("flags") + F.when(dash, 4).otherwise(0)).cast("int").alias("flags"), c("_r.copies").cast("bigint").alias("copies"))


class IncrementalMerge:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch, or raise TraceError for a malformed file and write nothing: the batch is tried again once the file is mended."""
        # parsed once for the check and the merge
        records = records_from_table(batch).persist()
        try:
            merge = Merge(records)
            try:
                merge.check()
            except TraceError as e:
                file = batch.filter(F.col("input_id") == e.input_id).select("file", "body").first()
                line = file.body.encode("utf-8")[: e.pos].count(b"\n") + 1
                raise TraceError(f"{file.file}:{line}: {e}", e.input_id, e.pos) from None
            as_records(merge.merged).write.mode("overwrite").parquet(f"{self.out}/batches/batch_id={batch_id}")
        finally:
            records.unpersist()

    def run(self, folder: str) -> None:
        """Take in all tracefiles of a folder that weren't taken in before."""
        stream = self.spark.readStream.text(folder, wholetext=True, recursiveFileLookup=True)
        named = stream.select(F.xxhash64("_metadata.file_path").alias("input_id"), F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))
        query = named.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def merged(self) -> DataFrame:
        return merge_records(self.spark.read.schema(_RECORDS).parquet(f"{self.out}/batches"))
