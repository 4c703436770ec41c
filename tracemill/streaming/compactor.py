"""Compaction of many tiny tracefiles into few well-sized files by a checkpointed stream.

Workers list the folders and write the paths that no earlier round has seen into manifests; the driver never holds a path. The
manifests are the files of a checkpointed stream, one manifest a batch, whose tiny files are read by the workers. Each batch is written
under its batch id in overwrite mode, so a retried batch replaces what it had written and never doubles it. Finished batches
are merged into runs of well-sized files.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import delete_path, hadoop_path, scratch_path
from tracemill.sources.inputs import filesystem_of

SUMMARY_TAGS = "FNF|FNH|BRF|BRH|MCF|MCH|LF|LH"
_MARK = "\u0001\u001e\u0001"


def sections_of(body: Column) -> Column:
    """array<struct<tn, path, rows>> of a tracefile's text.

    ``rows`` are the data rows in byte order. Line ends may be LF, CRLF or CR; blank lines, comments and summaries are
    dropped; a section ends at ``end_of_record``, at the next section or at the end of the text; a TN counts for the
    section that follows it and is empty otherwise. Null and empty texts give an empty or null array.
    """
    lines = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n")
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.rlike(f"^({SUMMARY_TAGS}):"))
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.array_join(kept, "\n")), "\n(TN:[^\n]*\n)?(SF|KF):", f"{_MARK}$1$2:")
    parts = F.slice(F.split(marked, _MARK), 2, 1_000_000_000)

    def section(part: Column) -> Column:
        own = F.split(F.regexp_replace(part, "(?s)\nend_of_record.*", ""), "\n")
        named = F.element_at(own, 1).startswith("TN:")
        return F.struct(
            F.when(named, F.substring(F.element_at(own, 1), 4, 1_000_000_000)).otherwise("").alias("tn"),
            F.substring(F.when(named, F.element_at(own, 2)).otherwise(F.element_at(own, 1)), 4, 1_000_000_000).alias("path"),
            F.array_sort(F.filter(own, lambda x: ~x.rlike("^(TN|SF|KF):"))).alias("rows"),
        )

    return F.transform(parts, section)


def section_rows(shards: DataFrame) -> DataFrame:
    """One row per section of each input: input_id, section_id (a 128-bit fingerprint), tn, path, rows."""
    one = shards.select("input_id", F.explode(sections_of(F.col("body"))).alias("s")).select("input_id", "s.*")
    # lengths in front keep differing texts from running together into the same bytes
    key = F.concat_ws("\n", F.length("tn").cast("string"), F.length("path").cast("string"), "tn", "path", F.array_join("rows", "\n"))
    return one.select("input_id", F.md5(key).alias("section_id"), "tn", "path", "rows")


#: Folders that ``write_files`` spreads its files over.
FOLDERS = 64
#: Inputs of a section, or of a class, that are paired in one key of a join; larger groups are cut into blocks of this size.
BLOCK = 1024
SECTION, MEMBER, MANIFEST = "section_id string, tn string, path string, rows array<string>", "input_id bigint, section_id string", "path string"


def _list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of the files of (folder, recursive), as they are named within their file system."""
    from pyarrow import fs

    for batch in batches:
        for folder, recursive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            filesystem, base = filesystem_of(folder)
            found = [x.path for x in filesystem.get_file_info(fs.FileSelector(base, recursive=recursive)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = filesystem_of(folder)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                bodies = []
                for path in part.column(0).to_pylist():
                    with filesystem.open_input_stream(path) as f:
                        bodies.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.string())], ["path", "body"])

    return read


def write_files(shards: DataFrame, folder: str, id_col: str = "input_id", body_col: str = "body") -> int:
    """Write each body of a table to a file ``<folder>/<n>/<id>.info`` from the workers and tell how many there are.

    Null and empty bodies are empty files. A task that runs again writes the same files again. Ids are unique; rows without one share
    the file ``none``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = filesystem_of(folder)
        made = set()
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{base}/{(k or 0) % FOLDERS}"
                if place not in made:
                    filesystem.create_dir(place, recursive=True)
                    made.add(place)
                with filesystem.open_output_stream(f"{place}/{'none' if k is None else k}.info") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    # a table of tiny bodies comes in few large splits; creating files is worth more tasks
    spread = shards.select(F.col(id_col).cast("bigint"), F.col(body_col).cast("string")).repartition(4 * shards.sparkSession.sparkContext.defaultParallelism)
    written = spread.mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: The id that ``write_files`` named a file after.
FILE_ID = "try_cast(regexp_extract(path, '(-?[0-9]+)[.]info$', 1) AS BIGINT)"


class Compactor:
    """Streams tracefiles into ``<out>/sections`` (each section once) and ``<out>/members`` (which input holds which).

    ``target_bytes`` is the size aimed at for a written file; ``files_per_batch`` bounds how many discovered files a batch takes.
    Both tables have a folder per batch, ``batch=n``, or per run of merged batches, ``batch=first-last``. Restarting with the same
    ``out`` continues where the checkpoint ends.
    """

    def __init__(self, spark: SparkSession, out: str, target_bytes: int = 128 << 20, files_per_batch: int = 25_000):
        self.spark, self.out, self.target_bytes, self.files_per_batch = spark, out.rstrip("/"), target_bytes, files_per_batch

    def discover(self, folder: str) -> None:
        """List ``folder`` with its sub-folders on the workers and write manifests of the files that no earlier round has seen."""
        from pyarrow import fs

        filesystem, base = filesystem_of(folder)
        top = filesystem.get_file_info(fs.FileSelector(base)) if filesystem.get_file_info(base).type == fs.FileType.Directory else []
        root = folder.rstrip("/")
        places = [(root, False), *((f"{root}/{x.base_name}", True) for x in top if x.type == fs.FileType.Directory and not x.base_name.startswith(("_", ".")))] if top else []
        listed = self.spark.createDataFrame(places, "folder string, recursive boolean").repartition(max(1, len(places))).mapInArrow(_list_files, MANIFEST)
        new = listed.join(self._read("discovered", MANIFEST), "path", "left_anti")
        rounds = len(self._folders("discovered"))
        new.hint("rebalance").write.option("maxRecordsPerFile", self.files_per_batch).mode("overwrite").parquet(f"{self.out}/discovered/batch={rounds}")

    def _folders(self, name: str) -> list[tuple[int, int, str, int, int]]:
        """(first, last, path, bytes, files) of the finished folders of a table, without those whose batches a run has taken over."""
        fs, path = hadoop_path(self.spark, f"{self.out}/{name}")
        found = []
        for status in fs.listStatus(path) if fs.exists(path) else ():
            m = re.fullmatch(r"batch=(\d+)(?:-(\d+))?", status.getPath().getName())
            files = list(fs.listStatus(status.getPath())) if m else []
            if any(f.getPath().getName() == "_SUCCESS" for f in files):
                data = [f.getLen() for f in files if f.getPath().getName().startswith("part-")]
                found.append((int(m[1]), int(m[2] or m[1]), str(status.getPath()), sum(data), len(data)))
        runs = [(a, b) for a, b, *_ in found if b > a]
        return sorted(x for x in found if not any(a <= x[0] and x[1] <= b and (a, b) != (x[0], x[1]) for a, b in runs))

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        folders = [path for _, last, path, _, _ in self._folders(name) if before is None or last < before]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        session.conf.set("spark.sql.adaptive.enabled", "true")
        session.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(self.target_bytes))
        rows = section_rows(batch)
        staged = f"{self.out}/staged/batch={batch_id}"
        rows.write.mode("overwrite").parquet(staged)
        rows = session.read.schema(rows.schema).parquet(staged)
        rows.select("input_id", "section_id").distinct().hint("rebalance").write.mode("overwrite").parquet(f"{self.out}/members/batch={batch_id}")
        first = rows.dropDuplicates(["section_id"]).select("section_id", "tn", "path", "rows")
        earlier = self._read("sections", SECTION, before=batch_id).select("section_id")
        # of all earlier sections only those that occur again are shuffled: the batch is the small side
        again = earlier.join(rows.select("section_id").distinct(), "section_id", "left_semi")
        first.join(again, "section_id", "left_anti").hint("rebalance").write.mode("overwrite").parquet(f"{self.out}/sections/batch={batch_id}")
        delete_path(session, staged)

    def run(self, folder: str, input_id: str = "xxhash64(path)") -> None:
        """Process every file of ``folder`` that wasn't there before, then stop.

        ``input_id`` is a SQL expression over ``path``, the file's path within its file system.
        """
        self.discover(folder)
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        paths = self.spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.out}/discovered")
        source = paths.repartition(tasks).mapInArrow(_reader(folder), "path string, body string").select(F.expr(input_id).alias("input_id"), "body")
        query = source.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", f"{self.out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def consolidate(self) -> None:
        """Merge neighbouring folders below the target size into runs, so that few well-sized files are left.

        A folder is rewritten only while it, or twice its mean file, is smaller than the target; the run is read once it is complete, and what it took over is then removed.
        """
        for name, schema, key in (("sections", SECTION, "section_id"), ("members", MEMBER, "input_id")):
            group: list[tuple[int, int, str, int, int]] = []
            for folder in [*self._folders(name), None]:
                if folder is not None and (folder[3] < self.target_bytes or folder[3] < folder[4] * self.target_bytes // 2):
                    group.append(folder)
                    continue
                if len(group) > 1:
                    self._merge(name, schema, key, group)
                group = []

    def _merge(self, name: str, schema: str, key: str, group: list[tuple[int, int, str, int, int]]) -> None:
        first, last = group[0][0], group[-1][1]
        pieces = max(1, math.ceil(sum(g[3] for g in group) / self.target_bytes))
        self.spark.read.schema(schema).parquet(*[g[2] for g in group]).repartition(pieces, key).write.mode("overwrite").parquet(f"{self.out}/{name}/batch={first}-{last}")
        for g in group:
            if (g[0], g[1]) != (first, last):
                delete_path(self.spark, g[2])

    def sizes(self, name: str = "sections") -> list[tuple[int, int]]:
        """(bytes, files) of each folder of a table."""
        return [(size, files) for _, _, _, size, files in self._folders(name)]

    def sections(self) -> DataFrame:
        return self._read("sections", SECTION)

    def members(self) -> DataFrame:
        return self._read("members", MEMBER).distinct()


def compact_table(spark: SparkSession, shards: DataFrame, **options: int) -> Compactor:
    """Write the bodies of a table to tiny files below the shared folder and compact them there; the tiny files are removed again."""
    out = scratch_path(spark, "compact")
    write_files(shards, f"{out}/files")
    compactor = Compactor(spark, out, **options)
    compactor.run(f"{out}/files", FILE_ID)
    compactor.consolidate()
    delete_path(spark, f"{out}/files")
    return compactor


def input_classes(members: DataFrame) -> DataFrame:
    """Inputs with exactly the same sections form a class: input_id, class_id (its smallest input), size, sections."""
    signature = members.groupBy("input_id").agg(F.md5(F.array_join(F.array_sort(F.collect_set("section_id")), "")).alias("signature"), F.count("*").alias("sections"))
    classes = signature.groupBy("signature").agg(F.min("input_id").alias("class_id"), F.count("*").alias("size"))
    return signature.join(classes, "signature").select("input_id", "class_id", "size", "sections")


def _pairs_within(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b), a < b, for items of the same group, with repeats; groups beyond BLOCK items are cut into blocks that meet pairwise.

    No key of the join holds more than about BLOCK items of a side, whatever the size of the group.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = placed.select(group, F.col("own").alias("i"), F.col("other").alias("j"), F.col(item).alias("a"))
    right = placed.select(group, F.col("other").alias("i"), F.col("own").alias("j"), F.col(item).alias("b"))
    return left.join(right, [group, "i", "j"]).filter("a < b").select("a", "b")


def class_links(members: DataFrame, classes: DataFrame) -> DataFrame:
    """class_a < class_b for any two classes that share a whole section, each pair once."""
    keys = members.join(classes.filter("input_id = class_id").select("input_id"), "input_id", "left_semi")
    return _pairs_within(keys, "section_id", "input_id").distinct().select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))


def linked_inputs(members: DataFrame) -> DataFrame:
    """input_id, class_id, size, sections, links: per input its class of identical inputs and with how many others it shares a section."""
    classes = input_classes(members)
    sizes = classes.filter("input_id = class_id").select("class_id", "size")
    links = class_links(members, classes)
    both = reduce(DataFrame.unionByName, [links.select(F.col(x).alias("class_id"), F.col(y).alias("other")) for x, y in (("class_a", "class_b"), ("class_b", "class_a"))])
    counted = both.join(sizes.select(F.col("class_id").alias("other"), F.col("size").alias("n")), "other").groupBy("class_id").agg(F.sum("n").alias("linked"))
    return classes.join(counted, "class_id", "left").select("input_id", "class_id", "size", "sections", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))


def shared_pairs(members: DataFrame) -> DataFrame:
    """input_a < input_b for any two inputs that share a whole section, each pair once.

    Links are found between class representatives and then spread to the members, so copies of an input don't multiply
    the join of sections. Inputs without sections (null and empty bodies) have no pair.
    """
    classes = input_classes(members)
    links = class_links(members, classes)
    blocks = classes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("input_id"), F.col("blocks")).cast("int"))
    a = blocks.select(F.col("class_id").alias("class_a"), F.col("input_id").alias("a"))
    b = blocks.select(F.col("class_id").alias("class_b"), "block", F.col("input_id").alias("b"))
    wide = blocks.filter("input_id = class_id").select(F.col("class_id").alias("class_b"), "blocks")
    spread = links.join(wide, "class_b").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    across = spread.join(a, "class_a").join(b, ["class_b", "block"]).select("a", "b")
    within = _pairs_within(classes.filter("size > 1"), "class_id", "input_id")
    return across.unionByName(within).select(F.least("a", "b").alias("input_a"), F.greatest("a", "b").alias("input_b"))
