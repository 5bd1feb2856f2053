"""Ingest that may be repeated: files are taken once, and a batch counts only when it is committed.

A batch writes its events below ``batch=<id>`` and then one small file that names the log files in it. Readers
look at committed batches only, so a run that dies in between leaves nothing to see, and a run that is repeated
finds its files committed. A file that changed since is taken again, and its earlier rows no longer count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.rules import DEFAULT_RULES, RuleSet
from spoor.session import match
from spoor.sources.parse import parse_lines
from spoor.sources.store import write_events
from spoor.sources.text import file_formats, scan_log_text

FILE = ["src_file", "length", "modified"]
COMMIT_SCHEMA = T.StructType([
    T.StructField("src_file", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType()),
    T.StructField("committed", T.TimestampType()), T.StructField("case_id", T.IntegerType()), T.StructField("batch", T.StringType())])


def list_files(spark: SparkSession, source) -> DataFrame:
    """``src_file, length, modified, path`` of the files below ``source``; none of them is opened.

    ``src_file`` is the name as events carry it, with the escapes of a URI; ``path`` is the one to read from."""
    return spark.read.format("binaryFile").load(source).select(
        F.col("_metadata.file_path").alias("src_file"), "length", F.col("modificationTime").alias("modified"), "path")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The files of each committed batch."""
    folder = f"{path}/_commits"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(folder)


def new_files(spark: SparkSession, source, path: str, case_id: int) -> DataFrame:
    """Files that no committed batch of the case holds in their present state."""
    done = commits(spark, path).filter(F.col("case_id") == case_id).select(*FILE)
    return list_files(spark, source).join(done, FILE, "left_anti")


def write_batch(events: DataFrame, files: DataFrame, path: str, case_id: int, batch: str,
                rules: RuleSet = DEFAULT_RULES) -> dict[str, int]:
    """Write a batch, then commit it. Both steps replace what an earlier try of the same batch left.

    The commit is one file, renamed into place: it is there whole or not at all.
    """
    counts = write_events(events, f"{path}/batch={batch}", case_id, rules, mode="overwrite")
    (files.select(*FILE, F.current_timestamp().alias("committed"), F.lit(case_id).alias("case_id")).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/_commits/batch={batch}"))
    return counts


def ingest_new(spark: SparkSession, source, path: str, case_id: int, fmt: str = "auto",
               rules: RuleSet = DEFAULT_RULES) -> dict[str, int]:
    """Take the files of ``source`` that are new or changed: ``ok, failed, unparsed, files``.

    Called again with the same files it does nothing. Their names pass through the driver, as those of any
    table that Spark reads do; their text does not.
    """
    found = [tuple(r) for r in new_files(spark, source, path, case_id).select(*FILE, "path").collect()]
    if not found:
        return {"ok": 0, "failed": 0, "unparsed": 0, "files": 0}
    files = spark.createDataFrame([f[:3] for f in found], T.StructType(COMMIT_SCHEMA.fields[:3]))
    names = [f[3] for f in found]
    formats = file_formats(spark, names) if fmt == "auto" else None
    events = parse_lines(scan_log_text(spark, names), fmt, keep_unparsed=True, formats=formats)
    counts = write_batch(events, files, path, case_id, uuid.uuid4().hex, rules)
    return {**counts, "files": len(found)}


def read_committed(spark: SparkSession, path: str, case_id: int | None = None) -> DataFrame:
    """Events of one case, or of all, from committed batches; of a file that was taken again only its last rows.

    Other batches are pruned by their folder. A file is matched by name only if some file was taken twice.
    """
    known = commits(spark, path) if case_id is None else commits(spark, path).filter(F.col("case_id") == case_id)
    batches = [r.batch for r in known.select("batch").distinct().collect()]
    if not batches:
        raise FileNotFoundError(f"no committed batch below {path}")
    rows = spark.read.parquet(path).filter(F.col("batch").isin(*batches) & (F.col("verdict") == "ok")).drop("verdict")
    if case_id is not None:
        rows = rows.filter(F.col("case_id") == case_id)
    last = Window.partitionBy("case_id", "src_file").orderBy(F.desc("committed"), F.desc("batch"))
    stale = known.withColumn("place", F.row_number().over(last)).filter("place > 1").select("case_id", "src_file", "batch")
    return rows if stale.isEmpty() else match(rows, stale, ["case_id", "src_file", "batch"], "left_anti")


def stream_batches(spark: SparkSession, source: str, path: str, case_id: int, checkpoint: str, fmt: str = "combined",
                   rules: RuleSet = DEFAULT_RULES):
    """Start a stream that takes files as they appear; it stops when all present ones are taken.

    A micro-batch that runs a second time after a failure has its old number, so it replaces what it left.
    """
    def take(lines: DataFrame, number: int) -> None:
        files = lines.groupBy("src_file").agg(F.first("length").alias("length"), F.first("modified").alias("modified"))
        rows = lines.select("src_file", "block_start", F.monotonically_increasing_id().alias("seq"), "line")
        events = parse_lines(rows, fmt, keep_unparsed=True)
        write_batch(events, files, path, case_id, f"stream-{case_id}-{number}", rules)
    meta = F.col("_metadata")
    lines = spark.readStream.text(source).select(
        meta["file_path"].alias("src_file"), meta["file_block_start"].alias("block_start"),
        F.make_valid_utf8("value").alias("line"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modified"))
    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
