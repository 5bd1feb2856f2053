"""Raw log lines with their true position in the file."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.schema import POSITION

FORMATS = ("auto", "combined", "iis")
# Endings by which the text reader decompresses. None: written in a framing that only it reads.
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".deflate": None, ".lz4": None, ".snappy": None}
# Schemes that Hadoop and Arrow spell differently.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
BOM = b"\xef\xbb\xbf"


def scan_log_text(spark: SparkSession, path) -> DataFrame:
    """``src_file, block_start, seq, line`` of every line below ``path``.

    A file split over many tasks keeps its order: splits sort by
    ``block_start`` and rows inside a split by ``seq``. Undecodable bytes
    become U+FFFD.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        F.make_valid_utf8("value").alias("line"))


def detect_format(lines: DataFrame) -> DataFrame:
    """``src_file, fmt``: iis when the first line of the file starts with ``#``.

    The answer rides in the lowest bit of the smallest row number, so the
    aggregate is one long per file.
    """
    first = F.min(F.col("seq") * 2 + F.when(F.col("line").startswith("#"), 0).otherwise(1))
    per_block = lines.groupBy("src_file", "block_start").agg(first.alias("code"))
    return (per_block.groupBy("src_file")
            .agg(F.min_by(F.col("code") % 2, "block_start").alias("code"))
            .select("src_file", F.when(F.col("code") == 0, "iis").otherwise("combined").alias("fmt")))


def _first_bytes(path: str, n: int = 4) -> bytes | None:
    """First bytes of a file's text; None when Arrow cannot open it. ``path`` has the escapes of a URI."""
    codec = CODECS.get(PurePosixPath(path).suffix, "")
    if codec is None:
        return None
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        scheme, rest = "file", path
    slashes = "" if rest.startswith("//") else "//"
    try:
        where, name = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{slashes}{quote(rest, safe='/:%')}")
        with where.open_input_stream(name, compression=codec or None, buffer_size=4096) as stream:
            return stream.read(n)
    except (pa.ArrowException, OSError, ImportError):
        return None


def file_formats(spark: SparkSession, path) -> DataFrame:
    """``src_file, fmt`` of the files below ``path``, as ``detect_format`` finds them, from their first bytes only.

    The files are spread over tasks by name. ``fmt`` is null for a file that only Spark can open: its file
    system or its compression is one that Arrow does not know.
    """
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [_first_bytes(p) for p in batch["src_file"]]
            fmt = [None if h is None else "iis" if h.removeprefix(BOM).startswith(b"#") else "combined" for h in heads]
            yield pd.DataFrame({"src_file": batch["src_file"], "fmt": pd.Series(fmt, dtype=object)})

    # Without its content column, the reader lists a file and does not open it.
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("src_file"))
    return names.mapInPandas(look, "src_file string, fmt string")


def sample_raw_lines(events: DataFrame, n: int = 1000) -> DataFrame:
    """Up to ``n`` stored raw lines, blanks left out, in no given order."""
    return events.filter(F.col("raw") != "").select("raw").limit(n)


def position() -> list:
    return [F.col(c) for c in POSITION]
