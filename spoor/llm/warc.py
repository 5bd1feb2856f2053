"""WARC archives, each record compressed on its own with a Zstandard dictionary of its archive."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import run_path
from spoor.llm.files import committed, open_fs

DICTIONARY_MAGIC = 0x184D2A5D     # skippable frame that holds the dictionary
DICTIONARY_BYTES = 1 << 15
SAMPLE_BYTES = 1 << 20            # of an archive's records, from all over it, that its dictionary is built from
PIECE_BYTES = 1 << 17             # of one record in the sample
ARCHIVE_BYTES = 1 << 25           # uncompressed; a task holds so much and starts another archive beyond it
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LIST, LIST_COLUMNS = "_archives", "archive string, records long"
COLUMNS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    number = re.search(r"(-?\d+)>$", uri or "")
    return int(number[1]) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record. A revisit keeps the HTTP header, with the length of the full payload, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; too few or too small ones serve as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def sample(records: list[bytes]) -> list[bytes]:
    """Pieces of records from all over an archive, by the hash of a record, ``SAMPLE_BYTES`` at most.

    Of a very long record a piece from a place that also follows from its hash, so one record is never the whole sample.
    """
    hashed = sorted((zlib.crc32(r), k) for k, r in enumerate(records))
    pieces, size = [], 0
    for h, k in hashed:
        r = records[k]
        start = h % (len(r) - PIECE_BYTES) if len(r) > PIECE_BYTES else 0
        pieces.append(r[start:start + PIECE_BYTES])
        size += len(pieces[-1])
        if size >= SAMPLE_BYTES:
            break
    return pieces


def write_archive(out, records: Iterator[bytes]) -> int:
    """Dictionary frame, then one frame for each record. The records of one archive are held until they are written."""
    records = list(records)
    dictionary = build_dictionary(sample(records))
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    for r in records:
        out.write(compress(r))
    return len(records)


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, as a stream. ``source``: binary file."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    raw = source.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    stream = io.BufferedReader(reader.stream_reader(source, read_across_frames=True), 1 << 16)
    while stream.readline():
        header = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            header[name] = value
        block = stream.read(int(header["Content-Length"]))
        stream.read(4)
        yield header, block


def _writer(folder: str, archive_bytes: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        rows = (r for b in batches for r in zip(b["page_id"], b["url"], b["html"], b["refers_to"]))
        row, number = next(rows, None), 0

        def records():
            nonlocal row
            size = 0
            while row is not None and size < archive_bytes:
                page_id, url, text, first = row
                payload = (text or "").encode("utf-8", "surrogatepass")
                made = record(None if pd.isna(page_id) else int(page_id), url, payload,
                              None if pd.isna(first) else int(first))
                size += len(made)
                row = next(rows, None)
                yield made

        while row is not None:
            # Each attempt has names of its own: only archives in a committed list are read.
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            with committed(folder, name, task.taskAttemptId()) as out:
                n = write_archive(out, records())
            yield pd.DataFrame({"archive": [name], "records": [n]})
            number += 1
    return of


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to``: of equal payloads of ``min_bytes`` or more, all but the
    one with the smallest page_id refer to it. Rows that repeat this page_id are all responses, and so
    are rows whose copies all have a null page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"_sha": F.sha1(F.encode("html", "UTF-8")), "_size": F.octet_length("html")})
    firsts = rows.groupBy("_sha", "_size").agg(F.min("page_id").alias("_first"))
    # The narrow side is hashed; the pages are neither sorted nor gathered, and a hot payload can be split.
    marked = rows.join(firsts.hint("shuffle_hash"), ["_sha", "_size"])
    refers = F.when((F.col("_size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return marked.select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below ``folder``, which all executors share, and then the list of them: (archive, records).

    ``pages``: page_id, url, html; other columns are ignored. A null html is an empty payload. The list is
    written by the tasks that count, so what a lost or doubled attempt left beside it is not in it;
    writing again into the same folder replaces the list.
    """
    made = mark_revisits(pages, min_bytes).mapInPandas(_writer(folder, archive_bytes), LIST_COLUMNS)
    made.write.mode("overwrite").parquet(f"{folder}/{LIST}")
    return pages.sparkSession.read.schema(LIST_COLUMNS).parquet(f"{folder}/{LIST}")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def row(header, block):
        end = block.index(b"\r\n\r\n") + 4
        size = int(re.search(rb"Content-Length: (\d+)", block[:end])[1])
        said, payload = header["WARC-Payload-Digest"].removeprefix("sha1:"), block[end:]
        if header["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != said):
            raise ValueError(f"damaged record {header['WARC-Record-ID']}")
        return (_page_id(header["WARC-Record-ID"]), size, said, header["WARC-Type"],
                _page_id(header.get("WARC-Refers-To")), header.get("WARC-Target-URI"))

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            where, inner = open_fs(path)
            rows = []
            with where.open_input_stream(inner, compression=None) as source:
                for header, block in read_archive(source):
                    rows.append(row(header, block))
                    if len(rows) == 4096:
                        yield _frame(rows, names)
                        rows = []
            yield _frame(rows, names)


def _frame(rows, names):
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in the folder's list. Payloads are checked against their digests."""
    listed = spark.read.schema(LIST_COLUMNS).parquet(f"{folder}/{LIST}")
    files = listed.select(F.concat(F.lit(f"{folder}/"), "archive").alias("path")).repartition("path")
    return files.mapInPandas(_reader, COLUMNS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages into archives in the shared folder and read them back; an empty table gives no rows."""
    folder = run_path(pages.sparkSession, "warc")
    write_warc(pages, folder, min_bytes)
    return read_warc(pages.sparkSession, folder)
