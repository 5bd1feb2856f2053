"""Packed token ids: best-fit-decreasing over a segment tree, written as binary matrices."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.bpe import read_ranks
from spoor.llm.files import committed, open_fs

LENGTH = 2048              # ids of a packed row
POOL_IDS = 1 << 22         # ids that are packed together; a task holds one pool at a time
SEGMENTS = "_segments"
COLUMNS = ("doc_id long, piece int, doc_start long, length int, pool string, pack_row int, row_start int, "
           "ids_crc32 long, n_tokens long")


class CapacityTree:
    """Segment tree over the room left in a row: finds the least room of an open row that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) with the least room of at least ``need``, and out of the tree."""
        count, at = self.count, self.leaves + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> tuple[list[int], list[int], int]:
    """Row and start of each piece (each at most ``length`` long), and the number of rows."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rows, starts, n, tree = [0] * len(lengths), [0] * len(lengths), 0, CapacityTree(length)
    for i in order:
        found = tree.take(lengths[i])
        if found is None:
            found, n = (length, n), n + 1
        room, row = found
        rows[i], starts[i] = row, length - room
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows, starts, n


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def _pack(pool: list[tuple[int, np.ndarray]], length: int, pad: int, out) -> list[tuple]:
    """Write one pool: matrix of ids, cumulative segment lengths and position resets of all rows."""
    pieces = [(doc, k, at, ids[at:at + length], len(ids)) for doc, ids in pool
              for k, at in enumerate(range(0, len(ids), length))]
    rows, starts, n = best_fit_decreasing([len(p[3]) for p in pieces], length)
    kind = np.uint16 if pad < 1 << 16 else np.uint32
    matrix = np.full((n, length), pad, kind)
    segments: list[list[int]] = [[] for _ in range(n)]
    found = []
    for (doc, k, at, ids, total), row, start in zip(pieces, rows, starts):
        matrix[row, start:start + len(ids)] = ids
        segments[row].append(start + len(ids))
        found.append((doc, k, at, len(ids), row, start, zlib.crc32(ids.astype("<u4").tobytes()), total))
    ends = [[0, *sorted(s)] for s in segments]
    buffer = io.BytesIO()
    np.savez(buffer, ids=matrix, cu_seqlens=np.array([x for e in ends for x in e], np.int32),
             row_ptr=np.cumsum([0] + [len(e) for e in ends]).astype(np.int64),
             resets=np.array([x for e in ends for x in e[:-1]], np.int32))
    out.write(buffer.getbuffer())
    return found


def _packer(folder: str, path: str, pattern: str, eos: int, length: int, pool_ids: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, task, number = _encoding(path, pattern), TaskContext.get(), 0
        names = [c.split()[0] for c in COLUMNS.split(", ")]

        def done(pool):
            nonlocal number
            # Each attempt has names of its own; the list of segments names those that count.
            name = f"pool-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}"
            number += 1
            with committed(folder, f"{name}.npz", task.taskAttemptId()) as out:
                found = _pack(pool, length, eos, out)
            frame = pd.DataFrame([(*f[:4], name, *f[4:]) for f in found], columns=names)
            return frame.astype({"doc_id": "Int64"})

        pool, size = [], 0
        for rows in batches:
            for doc, text in zip(rows["doc_id"], rows["text"]):
                ids = np.array([*encoding.encode_ordinary(text or ""), eos], np.uint32)
                pool.append((None if pd.isna(doc) else int(doc), ids))
                size += len(ids)
                if size >= pool_ids:
                    yield done(pool)
                    pool, size = [], 0
        if pool:
            yield done(pool)
    return of


def pack_documents(docs: DataFrame, folder: str, path: str, pattern: str, eos: int, length: int = LENGTH,
                   pool_ids: int = POOL_IDS) -> DataFrame:
    """Encode every text, pack the ids into rows of ``length`` and write them below ``folder``.

    ``docs``: doc_id, text. Each document ends in ``eos``, which also fills rows; so a null or empty text
    is one id. Longer documents are split without loss. Each task packs pools of about ``pool_ids`` ids
    of its own input, so nothing is shuffled; a pool is one file ``<pool>.npz`` with ids, cu_seqlens with
    row_ptr, and resets (where positions begin again). The result has one row per segment; it is
    also what shows which documents lie where. Repeated rows are packed again.

    All is written before this returns, the segments below ``folder`` too, and the result reads them: however
    often or little of it is used, the pools are packed once. Pools that a lost attempt left are in no segment.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInPandas(_packer(folder, path, pattern, eos, length, pool_ids), COLUMNS)
    packed.write.mode("overwrite").parquet(f"{folder}/{SEGMENTS}")
    return docs.sparkSession.read.schema(COLUMNS).parquet(f"{folder}/{SEGMENTS}")


def read_pool(folder: str, pool: str) -> dict[str, np.ndarray]:
    """The arrays of one pool."""
    where, path = open_fs(f"{folder}/{pool}.npz")
    with where.open_input_stream(path, compression=None) as source:
        return dict(np.load(io.BytesIO(source.read())))


def positions(arrays: dict[str, np.ndarray], row: int) -> np.ndarray:
    """Position of each id of a row: begins again at 0 with each segment and with the filling."""
    cu = arrays["cu_seqlens"][arrays["row_ptr"][row]:arrays["row_ptr"][row + 1]]
    at = np.arange(arrays["ids"].shape[1])
    return at - cu[np.searchsorted(cu, at, side="right") - 1]
