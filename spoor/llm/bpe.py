"""Byte-level BPE: encoding by rounds of merges over padded matrices, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)   # padded lengths of the matrices
BUCKET_OF = [min(i for i, b in enumerate(BUCKETS) if b >= n) for n in range(BUCKETS[-1] + 1)]
CELLS = 1 << 18        # cells of one matrix at most
KEPT_WORDS = 1 << 17   # chunks a worker remembers before it forgets all; it holds them while it does other work, too
STOPS = tuple(".,;:!?")
KEPT_BYTES = 64        # longer chunks are not remembered
GROUP_CHARS = 1 << 22  # texts whose new pieces share matrices
NONE = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """Open-addressed hash table (left id, right id) -> id of the merged token, probed by whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys) + 1).bit_length()))
        self.size = 1 << (64 - int(self.shift))
        self.keys = np.full(self.size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ids = np.full(self.size, NONE)
        ids, at, todo = np.array(merged, np.int32), self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[todo[free]]] = keys[todo[free]]
            won = self.keys[at[todo]] == keys[todo]
            self.ids[at[todo[won]]] = ids[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) % self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, ``NONE`` where there is none; a negative id never merges."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ids[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at_open = (at[open_] + 1) % self.size
            at[open_] = at_open
            hit = self.keys[at_open] == keys[open_]
            out[open_[hit]] = self.ids[at_open[hit]]
            open_ = open_[~hit & (self.keys[at_open] != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class Codec:
    """Encoder and decoder for one rank file. Pieces are the matches of ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.chunks: dict[str, bytes] = {}

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """All rows at once: each round every open row merges its leftmost pair of least rank.

        ``ids`` is padded with -1 on the right; so is the result.
        """
        done = np.full_like(ids, -1)
        live, width = np.arange(len(ids)), ids.shape[1]
        found = self._pairs_of(ids)
        while width > 1 and len(live):
            at = found.argmin(axis=1)                      # the first of equal ranks is the leftmost
            rows = np.arange(len(ids))
            best = found[rows, at]
            open_ = best != NONE
            if not open_.all():
                done[live[~open_], :width] = ids[~open_]
                ids, found, live, at, best = ids[open_], found[open_], live[open_], at[open_], best[open_]
                rows = rows[:len(live)]
                if not len(live):
                    break
            ids[rows, at] = best
            source = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)  # compaction: the rest moves one to the left
            found = np.take_along_axis(np.pad(found, ((0, 0), (0, 1)), constant_values=NONE), source, axis=1)
            width -= 1
            found = found[:, :max(width - 1, 1)]
            if width == 1:
                break
            right = np.minimum(at, width - 2)              # the pair that starts with the new token
            found[rows, right] = self._find(ids[rows, right], ids[rows, right + 1])
            found[rows[at > width - 2], width - 2] = self._find(ids[rows, width - 2], ids[rows, width - 1])[at > width - 2]
            has = at > 0                                   # and the one that ends with it
            before = at[has] - 1
            found[rows[has], before] = self._find(ids[rows[has], before], ids[rows[has], before + 1])
        if len(live):
            done[live, :width] = ids
        return done

    def _find(self, left, right):
        out = np.full(len(left), NONE)
        ok = (left >= 0) & (right >= 0)
        out[ok] = self.pairs.find(left[ok], right[ok])
        return out

    def _pairs_of(self, ids: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.full((len(ids), 1), NONE)
        return self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)

    def _merge_long(self, raw: bytes) -> list[int]:
        """A piece longer than all buckets: the same merges, next pair by a heap over a linked list."""
        from heapq import heapify, heappop, heappush
        n, tokens, ranks = len(raw), [raw[i:i + 1] for i in range(len(raw))], self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1)
                if (r := ranks.get(tokens[i] + tokens[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if tokens[i] is not None else n
            if j >= n or tokens[i] != a or tokens[j] != b:
                continue
            tokens[i], tokens[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(tokens[x] + tokens[y])) is not None:
                    heappush(heap, (r, x, tokens[x], tokens[y]))
        return [ranks[t] for t in tokens if t is not None]

    def pack(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct piece, as little-endian unsigned 32-bit numbers."""
        out: dict[str, bytes] = {}
        by_length: list[list[tuple[str, bytes]]] = [[] for _ in BUCKETS]
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[w] = whole.to_bytes(4, "little")
            elif len(raw) > BUCKETS[-1]:
                out[w] = np.array(self._merge_long(raw), "<u4").tobytes()
            else:
                by_length[BUCKET_OF[len(raw)]].append((w, raw))
        for width, group in zip(BUCKETS, by_length):
            for i in range(0, len(group), max(1, CELLS // width)):
                part = group[i:i + max(1, CELLS // width)]
                lengths = np.array([len(r) for _, r in part])
                flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for _, r in part), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[flat], np.int32(-1))
                merged = self._merge(ids)
                left = merged >= 0
                packed, ends = merged[left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1)) * 4
                start = 0
                for (w, _), end in zip(part, ends.tolist()):
                    out[w] = packed[start:end]
                    start = end
        return out

    def _matches(self, text: str) -> list[str]:
        """Matches of the pattern; a word of letters, with or without a stop, is known without it."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return [text]
        if word[-1:] in STOPS and word[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.pieces(text)

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Each text by its own matches; the pieces of all texts share the matrices."""
        matches = list(map(self._matches, texts))
        known = self.pack(list({w for m in matches for w in m}))
        return [b"".join(map(known.__getitem__, m)) for m in matches]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, in order; null counts as empty.

        No match crosses a single space between two visible characters, so a text is first cut
        there, and chunks seen before are looked up. Texts with other blanks are matched whole.
        """
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        heads = [parts.pop(0) for parts in cut]
        if len(self.chunks) > KEPT_WORDS:
            self.chunks = {}
        chunks, new = self.chunks, {c for parts in cut for c in parts}
        new = [c for c in new if c not in chunks]
        inner = [c for c in new if c and not c[0].isspace() and not c[-1].isspace()]
        found = self._joined([" " + c for c in inner] + heads)
        chunks.update(dict.fromkeys(new))          # None: not to be cut here
        chunks.update(zip(inner, found))
        packed, whole = [], []
        for i, (head, parts) in enumerate(zip(found[len(inner):], cut)):
            try:
                if parts and (not heads[i] or heads[i][-1].isspace()):
                    raise TypeError
                packed.append(head + b"".join(map(chunks.__getitem__, parts)))
            except TypeError:
                packed.append(b"")
                whole.append(i)
        for i, p in zip(whole, self._joined([texts[i] for i in whole])):
            packed[i] = p
        for c in new:
            if len(c) > KEPT_BYTES:
                del chunks[c]
        return packed

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(read_ranks(path), pattern)


def _digests(path: str, pattern: str):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path, pattern)
        for rows in batches:
            done = []
            for packed in bpe.encode(rows["text"].tolist()):
                done.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                             hashlib.sha256(bpe.decode(packed)).hexdigest()))
            yield rows[["doc_id"]].assign(n_tokens=[d[0] for d in done], ids_sha256=[d[1] for d in done],
                                          decoded_sha256=[d[2] for d in done])
    return of


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text; per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``docs``: doc_id long, text; other columns are ignored. Null and empty texts have no ids.
    The rank file is read in the workers, so ``path`` has to exist on each of them. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_digests(path, pattern),
                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str, pattern: str):
    def of(texts: pd.Series) -> pd.Series:
        bpe = codec(path, pattern)
        return pd.Series([np.frombuffer(p, "<u4").astype(np.int32) for p in bpe.encode(texts.tolist())], dtype=object)
    return of


def encode_column(docs: DataFrame, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of ``text`` as an array of int."""
    return docs.withColumn(into, F.pandas_udf(_ids(path, pattern), "array<int>")("text"))


def decode_column(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the bytes that ``ids`` stand for; null ids give null."""
    def of(column: pd.Series) -> pd.Series:
        bpe = codec(path, pattern)
        return pd.Series([None if i is None else bpe.decode(np.asarray(i, "<u4").tobytes()) for i in column], dtype=object)
    return rows.withColumn(into, F.pandas_udf(of, "binary")(ids))
