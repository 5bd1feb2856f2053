"""SimHash near-duplicates by a segment-popcount embedding."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import stage
from spoor.llm.graph import components

LOW_BITS = 0x5555555555555555
BLOCKS = 6          # groups of segments; a cell fixes the popcounts of all but DISTANCE of them
DISTANCE = 2
CELL_PAIRS = 64     # cells with more fingerprints take the route by one-bit variants
CHUNK = 1 << 15     # shingles whose bits are counted at once


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, as a signed number; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-width])).tolist()
        hashes = [digest(line[s:e], seed) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i:i + CHUNK], dtype=np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def embed(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments, each count in unary (0: 00, 1: 01, 2: 11).

    The Manhattan distance of two popcount vectors is then the number of bits in which their
    codes differ. It never exceeds the Hamming distance of the fingerprints.
    """
    half = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW_BITS).cast("long")
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def cell_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Signed masks of the segments that a cell fixes: all blocks but ``distance``, in each way."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << 2 * edges[i + 1]) - (1 << 2 * edges[i])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _variant_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints at 2 or fewer bits, by stars: both are one bit or none away from a
    common variant. At most 65 fingerprints share a variant, and all of them are linked."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long") for i in range(64)])
    near = fps.select("fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("variant"))
    hubs = near.groupBy("variant").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return near.join(hubs, "variant").filter("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints at ``DISTANCE`` or fewer bits. ``fps``: distinct fp.

    Grid range join: fingerprints within Manhattan distance 2 agree on the popcounts of all but two
    blocks, so each enters one cell per choice of blocks. Pairs of a cell pass the Manhattan bound,
    then the exact test. A cell with more than ``CELL_PAIRS`` fingerprints emits no pairs; its
    fingerprints are linked exactly through their one-bit variants instead.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in cell_masks()])
    coded = fps.select("fp", embed(F.col("fp")).alias("code"))
    cells = coded.select("fp", "code", F.posexplode(masks).alias("grid", "mask")).select(
        "fp", "code", "grid", F.col("code").bitwiseAND(F.col("mask")).alias("cell"))
    cells = stage(cells, "simhash-cells")
    full = stage(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_PAIRS)
                 .select("grid", "cell"), "simhash-full")
    kept = cells.join(full, ["grid", "cell"], "left_anti")
    a, b = kept.alias("x"), kept.alias("y")
    pairs = a.join(b, (F.col("x.grid") == F.col("y.grid")) & (F.col("x.cell") == F.col("y.cell"))
                   & (F.col("x.fp") < F.col("y.fp"))
                   & (F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= DISTANCE)
                   & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE))
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowded = cells.join(full, ["grid", "cell"], "left_semi").select("fp").distinct()
    return pairs.unionByName(_variant_links(crowded))


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of every row; ``mark`` tells texts of one doc_id apart."""
    of = F.pandas_udf(_fingerprints, "long")
    rows = stage(docs.select("doc_id", F.xxhash64("text").alias("mark"), of("text").alias("fp")), "simhash-rows")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    linked = components(near_links(nodes.select("fp")))
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = stage(rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-member")
    return rows.join(member, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of every row: doc_id, fingerprint (hex), component_id.

    ``docs``: doc_id, text; other columns are ignored. Null, empty and blank texts have fingerprint
    zero and are linked like any other. Repeated rows stay, each with the same component. A null
    doc_id never names a component; a component of null ids only is null. Copies of one fingerprint
    are one node of the graph, however many there are.
    """
    return _members(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id; one with a null doc_id
    only where there is no other. Of rows that repeat this doc_id one stays."""
    members = stage(_members(docs).select("doc_id", "mark", "root"), "simhash-roots")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("lead")
    kept = stage(members.groupBy("root").agg(lead).select(
        F.col("lead.doc_id").alias("_doc"), F.col("lead.mark").alias("_mark")).distinct(), "simhash-kept")
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_doc"]) & (F.xxhash64(docs["text"]) == kept["_mark"]), "left_semi")
    if members.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])
