"""A Merkle manifest of a dataset whose leaf coordinates come from bitmaps, not from a sort.

Each group's ids are merged into 64-bit words of which only those in use are kept; a directory of row counts
above them, 256 words or nodes to a node, gives the number of rows before any word. A leaf's place in its
group is then one look-up: rows before its word plus the bits set below its own.

Digests are put into arrays by (group, place div 729), so a task reduces six levels of runs of three at once, and
the levels above see one node for each array. Proofs come back down the same arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm.common import narrow, running, stage

FAN = 3                      # fixed value: nodes of a run
LEVELS = 6                   # levels that one array reduces
ARRAY = FAN ** LEVELS
NO_ID = -(1 << 58)           # word of null ids, before all others
DIRECTORY_BITS = 8
CHUNK = 4096
STEP = "struct<left:string,right:string>"


# --- digests ----------------------------------------------------------------------

def leaf_digest(*columns: Column) -> Column:
    """SHA-256 over the columns: ``-`` for null, else bytes, a colon and the value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


# --- coordinates --------------------------------------------------------------------

def _below(n: str, parts: list[str]) -> Column:
    line = W.partitionBy(*parts).orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(line), F.lit(0))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """``g, no, bits, n, before`` of the words in use, from rows (g, no, low).

    ``bits`` are the ids of the word, ``n`` its rows, ``before`` the rows of the group in words before it. The
    directory has as many levels as the ids' span asks for; a window never holds more than 256 nodes.
    """
    bit = F.expr("shiftleft(1L, low)")
    words = stage(rows.groupBy("g", "no").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")), "merkle-words")
    span = words.agg(F.min("no").alias("lo"), F.max("no").alias("hi")).first()
    lo, hi = span.lo or 0, span.hi or 0
    directory = [words]
    while (hi >> DIRECTORY_BITS * (len(directory) - 1)) - (lo >> DIRECTORY_BITS * (len(directory) - 1)) >= 1 << DIRECTORY_BITS:
        up = directory[-1].groupBy("g", F.shiftright("no", DIRECTORY_BITS).alias("no")).agg(F.sum("n").alias("n"))
        directory.append(stage(up, "merkle-directory"))
    top = directory[-1]
    known = top.withColumn("before", _below("n", ["g"]))
    for level in reversed(directory[:-1]):
        above = known.select("g", F.col("no").alias("parent"), F.col("before").alias("start"))
        inside = level.withColumn("parent", F.shiftright("no", DIRECTORY_BITS))
        inside = inside.withColumn("before", _below("n", ["g", "parent"]))
        known = inside.join(above, ["g", "parent"]).withColumn("before", F.col("before") + F.col("start")).drop("parent", "start")
    return known


def place_leaves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``g, slot, leaf, id, carry`` with gapless slots from 0, and ``g, n``: leaves of each group.

    ``rows``: g (not null), id long, leaf, carry. Leaves ascend by id, nulls first; rows that share an id by
    their digest, and such rows are counted before they are numbered.
    """
    rows = (rows.withColumn("no", F.coalesce(F.shiftright("id", 6), F.lit(NO_ID)))
            .withColumn("low", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")))
    words = stage(bitmap_index(rows), "merkle-index")
    found = rows.join(words, ["g", "no"])
    full = F.col("n") > F.bit_count("bits")
    rank = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, low)")))
    placed = found.filter(~full).select("g", rank.alias("slot"), "leaf", "id", "carry")
    if not words.filter(full).isEmpty():
        same = ["g", "no", "before", "low", "id", "leaf", "carry"]
        crowd = stage(found.filter(full).groupBy(*same).agg(F.count("*").alias("copies")), "merkle-crowd")
        bucket = F.col("low") * 256 + F.conv(F.substring("leaf", 1, 2), 16, 10).cast("int")
        crowd = running(crowd.withColumn("bucket", bucket), ["g", "no"], "bucket", ["leaf"], F.col("copies"), "inside")
        last = (F.col("copies") - 1).cast("long")
        chunks = crowd.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / CHUNK)))).repartition("g", "id", "leaf", "chunk")
        copy = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(last, F.col("chunk") * CHUNK + CHUNK - 1)))
        chunks = chunks.withColumn("copy", copy)
        placed = placed.unionByName(chunks.select(
            "g", (F.col("before") + F.col("inside") + F.col("copy")).alias("slot"), "leaf", "id", "carry"))
    return placed, words.groupBy("g").agg(F.sum("n").alias("n"))


# --- levels ---------------------------------------------------------------------------

def _up(level: str) -> Column:
    """Digests of the runs of a level."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1),
                       lambda i: F.sha2(F.array_join(F.slice(F.col(level), i * FAN + 1, FAN), ""), 256))


def _arrays(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``g, block, whole, entries, t0 .. t6, top``: nodes by place, and the levels above them as far as they go.

    An array that holds its whole group stops at one node; others reduce all six levels, as more nodes lie beside them.
    """
    arrays = (nodes.groupBy("g", F.floor(F.col("slot") / ARRAY).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("slot", "leaf", "id", "carry"))).alias("entries")))
    arrays = (arrays.join(sizes, "g").withColumn("whole", F.col("n") <= ARRAY).drop("n")
              .withColumn("t0", F.col("entries.leaf")))
    for k in range(LEVELS):
        arrays = arrays.withColumn(f"t{k + 1}", F.when(~F.col("whole") | (F.size(f"t{k}") > 1), _up(f"t{k}")))
    top = F.coalesce(*[F.col(f"t{k}")[0] for k in range(LEVELS, -1, -1)])
    return arrays.withColumn("top", top)


def climb(nodes: DataFrame, sizes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of each stage, written, and ``g, top`` of every group."""
    none = F.lit(None)
    sizes = stage(sizes, "merkle-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    stages, tops = [], []
    while True:
        stages.append(stage(_arrays(nodes, sizes), "merkle-arrays"))
        tops.append(stages[-1].filter("whole").select("g", "top"))
        if most <= ARRAY:
            return stages, reduce(DataFrame.unionByName, tops)
        most = -(-most // ARRAY)
        nodes = stages[-1].filter("not whole").select("g", F.col("block").alias("slot"), F.col("top").alias("leaf"),
                                                      none.cast("long").alias("id"), none.cast("string").alias("carry"))
        sizes = sizes.filter(F.col("n") > ARRAY).withColumn("n", F.ceil(F.col("n") / ARRAY))


def _path(j: Column) -> Column:
    """Siblings of the array's node ``j``, level by level."""
    steps = []
    for k in range(LEVELS):
        at = F.floor(j / FAN ** k)
        run, place = F.floor(at / FAN).cast("int"), F.pmod(at, F.lit(FAN)).cast("int")
        left = F.array_join(F.slice(F.col(f"t{k}"), run * FAN + 1, place), "")
        right = F.array_join(F.slice(F.col(f"t{k}"), run * FAN + place + 2, FAN - 1 - place), "")
        steps.append(F.when(F.col(f"t{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def descend(stages: list[DataFrame], groups: DataFrame) -> DataFrame:
    """``g, slot, leaf, id, carry, subroot, path`` of every leaf.

    ``groups``: g, subroot and the path above it. What lies above an array reaches it as one row.
    """
    entry = F.lit(0).cast("long")
    above = None
    for arrays in reversed(stages):
        up = groups.select("g", entry.alias("block"), F.lit(True).alias("whole"), "subroot", "path")
        if above is not None:
            up = up.unionByName(above.select("g", F.col("slot").alias("block"), F.lit(False).alias("whole"), "subroot", "path"))
        nodes = F.transform(F.sequence(F.lit(0), F.size("t0") - 1), lambda j: F.struct(
            F.col("entries")[j].alias("e"), _path(j).alias("inside")))
        above = (arrays.join(up, ["g", "block", "whole"])
                 .select("g", "subroot", F.col("path").alias("outside"), F.inline(nodes))
                 .select("g", "e.*", "subroot", F.concat("inside", "outside").alias("path")))
        if arrays is not stages[0]:
            above = stage(above, "merkle-paths")
    return above


def _ordered(groups: DataFrame) -> DataFrame:
    """``g, slot, ...`` by the bytes of g; only one row for each partition is ever added up in one place."""
    sorted_ = stage(groups.repartitionByRange("g").sortWithinPartitions("g")
                    .withColumn("id", F.monotonically_increasing_id()), "merkle-groups")
    part = F.shiftright("id", 33)
    sums = sorted_.groupBy(part.alias("no")).agg(F.count("*").alias("n"))
    starts = sums.select("no", F.coalesce(F.sum("n").over(W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.col("id").bitwiseAND((1 << 33) - 1)
    return (sorted_.withColumn("no", part).join(starts, "no")
            .withColumn("slot", F.col("start") + inside).drop("no", "start", "id"))


def build_manifest(rows: DataFrame, group: str = "source", id_column: str = "doc_id", leaf: str = "leaf",
                   carry: str | None = None) -> DataFrame:
    """Manifest of the leaves in ``rows``: ``group, id, slot, leaf, carry, subroot, root, path``.

    Within a group leaves ascend by id (nulls first, equal ids by digest); runs of three become their digest
    until one node is left, the subroot. Subroots by the bytes of their group (null first) give the root in the
    same way. ``path`` holds, level by level up to the root, the digests left and right of the node as one text
    each. Every row is a leaf, also one that repeats another. ``carry`` names a text column to bring along.

    A group that holds most rows is many arrays like any other rows; only its count is one row. An empty table
    gives an empty result. Other columns are not looked at.
    """
    text = F.lit(None).cast("string") if carry is None else F.col(f"`{carry}`")
    small = stage(rows.select(F.coalesce(F.concat(F.lit("g"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),
                              F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{leaf}`").alias("leaf"),
                              text.alias("carry")), "merkle-leaves")
    placed, sizes = place_leaves(small)
    stages, subroots = climb(placed, sizes)
    none = F.lit(None)
    tops = _ordered(subroots).select(F.lit("").alias("g"), "slot", F.col("top").alias("leaf"), none.cast("long").alias("id"),
                                     F.col("g").alias("carry"))
    tops = stage(tops, "merkle-subroots")
    top_stages, root = climb(tops, tops.groupBy("g").agg(F.count("*").alias("n")))
    roots = root.collect()                    # one row, none for an empty table
    root = F.lit(roots[0].top if roots else None).cast("string")
    start = root_row(rows, roots)
    groups = stage(descend(top_stages, start).select(F.col("carry").alias("g"), F.col("leaf").alias("subroot"), "path"), "merkle-tops")
    return descend(stages, groups).select(
        F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("group"), "id", "slot", "leaf", "carry", "subroot",
        root.alias("root"), "path")


def root_row(rows: DataFrame, roots: list) -> DataFrame:
    """The path above the root: empty."""
    one = rows.sparkSession.createDataFrame([("", r.top) for r in roots], "g string, subroot string")
    return one.withColumn("path", F.array().cast(f"array<{STEP}>"))


# --- documents ------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, tampered``: the leaf of each row, and of the row as a tamperer leaves it.

    Rows whose CRC-32 of the decimal doc_id is even lose the line feeds of their text; others, texts without
    any, and rows without a doc_id stay as they are.
    """
    rows = narrow(docs, **{c: c for c in FIELDS})
    columns = [F.col(c) for c in FIELDS[:-1]]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return rows.select("doc_id", "source", leaf_digest(*columns, F.col("text")).alias("leaf"),
                       leaf_digest(*columns, changed).alias("tampered"))


def audit_documents(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` against the manifest after tampering.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. Nulls, repeated rows and empty
    tables as in ``build_manifest``.
    """
    manifest = build_manifest(document_leaves(docs), leaf="leaf", carry="tampered")
    return manifest.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("carry"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
