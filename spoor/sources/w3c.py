"""Column lookup for W3C logs: which ``#Fields:`` line is in force for a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.session import stage

DIRECTIVE = "#Fields:"
# Lookups per file kept in an array beside each line; beyond it a window is used.
MAX_HEADERS_PER_FILE = 64


def header_changes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``src_file, block_start, seq, slots``: one row per new column layout.

    ``slots[i]`` is the 1-based place of ``keys[i]``, 0 when the layout lacks
    it; of a repeated name the last place counts. A directive without names ends
    the layout before it: its ``slots`` are empty. Repeats of the layout in force
    within a split are left out.
    """
    names = F.split(F.trim(F.regexp_replace(
        F.substring(F.col("line"), len(DIRECTIVE) + 1, 1 << 30), r"\s+", " ")), " ")
    slots = F.transform(
        F.array(*[F.lit(k) for k in keys]),
        lambda k: F.when(F.array_contains(F.col("names"), k),
                         F.size("names") + 1 - F.array_position(F.reverse("names"), k))
        .otherwise(0).cast("int"))
    found = (lines.filter(F.col("line").startswith(DIRECTIVE))
             .withColumn("names", names)
             .select("src_file", "block_start", "seq",
                     F.when(F.array_join("names", "") == "", F.array().cast("array<int>")).otherwise(slots).alias("slots"),
                     F.array_join("names", " ").alias("layout")))
    before = F.lag("layout").over(
        Window.partitionBy("src_file", "block_start").orderBy("seq"))
    return (found.withColumn("before", before)
            .filter(F.col("before").isNull() | (F.col("before") != F.col("layout")))
            .select("src_file", "block_start", "seq", "slots"))


def attach_slots(lines: DataFrame, keys: list[str],
                 max_per_file: int = MAX_HEADERS_PER_FILE) -> DataFrame:
    """Add ``slots`` of the latest directive before each line, null before any.

    Few layouts per file (the usual case) join as one array per file without
    moving the lines. Files with very many layouts take ``_fill_forward``,
    which gives the same answer with work split by file split.
    """
    changes = stage(header_changes(lines, keys), "w3c-headers")
    busiest = changes.groupBy("src_file").count().agg(F.max("count")).first()[0] or 0
    if busiest > max_per_file:
        return _fill_forward(lines, changes)
    per_file = stage(
        changes.groupBy("src_file").agg(F.sort_array(F.collect_list(
            F.struct("block_start", "seq", "slots"))).alias("headers")), "w3c-layouts")
    at = F.struct(F.col("block_start"), F.col("seq"))
    earlier = F.filter("headers", lambda h: F.struct(
        h["block_start"].alias("block_start"), h["seq"].alias("seq")) < at)
    return (lines.join(per_file, "src_file", "left")
            .withColumn("slots", F.try_element_at(earlier, F.lit(-1))["slots"])
            .drop("headers"))


def _fill_forward(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """Carry the layout over split borders, then forward inside each split."""
    blocks = (lines.select("src_file", "block_start").distinct()
              .join(changes.groupBy("src_file", "block_start")
                    .agg(F.max_by("slots", "seq").alias("last")),
                    ["src_file", "block_start"], "left"))
    before = (Window.partitionBy("src_file").orderBy("block_start")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = (blocks.withColumn("slots", F.last("last", True).over(before))
               .filter("slots is not null")
               .select("src_file", "block_start", F.lit(-1).cast("bigint").alias("seq"), "slots"))
    marks = changes.unionByName(carried)
    mixed = lines.unionByName(marks, allowMissingColumns=True)
    # A directive shares its position with the line it came from and sorts after
    # it, so that line still sees the layout before.
    order = (Window.partitionBy("src_file", "block_start")
             .orderBy("seq", F.col("line").isNull())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = mixed.withColumn("in_force", F.last("slots", True).over(order))
    return (filled.filter("line is not null").drop("slots")
            .withColumnRenamed("in_force", "slots"))


def value_of(keys: list[str], key: str, values):
    """Value of ``key`` in a split line; null when absent or the line is short."""
    slot = F.get("slots", F.lit(keys.index(key)))
    return F.when(slot > 0, F.get(values, slot - 1))
