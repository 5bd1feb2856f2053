"""Sharding by balanced label propagation, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import running, stage

SLICES = 256      # hash slices in which running sums are numbered
GAIN_BINS = 40    # powers of two of the gain of a move


def _collect_sizes(labels: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """Bytes of each shard, all and linked ones: at most ``n`` rows reach the driver."""
    total, linked = [0] * n, [0] * n
    for r in labels.groupBy("shard").agg(F.sum("size").alias("a"),
                                         F.sum(F.when(F.col("linked"), F.col("size")).otherwise(0)).alias("b")).collect():
        total[r.shard], linked[r.shard] = r.a, r.b
    return total, linked


def _literal(values: list[int]):
    return F.array(*[F.lit(int(v)) for v in values])


def _wishes(labels: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """The shard that holds most neighbours of each linked vertex, and what moving there gains.

    Neighbours are counted per key and shard before anything is sent back, so a key with a
    third of all vertices is one row of ``n`` counts. A key's home shard breaks ties alike for
    all its vertices, otherwise two copies would swap places for ever.
    """
    counts = (links.join(labels.select("v", "shard"), "v").groupBy("key")
              .agg(*[F.sum((F.col("shard") == j).cast("double")).alias(f"c{j}") for j in range(n)]))
    home = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n))
    counts = counts.select("key", *[(F.col(f"c{j}") + F.when(home == j, 0.5).otherwise(0.0)).alias(f"c{j}")
                                    for j in range(n)])
    # Written first: a join of two plain exchanges is one whose hot keys Spark can split.
    counts = stage(counts, "shard-counts")
    votes = links.join(counts, "key").groupBy("v").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(n)])
    best = F.greatest(*[F.struct(F.col(f"c{j}").alias("votes"), F.lit(n - j).alias("late")) for j in range(n)])
    here = F.element_at(F.array(*[F.col(f"c{j}") for j in range(n)]), F.col("shard") + 1)
    return (labels.join(votes, "v").withColumn("best", best)
            .select("v", "size", "shard", (F.lit(n) - F.col("best.late")).cast("int").alias("target"),
                    (F.col("best.votes") - here).alias("gain"))
            .filter("target <> shard"))


def _quotas(wanted: dict[tuple[int, int], int], linked: list[int], capacity: int, n: int) -> list[int]:
    """Bytes that may go from shard i to j: what comes back in exchange, and a share of j's room."""
    out = [0] * (n * n)
    for j in range(n):
        swap = {i: min(wanted.get((i, j), 0), wanted.get((j, i), 0)) for i in range(n) if i != j}
        rest = {i: wanted.get((i, j), 0) - swap[i] for i in swap}
        room, all_rest = max(0, capacity - linked[j]), sum(rest.values())
        for i in swap:
            out[i * n + j] = swap[i] + (rest[i] if all_rest <= room else rest[i] * room // all_rest)
    return out


def _moved(labels: DataFrame, accepted: DataFrame) -> DataFrame:
    to = accepted.select("v", F.col("target").alias("to"))
    return labels.join(to, "v", "left").select(
        "v", "size", "linked", F.coalesce("to", "shard").cast("int").alias("shard"))


def _propagate(labels: DataFrame, links: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One round: the best moves of each pair of shards, as far as its quota goes."""
    wishes = stage(_wishes(labels, links, n), "shard-wishes")
    wanted = {(r.shard, r.target): r.b for r in
              wishes.groupBy("shard", "target").agg(F.sum("size").alias("b")).collect()}  # n*n rows at most
    if not wanted:
        return labels, 0
    total, linked = _collect_sizes(labels, n)
    quotas = _quotas(wanted, linked, -(-sum(total) // n), n)
    rank = F.greatest(F.lit(0), GAIN_BINS - F.floor(F.log2(F.col("gain") + 1)))
    rows = wishes.withColumn("bucket", rank * SLICES + F.pmod(F.xxhash64("v"), F.lit(SLICES)))
    placed = running(rows, ["shard", "target"], "bucket", ["v"], F.col("size"))
    quota = F.element_at(_literal(quotas), F.col("shard") * n + F.col("target") + 1)
    accepted = placed.filter(F.col("before") + F.col("size") <= quota)
    return stage(_moved(labels, accepted), "shard-labels"), sum(quotas)


def _even(labels: DataFrame, n: int) -> DataFrame:
    """Move what full shards have too much to the others: unlinked vertices first."""
    total, _ = _collect_sizes(labels, n)
    mean = sum(total) / n
    excess = [max(0, int(t - mean)) for t in total]
    gaps = [max(0, int(mean - t)) for t in total]
    if not any(excess) or not any(gaps):
        return labels
    over = F.element_at(_literal(excess), F.col("shard") + 1)
    rows = (labels.filter(F.col("size") <= over)
            .withColumn("bucket", F.col("linked").cast("int") * SLICES + F.pmod(F.xxhash64("v", F.lit(3)), F.lit(SLICES))))
    placed = running(rows, ["shard"], "bucket", ["v"], F.col("size"))
    starts = [sum(excess[:j]) for j in range(n)]
    at = F.element_at(_literal(starts), F.col("shard") + 1) + F.col("before") + F.col("size") / 2
    target, end = F.lit(None).cast("int"), sum(gaps)
    for j in reversed(range(n)):
        if gaps[j]:
            target, end = F.when(at < end, F.lit(j)).otherwise(target), end - gaps[j]
    # Of nested conditions the one with the smallest end has to be asked first.
    accepted = (placed.filter(F.col("before") + F.col("size") <= over)
                .withColumn("target", target).filter("target is not null"))
    return stage(_moved(labels, accepted), "shard-even")


def balanced_shards(vertices: DataFrame, links: DataFrame, n: int = 8, rounds: int = 6,
                    even_passes: int = 4) -> DataFrame:
    """Shard of each vertex: (v, shard).

    ``vertices``: v long (unique), size long. ``links``: v, key; vertices with a common key are
    neighbours. All start at a hash of their id. In each round every linked vertex asks for the
    shard with most of its neighbours; of those asking to go from one shard to another, the ones
    that gain most go, as far as a quota of bytes allows that keeps every shard within its share
    of the total. A group larger than a shard is thereby split. Last, unlinked vertices, and
    linked ones only where these don't suffice, even out the sizes to about one vertex.

    Vertices without links only even out. Empty tables give an empty result; ties go to the
    home shard of the key, then to the smaller shard. The driver sees n x n sums at most.
    """
    links = stage(links.filter("v is not null and key is not null").select("v", "key").distinct(), "shard-all-links")
    shared = stage(links.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shard-keys")
    links = stage(links.join(shared, "key"), "shard-links")
    linked = links.select("v").distinct().withColumn("linked", F.lit(True))
    start = F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    labels = stage(vertices.select("v", "size").join(linked, "v", "left").select(
        "v", "size", F.coalesce("linked", F.lit(False)).alias("linked"), start.alias("shard")), "shard-start")
    for _ in range(rounds):
        labels, moved = _propagate(labels, links, n)
        if not moved:
            break
    for _ in range(even_passes):
        labels = _even(labels, n)
    return labels.select("v", "shard")


def shard_documents(docs: DataFrame, n: int = 8) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into shards of near-equal bytes; equal texts are linked.

    Law ``bytes``: a row's size is the UTF-8 bytes of its text plus 1, a null text has size 1 and no
    links, empty texts are linked with each other. Rows that repeat a doc_id stay together. A null
    doc_id is placed by its text. ``slot`` numbers a shard's rows from 0 without gaps.
    """
    # Two hashes from different inputs and the size identify a text.
    rows = stage(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("v"),
        F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.crc32("text").alias("b"),
                                                   F.octet_length("text").alias("c"))).alias("key")), "shard-rows")
    vertices = rows.groupBy("v").agg(F.sum("size").alias("size"))
    placed = rows.join(balanced_shards(vertices, rows.select("v", "key"), n), "v")
    numbered = running(placed.withColumn("bucket", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(4 * SLICES))),
                       ["shard"], "bucket", ["v", "text_crc32"], F.lit(1), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                           F.lit(None).cast("int").alias("grown_shard"))
