"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm.common import stage

TABLES = 2
WIDTH = 2.0             # of a bucket along one projection of unit vectors
SUCCESS = 0.94          # chance, over all tables, with which a neighbour at the fitted distance is met
FIT_QUERIES = 64        # queries whose true neighbours give that distance, at most
FIT_QUANTILE = 0.9
CELL_ROWS = 4096        # rows of one cell: larger buckets are dealt over several cells
QUERY_BLOCK = 2048      # queries that meet a cell at once


def functions_for(rows: int) -> int:
    """Projections of a table: an even number that grows with the logarithm of the rows."""
    return int(np.clip(2 * round(math.log2(max(rows, 2)) / 5), 4, 16))


@dataclass
class Hasher:
    """h_j(x) = floor((a_j . x + b_j) / WIDTH) with Gaussian a_j, for each table; fixed by the seed."""
    dims: int
    k: int
    seed: int = 11

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.a = rng.normal(size=(TABLES, self.k, self.dims))
        self.b = rng.uniform(0, WIDTH, (TABLES, self.k))

    def project(self, unit: np.ndarray, table: int) -> np.ndarray:
        return unit @ self.a[table].T + self.b[table]

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        """One number of all cell numbers of a row."""
        out = np.full(cells.shape[:-1], 0xCBF29CE484222325, np.uint64)
        for j in range(cells.shape[-1]):
            out = (out ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)

    def probes(self, projected: np.ndarray, distance: float) -> np.ndarray:
        """Buckets of one table in the order of the chance to hold a neighbour at ``distance``.

        Along one projection the neighbour lies at a Gaussian offset with deviation ``distance``, so each
        perturbation of a bucket number has a known chance, and a bucket the product over all projections.
        The likeliest buckets are taken until their chances add up to this table's share of ``SUCCESS``.
        Both halves of the projections are listed once; a bound on the product picks the pairs.
        """
        goal = 1 - (1 - SUCCESS) ** (1 / TABLES)
        halves = []
        for part in (projected[: self.k // 2], projected[self.k // 2:]):
            cells, chance = np.zeros((1, 0), np.int64), np.ones(1)
            for x in part:
                own = np.arange(math.floor((x - 4 * distance) / WIDTH), math.floor((x + 4 * distance) / WIDTH) + 1)
                edges = _normal((np.append(own, own[-1] + 1) * WIDTH - x) / distance)
                cells = np.concatenate([np.repeat(cells, len(own), axis=0), np.tile(own, len(cells))[:, None]], axis=1)
                chance = np.outer(chance, np.diff(edges)).ravel()
            order = np.argsort(-chance, kind="stable")
            halves.append((cells[order], chance[order]))
        (left, p), (right, q) = halves
        total, low, high = np.concatenate(([0.0], np.cumsum(q))), 0.0, float(p[0] * q[0])
        for _ in range(40):
            bound = (low + high) / 2
            n = np.searchsorted(-q, -(bound / np.maximum(p, 1e-300)), side="right")
            if p @ total[n] >= goal:
                low = bound
            else:
                high = bound
        n = np.searchsorted(-q, -(low / np.maximum(p, 1e-300)), side="right")
        at = np.repeat(np.arange(len(p)), n)
        to = np.concatenate([np.arange(x) for x in n]) if len(n) else np.zeros(0, int)
        order = np.argsort(-(p[at] * q[to]), kind="stable")
        return np.concatenate([left[at[order]], right[to[order]]], axis=1)


def _normal(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(column: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return column.isNotNull() & F.coalesce(F.forall(column, finite), F.lit(False)) & F.exists(column, lambda v: v != 0)


def cosine(a: str, b: str) -> Column:
    """In double precision, components added in their order."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _top(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the best ``keep`` of a row, with all that tie with the last."""
    if len(scores) <= keep:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - keep)[len(scores) - keep]
    return np.flatnonzero(scores >= least - 1e-9)


def _by_size(vectors: pd.Series) -> dict[int, np.ndarray]:
    """Places of the vectors of each size."""
    sizes = vectors.map(len).to_numpy()
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _distances(queries: DataFrame, rows: DataFrame, k: int, sizes: list[int]) -> dict[int, float]:
    """Of each size, FIT_QUANTILE of the distance from some queries to their k-th neighbour, found by a full scan."""
    order = W.partitionBy(F.size("q")).orderBy(F.xxhash64("query_id"), "query_id")
    sample = (queries.filter(F.size("q").isin(sizes)).withColumn("_r", F.row_number().over(order))
              .filter(F.col("_r") <= FIT_QUERIES).toPandas())
    own, fits = sample["query_id"].to_numpy(), {}
    if len(sample):
        fits = {n: (at, _unit(sample["q"].iloc[at])) for n, at in _by_size(sample["q"]).items()}

    def nearest(batches):
        best = np.full((len(own), k), -2.0)
        for batch in batches:
            for n, held in _by_size(batch["embedding"]).items():
                if n in fits:
                    at, unit = fits[n]
                    scores = unit @ _unit(batch["embedding"].iloc[held]).T
                    scores[own[at][:, None] == batch["vec_id"].to_numpy()[held][None, :]] = -2.0
                    best[at] = -np.sort(-np.concatenate([best[at], scores], axis=1), axis=1)[:, :k]
        yield pd.DataFrame({"i": np.repeat(np.arange(len(own)), k), "s": best.ravel()})

    out = dict.fromkeys(sizes, 1.0)
    if fits:
        # k numbers of each query and task.
        found = rows.select("vec_id", "embedding").mapInPandas(nearest, "i int, s double")
        nth = found.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("s")))).filter(F.col("r") == k).toPandas()
        nth = nth[nth["s"] > -2]
        for n, (at, _) in fits.items():
            s = nth["s"][nth["i"].isin(at)]
            if len(s):
                out[n] = float(max(0.05, np.sqrt(np.quantile(2 - 2 * s, FIT_QUANTILE))))
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query by cosine, ties to smaller vec_id.

    ``rows``: vec_id, embedding; ``queries``: query_id, q. A query never finds the row with its own id.
    Unusable vectors take no part. A query meets the rows of its own length. Repeated rows count once.

    Of equal vectors only the k + 1 smallest ids can be among the k nearest, so no more are indexed.
    Every other row is hashed into each table. A query visits buckets in the order of estimated success,
    takes all their rows as candidates, and the tables' candidates are merged and scored exactly. A bucket
    of any size is dealt over cells of bounded size; the whole bucket is searched. Each length has its own hashes;
    the rows of a rare length (CELL_ROWS at most, and not the commonest) are one bucket.
    """
    rows = rows.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    queries = queries.filter(usable(F.col("q"))).select(F.col("query_id").cast("long").alias("query_id"), "q").filter("query_id is not null")
    queries = stage(queries.dropDuplicates(["query_id", "q"]), "ann-queries")
    same = W.partitionBy("embedding").orderBy("vec_id")
    rows = stage(rows.dropDuplicates(["vec_id", "embedding"]).withColumn("_n", F.row_number().over(same))
                 .filter(F.col("_n") <= k + 1).drop("_n"), "ann-rows")
    schema = "query_id long, rank int, vec_id long, score double"
    asked_sizes = queries.select(F.size("q").alias("dims")).distinct()
    counts = {r.dims: r.n for r in rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
              .join(asked_sizes, "dims", "left_semi").collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], schema)
    total, most = sum(counts.values()), max(counts, key=lambda n: (counts[n], n))
    hashed = [n for n in counts if n == most or counts[n] > CELL_ROWS]
    rows = rows.filter(F.size("embedding").isin(list(counts)))
    queries = queries.filter(F.size("q").isin(list(counts)))
    distances = _distances(queries, rows, k, hashed)
    hashers = {n: Hasher(n, functions_for(counts[n])) for n in hashed}

    def key(size, codes):
        return codes ^ np.array(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64).view(np.int64)

    def index(batches):
        for batch in batches:
            for n, at in _by_size(batch["embedding"]).items():
                part = batch.iloc[at]
                if n not in hashers:
                    yield part.assign(tab=0, bucket=key(n, np.zeros(len(part), np.int64)))
                    continue
                unit = _unit(part["embedding"])
                for t in range(TABLES):
                    buckets = hashers[n].code(np.floor(hashers[n].project(unit, t) / WIDTH))
                    yield part.assign(tab=t, bucket=key(n, buckets))

    def probe(batches):
        for batch in batches:
            for n, at in _by_size(batch["q"]).items():
                part = batch.iloc[at]
                if n not in hashers:
                    yield pd.DataFrame({"query_id": part["query_id"], "tab": 0, "bucket": key(n, np.zeros(len(part), np.int64))})
                    continue
                unit = _unit(part["q"])
                for t in range(TABLES):
                    for query, projected in zip(part["query_id"], hashers[n].project(unit, t)):
                        found = hashers[n].code(hashers[n].probes(projected, distances[n]))
                        yield pd.DataFrame({"query_id": query, "tab": t, "bucket": key(n, found)})

    indexed = stage(rows.mapInPandas(
        index, f"vec_id long, embedding {dict(rows.dtypes)['embedding']}, tab int, bucket long"), "ann-index")
    sizes = stage(indexed.groupBy("tab", "bucket").agg(F.count("*").alias("n")), "ann-sizes")
    # A cell is a share of one large bucket, or many small buckets together.
    groups = max(1, -(-total // CELL_ROWS))
    deals = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    cells = sizes.select("tab", "bucket", deals.alias("deals"))
    home = F.pmod(F.xxhash64("tab", "bucket"), F.lit(groups))
    held = indexed.join(cells, ["tab", "bucket"]).withColumn(
        "cell", F.when(F.col("deals") == 1, home).otherwise(F.xxhash64("bucket", F.pmod(F.xxhash64("vec_id"), "deals"))))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # Spread out first: a few queries are one file, and each has many buckets to list.
    spread = queries.select("query_id", "q").repartition(max(1, min(blocks * 16, 512)), "query_id")
    asked = (spread.mapInPandas(probe, "query_id long, tab int, bucket long")
             .join(cells, ["tab", "bucket"])
             .withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
             .withColumn("cell", F.when(F.col("deals") == 1, home).otherwise(F.xxhash64("bucket", F.col("deal").cast("long"))))
             .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    asked = asked.groupBy("tab", "cell", "block", "query_id").agg(F.collect_set("bucket").alias("buckets"))
    asked = stage(asked, "ann-asked")
    # Rows go out only to the blocks of queries that visit their cell.
    visits = stage(asked.select("tab", "cell", "block").distinct(), "ann-visits")
    held = held.join(visits, ["tab", "cell"]).select("tab", "cell", "block", "bucket", "vec_id", "embedding")
    asked = asked.join(queries, "query_id")

    def search(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(asked):
            ids, buckets = held["vec_id"].to_numpy(), held["bucket"].to_numpy()
            places = _by_size(held["embedding"])
            units = {n: _unit(held["embedding"].iloc[at]) for n, at in places.items()}
            for query, q, wanted in zip(asked["query_id"], asked["q"], asked["buckets"]):
                if len(q) not in places:
                    continue
                at = places[len(q)]
                met = np.flatnonzero(np.isin(buckets[at], np.asarray(wanted)) & (ids[at] != query))
                own = at[met]
                if len(own):
                    q = np.asarray(q, np.float64)
                    scores = units[len(q)][met] @ (q / np.linalg.norm(q))
                    best = own[_top(scores, ids[own], k)]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64)})

    keys = ["tab", "cell", "block"]
    met = (held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long").distinct())
    scored = (met.join(queries, "query_id").join(rows, "vec_id")
              .filter(F.size("q") == F.size("embedding")).select("query_id", "vec_id", cosine("q", "embedding").alias("score")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
