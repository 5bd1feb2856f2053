"""Secrets in texts, told apart by how many owners hold the same value. DataFrame functions only.

A value that turns up with many owners is an example that people copy; one that stays with its owner and looks
random is likely to be live. Every candidate's digest is therefore counted over the whole corpus by distinct
repositories and owners before anything is said about it.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm.common import narrow, stage


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Patterns of the base kinds, the group that holds the value, its least length. The last kind only feeds the method.
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("opaque", "[A-Za-z0-9+/_-]{24,}", 0, 24),
)
BASE = 3
LIVE = "live"
COPIED_AT = 3      # owners from which a value is an example
DISTINCT = 8       # different characters a live value has at least


def _first_pass(kind: str, pattern: str, least: int) -> str:
    """Whether a text is worth a look; a run that is too short cannot be part of a longer one."""
    return f"[0-9a-f]{{{least}}}" if kind == "hex" else pattern


def _pattern(kind: str, pattern: str, least: int) -> str:
    """Runs of one class of characters are whole, so their least length may be asked for in the pattern itself.

    A match of ``assign`` that is too short still uses up its text, so there lengths are tested afterwards.
    """
    return f"[0-9a-f]{{{least},}}" if kind == "hex" else pattern


def _hits(place: int) -> Column:
    """Matches of one kind: place of the kind, length of the text since the last match, length, value."""
    kind, pattern, group, least = KINDS[place]
    guard, pattern = _first_pass(kind, pattern, least), _pattern(kind, pattern, least)
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    pairs = F.zip_with(found, value, lambda a, b: F.struct(F.length(a).alias("size"), b.alias("value")))
    # Between n matches and around them lie n + 1 pieces; the last one is of no use.
    hits = F.zip_with(F.split("text", pattern, -1), pairs, lambda gap, p: F.struct(
        F.lit(place).alias("kind"), F.length(gap).alias("gap"), p["size"].alias("size"), p["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,gap:int,size:int,value:string>>")
    return F.when(F.col("text").rlike(guard), F.filter(hits, lambda h: h["value"].isNotNull())).otherwise(none)


def _spans(hits: DataFrame) -> DataFrame:
    """One row a match: its span in code points, and that of its value."""
    rows = hits.filter("size(hits) > 0").select("row", "doc", "repository", "owner", F.posexplode("hits").alias("pos", "hit"))
    rows = rows.select("row", "doc", "repository", "owner", "pos", "hit.*")
    line = W.partitionBy("row", "kind").orderBy("pos")
    start = F.sum("gap").over(line) + F.coalesce(F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    # All matches are placed, then those that fail are dropped.
    return (rows.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
            .filter(F.length("value") >= least)
            .withColumn("value_start", F.col("end") - F.length("value")).withColumn("hash", F.sha2("value", 256))
            .withColumn("random", _looks_random(F.col("value"))).drop("pos", "gap", "size", "value"))


def _looks_random(value: Column) -> Column:
    kinds = F.size(F.array_remove(F.array_distinct(F.split(value, "")), ""))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= DISTINCT)


def ownership(spans: DataFrame) -> DataFrame:
    """``hash, owners, repositories``: how far each candidate's value has spread.

    Counted in three steps, each with map-side sums, so a value that a third of all rows hold is spread over
    its repositories, then its owners. A null repository or owner is one like any other.
    """
    held = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def find_secrets(docs: DataFrame, doc: str = "doc_id", repository: str = "doc_id", owner: str = "source",
                 copied_at: int = COPIED_AT) -> DataFrame:
    """One row a candidate: ``row, doc, kind, start, end, value_start, owners, repositories, verdict``.

    ``verdict``: ``copied`` if at least ``copied_at`` owners hold the value, else ``live`` if it holds letters,
    digits and 8 different characters, else ``plain``. Values themselves are not returned.
    """
    return _judged(_read(docs, doc, repository, owner), copied_at)


def _read(docs: DataFrame, doc: str, repository: str, owner: str) -> DataFrame:
    rows = narrow(docs, doc=doc, repository=repository, owner=owner, text="text")
    hits = F.concat(*[_hits(k) for k in range(len(KINDS))])
    return stage(rows.withColumn("text", F.coalesce("text", F.lit(""))).select(
        F.monotonically_increasing_id().alias("row"), "doc", "repository", "owner", hits.alias("hits")), "secrets-hits")


def _judged(hits: DataFrame, copied_at: int) -> DataFrame:
    # Both sides are written first: of a join of two plain exchanges Spark can split a hot value.
    spans = stage(_spans(hits), "secrets-spans")
    spread = stage(ownership(spans), "secrets-spread")
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    verdict = F.when(F.col("owners") >= copied_at, "copied").when(F.col("random"), LIVE).otherwise("plain")
    return spans.join(spread, "hash").select(
        "row", "doc", F.element_at(kinds, F.col("kind") + 1).alias("kind"), F.col("kind").alias("rank"), "start", "end",
        "value_start", "owners", "repositories", verdict.alias("verdict"))


def secret_spans(docs: DataFrame, doc: str = "doc_id", repository: str = "doc_id", owner: str = "source",
                 copied_at: int = COPIED_AT) -> DataFrame:
    """Per row of ``docs``: ``doc, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied``.

    Base spans are ``kind:start:end`` in code points, by start, then kind; the method adds ``live`` spans of the
    values that do not spread and look random, after the others of the same start. ``n_copied`` counts base
    spans whose value is a copied example; they stay among the spans.

    Null and empty texts have no spans and the digest of the empty text. A doc_id that repeats gives a row each
    time, as does a null one. Long texts are read whole: places are running sums over a text's matches.
    """
    hits = _read(docs, doc, repository, owner)
    found = _judged(hits, copied_at)
    base = F.col("rank") < BASE
    piece = F.struct(F.col("start"), F.col("rank"), F.col("end"), F.col("kind"))
    live = F.struct(F.col("value_start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit(LIVE).alias("kind"))

    def joined(list_of: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(list_of), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_row = found.groupBy("row").agg(
        F.first("doc").alias("doc"), *[F.count_if(F.col("kind") == KINDS[k][0]).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.collect_list(F.when(base, piece)).alias("base"),
        F.array_distinct(F.collect_list(F.when(F.col("verdict") == LIVE, live))).alias("live"),
        F.count_if(base & (F.col("verdict") == "copied")).alias("n_copied"))
    zero = F.lit(0).cast("long")
    rest = hits.join(found.select("row").distinct(), "row", "left_anti").select(
        "doc", *[zero.alias(f"n_{KINDS[k][0]}") for k in range(BASE)], F.lit(sha256().hexdigest()).alias("base_sha256"),
        F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_copied"))
    counts = [f"n_{KINDS[k][0]}" for k in range(BASE)]
    return per_row.select(
        "doc", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "live")).alias("spans"), F.size("live").cast("long").alias("n_live"), "n_copied").unionByName(rest)
