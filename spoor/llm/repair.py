"""Conversations brought back into turn order at least cost, by divide and conquer.

A repaired conversation reads ``(system? (user assistant)+)?``. Four states say what came last: nothing,
system, user or assistant. The cheapest edits are found without a table of all rows: costs run forward from
the start and backward from the end as vectors of four, meet in the middle, the best state to cross there is
chosen, and both halves are solved in the same way (Hirschberg). Ranks that travel with the forward costs say
which of several equally cheap beginnings has the least audit text, so ties need no texts to be kept.

Long conversations are cut into blocks of at most 4096 rows. A block is summarised by the costs between its
four first and four last states; these small summaries alone decide where a conversation crosses from block
to block, and blocks are then solved on their own. Texts are moved once, for the repaired result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.common import narrow, stage

# Costs of the edits, initials of roles that may follow each other, blanks, ends of sentences.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

FINE, TRUNCATED, GONE = range(3)
LETTERS = "suax"             # x: any other initial
BLOCK_BITS = 12
FAR = 1 << 50

_LONGS = T.ArrayType(T.LongType())
SUMMARY = T.StructType([T.StructField("costs", _LONGS), T.StructField("ranks", _LONGS), T.StructField("illegal", T.LongType())])
CROSSING = T.StructType([T.StructField("block", T.LongType()), T.StructField("enter", T.IntegerType()),
                         T.StructField("leave", T.IntegerType()), T.StructField("ends", T.BooleanType()),
                         T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType())])


# --- edits of one row ---------------------------------------------------------------

def _inserted(state: int) -> list[tuple[str, int]]:
    """Insertions that may be useful before a row; a third one would come back to a state already met."""
    found, text = [("", state)], ""
    while len(found) < 3:
        step = [FOLLOW[found[-1][1]][c] for c in "ua" if c in FOLLOW[found[-1][1]]]
        text += "I"
        if any(s == step[0] for _, s in found):
            break
        found.append((text, step[0]))
    return found


def _moves(letter: str, fault: int) -> list[list[tuple[int, int, str]]]:
    """From each state: (next state, cost, edits) of one row, the cheapest and then least edits for each next state."""
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        for text, at in _inserted(state):
            ways = [(at, DELETE, "D")]
            if fault != GONE:
                extra = CUT_OFF if fault == TRUNCATED else 0
                ways += [(FOLLOW[at][letter], extra, "K")] if letter in FOLLOW[at] else []
                ways += [(FOLLOW[at][c], REROLE + extra, "R") for c in "ua" if c in FOLLOW[at]]
            for to, cost, edit in ways:
                way = (cost + INSERT * len(text), text + edit)
                best[to] = min(best.get(to, way), way)
        out.append([(to, *way) for to, way in sorted(best.items())])
    return out


MOVES = {chr(65 + 3 * i + fault): _moves(letter, fault) for i, letter in enumerate(LETTERS) for fault in range(3)}
#: Insertions that complete a conversation, by its last state.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
END_COSTS = [INSERT * len(TAILS[s]) for s in range(4)]


# --- vectors of four ------------------------------------------------------------------

def forward(symbols: str, enter: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after the rows, and the rank of the least audit that reaches each so cheaply.

    Audits end with the edit of the last row, so none is the beginning of another, and their order is that of
    the ranks before the row, then of the edits.
    """
    costs, ranks = [FAR] * 4, [0] * 4
    costs[enter] = 0
    for symbol in symbols:
        best: list = [None] * 4
        for state, ways in enumerate(MOVES[symbol]):
            if costs[state] < FAR:
                for to, cost, edits in ways:
                    way = (costs[state] + cost, ranks[state], edits)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        order = sorted((w[1:], s) for s, w in enumerate(best) if w)
        costs, ranks = [w[0] if w else FAR for w in best], [0] * 4
        for place, (_, state) in enumerate(order):
            ranks[state] = place
    return costs, ranks


def backward(symbols: str, after: list[int]) -> list[int]:
    """Least cost from each of the four states before the rows, given the costs after them."""
    for symbol in reversed(symbols):
        after = [min([cost + after[to] for to, cost, _ in ways], default=FAR) for ways in MOVES[symbol]]
    return after


def crossing(costs: list[int], ranks: list[int], after: list[int]) -> int:
    """The state to cross in: on a cheapest way, and of these the one with the least audit so far."""
    return min(range(4), key=lambda s: (costs[s] + after[s], ranks[s]))


def rebuild(symbols: str, enter: int, leave: int) -> list[str]:
    """Edits of each row, insertions before it included, on the least of the cheapest ways between two states."""
    if len(symbols) == 1:
        return [next(edits for to, _, edits in MOVES[symbols][enter] if to == leave)]
    half = len(symbols) // 2
    ends = [0 if s == leave else FAR for s in range(4)]
    middle = crossing(*forward(symbols[:half], enter), backward(symbols[half:], ends))
    return rebuild(symbols[:half], enter, middle) + rebuild(symbols[half:], middle, leave)


def summary(symbols: str) -> tuple[list[int], list[int], int]:
    """Of a block: costs and ranks of the last states from each first state, and neighbours that must not be."""
    costs, ranks = [], []
    for enter in range(4):
        c, r = forward(symbols, enter)
        costs += c
        ranks += r
    letters = [LETTERS[(ord(s) - 65) // 3] for s in symbols]
    return costs, ranks, sum(a + b not in LEGAL for a, b in zip(letters, letters[1:]))


def join_blocks(blocks: list) -> list[tuple[int, int, int, bool, int, int]]:
    """(block, enter, leave, is last, cost, illegal) of a conversation's blocks, from their summaries."""
    after = [END_COSTS]
    for b in reversed(blocks):
        after.append([min(b["costs"][4 * s + t] + after[-1][t] for t in range(4)) for s in range(4)])
    after.reverse()
    cost, enter, out = after[0][START], START, []
    edges = zip(blocks, blocks[1:])
    illegal = sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in LEGAL for a, b in edges)
    for k, b in enumerate(blocks):
        rows = slice(4 * enter, 4 * enter + 4)
        leave = crossing(b["costs"][rows], b["ranks"][rows], after[k + 1])
        out.append((b["block"], enter, leave, k == len(blocks) - 1, cost, illegal))
        enter = leave
    return out


@F.pandas_udf(SUMMARY)
def _summaries(symbols: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summary(s) for s in symbols], columns=SUMMARY.names)


@F.pandas_udf(T.ArrayType(CROSSING))
def _crossings(blocks: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(CROSSING.names, c)) for c in join_blocks([_row(b) for b in of])] for of in blocks])


def _row(b) -> dict:
    out = dict(b) if isinstance(b, dict) else b.asDict()
    return {**out, "costs": [int(c) for c in out["costs"]], "ranks": [int(r) for r in out["ranks"]]}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _edits(symbols: pd.Series, enter: pd.Series, leave: pd.Series, ends: pd.Series) -> pd.Series:
    """One entry a row; after the last row of a conversation one more with the insertions at its end."""
    return pd.Series([rebuild(s, e, to) + ([TAILS[to]] if last else [])
                      for s, e, to, last in zip(symbols, enter, leave, ends)])


# --- rows -------------------------------------------------------------------------------

ORDER = ["key", "turn", "role", "digest"]


def _rows(conversations: DataFrame) -> DataFrame:
    """``key, conv_id, turn, role, text, digest``; a null role or text is one space, as is a null in the key."""
    one = F.lit(" ")
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return rows.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "conv_id",
                       "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text")
                       ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a fault for one row in four, by ``crc32(conv_id:turn) % 20``:
    0 drops the row, 1 empties its text, 2 takes out all of ``.!?``, 3 repeats it, 4 makes it the user's.
    Nulls count as one space; conv_id and turn stay null where they were."""
    one = F.lit(" ")
    rows = narrow(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    text = F.coalesce("text", one)
    rows = rows.withColumn("fault", F.crc32(name) % 20).filter("fault <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.coalesce("role", one)).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _symbol(letter: Column, fault: Column) -> Column:
    place = F.lit(3)
    for k, c in enumerate(LETTERS[:-1]):
        place = F.when(letter == c, F.lit(k)).otherwise(place)
    return F.char(F.lit(65) + 3 * place + fault)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without texts, numbered over all conversations in their order, with the first fault of each."""
    bare = F.rtrim("text", F.lit(BLANKS))
    small = rows.select(*ORDER, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"),
                        F.monotonically_increasing_id().alias("salt"))
    # The salt only keeps rows that agree in everything from falling into one partition.
    ordered = stage(small.repartitionByRange(*ORDER, "salt").sortWithinPartitions(*ORDER, "salt")
                    .drop("salt").withColumn("id", F.monotonically_increasing_id()), "repair-ordered")
    same = ["key", "role", "digest"]
    repeated = stage(ordered.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("n"))
                     .filter("n > 1").drop("n"), "repair-repeated")
    fault = (F.when(F.col("blank"), "blank").when(F.col("id") > F.col("first"), "duplicate").when(F.col("cut"), "truncated"))
    return stage(ordered.join(repeated, same, "left").select(*ORDER, "id", fault.alias("fault")), "repair-marked")


def _plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of each conversation, and its edits block by block with the place of the block's first row."""
    marked = _marked(rows)
    count = {f: F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")}
    counts = (marked.groupBy("key", "turn").agg(*count.values()).groupBy("key").agg(
        F.coalesce((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long"), F.lit(0).cast("long")).alias("gaps"),
        *[F.sum(f).alias(f) for f in count]))
    weight = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(FINE)
    blocks = (marked.withColumn("symbol", _symbol(F.left("role", F.lit(1)), weight))
              .groupBy("key", F.shiftright("id", BLOCK_BITS).alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("id", "symbol"))).alias("rows"),
                   F.min_by(F.struct("turn", "role", "digest"), "id").alias("first")))
    blocks = blocks.select("key", "block", "first.*", F.array_join(F.col("rows.symbol"), "").alias("symbols"))
    blocks = stage(blocks.withColumn("sums", _summaries("symbols")), "repair-blocks")

    def letter(place: int) -> Column:
        code = F.floor((F.ascii(F.substring("symbols", place, 1)) - 65) / 3)
        return F.substring(F.lit(LETTERS), code.cast("int") + 1, F.lit(1))
    piece = F.struct("block", "sums.*", letter(1).alias("first"), letter(-1).alias("last"))
    crossed = (blocks.groupBy("key").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
               .select("key", F.inline(_crossings("pieces"))))
    edits = blocks.join(crossed, ["key", "block"]).select(
        *ORDER, "block", _edits("symbols", "enter", "leave", "ends").alias("edits"), "cost", "illegal")
    return counts, edits


def _stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's edits and rows in order: a block's edits come before the rows they are for. Blocks that
    begin with equal rows, copies that were cut apart, go by their number."""
    none = F.lit(None)
    texts = rows.select(*ORDER, F.lit(1).alias("kind"), none.cast("long").alias("block"), "text", none.cast("array<string>").alias("edits"),
                        none.cast("long").alias("cost"), none.cast("long").alias("illegal"))
    plans = edits.select(*ORDER, F.lit(0).alias("kind"), "block", none.cast("string").alias("text"), "edits", "cost", "illegal")
    return texts.unionByName(plans).repartition("key").sortWithinPartitions(*ORDER, "kind", "block").drop("digest", "turn", "block")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, edit, role, text) of every edit, and (key, None, cost, illegal) after a conversation.

    Rows pass by one at a time; what is held are edits whose rows are still to come.
    """
    key, state, waiting, sums = None, START, deque(), (0, 0)

    def play(edits, role="", text=""):
        nonlocal state
        for edit in edits:
            if edit == "D":
                yield key, edit, role, text
                continue
            letter = role[:1] if edit == "K" else next(c for c in "ua" if c in FOLLOW[state])
            state = FOLLOW[state][letter]
            yield key, edit, role if edit == "K" else NAMES[letter], "" if edit == "I" else text

    for batch in batches:
        for of, role, kind, text, edits, cost, illegal in zip(*(batch[c] for c in (
                "key", "role", "kind", "text", "edits", "cost", "illegal"))):
            if of != key:
                if key is not None:
                    while waiting:
                        yield from play(waiting.popleft())
                    yield key, None, *sums
                key, state = of, START
            if kind == 0:
                waiting.extend(edits)
                sums = (int(cost), int(illegal))
            else:
                yield from play(waiting.popleft(), role, text)
    if key is not None:
        while waiting:
            yield from play(waiting.popleft())
        yield key, None, *sums


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 512) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _turns(batches):
    def rows():
        place = 0
        for key, edit, role, text in _replay(batches):
            if edit is None:
                place = 0
            elif edit != "D":
                yield key, place, edit, role, text
                place += 1
    return _frames(rows(), ["key", "place", "edit", "role", "text"])


def _digests(batches):
    def rows():
        audit, seen, told = [], sha256(), 0
        for key, edit, role, text in _replay(batches):
            if edit is None:
                yield key, role, text, "".join(audit), seen.hexdigest()
                audit, seen, told = [], sha256(), 0
                continue
            audit.append(edit)
            if edit != "D":
                seen.update((("\n" if told else "") + f"{role}:{text}").encode("utf-8", "replace"))
                told += 1
    return _frames(rows(), ["key", "cost", "illegal", "audit", "repaired_sha256"])


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``.

    ``place`` counts from 0 without gaps; ``edit`` is K (kept), R (role changed) or I (inserted, empty text).
    Input and its odd cases are those of ``repair_conversations``.
    """
    rows = _rows(conversations)
    out = _stream(rows, _plan(rows)[1]).mapInPandas(
        _turns, "key string, place long, edit string, role string, text string")
    return out.join(rows.select("key", "conv_id").distinct(), "key").select("conv_id", "place", "edit", "role", "text")


def repair_conversations(conversations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``conversations`` (conv_id, turn, role, text).

    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text. The
    first fault of a row counts: ``blank``, ``duplicate`` (role and text seen earlier), ``truncated`` (the last
    character that is no blank is none of ``.!?``). ``illegal`` counts neighbours whose role initials are not
    su, ua or au; ``gaps`` missing turns. ``cost`` is that of the cheapest edits, ``audit`` their initials in
    order and the least in ASCII of those, ``repaired_sha256`` the digest of the repaired ``role:text`` lines.

    A null role or text is one space (so the row is blank and its role fits nowhere), a null conv_id is a
    conversation of its own, a turn column that is all null gives no gaps. ``known`` names conversations (conv_id) that
    are to appear even without rows: zeros, no audit, the digest of an empty text. An empty table gives an
    empty result. Other columns are not looked at.

    No task holds a conversation: order comes from a range partitioning of rows without texts, blocks hold at most 4096
    symbols, and the digest, sequential by nature, is fed row by row. The audit is one value of the result.
    """
    rows = _rows(conversations)
    counts, edits = _plan(rows)
    found = _stream(rows, edits).mapInPandas(
        _digests, "key string, cost long, illegal long, audit string, repaired_sha256 string")
    source = conversations if known is None else known
    ids = source.select(F.col("conv_id")).distinct().withColumn(
        "key", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    whole = ids.join(counts, "key", "left").join(found, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c)
               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
