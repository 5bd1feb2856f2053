"""Benchmark decontamination by canonical templates and slot consistency."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm.common import stage

WINDOW = 8               # template tokens of a window; shorter items are one window
LITERALS = 3             # a window with slots and fewer plain words says nothing (shorter items: one)
MIN_COVERAGE = 0.5       # share of an item's windows in one document
MIN_RUN = 13             # or so many windows in a row: 20 tokens
BLOCK = 1 << 20          # benchmark windows that a task holds at once; more take further passes

# Units of measure, currencies and calendar words that are slots of their own type.
UNITS = frozenset(
    "% $ € £ ¥ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
    "lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents mph kmh "
    "meter meters metre metres kilometer kilometers kilometre kilometres percent degree degrees "
    "zentimeter millimeter fuß zoll meile meilen gramm kilogramm tonne tonnen pfund unze unzen sekunde sekunden minuten stunde "
    "stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "mètre mètres centimètre centimètres kilomètre kilomètres gramme grammes kilogramme kilogrammes livre livres once onces "
    "seconde secondes heure heures jour jours semaine semaines mois an ans année années pourcent degré degrés centime centimes "
    "metro metros centímetro centímetros kilómetro kilómetros gramo gramos kilo kilos kilogramo kilogramos tonelada toneladas "
    "libra libras onza onzas litro litros milla millas segundo segundos minuto minutos hora horas día días semana semanas mes "
    "meses año años dólar dólares céntimo céntimos grado grados".split())
# Numbers written as words. One is left out, as in these languages it is an article, too.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante "
    "mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split())
# Words that open sentences without being names. Words that are names as well (Will, May, Mark) are not here.
OPENERS = frozenset(
    "a about add after all also although among an and any are as assume at based because before both but by calculate can "
    "choose complete compute consider could determine did do does each either estimate evaluate every explain express factor "
    "find first five for four from give given he her here his how however identify if in is it its let list many more most "
    "multiply name no not now of on one only or other our out round select she should show simplify since six so solve some "
    "subtract suppose ten that the their then there these they this those three to two under using was we were what when "
    "where which while who whom whose why with without write you your "
    "alle als am auch auf aus bei berechne bestimme da dann das dass den der des die diese dieser ein eine einer er es finde "
    "für gib ihr im ist jede jeder löse mit nach nun nur ob sei sie sind so und vom von wann warum was welche welcher welches "
    "wenn wer wie wo während zeige zu "
    "au aux avec calcule calculez ce ces cette chaque combien comment dans de donnez du elle en est et étant il ils la le les leur "
    "lorsque mais montrez où par pour pourquoi quand que quel quelle quelles quels qui sa ses si soit son sont sur trouve trouvez un une "
    "al calcula cada como con cuando cuántas cuánto cuántos cuál cómo del demuestra determina dónde e el ella ellos en entonces "
    "es esta este halla las lo los para pero por qué quién se según si sin sobre su sus un una y".split())
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£¥°]|[.!?:;\n]")
WORD, NUMBER, CAPITAL, UNIT, STOP, OPENER = range(6)
PLACEHOLDER = {NUMBER: 0x9D39247E33776D41, CAPITAL: 0x2AF7398005AAA5C7, UNIT: 0x44DB015024623547}
STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 19          # characters of texts that are worked on together

# How a capitalised word that begins a sentence is read, or no slots at all. Windows meet windows of the same reading only.
AS_WORD, AS_NAME, VERBATIM = range(3)
READINGS = (AS_WORD, AS_NAME, VERBATIM)


def _spell(token: str) -> int:
    """64-bit value of a token, without case."""
    raw = token.casefold().encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)) ^ len(raw)


class Speller(dict):
    """Token -> place of its value and class, computed once; forgets all between texts when it has grown."""

    def __init__(self):
        super().__init__()
        self.values, self.kinds = array("Q"), array("b")

    def __missing__(self, token: str) -> int:
        first = token[0]
        kind = (NUMBER if first.isdigit() or token.lower() in NUMBER_WORDS else STOP if first in ".!?:;\n" else UNIT if token.lower() in UNITS
                else WORD if not first.isupper() else OPENER if token.lower() in OPENERS else CAPITAL)
        self[token] = place = len(self.values)
        self.values.append(_spell(token))
        self.kinds.append(kind)
        return place

    def spelled(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Value and class of all tokens, text after text."""
        if len(self) > 300_000:
            self.clear()
            self.values, self.kinds = array("Q"), array("b")
        place = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if not len(place):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8)
        return np.array(self.values, np.uint64)[place], np.array(self.kinds, np.int8)[place]


def template(value: np.ndarray, kind: np.ndarray, text: np.ndarray, reading: int) -> tuple[np.ndarray, ...]:
    """(canonical, value, class, text) of the tokens of texts; ``text`` numbers the text of each token.

    A number, in digits or as a word, is a slot; so is a unit right before or after one, and a capitalised word. One that begins a
    sentence is a plain word in the reading AS_WORD; in AS_NAME it is a slot, too, unless it is one of
    OPENERS. Names in a row are one slot. Other words stand for themselves, without case. VERBATIM has no
    slots: each token stands for itself, so that copies in any case or line length are the same.
    """
    if reading == VERBATIM:
        words = kind != STOP
        return value[words], value[words], np.zeros(int(words.sum()), np.int8), text[words]
    begins = np.ones(len(kind), bool)
    begins[1:] = (kind[:-1] == STOP) | (text[1:] != text[:-1])
    plain = begins & ((kind == OPENER) | ((kind == CAPITAL) & (reading == AS_WORD)))
    kind = np.where(plain, WORD, np.where(kind == OPENER, CAPITAL, kind)).astype(np.int8)
    words = kind != STOP
    value, kind, text = value[words], kind[words], text[words]
    number, joined = kind == NUMBER, np.zeros(len(kind), bool)
    joined[1:] = text[1:] == text[:-1]
    beside = np.zeros(len(kind), bool)
    beside[1:] |= number[:-1] & joined[1:]
    beside[:-1] |= number[1:] & joined[1:]
    kind[(kind == UNIT) & ~beside] = WORD
    name = kind == CAPITAL
    if name.any():                              # a run of names is one slot with a common value
        first = name.copy()
        first[1:] &= ~(name[:-1] & joined[1:])
        sums = np.zeros(int(first.sum()), np.uint64)
        np.add.at(sums, (np.cumsum(first) - 1)[name], value[name] * STEP)
        value = value.copy()
        value[first] = sums
        keep = ~name | first
        value, kind, text = value[keep], kind[keep], text[keep]
    canonical = value.copy()
    for k, mark in PLACEHOLDER.items():
        canonical[kind == k] = np.uint64(mark)
    return canonical, value, kind, text


def window_hashes(canonical: np.ndarray, kind: np.ndarray, text: np.ndarray, widths: list[int],
                  reading: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, hashes, telling) of the windows from each token on: whether it lies in one text and has enough plain words.
    Without slots, every window of one text is telling."""
    mixed = canonical * STEP
    mixed ^= mixed >> np.uint64(29)
    state = np.full(len(mixed), reading + 1, np.uint64)
    plain = np.concatenate(([0], np.cumsum(kind == WORD)))
    for width in range(1, min(max(widths, default=0), len(mixed)) + 1):
        n = len(mixed) - width + 1
        state = (state[:n] ^ mixed[width - 1:]) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(31)
        if width in widths:
            hashes = (state + np.uint64(width)) * STEP
            telling = text[:n] == text[width - 1:]
            if reading != VERBATIM:
                telling &= plain[width:] - plain[:n] >= min(LITERALS, max(1, width // 2))
            yield width, (hashes ^ hashes >> np.uint64(32)).view(np.int64), telling


WINDOW_COLUMNS = ("id long, copy long, reading int, width int, at int, hash long, slots array<struct<place: int, kind: int, value: long>>, "
                  "total int")


class Wanted:
    """Membership in a sorted array of hashes; a table of bits spares most searches."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, bits = hashes, int(np.clip(len(hashes).bit_length() + 4, 16, 25))
        self.mask = np.int64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[hashes & self.mask] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[hashes & self.mask])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def _rows(idents: list[tuple[int, int]], texts: list[str], widths, wanted: Wanted | None, speller: Speller) -> list[tuple]:
    """Windows of texts: all, or those whose hash is ``wanted``. Without ``widths``, of one text."""
    tokens = [TOKEN.findall(t) for t in texts]
    spelled, out = speller.spelled(tokens), []
    number = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
    for reading in READINGS:
        canonical, value, kind, text = template(*spelled, number, reading)
        start = np.searchsorted(text, np.arange(len(texts)))
        for width, hashes, telling in window_hashes(canonical, kind, text, widths or [min(WINDOW, len(kind))], reading):
            total = np.bincount(text[:len(telling)][telling], minlength=len(texts))
            found = np.flatnonzero(telling) if wanted is None else wanted.places(hashes)
            for at in found[telling[found]].tolist():
                own = int(text[at])
                place = at - int(start[own])
                slots = [(place + k, int(kind[at + k]), int(value[at + k].view(np.int64)))
                         for k in range(width) if kind[at + k] != WORD]
                out.append((*idents[own], reading, width, place, int(hashes[at]), slots, int(total[own])))
    return out


def windows(rows: DataFrame, id_column: str, widths: list[int] | None = None, wanted=None) -> DataFrame:
    """Template windows of ``rows`` (id, text). ``wanted``: broadcast sorted hashes to keep.

    ``copy`` is a hash of the text: rows that share an id and differ in text stay apart."""
    names = ["id", "copy", "reading", "width", "at", "hash", "slots", "total"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller, kept = Speller(), None if wanted is None else Wanted(wanted.value)
        for batch in batches:
            found, idents, texts, size = [], [], [], 0
            for ident, copy, text in zip(batch["id"], batch["copy"], batch["text"]):
                if not pd.isna(ident) and text:
                    idents.append((int(ident), int(copy)))
                    texts.append(text)
                    size += len(text)
                if texts and (size > CHUNK or widths is None):
                    found += _rows(idents, texts, widths, kept, speller)
                    idents, texts, size = [], [], 0
                if len(found) > 20_000:
                    yield pd.DataFrame(found, columns=names)
                    found = []
            if texts:
                found += _rows(idents, texts, widths, kept, speller)
            yield pd.DataFrame(found, columns=names)

    text = F.col("text").cast("string")
    narrow = rows.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return narrow.mapInPandas(of, WINDOW_COLUMNS)


def _hits(docs: DataFrame, items: DataFrame, id_column: str) -> DataFrame:
    """Windows of documents that some item has. The benchmark's hashes go to the tasks in blocks of a
    bounded size, one after another, so that no window of another text is ever shuffled and a task
    never holds more than one block."""
    spark = docs.sparkSession
    distinct = items.select("hash", "width").distinct()
    size = distinct.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    blocks, found = max(1, -(-size.n // BLOCK)), None
    for b in range(blocks if size.n else 0):
        part = distinct.filter(F.pmod("hash", F.lit(blocks)) == b).select("hash").toPandas()["hash"]
        wanted = spark.sparkContext.broadcast(np.unique(part.to_numpy(np.int64)))
        if len(wanted.value):
            own = windows(docs, id_column, sorted(size.widths), wanted)
            if blocks > 1:
                own = stage(own, "leak-block")
                wanted.unpersist()
            found = own if found is None else found.unionByName(own)
    return found if found is not None else windows(docs.limit(0), id_column)


def candidates(item: DataFrame, hit: DataFrame) -> DataFrame:
    """Pairs of a document and an item that share one of the item's least frequent windows.

    A leak holds a share of the item's T windows or a run of them. Of any T - ceil(share x T) + 1 windows it
    holds one, so the item is looked up by that many, those that the fewest documents have; and of every run
    that the item has room for, it is looked up by the rarest window (of equal ones that with the least hash).
    A window that many items and many documents share thus makes no pairs unless most of the item, or a whole
    run, consists of such windows, and then the pairs are leaks or fail by their slots only. No leak is lost.
    """
    key, own = ["hash", "width", "reading"], ["item_id", "item_copy", "reading"]
    often = hit.groupBy(*key).agg(F.count("*").alias("n"))
    told = item.drop("item_slots").join(often, key, "left").fillna(0, ["n"])
    each, run = W.partitionBy(*own), W.partitionBy(*own).orderBy("item_at").rangeBetween(0, MIN_RUN - 1)
    ranked = told.withColumns({
        "rank": F.row_number().over(each.orderBy("n", "hash", "item_at")),
        "least": F.when(F.count("*").over(run) == MIN_RUN, F.min(F.struct("n", "hash", "width")).over(run))})
    needed = F.ceil(F.lit(MIN_COVERAGE) * F.col("windows"))
    scattered = ranked.filter(F.col("rank") <= F.col("windows") - needed + 1).select(*own, "n", "hash", "width")
    probes = scattered.unionByName(ranked.filter("least is not null").select(*own, "least.*")).filter("n > 0").drop("n").distinct()
    return hit.join(probes, key).select("doc_id", "doc_copy", *own).distinct()


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """Pairs of a document and a benchmark item it contains, word for word or with other slot values.

    doc_id, item_id, matched (distinct windows of the item found), windows (all of the item), coverage,
    longest_run (windows in a row) and same_values (no slot differs).

    Windows are joined by hash. Along one alignment (document place minus item place) each slot value of
    the item has to stand for one value of the document, and the other way round. The value seen most
    often (of equal ones the smaller) is the one; windows with any other do not count. Null ids, null and empty texts take no part; repeated rows count once. A
    passage that a third of all documents hold makes one hit per window and document. Each reading is judged on its own,
    and so is each text of an id that has several; the figures are those with the greatest coverage, then the longest run,
    then the first reading. Slots are compared for the pairs of ``candidates`` only.
    """
    place = ["id", "copy", "reading", "width", "at"]
    own = stage(windows(items, item_column).dropDuplicates(place), "leak-items")
    item = own.select(F.col("id").alias("item_id"), F.col("copy").alias("item_copy"), "reading", F.col("at").alias("item_at"), "hash", "width",
                      F.col("slots").alias("item_slots"), F.col("total").alias("windows"))
    hits = stage(_hits(docs, own, id_column).dropDuplicates(place), "leak-hits")
    hit = hits.select(F.col("id").alias("doc_id"), F.col("copy").alias("doc_copy"), "reading", F.col("at").alias("doc_at"), "hash", "width",
                      F.col("slots").alias("doc_slots"))
    pair = ["doc_id", "doc_copy", "item_id", "item_copy", "reading"]
    line = [*pair, "shift"]
    asked = stage(candidates(item, hit), "leak-pairs").join(item, ["item_id", "item_copy", "reading"])
    met = stage(hit.join(asked, ["doc_id", "doc_copy", "reading", "hash", "width"])
                .withColumn("shift", F.col("doc_at") - F.col("item_at")), "leak-met")
    slots = met.select(*line, "item_at", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("z")).select(
        *line, "item_at", F.col("z.item_slots.kind").alias("kind"), F.col("z.item_slots.value").alias("asked"),
        F.col("z.doc_slots.value").alias("given"))
    pairs = slots.groupBy(*line, "kind", "asked", "given").agg(F.count("*").alias("n"))
    most = [F.desc("n"), "asked", "given"]
    rank = {side: F.row_number().over(W.partitionBy(*line, "kind", side).orderBy(*most)) for side in ("asked", "given")}
    other = (pairs.withColumns({"by_asked": rank["asked"], "by_given": rank["given"]})
             .filter("by_asked > 1 or by_given > 1").select(*line, "kind", "asked", "given"))
    torn = slots.join(other, [*line, "kind", "asked", "given"], "left_semi").select(*line, "item_at").distinct()
    kept = met.join(torn, [*line, "item_at"], "left_anti")
    # Windows in a row keep the difference of place and rank, along one alignment of one pair only.
    ranked = kept.withColumn("run", F.col("item_at") - F.row_number().over(W.partitionBy(*line).orderBy("item_at")))
    same = F.expr("forall(arrays_zip(item_slots, doc_slots), z -> z.item_slots.value = z.doc_slots.value)")
    runs = ranked.groupBy(*line, "run").agg(F.count("*").alias("length"), F.bool_and(same).alias("same"),
                                            F.max("windows").alias("windows"))
    long = runs.groupBy(*pair).agg(F.max("length").alias("longest_run"), F.bool_and("same").alias("same_values"),
                                   F.max("windows").cast("long").alias("windows"))
    seen = kept.select(*pair, "item_at").distinct().groupBy(*pair).agg(F.count("*").alias("matched"))
    both = long.join(seen, pair).withColumn("coverage", F.col("matched") / F.col("windows"))
    enough = both.filter((F.col("coverage") >= MIN_COVERAGE) | (F.col("longest_run") >= MIN_RUN))
    best = F.max(F.struct("coverage", "longest_run", (-F.col("reading")).alias("order"), "matched", "windows", "same_values"))
    return enough.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", *[f"best.{c}" for c in ("matched", "windows", "coverage", "longest_run", "same_values")])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; rows with a null doc_id stay."""
    found = stage(leaks(docs, items).select(F.col("doc_id").alias("_leak")).distinct(), "leak-docs")
    return docs.join(found, docs["doc_id"] == found["_leak"], "left_anti")
