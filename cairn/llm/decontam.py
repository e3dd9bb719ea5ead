"""Benchmark decontamination by template windows: typed placeholders, a hash join, and a check of the slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, in_batches

#: Words of a window.
WINDOW = 8
#: A run of this many matching words, or this share of an item's windows, makes a document contaminated.
RUN, COVERAGE = 13, 0.5
#: Benchmark windows up to which their hashes are sent to the tasks that read documents.
MOST_WINDOWS = 4_000_000

# Units that follow a number: abbreviations and words without a regular plural, and words with a plural in s. Fixed values.
_AS_THEY_ARE = (
    "mm cm m km in ft yd mi mg g kg lb oz t ml l gal s sec min h hr percent % c f k kelvin kmh kph mph hz khz mhz ghz w kw v a j kj cal kcal pa kpa bar b kb mb gb tb usd eur gbp foot feet inch inches celsius fahrenheit hertz "
    "penny pennies pence yen century centuries mois meses stunden tage tagen wochen monate monaten jahre jahren sekunden meilen unzen tonnen prozent grad zentimeter millimeter fuß zoll pfund unze gramm kilogramm"
)
_WITH_PLURAL = (
    "sec min hr second minute hour day week month year degree dollar cent euro mile kilometer kilometre meter metre centimeter centimetre millimeter millimetre yard acre hectare pound ounce gram kilogram kilo milligram ton tonne "
    "liter litre milliliter millilitre gallon quart pint cup teaspoon tablespoon watt volt amp joule calorie rupee peso franc quarter decade "
    "sekunde stunde tag woche monat jahr meile seconde heure jour semaine année pourcent degré mètre kilomètre centimètre pied pouce livre gramme "
    "segundo minuto hora día semana mes año grado metro kilómetro centímetro pulgada milla libra gramo litro céntimo"
)
UNITS = frozenset(_AS_THEY_ARE.split()) | {w + s for w in _WITH_PLURAL.split() for s in ("", "s")} | {"pies"}

_NUMBER = re.compile(r"[+-]?(?:[$€£])?\d[\d.,:/]*(?:%|[a-zA-Z]{1,3})?")
# Numbers as words, without those that are other words in another of the languages (once, cent, dos, mil). Fixed values.
_SPELLED = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante mille "
    "tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien".split()
)
_TRIM = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_P = np.uint64(0x100000001B3 * 2 + 1)

#: Classes of a word; START is a capitalised word at the start of a sentence, which may be a name.
WORD_, NUM, UNIT, NAME, START = 0, 1, 2, 3, 4
#: Words of a window that must be no slots where words at the start of sentences count as names.
LITERAL = 3
#: Items of fewer words are searched by their exact words.
SHORT = 4


def _h(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 7)


NUM_H, UNIT_H, NAME_H = _h("<num>"), _h("<unit>"), _h("<name>")


class Words(dict):
    """Number of each distinct raw word, with its trimmed form, hash and properties; filled as words are met."""

    def __init__(self) -> None:
        super().__init__()
        self.form: list[str] = []
        self.hash: list[int] = []
        self.flag: list[int] = []  # 1 number, 2 unit, 4 capital, 8 ends a sentence, 16 empty

    def __missing__(self, raw: str) -> int:
        form = _TRIM.sub("", raw)
        low = form.lower()
        flag = 0
        if _NUMBER.fullmatch(form) or low in _SPELLED:
            flag |= 1
        elif low in UNITS:
            flag |= 2
        elif form[:1].isupper():
            flag |= 4
        if raw[-1:] in ".!?:" or raw[-2:] in ('."', '!"', '?"', ".)"):
            flag |= 8
        if not form:
            flag |= 16
        self.form.append(form)
        self.hash.append(NUM_H if flag & 1 else _h(low))
        self.flag.append(flag)
        number = self[raw] = len(self.form) - 1
        return number


class Reader:
    """Turns texts into template words and windows."""

    def __init__(self, most_words: int = 1_000_000) -> None:
        self.words, self.most = Words(), most_words

    def read(self, texts: list[str]):
        """(doc index, word numbers, plain hash, template hash, hash with names at sentence starts, slot class) of all words of ``texts`` that have a letter or digit."""
        if len(self.words) > self.most:
            self.words = Words()
        get, ids, sizes = self.words.__getitem__, [], []
        for t in texts:
            w = t.split()
            ids.append(np.fromiter(map(get, w), np.int64, len(w)))
            sizes.append(len(w))
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        hashes, flags = np.array(self.words.hash, np.uint64), np.array(self.words.flag, np.int64)
        flag = flags[ids] if len(ids) else np.empty(0, np.int64)
        solid = (flag & 16) == 0
        ends = (flag & 8) > 0
        starts = np.ones(len(ids), bool)
        starts[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        ids, doc, flag, starts = ids[solid], doc[solid], flag[solid], starts[solid]
        plain = hashes[ids] if len(ids) else np.empty(0, np.uint64)
        number = (flag & 1) > 0
        unit = (flag & 2) > 0
        unit[1:] &= number[:-1]
        unit[:1] = False
        capital = (flag & 4) > 0
        name = capital & ~starts
        kind = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, np.where(capital, START, WORD_))))
        plain = np.where(unit, np.uint64(UNIT_H), plain)
        template = np.where(name, np.uint64(NAME_H), plain)
        return doc, ids, plain, template, np.where(capital, np.uint64(NAME_H), template), kind


def rolled(hashes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each run of ``window`` values."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            out *= _P
            out += hashes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def windows_of(reader: Reader, texts: list[str], window: int, wanted: np.ndarray | None = None):
    """Per window: text index, position, hash, slot values inside, and form; only hashes in ``wanted``, if given.

    A window is hashed in three forms: 0, with numbers and units replaced; 1, with names replaced as well; 2, with
    capitalised words at the start of a sentence too. A window shorter than ``SHORT`` has form 0 alone.
    """
    doc, ids, plain, template, started, kind = reader.read(texts)
    form = reader.words.form
    first = np.zeros(len(doc), np.int64)
    if len(doc):
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        first = np.repeat(new, np.diff(np.r_[new, len(doc)]))
    out = []
    screen = None
    if wanted is not None:
        screen = np.zeros(1 << 20, bool)
        screen[wanted >> np.uint64(44)] = True
    for which, hashes in ((0, plain), (1, template), (2, started))[: 3 if window >= SHORT else 1]:
        h = rolled(hashes, window)
        at = np.arange(len(h))
        good = doc[: len(h)] == doc[window - 1 :] if len(h) else np.empty(0, bool)
        if which == 1 and len(h):  # without a name both forms are the same
            names = np.cumsum(np.r_[0, kind == NAME])
            good = good & (names[window:] > names[:-window])
        if which == 2 and len(h):  # nor does the third form differ without a word at a start
            begun, literal = np.cumsum(np.r_[0, kind == START]), np.cumsum(np.r_[0, kind == WORD_])
            good = good & (begun[window:] > begun[:-window]) & (literal[window:] - literal[:-window] >= min(LITERAL, window // 2))
        if screen is not None and len(h):
            good = good & screen[h >> np.uint64(44)]
        at = at[good]
        h = h[good]
        if wanted is not None and len(h):
            spot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            hit = wanted[spot] == h
            at, h = at[hit], h[hit]
        for i, x in zip(at.tolist(), h.tolist(), strict=True):
            slots = [form[ids[j]].lower() for j in range(i, i + window) if kind[j] in (NUM, UNIT) or (which and kind[j] == NAME) or (which == 2 and kind[j] == START)]
            out.append((int(doc[i]), i - int(first[i]), x - (1 << 64) if x >> 63 else x, slots, which))
    return out, np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)


_WINDOWS = "{id} {kind}, pos int, h long, slots array<string>, n_words int, window int, form int"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, pos, h, slots, n_words, window, form): all windows of the benchmark; an item shorter than a window is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reader, out = Reader(), []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(reader.read([text or ""])[0])
                size = min(window, n)
                if not size:
                    continue
                out += [(item, p, h, s, n, size, f) for _, p, h, s, f in windows_of(reader, [text], size)[0]]
            yield _batch(out, batch.schema.field(0).type, ("item_id", "pos", "h", "slots", "n_words", "window", "form"))

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, _WINDOWS.format(id="item_id", kind=kind)).dropDuplicates(["item_id", "pos", "h"])


def _batch(rows: list[tuple], kind: pa.DataType, names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = [kind, pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, run: int = RUN, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, longest_run, n_slots, changed_slots): documents that hold a benchmark item.

    Numbers become <num>, units after a number <unit>, capitalised words inside a sentence <name>, and in a
    further form those at its start as well (in windows with ``LITERAL`` words that are no slots); windows of
    ``window`` template words are joined by hash. Of the windows that line up (same shift between document
    and item) the slots must agree: one item value always stands for one document value and the other way
    round; else only those with equal slots count. An item is in a document if a run of ``run`` words
    matches, or all of a shorter item, or ``coverage`` of its windows; this is decided without the further form
    and with it. Items of fewer than ``SHORT`` words are in a document that has their exact words in a row.

    Rows with a null id are handled like any id; null and empty texts match nothing; repeated rows of an id
    count as one document; an empty table on either side gives no rows; words without letter or digit are
    skipped, and so are items without any. Other columns are not read.
    """
    items = cut(item_windows(benchmark, window))
    wanted = None
    sizes = sorted(r[0] for r in items.select("window").distinct().collect())  # at most ``window`` values
    if not sizes:
        sizes = [window]
    if items.select("h").distinct().count() <= MOST_WINDOWS:  # proven small: a benchmark's windows
        arrays = {s: np.unique(items.where(F.col("window") == s).select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64)) for s in sizes}
        wanted = {s: a for s, a in arrays.items() if len(a)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            step, at = 2_000_000, 0
            while at < len(texts):  # so many characters at once
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= step:
                    size += len(texts[to])
                    to += 1
                out = []
                for s in sizes:
                    if wanted is not None and s not in wanted:
                        continue
                    found, n = windows_of(reader, texts[at:to], s, None if wanted is None else wanted[s])
                    out += [(ids[at + d], p, h, sl, int(n[d]), s, f) for d, p, h, sl, f in found]
                if out:
                    yield _batch(out, batch.schema.field(0).type, ("doc_id", "pos", "h", "slots", "n_words", "window", "form"))
                at = to

    found = in_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(search, _WINDOWS.format(id="doc_id", kind=kind))
    side = items.select("item_id", F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots"), F.col("n_words").alias("item_words"), "window", F.col("form").alias("item_form"))
    if wanted is not None:
        side = F.broadcast(side)  # at most MOST_WINDOWS hashes, checked above
    pairs = found.select("doc_id", "pos", "h", "slots", "window", "form").join(side, ["h", "window"])
    started = F.greatest("form", "item_form") == 2
    pairs = pairs.withColumn("started", F.explode(F.when(started, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    together = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    by_shift = pairs.groupBy("doc_id", "item_id", "window", "item_words", "started", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("at"),
        F.collect_set(F.when(F.col("item_slots") == F.col("slots"), F.col("item_pos"))).alias("same_at"),
        F.array_distinct(F.flatten(F.collect_set(together))).alias("filled"),
    )  # of one document, item and shift: at most the item's windows
    n = F.size("filled")
    agrees = (F.size(F.array_distinct(F.transform("filled", lambda x: x["i"]))) == n) & (F.size(F.array_distinct(F.transform("filled", lambda x: x["d"]))) == n)
    by_shift = by_shift.withColumn("use", F.when(agrees & (F.col("window") >= SHORT), F.col("at")).otherwise(F.col("same_at"))).where(F.size("use") > 0)
    sorted_use = F.array_sort("use")
    longest = F.aggregate(
        sorted_use,
        F.struct(F.lit(-9).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(x == a["last"] + 1, a["now"] + 1).otherwise(1).alias("now"),
            F.greatest(a["best"], F.when(x == a["last"] + 1, a["now"] + 1).otherwise(1)).alias("best"),
        ),
        lambda a: a["best"],
    )
    by_shift = by_shift.withColumn("longest", longest + F.col("window") - 1).withColumn("changed", F.size(F.filter("filled", lambda x: x["i"] != x["d"])))
    by_item = by_shift.groupBy("doc_id", "item_id", "window", "item_words", "started").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("use")))).alias("n_windows"), F.max("longest").alias("longest_run"), F.max(F.size("filled")).alias("n_slots"), F.max("changed").alias("changed_slots")
    )
    by_item = by_item.withColumn("item_windows", F.col("item_words") - F.col("window") + 1).withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    held = by_item.where((F.col("longest_run") >= F.least(F.lit(run), F.col("item_words"))) | (F.col("coverage") >= coverage))
    told = ["n_windows", "item_windows", "coverage", "longest_run", "n_slots", "changed_slots"]
    return held.groupBy("doc_id", "item_id").agg(F.min(F.struct("started", *told)).alias("f")).select("doc_id", "item_id", *[f"f.{c}" for c in told])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are.

    Each row is judged by its own text, whatever other rows have its id or a null id.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"].cast("string")) == bad["_bad"], "left_anti")
