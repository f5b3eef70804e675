"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders.  Windows of template words of the benchmark are
joined by hash with those of the documents, so a question asked again with
other values is met like a verbatim one.  A window counts if its slots are
equal word for word, or consistent: along one alignment each of its values of
the item stands for one value of the document.  Where one stands for two, the
windows that hold it drop out, and those that share a value with such a window
of other values; the rest of the alignment counts.  Every window is also matched with names
left as they are, which finds copies whose letter case was changed, and word for
word with no placeholder at all, which finds copies of what is mostly numbers.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.llm.common import rolling, staged, text_chunks

WINDOW = 8
#: Words of a template window that must not be placeholders; words of an item that matches must cover.
LEAST_LITERAL, LEAST_COVERED = 4, 13
#: Hashes of benchmark windows that one pass over the documents holds; a larger benchmark takes more passes.
PASS_HASHES = 2_000_000
# Units that are placeholders after a number.
UNITS = frozenset("""% ° °c °f k mm cm m km in ft yd mi mg g kg t oz lb lbs ml l cl gal ms s sec min h hr hrs d day days week weeks month months year years
hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet
inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent
degree degrees hz khz mhz ghz w kw mw v a n j kj cal kcal b kb mb gb tb pa kpa mph kmh km/h m/s m2 m3 cm2 cm3""".split())
_NUMBER = regex.compile(r"[+\-−$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?[%°$€£]?")
_EDGE = regex.compile(r"^[^\p{L}\p{N}%°]+|[^\p{L}\p{N}%°]+$")
_ENDS = regex.compile(r"[.!?:…]\W*$")
#: ASCII marks that are no part of a word's core at its ends.
_MARKS = string.punctuation.replace("%", "").replace("_", "")
_HIT = "doc_id long, at int, hash long, size int, slots array<string>"


class Words:
    """What the template needs to know of each word, remembered for a bounded number of words."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.rows = limit, {}
        self._reset()

    def _reset(self):
        self.rows.clear()
        self.core, self.hash, self.flag = [], [], []

    def index(self, words: list[bytes]) -> list[int]:
        if len(self.rows) > self.limit:
            self._reset()
        get, out = self.rows.get, []
        for w in words:
            i = get(w)
            out.append(self._add(w) if i is None else i)
        return out

    def _add(self, raw: bytes) -> int:
        word = raw.decode(errors="replace")
        core = word.strip(_MARKS)
        if core.isalpha():  # most words: letters with ASCII marks around them
            low = core.lower()
            flags = 1 | 4 * (low in UNITS) | 8 * core[0].isupper()
            if word[-1] in _MARKS:
                tail = word[word.rindex(core) + len(core) :]
                flags |= 16 * ("." in tail or "!" in tail or "?" in tail or ":" in tail)
        else:
            core = _EDGE.sub("", word)
            low = core.lower()
            flags = (1 if core else 0) | 2 * (_NUMBER.fullmatch(core) is not None) | 4 * (low in UNITS) | 8 * (core[:1].isupper()) | 16 * (_ENDS.search(word) is not None)
        self.rows[raw] = i = len(self.core)
        self.core.append(low)
        self.hash.append(xxhash.xxh3_64_intdigest(low))
        self.flag.append(flags)
        return i


_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1F3D5B79A8C6E402, 0x2A4C6E8091B3D5F7, 0x3B5D7F9182A4C6E8))


def template(texts: list[bytes], words: Words):
    """(text number, core words, hashes of the words, of the template with names left, of the template, kinds) of all words but bare punctuation.

    Kinds: 0 literal, 1 number, 2 unit, 3 name.
    """
    split = [t.split() for t in texts]
    idx = np.array(words.index([w for s in split for w in s]), np.int64)
    of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    flag, hashes = np.array(words.flag, np.uint8)[idx], np.array(words.hash, np.uint64)[idx]
    first = np.ones(len(idx), bool)
    if len(idx) > 1:
        first[1:] = (of[1:] != of[:-1]) | (flag[:-1] & 16 > 0)
    keep = flag & 1 > 0
    idx, of, flag, hashes, first = idx[keep], of[keep], flag[keep], hashes[keep], first[keep]
    kind = np.zeros(len(idx), np.uint8)
    kind[(flag & 8 > 0) & ~first] = 3
    number = flag & 2 > 0
    unit = (flag & 4 > 0) & ~number
    if len(idx):
        unit[1:] &= number[:-1] & (of[1:] == of[:-1])
        unit[0] = False
    kind[number], kind[unit] = 1, 2
    plain = np.where(kind == 1, _NUM, np.where(kind == 2, _UNIT, hashes))
    return of, idx, hashes, plain, np.where(kind == 3, _NAME, plain), kind


def _windows(of, values, size):
    """(start, hash) of the windows of ``size`` words within one text."""
    h = rolling(values, size)
    at = np.flatnonzero(of[: len(h)] == of[size - 1 :][: len(h)]) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def _slots(words: Words, idx, kind, at: int, size: int, named: bool) -> list[str]:
    return [words.core[idx[i]] for i in range(at, at + size) if kind[i] and (named or kind[i] != 3)]


def _benchmark_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, cls, own, item_at, hash, size, item_slots, n_words); items shorter than WINDOW are one window.

    Items of one ``cls`` have the same template and repeat its slots alike, so
    the same texts are re-parameterisations of them; ``own`` names the words.
    """

    def cut(batches):
        words = Words()
        for (ids,), texts in text_chunks(batches, ["item_id"]):
            of, idx, literal, plain, named, kind = template(texts, words)
            out = [[] for _ in range(8)]
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            for k in range(len(texts)):
                a, b = ends[k], ends[k + 1]
                size = min(WINDOW, int(b - a))
                if not size:
                    continue
                order: dict[str, int] = {}
                repeats = [order.setdefault(x, len(order)) for x in _slots(words, idx, kind, a, b - a, True)]
                cls = xxhash.xxh3_64_intdigest(named[a:b].tobytes() + np.array(repeats, np.int64).tobytes())
                own = xxhash.xxh3_64_intdigest(literal[a:b].tobytes())
                held = set()

                def add(i, h, slots):
                    for col, x in zip(out, (ids[k], cls - (1 << 63), own - (1 << 63), i, h, size, slots, int(b - a))):  # noqa: B023
                        col.append(x)

                for values, is_named in ((named, True), (plain, False)):
                    for i, h in enumerate(rolling(values[a:b], size).view(np.int64).tolist()):
                        slots = _slots(words, idx, kind, a + i, size, is_named)
                        if size - len(slots) >= LEAST_LITERAL and (is_named or (kind[a + i : a + i + size] == 3).any()):
                            add(i, h, slots)
                            held.add(i)
                for i, h in enumerate(rolling(literal[a:b], size).view(np.int64).tolist()):
                    if i not in held or np.isin(kind[a + i : a + i + size], (1, 2)).any():  # without numbers and units a template is word for word
                        add(i, h, [])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["item_id", "cls", "own", "item_at", "hash", "size", "item_slots", "n_words"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t")).filter("item_id is not null")
    return rows.mapInArrow(cut, "item_id long, cls long, own long, item_at int, hash long, size int, item_slots array<string>, n_words int")


def _hits(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """Windows of the documents whose hash is among the wanted ones of their size."""

    def search(batches):
        words = Words()
        sieve = {}
        for size, hashes in wanted.items():
            sieve[size] = np.zeros(1 << 22, bool)
            sieve[size][(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for (ids,), texts in text_chunks(batches, ["doc_id"]):
            of, idx, literal, plain, named, kind = template(texts, words)
            starts = np.searchsorted(of, np.arange(len(texts)))
            out = [[] for _ in range(5)]
            # each way of reading a window, and the kinds of word without which it is one of the others
            ways = [(named, ()), (plain, (3,)), (literal, (1, 2))]
            ways = [(values, kinds) for values, kinds in ways if not kinds or np.isin(kind, kinds).any()]
            for size, hashes in wanted.items():
                for values, kinds in ways:
                    at, h = _windows(of, values, size)
                    near = sieve[size][(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
                    at, h = at[near], h[near]
                    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    found = hashes[place] == h
                    for i, x in zip(at[found].tolist(), h[found].view(np.int64).tolist()):
                        if not kinds or np.isin(kind[i : i + size], kinds).any():
                            slots = [] if values is literal else _slots(words, idx, kind, i, size, values is named)
                            for col, y in zip(out, (ids[of[i]], i - int(starts[of[i]]), x, size, slots)):
                                col.append(y)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "at", "hash", "size", "slots"])

    return docs.mapInArrow(search, _HIT)


_values = lambda w: F.transform(w["pairs"], lambda p: p["a"])
_literal = lambda w: F.forall(w["pairs"], lambda p: p["a"] == p["b"])


def _clashes(windows: Column) -> Column:
    """Item values that the windows (item_at, pairs) of one alignment give different document values."""
    pairs = F.array_sort(F.array_distinct(F.flatten(F.transform(windows, lambda w: w["pairs"]))))
    n = F.greatest(F.size(pairs) - 1, F.lit(0))
    twice = F.zip_with(F.slice(pairs, F.lit(1), n), F.slice(pairs, F.lit(2), n), lambda p, q: F.when(p["a"] == q["a"], p["a"]))
    return F.array_distinct(F.array_compact(twice))


def _with_sound(df: DataFrame, windows: str) -> DataFrame:
    """``df`` with the windows of the column that hold under one mapping of item values (sound), and those word for word (same)."""
    df = df.withColumn("clashes", _clashes(F.col(windows)))
    at_odds = F.filter(windows, lambda w: ~_literal(w) & F.arrays_overlap(_values(w), F.col("clashes")))
    df = df.withColumn("doubted", F.array_distinct(F.concat("clashes", F.flatten(F.transform(at_odds, _values)))))
    sound = F.filter(windows, lambda w: _literal(w) | ~F.arrays_overlap(_values(w), F.col("doubted")))
    return df.withColumn("sound", _words(sound)).withColumn("same", _words(F.filter(windows, _literal))).drop("clashes", "doubted")


def _words(windows: Column) -> Column:
    """Places in the item of the words that windows cover."""
    starts = F.array_distinct(F.transform(windows, lambda w: w["item_at"]))
    return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + F.col("size") - 1))))


def _covered(pairs: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered) under the best single mapping: of one alignment, or of all of them together."""
    lines = pairs.groupBy("doc_id", "item_id", "n_words", "size", "line").agg(F.collect_set(F.struct("item_at", "pairs")).alias("windows"))
    lines = _with_sound(lines, "windows")
    both = lines.groupBy("doc_id", "item_id", "n_words", "size").agg(F.flatten(F.collect_list("windows")).alias("windows"), F.collect_list("sound").alias("each"))
    both = _with_sound(both, "windows")
    best = F.array_max(F.transform("each", lambda x: F.size(F.array_union(F.col("same"), x))))
    return both.select("doc_id", "item_id", "n_words", F.greatest(best, F.size("sound")).alias("n_covered"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_covered, n_words): documents that hold a benchmark item or a re-parameterised one.

    ``n_covered`` of the item's ``n_words`` template words lie in matched
    windows of WINDOW words (the whole item, if shorter): word for word, or with
    slots that are consistent under one mapping, that of one alignment or of all
    alignments together.  Bare punctuation, signs of arithmetic included, isn't
    a word.  A pair needs LEAST_COVERED of them, or all of a shorter item.
    Windows with fewer than LEAST_LITERAL words that aren't placeholders match
    word for word alone.

    A re-parameterised item is reported once for all items of its template that
    repeat slots alike, under the least id; the others of these are reported
    where they occur word for word; items of the same words are one, under the
    least id.  Null and empty texts match nothing; a null id can't be reported,
    so such rows give no pair; repeated rows give one pair; empty tables give no
    rows; further columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    windows = staged(_benchmark_windows(benchmark, item_id, item_text), "benchmark")
    passes = max(1, -(-windows.count() // PASS_HASHES))
    hits = None
    for k in range(passes):
        part = windows.filter(F.pmod(F.col("hash"), F.lit(passes)) == k).select("size", "hash").distinct().toPandas()  # PASS_HASHES rows or so
        wanted = {int(s): np.sort(g["hash"].to_numpy().view(np.uint64)) for s, g in part.groupby("size")}
        found = _hits(rows, wanted)
        hits = found if hits is None else hits.unionByName(found)
    hits = staged(hits.filter("doc_id is not null"), "hits")
    least = windows.groupBy("cls", "own").agg(F.min("item_id").alias("of"))
    least = least.withColumn("first", F.min("of").over(Window.partitionBy("cls")) == F.col("of")).select("of", "first")
    of_item = windows.drop("cls", "own").join(least, F.col("item_id") == F.col("of")).drop("of")
    met = hits.join(of_item.filter("first"), ["hash", "size"]).filter("size(slots) = size(item_slots)")
    verbatim = hits.join(of_item.filter("not first"), (hits["hash"] == of_item["hash"]) & (hits["size"] == of_item["size"]) & (F.col("slots") == F.col("item_slots"))).drop(of_item["hash"]).drop(of_item["size"])
    zipped = F.transform(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    pairs = met.unionByName(verbatim).withColumn("pairs", zipped).withColumn("line", F.col("at") - F.col("item_at"))
    out = _covered(pairs).filter(F.col("n_covered") >= F.least(F.lit(LEAST_COVERED), F.col("n_words")))
    return out.select("doc_id", "item_id", F.col("n_covered").cast("long").alias("n_covered"), F.col("n_words").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (columns doc_id and text, others kept) without the contaminated ones; rows with a null id stay."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == F.col("__bad"), "left_anti")
