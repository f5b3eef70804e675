"""Language identification of mixed texts: script ranges, word scores, Viterbi.

Each word is scored under every learned language by hashed letter trigrams.  The
script of its letters narrows the candidates to languages that were seen in that
script.  A Viterbi pass with a switching penalty labels spans of words, and the
language of the most letters is the document's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import text_chunks

GRAMS = 1 << 15
#: Documents of each language that are counted, about; all if there are fewer.
SAMPLE = 3000
#: Languages that are learned: those of the most documents, ties by name.
MOST_LANGS = 200
SWITCH, OUTSIDE = 6.0, -12.0
# First code point of ranges of letters and the script there.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "bengali"),
           (0xA00, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other")]
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_NOT_LETTERS = re.compile(r"(?:[^\w\n]|[\d_])+")
#: Signs that count as word characters without being letters or digits: fractions, Roman and circled numbers and the like.
_NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_WITHOUT = {ord(c): None for c in _NUMERALS}
_SEEDS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def read_words(words: list[bytes]):
    """(letters of each word, its script or -1, words of the grams, grams): grams are hashed trigrams of the letters with both ends marked."""
    text = _NOT_LETTERS.sub("", "\n" + b"\n".join(words).decode(errors="replace").lower() + "\n")
    if not _NUMERALS.isdisjoint(text):
        text = text.translate(_WITHOUT)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    end = code == 10
    of = np.cumsum(end) - 1
    sizes = np.diff(np.flatnonzero(end)) - 1
    first = code[np.minimum(np.flatnonzero(end)[:-1] + 1, len(code) - 1)]
    script = np.where(sizes > 0, _SCRIPT[np.maximum(0, np.searchsorted(_STARTS, first, side="right") - 1)], -1)
    middle = np.flatnonzero(~end[1:-1]) + 1
    h = code[middle - 1] * _SEEDS[0] + code[middle] * _SEEDS[1] + code[middle + 1] * _SEEDS[2]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return sizes, script, of[middle], (h % np.uint32(GRAMS)).astype(np.int64)


def distinct(split: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of all texts and the place of every word among them."""
    ids: dict[bytes, int] = {}
    put = ids.setdefault
    places = np.fromiter((put(w, len(ids)) for s in split for w in s), np.int64, sum(map(len, split)))
    return list(ids), places


def _counted(batches):
    """(lang, code, n): how often each gram occurs in this partition, and (codes from GRAMS on) how many letters of each script."""
    counts: dict[str, np.ndarray] = {}
    for (langs,), texts in text_chunks(batches, ["lang"]):
        split = [t.split() for t in texts]
        words, places = distinct(split)
        if not words:
            continue
        sizes, script, of, grams = read_words(words)
        at = np.repeat(np.array(langs, object), [len(s) for s in split])
        for lang in set(langs):
            often = np.bincount(places[at == lang], minlength=len(words))
            held = counts.setdefault(lang, np.zeros(GRAMS + len(_NAMES), np.int64))
            held[:GRAMS] += np.bincount(grams, weights=often[of], minlength=GRAMS).astype(np.int64)
            held[GRAMS:] += np.bincount(np.maximum(script, 0), weights=often * sizes, minlength=len(_NAMES)).astype(np.int64)
    for lang, held in counts.items():
        code = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(held[code])], names=["lang", "code", "n"])


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # languages by grams
    scripts: list[set[str]]


def train(docs: DataFrame, sample_docs: int = SAMPLE, most_langs: int = MOST_LANGS) -> Model:
    """Fit on about ``sample_docs`` whole documents of each language, drawn by hashed id; ``docs`` has doc_id, text, lang.

    The ``most_langs`` languages of the most documents are learned, so the
    counts that come to the driver are bounded.
    """
    known = docs.filter("lang is not null and text is not null")
    often = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    sizes = {r["lang"]: r["count"] for r in often.collect()}
    if not sizes:
        return Model([], np.zeros((0, GRAMS)), [])
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * 1_000_000)
    rows = drawn.select("lang", F.col("text").alias("t")).mapInArrow(_counted, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs, logs, scripts = sorted(set(rows["lang"])), [], []
    for lang in langs:
        mine = rows[rows["lang"] == lang]
        c = np.zeros(GRAMS + len(_NAMES))
        c[mine["code"]] = mine["n"]
        grams, letters = c[:GRAMS] + 0.3, c[GRAMS:]
        logs.append(np.log(grams / grams.sum()))
        scripts.append({k for k, n in zip(_NAMES, letters) if n and n >= 0.01 * letters.sum()})
    return Model(langs, np.array(logs), scripts)


def word_scores(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each word under each language, its letters); words without letters score 0 for all."""
    n, langs = len(words), len(model.langs)
    if not n or not langs:
        return np.zeros((n, max(1, langs)), np.float32), read_words(words)[0] if n else np.zeros(0, np.int64)
    sizes, script, of, grams = read_words(words)
    s = np.zeros((n, langs), np.float32)
    filled = np.flatnonzero(sizes > 0)
    if len(grams):
        s[filled] = np.add.reduceat(model.logs.T.astype(np.float32)[grams], np.searchsorted(of, filled), axis=0)
    s -= s.max(1, keepdims=True)
    s = np.maximum(s - np.log(np.exp(s).sum(1, keepdims=True)), OUTSIDE)
    fits = np.array([[name in held for held in model.scripts] for name in _NAMES])
    allowed = fits[np.maximum(script, 0)]
    s = np.where(allowed, s, OUTSIDE)
    s[~allowed.any(1) | (sizes == 0)] = 0.0
    return s.astype(np.float32), sizes


def viterbi(table: np.ndarray, words: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every word, all texts at once; texts are runs of ``words`` and switching labels costs ``penalty``."""
    out = np.zeros(len(words), np.int8)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), side="left")  # texts longer than each step
    stay = np.zeros((len(words), table.shape[1]), bool)
    came = np.zeros(len(words), np.int8)
    m = None
    for t in range(steps):
        n = active[t]
        at = starts[:n] + t
        s = table[words[at]]
        if m is None:
            m = s
        else:
            m = m[:n]
            best = m.argmax(1)
            other = m[np.arange(n), best] - penalty
            came[at] = best
            stay[at] = m >= other[:, None]
            m = np.maximum(m, other[:, None]) + s
        done = np.flatnonzero(counts[:n] == t + 1)
        if len(done):
            out[at[done]] = m[done].argmax(1)
    for t in range(steps - 1, 0, -1):
        at = starts[: active[t]] + t
        label = out[at]
        out[at - 1] = np.where(stay[at, label], label, came[at])
    return out


def label_spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans: spans are (lang, first word, word after the last) over words cut at ASCII white space.

    The language with the most letters wins, ties by its name; ``score`` is its
    share of the letters.  Null texts and texts without letters are ``und`` at 0
    with no spans.
    """
    langs = model.langs

    def label(batches):
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for (ids,), texts in text_chunks(batches, ["doc_id"], limit=6_000_000):
            split = [t.split() for t in texts]
            counts = np.array([len(s) for s in split], np.int64)
            names, words = distinct(split)
            del split
            table, sizes = word_scores(model, names)
            starts = np.cumsum(counts) - counts
            labels = viterbi(table, words, starts, counts, penalty) if langs and len(words) else np.zeros(len(words), np.int8)
            weight = sizes[words]
            of = np.repeat(np.arange(len(counts)), counts)
            sums = np.bincount(of * max(1, len(langs)) + labels, weights=weight, minlength=len(counts) * max(1, len(langs))).reshape(len(counts), -1)
            total, best = sums.sum(1), sums.argmax(1)
            new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])])) if len(words) else np.zeros(0, np.int64)
            ends = np.append(new[1:], len(words))
            spans = [[] for _ in ids]
            for a, b in zip(new.tolist(), ends.tolist()):
                k = of[a]
                if total[k] and langs:
                    spans[k].append({"lang": langs[labels[a]], "start": int(a - starts[k]), "end": int(b - starts[k])})
            found = [langs[b] if t and langs else "und" for b, t in zip(best, total)]
            score = [float(sums[i, best[i]] / total[i]) if total[i] and langs else 0.0 for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")


def held_out(doc_id):
    """Whether crc32 of the id as text is 2 modulo 4; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def identify(docs: DataFrame, sample_docs: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans for every row of ``docs`` (doc_id, text, lang).

    Only rows that are not held out teach the model.  Without any language to
    learn all rows are ``und``; repeated rows are labelled each; an empty table
    gives no rows; further columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.filter(~held_out(F.col("doc_id"))), sample_docs)
    return label_spans(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
