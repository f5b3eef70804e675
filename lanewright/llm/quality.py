"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on two questions, whether a text is junk
and whether it is toxic; human labels, where there are any, are one more
labeller of each.  One labeller goes by families of words that are frequent in
toxic documents; on each half of the sample it uses the words chosen on the
other half, so it doesn't repeat the labels it is judged by.  Expectation-maximisation estimates every labeller's
sensitivity and specificity from the votes, and the posterior labels train two
hashed linear scorers: one on shares of word shapes and of repetition, one on
hashed words and word beginnings.  Both are fitted on at most SAMPLE labelled
documents and then score every document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import mix, rolling, text_chunks

#: The bound of the sample of labelled documents that the scorers are fitted on.
SAMPLE = 8000
SHAPES, TERMS, MOST_TERMS = 1 << 10, 1 << 20, 4096
#: Least documents and least z-score of a term that the toxicity scorer weighs.
LEAST_DOCS, LEAST_Z = 3, 4.5
#: Copies are told by terms in one of this many documents or fewer.
RARE = 200
# Insults that one labeller looks for, in the languages of general web text.
INSULTS = frozenset("""idiot idiots moron morons stupid scum trash garbage worthless pathetic loser losers clown disgusting dumb imbecile retard bastard
vermin filth idiota idiotas basura imbécil estúpido estúpida asqueroso inútil payaso asco crétin débile connard ordure abruti pathétique
dégueulasse minable dummkopf abschaum müll idiotisch wertlos erbärmlich trottel ekelhaft widerlich arschloch""".encode().split())
JUNK_VOTERS = ("symbols", "shouting", "separators", "repetition", "human")
TOXIC_VOTERS = ("insults", "family", "human")


_PLAIN = b" \t\n\r\x0b\x0c"
_LOWER, _UPPER, _DIGIT = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Classes of bytes: small, capital, digit, other letter (all beyond ASCII); white space and marks stand for themselves.
CLASSES = bytes(97 if c in _LOWER else 65 if c in _UPPER else 57 if c in _DIGIT else 117 if c > 127 else c for c in range(256))
NOT_LETTERS = bytes(c for c in range(128) if c not in _LOWER + _UPPER + _PLAIN)
COMMON_MARKS = b"aAu9.,;:'\"()!?-"


class Shapes(dict):
    """Word shape -> (bucket, has odd marks, is loud, is bare of letters and digits), for a bounded number of shapes."""

    def __missing__(self, shape: bytes):
        if len(self) >= 100_000:
            self.clear()
        short = re.sub(rb"(.)\1{2,}", rb"\1\1", shape)[:8]
        odd = len(shape.translate(None, COMMON_MARKS)) > 1
        loud = shape.count(b"A") > 1 and b"a" not in shape
        self[shape] = out = (zlib.crc32(short) % (SHAPES - 8), odd, loud, not any(c in b"aAu9" for c in shape))
        return out


def cores(text: bytes) -> set[bytes]:
    """Distinct words in small letters, without digits and marks."""
    return set(text.lower().translate(None, NOT_LETTERS).split())


def term_buckets(core: bytes) -> list[int]:
    """Hash buckets of a word and of its first 4, 5 and 6 bytes; none for words of one or two bytes."""
    if len(core) < 3:
        return []
    return [zlib.crc32(core, 1) % TERMS, *(zlib.crc32(core[:n], n) % TERMS for n in (4, 5, 6) if len(core) > n)]


def _style(text: bytes, memo: Shapes):
    """(shape buckets, their shares and the repetition features, votes for junk)."""
    words = text.split()
    n = len(words)
    if not n:
        return [], [], [0, 0, 0, 0]
    shares, symbols, loud, bare = {}, 0, 0, 0
    for shape, k in Counter(text.translate(CLASSES).split()).items():
        bucket, is_odd, is_loud, is_bare = memo[shape]
        shares[bucket] = shares.get(bucket, 0) + k / n
        symbols, loud, bare = symbols + k * is_odd, loud + k * is_loud, bare + k * is_bare
    symbols, loud, bare, again = symbols / n, loud / n, bare / n, sum(map(eq, words, words[1:])) / n
    repeats = 0.0
    if n > 8:
        runs = rolling(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 5)
        repeats = 1 - len(np.unique(runs)) / len(runs)
    extra = (again, max(0.0, again - 0.2), repeats, max(0.0, repeats - 0.3), symbols, loud, bare)
    shares |= {SHAPES - 8 + i: v for i, v in enumerate(extra) if v}
    return list(shares), list(shares.values()), [int(symbols > 0.1), int(loud > 0.5 and n > 2), int(bare > 0.1), int(again > 0.3 or repeats > 0.3)]


def _measure(text: bytes, memo: Shapes):
    at, shares, votes = _style(text, memo)
    words = cores(text)
    terms, numbers = np.unique(np.array([t for w in words for t in term_buckets(w)], np.int64), return_counts=True)
    return at, shares, terms.tolist(), np.minimum(numbers, 100).tolist(), votes, int(not INSULTS.isdisjoint(words))


_SAMPLE = "quality int, toxic int, shapes array<int>, shares array<float>, terms array<int>, numbers array<tinyint>, junk array<int>, insult int"


def _sampled(batches):
    memo = Shapes()
    for (quality, toxic), texts in text_chunks(batches, ["quality", "toxic"]):
        rows = [_measure(t, memo) for t in texts]
        ints = pa.list_(pa.int32())
        kinds = (pa.int32(), pa.int32(), ints, pa.list_(pa.float32()), ints, pa.list_(pa.int8()), ints, pa.int32())
        columns = (quality, toxic, *zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["quality", "toxic", "shapes", "shares", "terms", "numbers", "junk", "insult"])


def estimate_accuracies(votes: np.ndarray, rounds: int = 60):
    """Posterior of the positive class, sensitivities and specificities from ``votes`` (rows by labellers; -1 abstains)."""
    known, yes = votes >= 0, votes == 1
    p = np.where(yes.any(1), 0.9, 0.05)
    for _ in range(rounds):
        prior = (p.sum() + 1) / (len(p) + 2)
        hit = (p[:, None] * yes).sum(0)
        miss = (p[:, None] * (known & ~yes)).sum(0)
        wrong = ((1 - p)[:, None] * yes).sum(0)
        right = ((1 - p)[:, None] * (known & ~yes)).sum(0)
        sens, spec = (hit + 1) / (hit + miss + 2), (right + 8) / (right + wrong + 9)
        odds = np.log(prior / (1 - prior)) + (yes * np.log(sens / (1 - spec))).sum(1) + ((known & ~yes) * np.log((1 - sens) / spec)).sum(1)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, sens, spec


def _fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-5):
    """Weights and bias of a logistic scorer of soft labels, by Adam on all rows."""
    y = y.astype(np.float32)
    w, m, v = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    w[-1] = -2.0
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y
        g = np.append(x.T @ error / max(1, len(y)) + decay * w[:-1], error.mean() if len(y) else 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Scorer:
    """Linear weights by hash bucket, with the labellers' estimated accuracies."""

    shapes: np.ndarray
    shape_bias: float
    terms: dict[int, float]
    term_bias: float
    accuracies: dict[str, tuple[float, float]]


def _one_of_copies(doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """Which documents stay when those that share the least of their rare terms, under either of two orders, count once."""
    often = np.bincount(term, minlength=TERMS)
    rare = (often[term] > 1) & (often[term] <= max(3, n // RARE))
    stay = np.ones(n, bool)
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, doc[rare], mix(term[rare].astype(np.uint64) * np.uint64(seed)))
        known = least < np.iinfo(np.uint64).max
        stay &= ~(pd.Series(least).duplicated().to_numpy() & known)
    return stay


def _telling(doc: np.ndarray, term: np.ndarray, seed: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Terms that documents with ``seed`` have far more often than the others, of the documents ``among``, the most telling first."""
    bad, every = np.bincount(term, weights=seed[doc], minlength=TERMS), np.bincount(term, minlength=TERMS)
    rate = max(seed[among].mean(), 1e-6) if among.any() else 1e-6
    z = (bad - every * rate) / np.sqrt(np.maximum(every * rate * (1 - rate), 1e-9))
    chosen = np.flatnonzero((bad >= LEAST_DOCS) & (z >= LEAST_Z) & (bad > 0.7 * every))
    return chosen[np.argsort(-z[chosen], kind="stable")][:MOST_TERMS]


def fit(sample) -> Scorer:
    """``sample``: a pandas frame of the columns that ``_sampled`` gives."""
    n = len(sample)
    if not n:
        weights = np.zeros(SHAPES)
        weights[SHAPES - 8 : SHAPES - 1] = [0, 60, 0, 60, 40, 8, 40]
        return Scorer(weights, -4.0, {zlib.crc32(w, 1) % TERMS: 8.0 for w in INSULTS}, -4.0, {})
    human = lambda c, bad: np.where(sample[c].isna(), -1, (sample[c] == bad).astype(int)).astype(int)
    junk_votes = np.column_stack([np.array(sample["junk"].tolist()), human("quality", 0)])
    junk, sens, spec = estimate_accuracies(junk_votes)
    accuracies = {f"junk:{k}": (float(a), float(b)) for k, a, b in zip(JUNK_VOTERS, sens, spec)}
    x = np.zeros((n, SHAPES), np.float32)
    for i, (at, values) in enumerate(zip(sample["shapes"], sample["shares"])):
        x[i, at] = values
    shapes, shape_bias = _fit_linear(x, junk, rate=0.3)
    del x

    doc = np.repeat(np.arange(n, dtype=np.int32), sample["terms"].map(len))
    term, number = np.concatenate(sample["terms"].tolist()).astype(np.int32, copy=False), np.concatenate(sample["numbers"].tolist()).astype(np.int8)
    held = np.bincount(term, minlength=TERMS)[term] > 1  # a term of one document tells neither toxicity nor copies
    doc, term, number = doc[held], term[held], number[held]
    # Copies of one document say nothing new about a term: of those that share a least rare term one stays.
    alone = _one_of_copies(doc, term, n)
    doc, term, number = (v[alone[doc]] for v in (doc, term, number))
    insult, told = sample["insult"].to_numpy(), human("toxic", 1)
    seed = np.where(told >= 0, told, insult).astype(bool)
    chosen = _telling(doc, term, seed, alone)
    place = np.full(TERMS, -1)
    place[chosen] = np.arange(len(chosen))
    held = place[term] >= 0
    x = np.zeros((n, len(chosen)), np.float32)
    np.add.at(x, (doc[held], place[term[held]]), number[held])
    # halves by the documents' own terms, whatever the order of the rows
    fold, family = np.bincount(doc, weights=term, minlength=n) % 2 == 1, np.zeros(n, int)
    for half in (False, True):
        other = (fold != half)[doc]
        told_by = np.zeros(TERMS, bool)
        told_by[_telling(doc[other], term[other], seed, alone & (fold != half))] = True
        hits = ~other & told_by[term]
        family |= np.bincount(doc[hits], weights=number[hits], minlength=n) >= 2
    toxic, sens, spec = estimate_accuracies(np.column_stack([insult, np.where(alone, family, -1), told]))
    accuracies |= {f"toxic:{k}": (float(a), float(b)) for k, a, b in zip(TOXIC_VOTERS, sens, spec)}
    weights, bias = _fit_linear(np.minimum(x[alone], 3), toxic[alone], rounds=1500, rate=0.05)
    return Scorer(shapes, shape_bias, {int(t): float(w) for t, w in zip(chosen, weights) if w > 0}, bias, accuracies)


def _fitted(parts):
    """The scorer of all rows of the sample, fitted where they are."""
    held = list(parts)
    if sum(map(len, held)):
        yield pd.DataFrame({"model": [pickle.dumps(fit(pd.concat(held, ignore_index=True)))]})


def train(docs: DataFrame, labels: DataFrame | None, sample_rows: int = SAMPLE) -> Scorer:
    """Fit on the labelled documents among the ``sample_rows`` labels of least hashed id."""
    if labels is None:
        return fit(_no_sample())
    told = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).filter("label_id is not null")
    told = told.groupBy("label_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).join(F.broadcast(told), F.col("doc_id") == F.col("label_id"))
    sample = rows.select("quality", "toxic", "t").mapInArrow(_sampled, _SAMPLE)
    made = sample.repartition(1).mapInPandas(_fitted, "model binary").collect()  # at most ``sample_rows`` rows meet, one comes back
    return pickle.loads(made[0]["model"]) if made else fit(_no_sample())


def _no_sample():
    return pd.DataFrame({"quality": []})


class Terms:
    """Toxicity weights of words; remembers words without any, a bounded number of them."""

    def __init__(self, model: Scorer, limit: int = 400_000):
        self.weights, self.limit, self.plain, self.hot = model.terms, limit, set(), {}

    def total(self, text: bytes) -> float:
        seen: dict[int, int] = {}
        for word in cores(text) - self.plain:
            buckets = self.hot.get(word)
            if buckets is None:
                buckets = [b for b in term_buckets(word) if b in self.weights]
                if buckets and len(self.hot) < self.limit:
                    self.hot[word] = buckets
                elif not buckets:
                    if len(self.plain) >= self.limit:
                        self.plain.clear()
                    self.plain.add(word)
            for b in buckets:
                seen[b] = seen.get(b, 0) + 1
        return sum(self.weights[b] * min(k, 3) for b, k in seen.items())


def score_texts(texts: list[bytes], model: Scorer, shapes: Shapes, terms: Terms) -> tuple[list[float], list[float]]:
    """Probabilities of junk and of toxicity."""
    junk, toxic = [], []
    for text in texts:
        at, shares, _ = _style(text, shapes)
        junk.append(float(model.shapes[at] @ np.array(shares, np.float32)) + model.shape_bias if at else 0.0)
        toxic.append(terms.total(text) + model.term_bias)
    p = lambda v: (1 / (1 + np.exp(-np.clip(v, -30, 30)))).tolist()
    return p(np.array(junk)), p(np.array(toxic))


def classify(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, p_junk, p_toxic, score, kept for every row.

    ``score`` is the probability of neither; a row is kept if both are under one
    half.  ``labels`` has doc_id, quality (0 bad) and toxic (1 bad), nulls where
    untold, several rows of an id count as the worst.  Without labels or
    labelled documents a fixed scorer of the heuristics stands in.  Null and
    empty texts have nothing to read and are junk at one half, so they go;
    repeated rows score alike; a null id is scored; an empty table gives no
    rows; further columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = train(rows, labels, sample_rows)

    def score(batches):
        shapes, terms = Shapes(), Terms(model)
        for (ids,), texts in text_chunks(batches, ["doc_id"]):
            junk, toxic = score_texts(texts, model, shapes, terms)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(junk), pa.array(toxic)], names=["doc_id", "p_junk", "p_toxic"])

    out = rows.select("doc_id", F.col("text").alias("t")).mapInArrow(score, "doc_id long, p_junk double, p_toxic double")
    return out.withColumn("score", (1 - F.col("p_junk")) * (1 - F.col("p_toxic"))).withColumn("kept", (F.col("p_junk") < 0.5) & (F.col("p_toxic") < 0.5))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that ``classify`` keeps; the text is read where it lies, no join."""
    model = train(docs, labels, sample_rows)

    @F.pandas_udf("boolean")
    def good(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes, terms = Shapes(), Terms(model)
        for texts in parts:
            junk, toxic = score_texts([t.encode() if t else b"" for t in texts], model, shapes, terms)
            yield pd.Series([j < 0.5 and t < 0.5 for j, t in zip(junk, toxic)], dtype=bool)

    return docs.filter(good("text"))
