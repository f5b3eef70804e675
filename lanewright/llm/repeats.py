"""Substring dedup with repeated-phrase automata.

Documents are dealt by blocks of ids, and one exchange of the texts serves all
passes.  (1) Every window of words is named by its anchor, the least hash of the
short phrases in it, so equal windows have equal anchors; blocks report the
anchors they hold, and only those of two or more documents go on.  (2) Blocks
report their windows with such anchors by 96-bit hashes, which confirms the
recurring ones and their owners: the least document of each.  (3) Owners cut
maximal runs of confirmed windows out as passages, and blocks ask for those of
the owners they share windows with.  (4) Each block compiles Aho-Corasick
automata from the passages it is sent, in shards of bounded size, streams its
whole documents through them, and removes what they locate.  The automata
compare words, so a hash can't remove anything by itself.

Every message holds a window at most once for a block, however often it occurs,
and passages that very many blocks ask for are dealt in as many copies as keep
one copy's readers under READERS.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import rolling, span_hashes, word_spans

PHRASE = 5
BLOCK_BITS = 7
IDS_PER_BLOCK = 1 << BLOCK_BITS
#: Documents whose anchors meet in one bucket, on average, and the least number of buckets.
DOCS_PER_BUCKET, BUCKETS = 1000, 256
#: Bits of the word numbers in one region of a document; owners are asked for passages by region.
REGION_BITS = 9
#: Blocks that read one copy of a passage, about; a more popular one is dealt in more copies.
READERS = 256
#: Windows that one automaton is compiled from.
SHARD_WINDOWS = 50_000
#: Words that two letters can stand for; a shard of more distinct words takes three.
TWO_LETTERS = 1 << 16

_BUCKETED = "bucket long, blk long, h1 binary, h2 binary, lo binary, hi binary, region binary"
_TOLD = "blk long, owners binary, regions binary, wanted binary, own binary, levels binary"
_DEALT = "owner long, region int, level int, salt int, blk long, words binary"


def _block(table: pa.Table):
    """(ids, texts) of a block in a fixed order."""
    ids, texts = table.column("doc_id").to_pylist(), [t or b"" for t in table.column("t").cast("binary").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _places(texts: list[bytes], window: int):
    """(spans, hashes of the words, row of each window, its first word, place of that in its row)."""
    spans = word_spans(texts)
    fits = np.maximum(spans.counts - window + 1, 0)
    row = np.repeat(np.arange(len(texts)), fits)
    place = np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits)
    return spans, span_hashes(spans), row, place + (np.cumsum(spans.counts) - spans.counts)[row], place


def _anchors(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The least hash of a phrase in each window."""
    phrase = min(PHRASE, window)
    least, span = rolling(h, phrase), 1
    need = window - phrase + 1
    while span < need:
        step = min(span, need - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    return least[at]


def _cuts(keys: np.ndarray):
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(keys)).astype(np.int64)


def _raw(values: np.ndarray, starts, ends) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())


def _joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


def _report(window: int, buckets: int):
    """The distinct anchors of a block by bucket, with whether several of its documents hold them."""

    def report(table: pa.Table) -> pa.Table:
        blk = table.column("blk")[0].as_py()
        ids, texts = _block(table)
        _, h, row, at, _ = _places(texts, window)
        anchor = _anchors(h, at, window)
        docs = np.array([i - blk * IDS_PER_BLOCK for i in ids], np.uint8)[row]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])])) if len(anchor) else np.zeros(0, np.int64)
        anchor, docs = anchor[new], docs[new]
        order = np.lexsort((anchor, anchor % np.uint64(buckets)))
        anchor, docs = anchor[order], docs[order]
        starts, _ = _cuts(anchor)
        many = np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts) if len(starts) else np.zeros(0, bool)
        names = anchor[starts]
        bucket = (names % np.uint64(buckets)).astype(np.int64)
        a, b = _cuts(bucket)
        return pa.table({"bucket": pa.array(bucket[a], pa.int64()), "blk": pa.array([blk] * len(a), pa.int64()), "names": _raw(names, a, b), "many": _raw(many, a, b)})

    return report


def _recurring(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block its anchors that several documents hold."""
    blks, raw = table.column("blk").to_numpy(), table.column("names").to_pylist()
    names, many = _joined(table, "names", np.uint64), _joined(table, "many", bool)
    place = np.repeat(np.arange(len(blks)), [len(r) // 8 for r in raw])
    _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    some = np.bincount(inverse, weights=many, minlength=len(counts)) > 0
    keep = ((counts > 1) | some)[inverse]
    place, names = place[keep], names[keep]
    a, b = _cuts(place)
    return pa.table({"blk": pa.array(blks[place[a]], pa.int64()), "names": _raw(names, a, b)})


def _hashes(h: np.ndarray, at: np.ndarray, window: int):
    """96 bits of each window, as 64 and 32."""
    return rolling(h, window)[at], (rolling(h, window, base=0x8CB92BA72F3D8DD7)[at] >> np.uint64(32)).astype(np.uint32)


def _windows(window: int, buckets: int):
    """The distinct windows of a block whose anchors recur, by bucket: hashes, first and last document, region of the first."""

    def windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        a = b = bucket = empty
        h1, h2, lo, hi, region, blk = (empty,) * 5 + (0,)
        if table.num_rows and replies.num_rows:
            blk = table.column("blk")[0].as_py()
            ids, texts = _block(table)
            _, h, row, at, place = _places(texts, window)
            anchor = _anchors(h, at, window)
            known = np.sort(_joined(replies, "names", np.uint64))
            held = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
            row, at, place = row[held], at[held], place[held]
            h1, h2 = _hashes(h, at, window)
            docs = np.array([i - blk * IDS_PER_BLOCK for i in ids], np.uint8)[row]
            bucket = (h1 % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((h2, h1, bucket))  # stable, so places stay in order
            h1, h2, docs, region, bucket = h1[order], h2[order], docs[order], (place[order] >> REGION_BITS).astype(np.uint32), bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else empty
            lo, hi = docs[first], np.maximum.reduceat(docs, first) if len(first) else docs
            h1, h2, region, bucket = h1[first], h2[first], region[first], bucket[first]
            a, b = _cuts(bucket)
        columns = (h1.astype(np.uint64), h2.astype(np.uint32), lo.astype(np.uint8), hi.astype(np.uint8), region.astype(np.uint32))
        return pa.table({"bucket": pa.array(bucket[a], pa.int64()), "blk": pa.array([blk] * len(a), pa.int64())} | {n: _raw(c, a, b) for n, c in zip(("h1", "h2", "lo", "hi", "region"), columns)})

    return windows


def _confirmed(readers: int):
    """Of one bucket: whom each block has to ask for passages, and which windows of its own are asked for."""

    def confirmed(table: pa.Table) -> pa.Table:
        blks, sizes = table.column("blk").to_numpy(), [len(r) for r in table.column("lo").to_pylist()]
        h1, h2, region = _joined(table, "h1", np.uint64), _joined(table, "h2", np.uint32), _joined(table, "region", np.uint32)
        place = np.repeat(np.arange(len(blks)), sizes)
        lo, hi = (blks[place] * IDS_PER_BLOCK + _joined(table, c, np.uint8) for c in ("lo", "hi"))
        order = np.lexsort((lo, h2, h1))
        first = np.flatnonzero(np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])) if len(order) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        least, most = lo[order[first]], np.maximum.reduceat(hi[order], first) if len(first) else hi
        level = np.ceil(np.log2(np.maximum(1.0, np.diff(np.append(first, len(order))) / readers))).astype(np.uint8)
        asks = hi[order] > least[group]
        out = {}
        # what blocks want: (owner, region, level), once each
        wants, of = order[asks], group[asks]
        keys = [level[of], region[order[first]][of], least[of], place[wants]]
        keys = np.stack([k.astype(np.int64) for k in keys])[:, np.lexsort(keys)]
        keys = keys[:, np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])] if keys.shape[1] else keys
        a, b = _cuts(keys[3])
        for i, j in zip(a.tolist(), b.tolist()):
            out[int(keys[3, i])] = (keys[2, i:j], keys[1, i:j], keys[0, i:j], [], [])
        owns = order[first[most > least]]
        for p, name, k in zip(place[owns].tolist(), h1[owns].tolist(), level[most > least].tolist()):
            held = out.setdefault(p, ([], [], [], [], []))
            held[3].append(name)
            held[4].append(k)
        raw = lambda i, dtype: pa.array([np.array(v[i], dtype).tobytes() for v in out.values()], pa.binary())
        return pa.table({"blk": pa.array(blks[list(out)], pa.int64()), "owners": raw(0, np.int64), "regions": raw(1, np.uint32), "wanted": raw(2, np.uint8), "own": raw(3, np.uint64), "levels": raw(4, np.uint8)})

    return confirmed


def _passages(window: int):
    """Passages of the block's own confirmed windows (blk null), and its requests for those of others (no words)."""

    def passages(table: pa.Table, told: pa.Table) -> pa.Table:
        owner, region, level, salt, blks, words = [], [], [], [], [], []
        if table.num_rows and told.num_rows:
            blk = table.column("blk")[0].as_py()
            wants = np.unique(np.stack([_joined(told, "owners", np.int64), _joined(told, "regions", np.uint32).astype(np.int64), _joined(told, "wanted", np.uint8).astype(np.int64)], axis=1), axis=0)
            for o, r, k in wants.tolist():
                for column, x in zip((owner, region, level, salt, blks, words), (o, r, k, blk % (1 << k), blk, None)):
                    column.append(x)
            own, levels = _joined(told, "own", np.uint64), _joined(told, "levels", np.uint8)
            if len(own):
                order = np.argsort(own)
                own, levels = own[order], levels[order]
                ids, texts = _block(table)
                spans, h, row, at, place = _places(texts, window)
                name = rolling(h, window)[at]
                where = np.minimum(np.searchsorted(own, name), len(own) - 1)
                held = np.flatnonzero(own[where] == name)
                held = held[np.unique(name[held], return_index=True)[1]]  # the first place of each
                held.sort()
                part, deal = place[held] >> REGION_BITS, levels[where[held]]
                new = np.concatenate([[True], (np.diff(at[held]) != 1) | (np.diff(row[held]) != 0) | (np.diff(part) != 0) | (np.diff(deal.astype(np.int64)) != 0)]) if len(held) else np.zeros(0, bool)
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(held)) - 1
                raw = spans.buf.tobytes()
                for i, j in zip(a.tolist(), b.tolist()):
                    lo, hi = at[held[i]], at[held[j]] + window
                    text = b" ".join(raw[spans.starts[lo] : spans.ends[hi - 1]].split())
                    for s in range(1 << int(deal[i])):
                        for column, x in zip((owner, region, level, salt, blks, words), (ids[row[held[i]]], int(part[i]), int(deal[i]), s, None, text)):
                            column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("owner", "region", "level", "salt", "blk", "words"), (owner, region, level, salt, blks, words), kinds)})

    return passages


def _delivered(batches):
    """Rows sorted by key, passages first: each passage once for every block that asks."""
    key, held, out = None, [], ([], [], [])
    for batch in batches:
        for o, r, k, s, blk, words in zip(*(batch.column(c).to_pylist() for c in ("owner", "region", "level", "salt", "blk", "words"))):
            if (o, r, k, s) != key:
                key, held = (o, r, k, s), []
            if blk is None:
                held.append(words)
                continue
            for passage in held:
                for column, x in zip(out, (blk, o, passage)):
                    column.append(x)
            if len(out[0]) >= 2000:
                yield _delivery(out)
                out = ([], [], [])
    if out[0]:
        yield _delivery(out)


def _delivery(out):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary()))], names=["blk", "owner", "words"])


class Letters(dict):
    """Two or three letters for every word of a shard; those of the first place stand in no other."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        self.width = 2 if len(words) <= TWO_LETTERS else 3
        base = 1
        while base**self.width < len(words):
            base += 1
        firsts, rest = [chr(0x100 + i) for i in range(base)], [chr(0x1000 + i) for i in range(base)]
        for n, w in enumerate(words):
            self[w] = firsts[n % base] + rest[n // base % base] + (rest[n // base**2] if self.width == 3 else "")
        self.other = "\0" * self.width

    def spell(self, words: list[bytes]) -> str:
        get, other = self.get, self.other
        return "".join([get(w, other) for w in words])


def _shards(passages: list[tuple[int, list[bytes]]], window: int, limit: int):
    """(letters, automaton) of each shard of passages; an automaton holds ``limit`` windows or a bit more."""
    held, size = [], 0
    for k, (owner, words) in enumerate(passages):
        for a in range(0, len(words) - window + 1, limit):  # a long passage is cut between windows
            part = words[a : a + limit + window - 1]
            held.append((owner, part))
            size += len(part) - window + 1
            if size >= limit:
                yield _compiled(held, window)
                held, size = [], 0
    if held:
        yield _compiled(held, window)


def _compiled(held, window: int):
    letters = Letters(list(dict.fromkeys(w for _, words in held for w in words)))
    automaton, step = ahocorasick.Automaton(), letters.width
    for owner, words in held:
        spelled = letters.spell(words)
        for i in range(0, (len(words) - window + 1) * step, step):
            automaton.add_word(spelled[i : i + window * step], owner)
    automaton.make_automaton()
    return letters, automaton


def _located(window: int, limit: int):
    """The rows of a block without the words that its automata locate."""

    def located(table: pa.Table, passages: pa.Table) -> pa.Table:
        ids, texts = _block(table) if table.num_rows else ([], [])
        gone: dict[int, np.ndarray] = {}
        split = [t.split() for t in texts]
        sent = sorted(zip(passages.column("owner").to_pylist(), (p.split(b" ") for p in passages.column("words").to_pylist())))
        for letters, automaton in _shards(sent, window, limit):
            for k, words in enumerate(split):
                if len(words) < window:
                    continue
                hits = list(automaton.iter(letters.spell(words)))
                if hits:
                    ends, owners = np.array(hits, np.int64).T
                    ends = ends[owners < ids[k]] // letters.width
                    if len(ends):
                        turns = gone.setdefault(k, np.zeros(len(words) + 1, np.int64))
                        np.add.at(turns, ends - window + 1, 1)
                        np.add.at(turns, ends + 1, -1)
        totals, removed, kept = list(map(len, split)), [0] * len(ids), []
        for k, words in enumerate(split):
            if k in gone:
                covered = np.cumsum(gone[k][:-1]) > 0
                removed[k] = int(covered.sum())
                words = [w for w, x in zip(words, covered.tolist()) if not x]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return located


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", readers: int = READERS, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row.

    Words are cut at ASCII white space and stay as they are.  Each word covered
    by a window of ``window`` words that also starts in a document of a smaller
    id is removed; the rest is joined by single spaces.  Null texts have no
    words; rows of one id don't remove each other's words; a row with a null id
    neither loses nor removes words; an empty table gives no rows; further
    columns are ignored.  ``readers`` and ``shard_windows`` (READERS,
    SHARD_WINDOWS) bound tasks and memory and don't change the result.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    rows = named.filter("doc_id is not null").select(F.shiftright("doc_id", BLOCK_BITS).alias("blk"), "doc_id", "t").groupBy("blk")
    buckets = max(BUCKETS, docs.count() // DOCS_PER_BUCKET)
    anchors = rows.applyInArrow(_report(window, buckets), "bucket long, blk long, names binary, many binary")
    recurring = anchors.groupBy("bucket").applyInArrow(_recurring, "blk long, names binary").groupBy("blk")
    windows = rows.cogroup(recurring).applyInArrow(_windows(window, buckets), _BUCKETED)
    told = windows.groupBy("bucket").applyInArrow(_confirmed(readers), _TOLD).groupBy("blk")
    asked = rows.cogroup(told).applyInArrow(_passages(window), _DEALT)
    key = ["owner", "region", "level", "salt"]
    sent = asked.repartition(*key).sortWithinPartitions(*key, F.col("blk").asc_nulls_first()).mapInArrow(_delivered, "blk long, owner long, words binary").groupBy("blk")
    out = rows.cogroup(sent).applyInArrow(_located(window, shard_windows), "doc_id long, n_words long, n_removed long, kept_text string")
    bare = named.filter("doc_id is null").select("doc_id", F.filter(F.split(F.coalesce("t", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("w"))
    return out.unionByName(bare.select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("w", " ").alias("kept_text")))
