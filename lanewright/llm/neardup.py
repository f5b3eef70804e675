"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents of equal shingle sets are first folded into one class.  A class is
posted under each (coordinate, value) of its COORDINATES MinHash coordinates,
and the postings are counted.  Values of one class alone can't be shared and go;
classes with fewer than MATCHES left have no candidate.  Of the others the
rarest c - MATCHES + 1 of the c left are their prefix: two classes that share
MATCHES values share one within both prefixes, the rarest they share, as at
least MATCHES - 1 shared ones follow it in both.  So only the lists of prefixes
are merged, and a pair that meets there has its other collisions counted by
skipping to the two rows' own coordinates.  Merging a list also skips partners
of too different a size, and those that the list has connected already, so a
list of near copies costs about one pass.

Connected candidates form clouds; each class sends its full set once to its
cloud, where links are confirmed exactly and only a spanning forest of them
leaves.  Components are taken of those.  Lists and clouds that are too large for
a task are cut into blocks, of which the parts that are still apart are compared
with all others; nothing is left out.

At a similarity of 0.75 48 of 64 coordinates are equal on average, with a
standard deviation of 3.5: fewer than MATCHES are in about 5 of a million.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import join_classes, mix, rolling, span_hashes, staged, text_chunks, word_spans
from lanewright.llm.components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
COORDINATES, MATCHES = 64, 32
#: Rows of a list, or classes of a cloud, that one task compares; longer ones are cut into blocks.
LIST, CLOUD = 4096, 4096
#: Shingles of a block of a cloud, about.
CLOUD_SHINGLES = 4_000_000
#: Lists of up to this size are compared for all lists of a batch at once.
SHORT = 24
#: Rows of a list that are compared with the others at a time.
FRONT = 256


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    spans = word_spans(texts, lower=True)
    hashes = span_hashes(spans)
    runs, out, at = rolling(hashes, SHINGLE), [], 0
    for n in spans.counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(runs[at : at + n - SHINGLE + 1]))
        elif n:
            out.append(rolling(hashes[at : at + n], n, base=0x51ED270B9F652295))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(batches):
    factors = _multipliers()
    names = ["doc_id", "n_shingles", "digest", "keys", "sig"]
    for (ids,), texts in text_chunks(batches, ["doc_id"], limit=500_000):
        sets = shingle_sets(texts)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        keys, sigs = [None] * len(sets), [None] * len(sets)
        if len(full):
            every = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            least = np.stack([np.minimum.reduceat(every * f, starts) for f in factors], axis=1)
            low = (mix(least) & np.uint64(255)).astype(np.uint8)
            posted = mix(least ^ (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(56))).view(np.int64)
            for row, i in enumerate(full):
                keys[i], sigs[i] = posted[row], low[row].tobytes()
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, sizes, list(map(_digest, sets)), keys, sigs), kinds)], names=names)


def _runs(batches, key: str):
    """Tables cut only between values of the sorted column ``key``."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        values = held.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1])) if len(values) else 0
        if cut >= 2000:
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _close(a, b):
    return np.minimum(a, b) * DENOMINATOR >= np.maximum(a, b) * NUMERATOR


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _spread(size: int, linked):
    """Labels of connected rows: a front is compared with the unseen rows alone, until none is left."""
    label, unseen = np.arange(size), np.arange(size)
    while len(unseen):
        start, unseen = unseen[0], unseen[1:]
        todo = [np.array([start])]
        while todo and len(unseen):
            front = todo.pop()
            if len(front) > FRONT:
                todo.append(front[FRONT:])
                front = front[:FRONT]
            hit = linked(front, unseen).any(0)
            if hit.any():
                found, unseen = unseen[hit], unseen[~hit]
                label[found] = start
                todo.append(found)
    return label


class Signatures:
    """Rows of MinHash bytes; a pair is a candidate from MATCHES equal coordinates on."""

    def __init__(self, payloads: list[bytes], sizes: np.ndarray):
        self.columns = np.ascontiguousarray(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COORDINATES).T)
        self.sizes = sizes

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), bool)
        for lo in range(0, len(b), 4096):
            some = b[lo : lo + 4096]
            equal = np.zeros((len(a), len(some)), np.uint8)
            for c in self.columns:
                equal += c[a, None] == c[None, some]
            out[:, lo : lo + 4096] = (equal >= MATCHES) & _close(self.sizes[a, None], self.sizes[None, some])
        return out


class Sets:
    """Full shingle sets; links are exact.  Only shingles of two sets or more count in intersections."""

    def __init__(self, payloads: list[bytes], sizes=None):
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        names, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), self.sizes)
        shared = np.bincount(column, minlength=len(names)) > 1
        held = shared[column]
        row, self.column = row[held], (np.cumsum(shared) - 1)[column[held]]
        self.width, self.dense = int(shared.sum()), []
        if len(sets) * self.width <= 40_000_000:
            for lo in range(0, self.width, 8192):
                hi = min(self.width, lo + 8192)
                x = np.zeros((len(sets), hi - lo), np.float32)
                pick = (self.column >= lo) & (self.column < hi)
                x[row[pick], self.column[pick] - lo] = 1
                self.dense.append(x)
        self.cuts = np.searchsorted(row, np.arange(len(sets) + 1))

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.zeros((len(a), len(b)), np.float64)
        if self.dense:
            for x in self.dense:
                both += x[a] @ x[b].T
        else:  # wide clouds: count by the front's shingles
            mark = np.zeros(self.width, bool)
            for k, i in enumerate(a):
                mark[:] = False
                mark[self.column[self.cuts[i] : self.cuts[i + 1]]] = True
                sums = np.concatenate([[0], np.cumsum(mark[self.column])])
                both[k] = sums[self.cuts[b + 1]] - sums[self.cuts[b]]
        every = self.sizes[a, None] + self.sizes[None, b] - both
        return DENOMINATOR * both >= NUMERATOR * every


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _gather(batches):
    """Candidates of each list (cell) as links to the least row that the list connects them with."""
    for table in _runs(batches, "cell"):
        key, ids, n = (table.column(c).to_numpy() for c in ("cell", "doc_id", "n"))
        payloads = table.column("payload").to_pylist()
        sig = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COORDINATES)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        size_of = np.repeat(sizes, sizes)
        left, right = [], []
        for d in range(1, min(SHORT, len(key))):
            i = np.flatnonzero((key[:-d] == key[d:]) & (size_of[:-d] <= SHORT) & _close(n[:-d], n[d:]))
            for part in np.array_split(i, max(1, len(i) // 20_000)):
                good = part[(sig[part] == sig[part + d]).sum(1, dtype=np.int16) >= MATCHES]
                left.append(good)
                right.append(good + d)
        label = _labels(len(key), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(key))
        for s, size in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            label[s : s + size] = s + _spread(int(size), Signatures(payloads[s : s + size], n[s : s + size]).linked)
        moved = np.flatnonzero(label != np.arange(len(key)))
        yield _links(ids[moved], ids[label[moved]])


def _confirm(batches):
    """Links within each cell, as a forest: from every class to the least one that exact links connect it with."""
    for table in _runs(batches, "cell"):
        cell, ids = table.column("cell").to_numpy(), table.column("doc_id").to_numpy()
        payloads = table.column("payload").to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        a, b = [], []
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
            if e - s > 1:
                label = _spread(e - s, Sets(payloads[s:e]).linked)
                moved = np.flatnonzero(label != np.arange(e - s))
                a += ids[s + moved].tolist()
                b += ids[s + label[moved]].tolist()
        yield _links(a, b)


def _apart(kind):
    """Of each cell: a link for every two labels of which a row of ``few`` is linked with another."""

    def compare(batches):
        for table in _runs(batches, "cell"):
            cell, label, few = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "label", "few"))
            payloads, n = table.column("payload").to_pylist(), table.column("n").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            found = set()
            for s, e in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
                rows = np.arange(e - s)
                front, others = rows[few[s:e]], rows[~few[s:e]]
                if len(front) and len(others):
                    matcher = kind(payloads[s:e], n[s:e])
                    for a in range(0, len(front), FRONT):
                        part = front[a : a + FRONT]
                        i, j = np.nonzero(matcher.linked(part, others) & (label[s:e][part, None] != label[s:e][None, others]))
                        found |= set(zip(label[s:e][part[i]].tolist(), label[s:e][others[j]].tolist()))
            yield _links([x for x, _ in found], [x for _, x in found])

    return compare


_GROUPED = ["cell", "label", "doc_id", "n", "payload"]


def _dealt(rows: DataFrame, function) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "doc_id").mapInArrow(function, "a long, b long")


def _connected(rows: DataFrame, within, kind, any_large: bool) -> DataFrame:
    """(node, component) of the links that ``kind`` finds between rows of one group.

    ``rows``: grp, blocks (how many the group needs; ``any_large`` says whether
    any needs several), doc_id, n, payload.  Blocks of a group are connected
    within first.  In groups of several blocks the least
    rows of the parts found are then connected, and at last the rows outside the
    largest part of a group, in chunks of a block's size, meet all of its rows of
    other parts, block by block.
    """
    own = F.pmod(F.xxhash64("doc_id", "payload"), F.col("blocks")).cast("int")
    links = _dealt(rows.withColumn("cell", F.when(F.col("blocks") > 1, F.xxhash64("grp", own)).otherwise(F.col("grp"))).select("cell", "doc_id", "n", "payload"), within)
    parts = components(links)
    if not any_large:
        return parts
    large, parts = staged(rows.filter("blocks > 1"), "large"), staged(parts, "parts")
    labelled = lambda: large.join(parts, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
    every = lambda: parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    heads = labelled().groupBy("grp", "label").agg(F.min_by(F.struct("blocks", "doc_id", "n", "payload"), F.struct("doc_id", "payload")).alias("x")).select("grp", "label", "x.*")
    heads = heads.join(heads.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("heads"), F.max("blocks").alias("most")), F.col("grp") == F.col("g"))
    least = F.least(F.col("most"), F.ceil(F.col("heads") / LIST)).cast("int")
    cell = F.xxhash64("grp", F.pmod(F.xxhash64("doc_id", "payload"), least).cast("int"))
    parts = staged(components(every().unionByName(_dealt(heads.withColumn("cell", cell).select("cell", "doc_id", "n", "payload"), within))), "parts")

    sizes = labelled().groupBy("grp", "label").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy(F.col("grp").alias("g")).agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("rest"), F.sum("k").alias("all")).filter("rest > 0")
    main = main.withColumn("chunks", F.col("rest") * 1.0 / F.col("all"))
    split = labelled().join(main, F.col("grp") == F.col("g")).withColumn("own", own).withColumn("chunks", F.ceil(F.col("chunks") * F.col("blocks")).cast("int"))
    span = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    others = split.withColumn("chunk", F.explode(span("chunks"))).withColumn("few", F.lit(False))
    few = split.filter("label <> main").withColumn("chunk", F.pmod(F.xxhash64("payload", "doc_id"), F.col("chunks")).cast("int")).withColumn("own", F.explode(span("blocks"))).withColumn("few", F.lit(True))
    met = others.unionByName(few).withColumn("cell", F.xxhash64("grp", "own", "chunk"))
    return components(every().unionByName(_dealt(met.select(*_GROUPED, "few"), _apart(kind))))


def _lists(reps: DataFrame, total: int) -> DataFrame:
    """grp, blocks, doc_id, n, payload: the classes under the keys of their prefixes."""
    posted = reps.select("doc_id", "cls", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    held = join_classes(posted, shared, "key", "times", total * COORDINATES, how="inner")
    ordered = held.groupBy("doc_id", "cls").agg(F.array_sort(F.collect_set(F.struct("times", "key"))).alias("keys")).filter(F.size("keys") >= MATCHES)
    prefix = ordered.select(F.col("doc_id").alias("d"), F.col("cls").alias("c"), F.explode(F.slice("keys", F.lit(1), F.size("keys") - MATCHES + 1)).alias("x"))
    rows = reps.select("doc_id", "cls", "n", F.col("sig").alias("payload")).join(prefix, (F.col("doc_id") == F.col("d")) & (F.col("cls") == F.col("c")))
    return rows.select(F.col("x.key").alias("grp"), F.ceil(F.col("x.times") / LIST).cast("int").alias("blocks"), "doc_id", "n", "payload")


def _sets(docs: DataFrame, clouds: DataFrame) -> DataFrame:
    """grp, blocks, doc_id, n, payload: the full sets of the documents in a cloud."""

    def cut(batches):
        seen = set()  # repeated rows of an id that came to this task
        for (ids, grp, blocks), texts in text_chunks(batches, ["doc_id", "grp", "blocks"], limit=500_000):
            rows = []
            for row in zip(grp, blocks, ids, shingle_sets(texts)):
                if (name := (row[2], _digest(row[3]))) not in seen and len(row[3]):
                    seen.add(name)
                    rows.append((*row[:3], len(row[3]), row[3].tobytes()))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "blocks", "doc_id", "n", "payload"])

    members = clouds.select(F.col("node").alias("__node"), F.col("component").alias("grp"), "blocks").hint("shuffle_hash")
    return docs.join(members, F.col("doc_id") == F.col("__node")).select("doc_id", "grp", "blocks", "t").mapInArrow(cut, "grp long, blocks int, doc_id long, n long, payload binary")


def _sized(clouds: DataFrame, sizes: DataFrame) -> DataFrame:
    """``clouds`` (node, component) with the blocks that each is cut into."""
    weight = F.greatest(F.count(F.lit(1)) / CLOUD, F.sum("size") / CLOUD_SHINGLES)
    weighed = clouds.join(sizes, F.col("node") == F.col("of")).groupBy(F.col("component").alias("__cloud")).agg(F.ceil(weight).cast("int").alias("blocks"))
    return clouds.join(weighed, F.col("component") == F.col("__cloud")).drop("__cloud")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words are lower-cased in A-Z and cut at ASCII white space; a text of fewer
    than SHINGLE words is one shingle.  Null texts and texts without words have
    no shingles and are linked with nothing.  ``component_id`` is the smallest
    id reachable over links, exact copies included; ``kept`` is whether that is
    the row's own.  Rows of one id are one document with several texts, and the
    links of each count; a null id links with nothing but its exact copies; an
    empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    signed = staged(rows.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, keys array<long>, sig binary"), "signed")
    total = signed.count()
    classes = staged(signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    least = signed.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep")))
    reps = staged(least.select("doc_id", F.xxhash64("digest").alias("cls"), F.col("n_shingles").alias("n"), "keys", "sig"), "reps")
    lists = staged(_lists(reps, total), "lists")
    clouds = staged(_connected(lists, _gather, Signatures, not lists.filter("blocks > 1").isEmpty()), "clouds")
    sizes = reps.groupBy(F.col("doc_id").alias("of")).agg(F.sum("n").alias("size"))
    clouds = staged(_sized(clouds, sizes), "sized")
    linked = _connected(_sets(rows, clouds), _confirm, Sets, not clouds.filter("blocks > 1").isEmpty())
    members = staged(join_classes(signed.select("doc_id", "n_shingles", "digest"), classes, "digest", "copies", total).select("doc_id", "n_shingles", "rep"), "members")
    twice = members.groupBy(F.col("doc_id").alias("d")).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("d is not null and lo < hi")
    if not twice.isEmpty():  # ids with several texts
        more = members.join(twice, F.col("doc_id") == F.col("d")).select(F.col("rep").alias("a"), F.col("lo").alias("b"))
        linked = components(more.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    ends = classes.filter("rep is not null").groupBy("rep").agg(F.sum("copies").alias("copies")).join(linked, F.col("rep") == F.col("node"), "left").select("rep", "copies", "component")
    out = join_classes(members, ends, "rep", "copies", total)
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id (all rows of that id)."""
    gone = near_duplicates(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == F.col("__gone"), "left_anti")
