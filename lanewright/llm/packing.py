"""Best-fit packing with large-item matching.

Piece lengths are whole numbers up to the capacity, so the packing is planned on
the histogram of lengths (at most one count for each length, whatever the input)
and then dealt out to the pieces by their rank among those of equal length.
Pieces above a third of the capacity are at most two to a bin and are matched
greedily, each largest one with the largest partner that still fits; smaller
ones fill the tightest gaps that hold them.

Token ids are those of ``tokenizers`` with the vocabulary's JSON file.  Most text
is encoded by ``tiktoken`` on the same vocabulary, a fraction of the cost, with
equal ids (a test compares the two on every code point).  Its regular expression
can't read very long runs, so texts with one are cut into parts: the byte-level
pattern has no token with a blank after something that isn't white space, and
looks ahead past white space only, so a text may be cut before such blanks, and
its ids are those of the parts, one after the other.  Long parts go to
``tokenizers``.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.llm.common import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Groups that the pieces of one length are ranked in at least, and the most pieces meant for one group.
GROUPS, GROUP_PIECES = 64, 20_000


#: Parts of more code points than this go to ``tokenizers``.
LONG_PART = 1000
_LONG = re.compile(rf"\s{{{LONG_PART}}}|\S{{{LONG_PART}}}")
#: A blank may follow something that this pattern can't tell from white space.
_UNSURE = re.compile(r"[^ !-~\w] ")
_CUT = re.compile(r"(?<=[!-~\w])(?= )")
_PARTS = re.compile(r" *[^ ]+| +")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_parts(text: str) -> list[str]:
    """Parts of a text whose token ids, one after the other, are the text's."""
    return _CUT.split(text) if _UNSURE.search(text) else _PARTS.findall(text)


class Encoder:
    """Token ids by the byte-level vocabulary at ``path`` (JSON, beside it its merge ranks); the special token's string in a text is that token."""

    def __init__(self, path: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: self.tokenizer.token_to_id(special)})

    def encode(self, text: str) -> np.ndarray:
        if not _LONG.search(text):
            return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4")
        out, held = [], []
        for part in text_parts(text):
            if len(part) <= LONG_PART:
                held.append(part)
                continue
            out += [self.quick.encode_to_numpy("".join(held), allowed_special="all"), self.tokenizer.encode(part, add_special_tokens=False).ids]
            held = []
        out.append(self.quick.encode_to_numpy("".join(held), allowed_special="all"))
        return np.concatenate([np.asarray(ids, "<u4") for ids in out])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def split_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, capacity: int, path: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and CRC-32 of the token ids of every piece; null texts are empty and have the end token alone."""
    path = path or vocabulary_path()

    def pieces(batches):
        enc = encoder(path)
        for batch in batches:
            cols = [[] for _ in range(5)]
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("t")):
                ids = np.append(enc.encode(value.as_py() or ""), end_id).astype("<u4")
                for k, (start, length) in enumerate(split_pieces(len(ids), capacity)):
                    for col, x in zip(cols, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(pieces, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, how many), ...), number of such bins), ...] for ``counts`` pieces of each length."""
    left = {s: n for s, n in counts.items() if n}
    classes: dict[tuple, int] = {}
    gaps: dict[int, list[tuple]] = {}

    def put(content: tuple, n: int) -> None:
        if content not in classes:
            classes[content] = 0
            gaps.setdefault(capacity - sum(a * b for a, b in content), []).append(content)
        classes[content] += n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left.get(s):
            partner = next((t for t in large if t <= capacity - s and left.get(t) and (t != s or left[s] > 1)), None)
            if partner is None:
                put(((s, 1),), left.pop(s))
            elif partner == s:
                put(((s, 2),), left[s] // 2)
                left[s] %= 2
            else:
                n = min(left[s], left[partner])
                put(((s, 1), (partner, 1)), n)
                left[s] -= n
                left[partner] -= n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = min((g for g in gaps if g >= s and gaps[g]), default=None)
            if gap is None:
                each = min(capacity // s, n)
                put(((s, each),), bins := max(1, n // each))
                n -= bins * each
                continue
            content, each = gaps[gap][-1], min(gap // s, n)
            bins = min(classes[content], max(1, n // each))
            classes[content] -= bins
            if not classes[content]:
                del classes[content]
                gaps[gap].pop()
            put((*content, (s, each)), bins)
            n -= bins * each
    return list(classes.items())


def deal_out(bins: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, how many to a bin, place of the first in its bin)."""
    rows, used, sequence = [], {}, 0
    for content, n in bins:
        at = 0
        for s, each in content:
            rows.append((s, used.get(s, 0), used.get(s, 0) + n * each, sequence, each, at))
            used[s] = used.get(s, 0) + n * each
            at += s * each
        sequence += n
    return rows


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (a stored table) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = deal_out(plan_bins(counts, capacity))
    groups = max(GROUPS, -(-max(counts.values(), default=0) // GROUP_PIECES))
    rows = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = rows.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("of"), F.col("grp").alias("of_grp"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    rows = rows.join(sizes, (F.col("length") == F.col("of")) & (F.col("grp") == F.col("of_grp"))).withColumn("rank", F.col("skip") + F.col("at"))
    table = spark.createDataFrame(plan, "len long, lo long, hi long, seq long, each long, place long")
    # The plan's size depends on the capacity, not on the number of pieces.
    rows = rows.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A document is its token ids and the end token; only longer ones than the
    capacity are cut.  Null texts are empty; a null id stays null; repeated rows
    are packed each; an empty table gives no rows; further columns are ignored.
    """
    return pack_pieces(staged(tokenized_pieces(docs, capacity, path, doc_id=doc_id, text=text), "pieces"), capacity)
