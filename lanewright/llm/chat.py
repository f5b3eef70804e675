"""Chat formatting by cumulative-snapshot collapse (DataFrame functions only).

Loggers often store a conversation again after every turn, so a log holds many
snapshots that are prefixes of a longer one.  Each turn gets a rolling hash of
the turns up to it; a conversation whose whole hash occurs as a proper-prefix
hash of another is anti-joined away, and the remaining ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.llm.common import staged

#: Bits of the turns whose running hash one window computes; longer conversations are joined from such blocks.
BLOCK_BITS = 8
#: Turns rendered into one output row; only longer conversations have several segments.
SEGMENT_TURNS = 1024


#: A conversation id as a key that is never null, and the block of a turn; rows are exchanged by these once.
_KEY = ["none", "c", "blk"]


def _rows(conv: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(none, c, blk, t, role, text, at): turns with their places in their blocks."""
    rows = conv.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))
    zero = F.lit("0").cast(rows.schema["c"].dataType)
    rows = rows.withColumn("none", F.col("c").isNull()).withColumn("c", F.coalesce("c", zero)).withColumn("blk", F.coalesce(F.shiftright(F.col("t").cast("long"), BLOCK_BITS), F.lit(-(1 << 62))))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*_KEY).orderBy("t", "role", "text")))


def _blocks(rows: DataFrame) -> DataFrame:
    """(none, c, blk, skip, n): turns before each block, and of its conversation."""
    before = Window.partitionBy("none", "c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("k"))
    return counts.select(*_KEY, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"), F.sum("k").over(Window.partitionBy("none", "c")).alias("n"))


def _turns(rows: DataFrame) -> DataFrame:
    """(none, c, pos, n, x1, x2): position in, length of and rolling hash within each conversation."""
    parts = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = rows.join(_blocks(rows), _KEY).withColumn("pos", F.col("skip") + F.col("at"))
    hashed = hashed.select(*_KEY, "pos", "n", F.xxhash64(F.col("pos"), *parts).alias("h1"), F.xxhash64(F.lit("second"), *parts, F.col("pos")).alias("h2"))
    running = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("none", "c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy(*_KEY).agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    sums = sums.select(*_KEY, *(F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")))
    hashed = hashed.select(*_KEY, "pos", "n", F.bit_xor("h1").over(running).alias("x1"), F.bit_xor("h2").over(running).alias("x2")).join(sums, _KEY)
    return hashed.select("none", "c", "pos", "n", F.col("x1").bitwiseXOR(F.col("b1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("x2"))


def _maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that stay."""
    turns = _turns(rows).withColumn("conv_id", F.when(~F.col("none"), F.col("c")))
    whole = turns.filter("pos = n").groupBy("n", "x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = turns.filter("pos < n").select(F.col("pos").alias("n"), "x1", "x2").distinct()
    return whole.join(prefixes, ["n", "x1", "x2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def collapse_snapshots(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies.

    A conversation is the list of its (role, text) in order of (turn, role,
    text), nulls first; turn numbers themselves do not count.  It goes if it is
    a proper prefix of another; of equal ones the smallest id stays (a null id
    only if no other has that content) and ``n_copies`` counts them.  Repeated
    rows are repeated turns; null roles and texts equal only nulls; a null
    conv_id is one conversation.  An empty table gives no rows; further columns
    are ignored.
    """
    return _maximal(_rows(conv, conv_id, turn, role, text))


def render_chats(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered maximal conversations: conv_id, n_turns, n_copies, segment, text.

    Each turn is ``<|role|>``, a line break, its text and ``<|end|>``; turns are
    joined by line breaks.  A null role is written ``unknown`` and a null text
    is empty.  ``segment`` counts pieces of SEGMENT_TURNS turns from 0, so no
    row gathers an unbounded conversation; see ``collapse_snapshots`` for the rest.
    """
    rows = _rows(conv, conv_id, turn, role, text)
    kept = staged(_maximal(rows), "kept")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))
    # A conversation's blocks learn that it stays; its turns are beside them already.
    zero = F.lit("0").cast(kept.schema["conv_id"].dataType)
    named = kept.withColumn("none", F.col("conv_id").isNull()).withColumn("c", F.coalesce("conv_id", zero))
    blocks = _blocks(rows).drop("n").join(named, ["none", "c"])
    lines = rows.join(blocks, _KEY).withColumn("pos", F.col("skip") + F.col("at"))
    lines = lines.select("conv_id", "n_turns", "n_copies", F.floor((F.col("pos") - 1) / SEGMENT_TURNS).cast("long").alias("segment"), F.struct("pos", line.alias("line")).alias("x"))
    out = lines.groupBy("conv_id", "n_turns", "n_copies", "segment").agg(F.array_sort(F.collect_list("x")).alias("lines"))
    return out.select("conv_id", "n_turns", "n_copies", "segment", F.concat_ws("\n", "lines.line").alias("text"))
