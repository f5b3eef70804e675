"""Document fingerprints as Merkle trees over sections, paragraphs and phrases (DataFrame functions only).

A text is cut without loss into sections (after blank lines), paragraphs (after
line breaks) and phrases (after a blank that follows punctuation or one of a few
letters, so the cut depends on nearby content alone and survives edits
elsewhere).  Phrases are hashed, paragraphs hash their phrases, sections their
paragraphs, and the root hashes the sections.  The fingerprint carries all of
these hashes in tree shape: roots test equality, sections and in them paragraphs
whose hashes the other tree lacks locate edits, and shared phrase hashes measure
likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.llm.common import staged

SECTION_END = r"(?<=\n[ \t]{0,8}\n)"
PARAGRAPH_END = r"(?<=\n)"
PHRASE_END = r"(?<=(?:[^\p{L}\p{N}\s]|[dlmsxzDLMSXZ])[ \t])"
#: Bits of the document ids in one window of the walk in id order.
BLOCK_BITS = 6
TREE = "array<struct<h:bigint,p:array<struct<h:bigint,l:array<int>>>>>"


def tree_parts(text: Column) -> Column:
    """Sections of paragraphs of phrases; their concatenation is the text."""
    return F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.split(s, PARAGRAPH_END), lambda p: F.split(p, PHRASE_END)))


def tree_of(parts: Column) -> Column:
    """The hashes of sections, paragraphs and phrases as a TREE."""
    paragraphs = lambda s: F.transform(s, lambda p: F.struct(F.xxhash64(p).alias("h"), F.transform(p, lambda x: F.hash(x)).alias("l")))
    return F.transform(F.transform(parts, paragraphs), lambda s: F.struct(F.xxhash64(F.transform(s, lambda p: p["h"])).alias("h"), s.alias("p")))


def root_of(tree: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(tree, lambda s: s["h"].cast("string"))), 256)


def fingerprint_of(root: Column, tree: Column) -> Column:
    return F.concat(root, F.lit(":"), F.to_json(tree))


def leaf_set(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(tree, lambda s: F.transform(s["p"], lambda p: p["l"])))))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of phrase hashes, 0 to 1."""
    return F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text; null is as empty."""
    tree = tree_of(tree_parts(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("__tree", tree).withColumn(out, fingerprint_of(root_of(F.col("__tree")), F.col("__tree"))).drop("__tree")


def locate_edits(a: Column, b: Column) -> Column:
    """The (section, paragraph) branches of ``a`` that ``b`` lacks, wherever they stand there.

    Equal roots end the search, and sections that ``b`` has aren't entered; of
    the others the paragraphs are looked up among those of ``b``'s sections that
    ``a`` lacks.  What was inserted is found with the arguments swapped.  Null if
    either fingerprint is null, empty if the roots are equal.
    """
    tree = lambda x: F.from_json(F.substring(x, 66, 1 << 30), TREE)
    hashes = lambda x: F.transform(x, lambda s: s["h"])
    ta, tb = tree(a), tree(b)
    lacking = F.array_distinct(F.flatten(F.transform(F.filter(tb, lambda s: ~F.array_contains(hashes(ta), s["h"])), lambda s: hashes(s["p"]))))
    numbered = F.transform(ta, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    changed = F.filter(numbered, lambda x: ~F.array_contains(hashes(tb), x["s"]["h"]))
    branches = F.flatten(F.transform(changed, lambda x: F.transform(x["s"]["p"], lambda p, j: F.struct(x["i"].alias("section"), j.alias("paragraph"), p["h"].alias("h")))))
    found = F.transform(F.filter(branches, lambda x: ~F.array_contains(lacking, x["h"])), lambda x: F.struct(x["section"], x["paragraph"]))
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return F.when(same, F.slice(found, 1, 0)).otherwise(found)


def with_next_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t, next_t): each text and that of the next document by id; the first follows the last.

    Rows are dealt by blocks of 2 ** BLOCK_BITS ids, so no window holds more than
    a block; what follows a block comes from a table of block heads.  Null texts
    are empty, a null id sorts first, rows of equal id go by text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("blk", F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BLOCK_BITS), F.lit(-(1 << 62))))
    by_id = Window.partitionBy("blk").orderBy("doc_id", "t")
    heads = rows.withColumn("at", F.row_number().over(by_id)).filter("at = 1").select(F.col("blk").alias("head_blk"), F.col("t").alias("head_t"))
    # Blocks in use are dealt by ranges; what follows a range's last one comes from a row for each range.
    blocks = staged(rows.select("blk").distinct().repartitionByRange("blk").select("blk", F.spark_partition_id().alias("range")), "blocks")
    ranges = blocks.groupBy("range").agg(F.min("blk").alias("first"))
    ranges = ranges.select(F.col("range").alias("r"), F.coalesce(F.lead("first").over(Window.orderBy("first")), F.min("first").over(Window.partitionBy())).alias("after"))
    ahead = F.lead("blk").over(Window.partitionBy("range").orderBy("blk"))
    blocks = blocks.join(F.broadcast(ranges), F.col("range") == F.col("r")).select(F.col("blk").alias("of_blk"), F.coalesce(ahead, "after").alias("head_blk"))
    follow = blocks.join(heads, "head_blk").select("of_blk", "head_t")
    rows = rows.withColumn("in_blk", F.lead("t").over(by_id))
    return rows.join(follow, F.col("blk") == F.col("of_blk")).select("doc_id", "t", F.coalesce("in_blk", "head_t").alias("next_t"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text has the last
    floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document's.  Null texts are empty; a lone document follows itself; two
    empty texts are alike (1.0); repeated rows each give a row; an empty table
    gives no rows; further columns are ignored.
    """
    rows = with_next_document(docs, doc_id, text)
    rows = rows.withColumn("n_chars", F.length("t").cast("long")).withColumn("k", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring("t", F.lit(1), F.col("n_chars").cast("int") - F.col("k")), F.substring("next_t", F.lit(1), F.col("k")))
    rows = rows.withColumn("e", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), tree_of(tree_parts(F.col("t"))).alias("tree"), tree_of(tree_parts(F.col("e"))).alias("etree"), leaf_set(tree_of(tree_parts(F.col("next_t")))).alias("ns"))
    rows = rows.withColumn("root", root_of(F.col("tree"))).withColumn("eroot", root_of(F.col("etree"))).withColumn("s", leaf_set(F.col("tree")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_of(F.col("root"), F.col("tree")).alias("fingerprint"), fingerprint_of(F.col("eroot"), F.col("etree")).alias("edited_fingerprint"),
        F.when(F.col("root") == F.col("eroot"), F.lit(1.0)).otherwise(likeness(F.col("s"), leaf_set(F.col("etree")))).alias("near_edited"),
        likeness(F.col("s"), F.col("ns")).alias("near_next"),
    )
