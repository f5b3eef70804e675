"""Secret scans over an incremental blob ledger.

Every historical version of a file or document is a blob named by the SHA-256
of its text.  A ledger row says which rule versions have scanned a blob and what
each found.  Only unseen (blob, rule version) pairs are scanned and appended;
findings of the current versions, and of no others, are then joined back to all
rows ("paths") that hold the blob.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, staged

# The base rules, then further formats that carry their own markers.  Kinds are listed in output order.
RULES = {
    "assign": (1, r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": (1, r"AKIA[A-Z0-9]+"),
    "hex": (1, r"[0-9a-f]+"),
    "pem": (2, r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:(?>(?:[A-Za-z0-9+/=:,.\s]|-(?!-))*)-----END [A-Z ]{0,24}PRIVATE KEY-----|(?:\s*[A-Za-z0-9+/=]{16,})*)"),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
}
BASE_KINDS = ("assign", "access", "hex")
#: Least length of a match (of its group 2, here the only group, for assign); shorter ones are dropped after matching.
LEAST = {"assign": 6, "access": 20, "hex": 24, "pem": 0, "jwt": 0}
#: What a text must hold, as bytes in lower case, for a rule to match at all.
NEEDS = {"assign": (b"passw", b"secret", b"token", b"api"), "access": (b"akia",), "pem": (b"private key",), "jwt": (b"eyj",)}
SPREAD = 32
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Spans of a ledger row name the rule version that found them.
LEDGER_SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"sha string, rules array<string>, spans {LEDGER_SPANS}"


def rule_names() -> list[str]:
    """Names of the current rule versions, such as ``hex@1``."""
    return [f"{kind}@{version}" for kind, (version, _) in RULES.items()]


@lru_cache(maxsize=1)
def _compiled() -> dict[str, re.Pattern]:
    out = {kind: re.compile(pattern) for kind, (_, pattern) in RULES.items()}
    # A maximal run under its least length matches nothing from any start within it, so the length may stand in the pattern.
    return out | {"hex": re.compile(rb"[0-9a-f]{24,}"), "access": re.compile(r"AKIA[A-Z0-9]{16,}")}


def find_spans(raw: bytes, kinds=tuple(RULES)) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed."""
    rules, found, lower, text = _compiled(), [], raw.lower(), None
    for kind in kinds:
        if kind == "hex":
            at = start = 0
            for m in rules["hex"].finditer(raw):
                start, at = start + len(raw[at : m.start()].decode()), m.start()
                found.append((kind, start, start + m.end() - m.start()))
        elif any(x in lower for x in NEEDS[kind]):
            text = raw.decode() if text is None else text
            for m in rules[kind].finditer(text):
                if len(m[m.lastindex or 0]) >= LEAST[kind]:
                    found.append((kind, *m.span()))
    order = list(RULES)
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


def _scan(batches):
    names = {name: name.partition("@")[0] for name in rule_names()}
    versions = {kind: name for name, kind in names.items()}
    kind = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        shas, rules, spans = batch.column("sha").to_pylist(), batch.column("todo").to_pylist(), []
        for raw, todo in zip(batch.column("t").cast("binary"), rules):
            spans.append([{"rule": versions[k], "start": s, "end": e} for k, s, e in find_spans(raw.as_py(), [names[x] for x in todo])])
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.string()), pa.array(rules, pa.list_(pa.string())), pa.array(spans, pa.list_(kind))], names=["sha", "rules", "spans"])


def _paths(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.withColumn("sha", F.sha2("t", 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """New ledger rows (sha, rules, spans) for the blobs of ``docs``: one for each blob with a rule version not yet in ``ledger``.

    Each blob is read at the smallest of its ids; equal texts are scanned once.
    """
    paths = _paths(docs, doc_id, text)
    blobs = paths.groupBy("sha").agg(F.min("doc_id").alias("at"))
    every = F.array(*map(F.lit, rule_names()))
    if ledger is None:
        blobs = blobs.withColumn("todo", every)
    else:
        seen = ledger.select(F.col("sha").alias("seen_sha"), F.explode("rules").alias("rule")).filter(F.col("rule").isin(rule_names()))
        seen = seen.groupBy("seen_sha").agg(F.collect_set("rule").alias("done"))
        blobs = blobs.join(seen, F.col("sha") == F.col("seen_sha"), "left")
        blobs = blobs.withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    blobs = blobs.select(F.col("sha").alias("blob"), "at", "todo").hint("shuffle_hash")
    texts = paths.join(blobs, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("sha") == F.col("blob"))).select("sha", "todo", "t")
    return texts.mapInArrow(_scan, LEDGER).dropDuplicates(["sha"])


def join_findings(docs: DataFrame, ledger: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha, found): the spans of each row's blob that current rule versions have in the ledger, empty if none."""
    span = F.struct(F.substring_index("x.rule", "@", 1).alias("kind"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    current = ledger.withColumn("x", F.explode("spans")).filter(F.col("x.rule").isin(rule_names()))
    current = current.groupBy(F.col("sha").alias("blob")).agg(F.collect_set(span).alias("found"))
    # A blob may have a third of all paths: its findings, where there are any, are there once for each of SPREAD groups of paths.
    current = current.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    paths = _paths(docs, doc_id, text).drop("t").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int"))
    return paths.join(current, (F.col("sha") == F.col("blob")) & (F.col("grp") == F.col("part")), "left").select("doc_id", "sha", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def _joined(spans):
    kinds = F.array(*map(F.lit, RULES))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def update_ledger(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger table at ``path`` with rows appended for what ``docs`` has that it lacks; a new table if there is none.

    A run that dies before its rows are committed leaves the table as it was; one
    that is repeated appends nothing.
    """
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    new = staged(scan_unseen(docs, spark.read.schema(LEDGER).parquet(path) if known else None, doc_id, text), "unseen")
    new.write.mode("append").parquet(path)
    discard(new)
    return spark.read.schema(LEDGER).parquet(path)


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    ``spans`` lists all spans as kind:start:end (code points, end exclusive) by
    start and kind; ``base_sha256`` hashes that list of the base kinds.  Null
    texts are empty and have no spans; repeated rows each give a row; a null id
    is an id; an empty table gives no rows; further columns are ignored.
    """
    new = staged(scan_unseen(docs, ledger, doc_id, text), "ledger")
    rows = join_findings(docs, new if ledger is None else ledger.unionByName(new), doc_id, text)
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every run of overlapping spans replaced by ``marker``; n_chars, if there, follows the text.

    All rows and columns stay; null texts stay null.
    """
    dirty = scan_unseen(docs, None, doc_id, text).filter(F.size("spans") > 0).select(F.col("sha").alias("__blob"), F.col("spans").alias("__spans"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("__part"))
    rows = docs.withColumn("__sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withColumn("__grp", F.pmod(F.xxhash64(doc_id), F.lit(SPREAD)).cast("int"))
    rows = rows.join(dirty, (F.col("__sha") == F.col("__blob")) & (F.col("__grp") == F.col("__part")), "left")
    ordered = F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def step(done, x):
        more = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, x["start"] - done["at"]), F.lit(marker))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(x["start"] >= done["at"], more).otherwise(done["out"]).alias("out"))

    clean = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.lit(1 << 30))))
    out = rows.withColumn("__clean", F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col(text)))
    columns = {text: F.col("__clean")} | ({"n_chars": F.when(F.col("__spans").isNotNull(), F.length("__clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))
