"""The corpus pipeline, stage by stage, against plain Python on a small table."""

from collections import Counter

import corpus_pipeline


def test_stages(spark, sf):
    path = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, docs
    bench = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.staged(stage(spark, before, path), f"test{k}")
        old, new = {r.doc_id: r for r in before.collect()}, after.collect()
        if k < 4:
            assert after.columns == columns and {r.doc_id for r in new} <= set(old)
        gone = set(old) - {r.doc_id for r in new}
        if name == "quality classifier":
            clean = {i for i, r in labels.items() if i in old and r.quality == 1 and r.toxic == 0}
            assert len(gone & clean) <= 0.01 * len(clean) and gone
        elif name == "near-duplicates":
            assert len({r.text for r in new}) == len(new) and gone
        elif name == "benchmark decontamination":
            assert gone == {i for i, r in old.items() if any(b in r.text for b in bench)}
        elif name == "secret scans":
            assert not gone and all((r.text == old[r.doc_id].text) != ("[SECRET]" in r.text) and r.n_chars == len(r.text) for r in new)
        else:
            assert {r.doc_id for r in new} == set(old)
        before = after
    assert Counter(name for name, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1


def test_run_and_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_hard_rows_go_through_all_stages(spark, sf, tmp_path):
    plain = "The harbour was quiet that morning and the boats lay still while the men mended their nets along the wall"
    rows = [
        (1, plain), (1, plain), (2, plain + " again"), (3, None), (4, ""), (5, f"{plain} token: abcdefgh and nothing else besides that here"), (None, "A note without any number at all was found beside the old mill by the river"),
        (6, " ".join(f"word{k} of" for k in range(60_000))), (7, "é" * 3), (8, plain.replace("harbour", "market") + " " * 300_000 + "end"),
    ]
    extra = ", ".join(f"{c} string" for c in ("sha", "key", "t", "blk", "rep", "piece", "length", "item_id", "at", "line", "label"))
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    frame = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *["mine"] * 11) for i, t in rows], schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (99, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "some question that no document holds at all, is it not so?", "z")], "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = frame
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = corpus_pipeline.staged(stage(spark, before, str(tmp_path)), f"hard{k}")
        assert before.columns == frame.columns
        held = Counter(r.doc_id for r in before.collect())
        if name == "quality classifier":
            assert not {3, 4} & set(held) and held[1] == 2
        elif name == "near-duplicates":
            assert held[1] == 2 and 2 not in held and held[None] == 1
        else:
            assert {1, 5, 6, 8} <= set(held)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert "[SECRET]" in texts[5] and texts[1] == plain
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in before.collect())
