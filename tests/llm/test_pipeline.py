"""The corpus pipeline on planted cases."""
import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from citeloom.llm.shared import stored

from .test_words import labelled, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t + " " + prose(rng, 30), lang) for i, t, lang in labelled(rng, 60)]
    passage = prose(rng, 30)
    rows += [(100, rows[3][1], "xx"), (101, rows[4][1] + " tail", "yy"), (102, "123 456", "xx"), (103, None, "xx"), (104, prose(rng, 9) + " " + passage + " end", "xx"), (105, prose(rng, 20) + " mail me@example.com now", "zz")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids, texts = docs.columns, [], {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        ids.append({r["doc_id"] for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == columns
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = set(range(60)) | {105}
    assert ids[0] == clean | {100, 101, 104} and ids[1] == clean | {104} and ids[2] == ids[3] == ids[4] == clean
    assert "me@example.com" not in texts[105] and "[EMAIL]" in texts[105]
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == clean


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, clashing extra columns, and empty tables."""
    rng = random.Random(10)
    rows = [(i, t + " " + prose(rng, 12), lang) for i, t, lang in labelled(rng, 30)] + [(None, "the andtion theing and", "xx"), (None, None, None), (3, "the theand ingtion", None), (3, None, "yy")]
    rows.append(rows[5])
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_lang", "_score", "_sum", "_answer", "_digest", "_at", "ids", "digest", "keys"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([(None, "a b"), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.where("false")):
        held = stored(start, "odd")
        for name, stage in pipeline.STAGES:
            held = stored(stage(spark, held, str(tmp_path)), name)
            assert name == "tokens" or held.columns == docs.columns
        assert (held.count() > 30) == (start is docs) and all(r["decodes"] for r in held.collect())
