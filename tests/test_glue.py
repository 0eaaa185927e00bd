"""Readers, model interfaces, predictors, checks and the command line."""
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from citeloom import __main__ as command
from citeloom.functions import text
from citeloom.operators import classify, evaluation, fusion, index, lexical, reports, vectors
from citeloom.plans import retrieval
from citeloom.sources import benchmarks, readers


def test_ordinals_count_examples(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n\n  \t\n{"text": "y"}\n{"text": " \\t z \\n"}\n')
    (tmp_path / "b.jsonl").write_text('\n{"text": "w", "label": "\\tbackground\\u00a0"}\n')
    rows = readers.jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted((r["ordinal"], r["line"]) for r in rows.collect()) == [(0, 0), (1, 3), (2, 4)]
    assert {r["ordinal"] for r in readers.first_lines(spark, str(tmp_path / "a.jsonl"), 4).collect()} == {0, 1}
    got = {r["example_id"]: (r["text"], r["gold_label"], r["citation_intent"]) for r in readers.acl_arc_jsonl(spark, str(tmp_path)).collect()}
    assert got == {"acl-arc-0": ("x", "UNKNOWN", None), "acl-arc-1": ("y", "UNKNOWN", None), "acl-arc-2": ("z", "UNKNOWN", None), "acl-arc-3": ("w", "background", "BACKGROUND")}


def test_many_lines_are_read_in_pieces(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f'{{"id": {i}}}\n' if i % 7 else "\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.jsonl(spark, str(path))
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        found = rows.selectExpr("ordinal", "line", "try_variant_get(v, '$.id', 'long') id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    full = [i for i in range(20000) if i % 7]
    assert sorted((r["ordinal"], r["line"], r["id"]) for r in found) == [(n, i, i) for n, i in enumerate(full)]


def test_delimited_without_columns(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("string\tlabel\tnote\tid\nan example\tmethod\t\tx1\n\t\tn\t\n")
    got = sorted(tuple(r) for r in readers.scicite_tsv(spark, str(path)).select("example_id", "text", "gold_label", "citation_intent", F.col("metadata")["note"]).collect())
    assert got == [("scicite-1", "", "UNKNOWN", None, "n"), ("x1", "an example", "method", "METHOD", "")]
    other = readers.acl_arc_tsv(spark, str(path)).orderBy("ordinal").collect()
    assert [(r["example_id"], r["text"], r["gold_label"]) for r in other] == [("x1", "", "method"), ("acl-arc-1", "", "UNKNOWN")]
    none = tmp_path / "u.tsv"
    none.write_text("body\nhello\n")
    assert [(r["example_id"], r["text"], r["gold_label"]) for r in readers.acl_arc_tsv(spark, str(none), body="body").collect()] == [("acl-arc-0", "hello", "UNKNOWN")]


def test_hide_seek_metadata(spark):
    rows = spark.createDataFrame([('{"sentence_id": "s", "citing_paper_id": "W", "venue": "v", "text": "\\u2003q\\t", "year": 3, "indexed_reference_ids": ["a"]}',), ('{"venue": null}',)], "j string")
    got = benchmarks.hide_seek_rows(rows.select(F.parse_json("j").alias("v"))).collect()
    assert got[0]["query_text"] == "q" and got[0]["metadata"] == {"citing_paper_id": "W", "venue": "v", "year": "3", "indexed_reference_ids": '["a"]'}
    assert got[1]["example_id"] == "unknown" and "citing_paper_id" not in got[1]["metadata"]


def test_tidy_and_markdown(spark):
    df = spark.createDataFrame([("2.1 Results , see foot_3 www.x.org/a ( b )", "# A title \n\nx\n## Abstract\nfirst\nsecond\n\n# References\n[1]")], "a string, m string")
    r = df.select(text.tidy(F.col("a")).alias("a"), text.markdown_title(F.col("m")).alias("t"), text.markdown_section(F.col("m"), "abstract").alias("s"), text.markdown_section(F.col("m"), "methods").alias("n")).first()
    assert tuple(r) == ("Results, see (b)", "A title", "first\nsecond", "")


@pytest.mark.parametrize("answer", ['[1, 2]', '[{"sentence_index": "0"}, {"sentence_index": 1}]', '[{"sentence_index": true}, {"sentence_index": 0}]', '[{"sentence_index": null}, {"sentence_index": 1}]', '[{"sentence_index": 0}]', "none"])
def test_odd_answers_are_value_errors(answer):
    with pytest.raises(ValueError):
        classify.read_answer(answer, 2)


def answered(system, prompt):
    lines = prompt.partition("Sentences:\n")[2].split("\n")
    if len(lines) > 2:
        return json.dumps([{"sentence_index": str(i)} for i in range(len(lines))])  # of the wrong type: halved
    return json.dumps([{"sentence_index": i, "citation_worthy": "cite" in line, "citation_intent": "METHOD", "confidence": 0.9} for i, line in enumerate(lines)])


def silent(system, prompt):
    return ""


def labelled(spark):
    rows = [("a", 0, "we cite", "METHOD", True), ("b", 1, "nothing", "METHOD", False), ("c", 2, "cite more", "RESULT", True), ("d", 3, "no", None, True), ("e", 4, "cite", "METHOD", None), ("f", 5, "cite x", "METHOD", False)]
    return spark.createDataFrame([(i, n, t, None, c, w) for i, n, t, c, w in rows], "example_id string, ordinal long, text string, section string, citation_intent string, citation_worthy boolean")


def test_classifier_evaluation(spark):
    examples = classify.labelled_both(labelled(spark))
    assert [r["example_id"] for r in examples.orderBy("ordinal").collect()] == ["a", "b", "c", "f"]
    assert [r["example_id"] for r in classify.labelled_both(labelled(spark), 2).orderBy("ordinal").collect()] == ["a", "b"]
    records = classify.to_classify(examples)
    assert not {"citation_intent", "citation_worthy"} & set(records.columns) and {r["section"] for r in records.collect()} == {"UNKNOWN"}
    intents, worthy = classify.evaluate(examples, answered)
    w = worthy.first()
    assert (w["tp"], w["fp"], w["fn"], w["tn"]) == (2, 1, 0, 1)
    assert {r["label"]: r["support"] for r in intents.collect()} == {"BACKGROUND": 0, "METHOD": 3, "RESULT": 1}
    with pytest.raises(classify.EmptyAnswer):
        classify.completed(silent, "", "")
    with pytest.raises(Exception, match="empty answer"):
        classify.evaluate(examples, silent)[1].collect()


class Overlap:
    loads = 0

    def __init__(self):
        Overlap.loads += 1

    def predict(self, pairs):
        assert len(pairs) <= 2
        return [len(set(a.split()) & set(b.split())) + 10 * (Overlap.loads - 1) for a, b in pairs]


def test_pair_model_is_loaded_once_a_worker(spark):
    rows = spark.createDataFrame([("q", i, f"d{i}", "a b c", " ".join("abcde"[: i % 5])) for i in range(9)], "query_id string, rank int, doc_id string, query string, title string").coalesce(1)
    scorer = fusion.model_scorer(Overlap, "overlap", size=2)
    got = fusion.rerank(rows, scorer(F.col("query"), F.col("title")), 3).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"] % 10) for r in got] == [("d3", 3.0), ("d4", 3.0), ("d8", 3.0)]


def encoder(passages):
    assert len(passages) <= 64
    return [[float(len(p)), 1.0] for p in passages], [{len(p): 0.5} for p in passages]


def test_encoding_in_batches(spark):
    rows = spark.range(150).select("id", F.concat(F.lit("p"), F.col("id")).alias("passage"))
    got = index.encoded(rows, encoder).orderBy("id").collect()
    assert len(got) == 150 and got[149]["dense"] == [4.0, 1.0] and got[5]["sparse"] == {2: 0.5}


def test_payload(spark):
    ranked = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 8, 0.4), (1, 3, 9, 0.3)], "query_id long, rank int, doc_id long, score double")
    papers = spark.createDataFrame([(7, "T", "V"), (8, None, None)], "doc_id long, title string, venue string")
    got = [(r["paper_id"], r["title"], r["year"], r["venue"]) for r in fusion.with_payload(ranked, papers).orderBy("rank").collect()]
    assert got == [("7", "T", None, "V"), ("8", None, None, None), ("9", "", None, None)]


def test_checks_and_latency(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert retrieval.checked(docs, 10, 30).count() == 1
    for bad in ((docs, 10, 5), (docs.where("false"), 1, 5)):
        with pytest.raises(ValueError):
            retrieval.checked(*bad)
    r = reports.latency(spark.createDataFrame([(0.5, 10), (1.5, 4), (None, None)], "seconds double, results int")).first()
    assert (r["queries"], r["completed"], r["results"], r["total_seconds"], r["seconds_per_query"], r["seconds_per_completed"]) == (3, 2, 14, 2.0, pytest.approx(0.666666667), 1.0)


def test_any_predictor(spark):
    examples = spark.createDataFrame([("a", "x", ["1"], "s", None, "single"), ("b", "y", ["2"], "s", None, "single")], "query_id string, text string, relevant array<string>, section string, intent string, facet string")
    lists = spark.createDataFrame([("a", ["3", "1"])], "example_id string, ranked array<string>")
    got = {r["query_id"]: r["mrr"] for r in retrieval.evaluate(examples, retrieval.external(lists)).collect()}
    assert got == {"a": 0.5, "b": 0.0}
    assert {r["query_id"]: r["mrr"] for r in retrieval.evaluate(examples, retrieval.external(lists, 1)).collect()} == {"a": 0.0, "b": 0.0}


def test_passages_in_documents(spark):
    rng = random.Random(1)
    words = [rng.choice(["aa", "b", "ccc", "dd", "e"]) for _ in range(900)]
    docs = [(i, " ".join(words[i * 7 : i * 7 + rng.randint(0, 60)])) for i in range(120)] + [(500, None), (501, ""), (502, "xaa b ccc ddy"), (503, "aa\nb  ccc")]
    asked = [(i, " ".join(words[i * 11 : i * 11 + n])) for i, n in enumerate([1, 2, 3, 4, 5, 8, 20, 40] * 3)] + [(900, None), (901, ""), (902, "a b ccc d"), (903, "aa\nb"), (904, " b "), (905, "b  ccc")]
    got = {(r["query_id"], r["doc_id"]) for r in lexical.containing(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(q, d) for q, p in asked for d, t in docs if p is not None and t is not None and p in t}


def test_numbers_without_gaps(spark):
    rows = spark.range(0, 3000, 3).select((F.col("id") * 7919 % 30011).alias("k")).distinct().repartition(5)
    got = sorted((r["k"], r["i"]) for r in evaluation.numbered(rows, "k").collect())
    assert [i for _, i in got] == list(range(len(got)))
    assert evaluation.numbered(rows.where("false"), "k").count() == 0


def test_dense_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[7] = 0
    held = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vector array<double>").repartition(3)
    got = vectors.dense_top(held.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), "vector"), held, 5, block_rows=4).collect()
    unit = np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))
    for q in range(0, 300, 30):
        score = np.round(unit @ unit[q], 6)
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(300), -score))[:5].tolist()


def test_command_line(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("".join(json.dumps({"text": t, "label": "method", "citation_worthy": w}) + "\n" for t, w in (("we cite", True), ("no", False), ("cite", False))))
    out = command.main(["classifier", "scicite", str(path), "--client", "tests.test_glue:answered", "--pause", "0"], spark)
    assert "METHOD" in out and "precision" in out
    with pytest.raises(ValueError):
        command.main(["classifier", "scicite", str(path), "--client", "tests.test_glue:answered", "--most", "0"], spark)
    docs, rows = tmp_path / "docs", tmp_path / "r.jsonl"
    spark.createDataFrame([(i, f"word{i} text") for i in range(20)], "doc_id long, text string").write.parquet(str(docs))
    rows.write_text(json.dumps({"sentence_id": "s", "text": "word3", "indexed_reference_ids": ["3"], "total_reference_count": 1}) + "\n")
    assert "overall" in command.main(["retrieval", str(rows), str(docs)], spark)
    with pytest.raises(ValueError):
        command.main(["retrieval", str(rows), str(docs), "--candidates", "3"], spark)


def test_the_package_is_shipped_once(spark):
    driver.ship(spark)
    files = [f for f in spark.sparkContext.listFiles if f.endswith("citeloom.zip")]
    driver.ship(spark)
    assert len(files) == 1 and [f for f in spark.sparkContext.listFiles if f.endswith("citeloom.zip")] == files
