import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import graph, hideseek, index, sentences
from citeloom.sources import readers, tei
from citeloom.streaming.indexing import upsert_stream

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A <hi>bold</hi> title</title></titleStmt></fileDesc>
<profileDesc><abstract><div><p>First <ref>x</ref> tail</p><p>Second.</p></div></abstract></profileDesc></teiHeader><text><body><p>lost</p>
<div><p>root text</p><div><head>Inner</head><p>a <ref>[1]</ref> b</p></div></div>
<div><head>Intro</head><p>one</p><p> </p><div><head>Deep</head><div><p>two</p></div></div></div><div><head>Intro</head><p>again</p></div></body>
<back><listBibl><biblStruct><analytic><title>Ref A</title></analytic></biblStruct><biblStruct><analytic><title></title></analytic><monogr><title>no</title></monogr></biblStruct>
<biblStruct><monogr><title>Ref M</title></monogr></biblStruct><biblStruct><monogr><title>Ref M</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei(spark):
    r = tei.papers(spark.createDataFrame([("p", TEI)], "paper_id string, xml string")).first()
    assert (r["title"], r["abstract"], r["references"]) == ("A", "First  Second.", ["Ref A", "Ref M", "Ref M"])
    assert [(s["name"], s["text"]) for s in r["sections"]] == [("Untitled Section", "root text"), ("Inner", "a [1] b"), ("Intro", "one\nagain"), ("Intro / Deep", "two")]
    with pytest.raises(ET.ParseError):
        tei.parse("<a>")


def test_sentence_records(spark):
    papers = spark.createDataFrame([("p", "The old abstract has words. More words are in here."), ("q", " ")], "paper_id string, abstract string")
    parts = spark.createDataFrame([("p", 1, "Intro", "We use many words here. Short one. As shown by Smith (2020) it works well."), ("p", 2, "Abstract", "New abstract text wins over old."), ("p", 3, "Noise", "- - - -")], "paper_id string, section_ord int, section string, body string")
    joined = sentences.with_abstract(papers, parts)
    assert {(r["section"], r["section_ord"], r["body"][:3]) for r in joined.collect()} == {("Abstract", 0, "New"), ("Intro", 1, "We "), ("Noise", 3, "- -")}
    got = sentences.extract(joined).orderBy("section_ord", "sent_ord").collect()
    assert [(r["section"], r["position_in_section"], r["has_citation"]) for r in got] == [("Abstract", 0.0, False), ("Intro", 0.0, False), ("Intro", 1.0, True)]
    assert got[1]["next_sentence"] == got[2]["text"] and got[1]["previous_sentence"] is None and got[2]["retrieval_text"] == "As shown by it works well."
    assert sentences.samples(sentences.extract(joined), 1, 1).count() == 2


@pytest.mark.parametrize(("n", "k"), [(0, 0), (1, 1), (2, 1), (5, 2), (10, 3), (15, 4), (25, 8)])
def test_hidden_sizes(spark, n, k):
    rows = spark.createDataFrame([("e", [str(i) for i in range(n)] * 2)], "e string, ids array<string>")
    found = rows.select(hideseek.hidden(F.col("ids"), F.col("e")).alias("h")).first()["h"]
    assert len(found) == k and set(found) <= {str(i) for i in range(n)}


def test_hide_seek_file(spark, tmp_path):
    rows = [
        {"query_text": " q ", "sentence_id": 7, "indexed_reference_ids": ["a", "b", "a"], "total_reference_count": 4, "is_multi_facet": True, "section": "s"},
        {"text": "t", "citing_paper_id": "W", "indexed_references": ["a"]}, {"text": "low", "indexed_reference_ids": ["a"], "total_reference_count": 2}, {"text": "bad", "indexed_reference_ids": "a"},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = {r["example_id"]: r for r in readers.hide_seek_jsonl(spark, str(tmp_path / "x.jsonl")).collect()}
    assert set(got) == {"7", "citing_paper_id:W"} and got["7"]["query_text"] == "q" and got["7"]["is_multi_facet"] is True and len(got["7"]["hidden_paper_ids"]) == 1


def test_coverage(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (7, 10), (5, 4)], "i int, t int")
    assert [r[0] for r in df.select(hideseek.coverage(F.col("i"), F.col("t"))).collect()] == [0.0, 1.0, 0.7, 1.25]


def test_adapters(spark, tmp_path):
    rows = [{"text": " ", "sentence": " hello ", "label": " ", "citation_worthy": "yes"}, {"text": 5, "string": "s", "gold": "Motivation_Background", "id": 3, "citation_worthy": True, "section": "x", "extra": 1}, {"label": "compareorcontrast"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = sorted(readers.acl_arc_jsonl(spark, str(tmp_path / "a.jsonl")).collect(), key=lambda r: r["example_id"])
    assert [(r["example_id"], r["text"], r["gold_label"], r["citation_intent"], r["citation_worthy"]) for r in got] == [
        ("3", "s", "Motivation_Background", "BACKGROUND", True), ("acl-arc-0", "hello", "UNKNOWN", None, None), ("acl-arc-2", "", "compareorcontrast", None, None)]
    assert got[0]["metadata"]["extra"] == "1" and got[0]["section"] == "x"
    (tmp_path / "s.tsv").write_text('string\tlabel\tcite_id\n"a b"\tresults\tc1\n')
    r = readers.scicite_tsv(spark, str(tmp_path / "s.tsv")).first()
    assert (r["example_id"], r["text"], r["citation_intent"], r["citation_worthy"]) == ("c1", "a b", "RESULT", None)


def test_rankings(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"e1": ["a", 2], "e2": 5}')
    (tmp_path / "l.json").write_text('[{"example_id": "e1", "ranked_paper_ids": []}, {"id": "e1", "ranking": [7]}, 3, {"id": "e2", "ranked_paper_ids": [], "paper_ids": ["z"]}]')
    (tmp_path / "s.json").write_text("3")
    read = lambda n: {r["example_id"]: r["ranked"] for r in readers.rankings(spark, str(tmp_path / n)).collect()}
    assert read("o.json") == {"e1": ["a", "2"]} and read("l.json") == {"e1": ["7"], "e2": ["z"]}
    with pytest.raises(Exception, match="rankings must be"):
        read("s.json")


def test_first_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert readers.first_lines(spark, str(tmp_path / "q.jsonl"), 2).count() == 1
    assert [r[0] for r in readers.papers(spark.createDataFrame([(None, "x"), ("", None)], "paperId string, paper_id string")).select("paper_id").collect()] == ["x", ""]


def test_index_and_stream(spark, tmp_path):
    store = index.PaperIndex(spark, "points")
    schema = "paper_id string, title string, abstract string, ordinal int"
    assert store.create(schema + ", point_id string, passage string") and not store.create(schema)
    first = spark.createDataFrame([("a", "T", "", 1), ("a", "U", "", 2), ("b", "V", None, 3)], schema)
    assert store.upsert(first, F.col("ordinal")) == (3, 2) and store.upsert(first, F.col("ordinal")) == (0, 0) and store.count() == 2
    assert {r["title"] for r in spark.table("points").collect()} == {"U", "V"}
    spark.createDataFrame([("b", "X", "", 4), ("c", "Y", "", 5)], schema).write.parquet(str(tmp_path / "in"))
    q = upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "ck"))
    q.awaitTermination()
    assert store.count() == 3
    spark.sql("DROP TABLE points")


def test_hops(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "c"), ("a", "s")], "source string, target string")
    got = {r["paper_id"]: r["role"] for r in graph.hop_roles(edges, spark.createDataFrame([("s",)], "paper_id string")).collect()}
    assert got == {"s": "seed", "a": "hop1", "b": "hop2"}


def test_full_text(spark):
    df = spark.createDataFrame([("T", "", [("I", "x")])], "t string, a string, s array<struct<name:string,text:string>>")
    assert df.select(text.full_text(F.col("t"), F.col("a"), F.col("s"))).first()[0] == "Title: T\n\nI:\nx"
