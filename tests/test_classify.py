import json

import pytest
from pyspark.sql import functions as F

from citeloom.operators import classify, reports

GOLDEN = {("BACKGROUND", "BACKGROUND"): 5, ("BACKGROUND", "METHOD"): 1, ("BACKGROUND", "RESULT"): 2, ("METHOD", "METHOD"): 5, ("METHOD", "RESULT"): 1, ("RESULT", "BACKGROUND"): 3, ("RESULT", "RESULT"): 3}


def test_intent_golden(spark):
    rows = spark.createDataFrame([(g, p) for (g, p), n in GOLDEN.items() for _ in range(n)] + [(None, "METHOD")], "gold string, pred string")
    got = {r["label"]: r for r in classify.intent_metrics(rows).collect()}
    assert {k: round(r["f1"], 4) for k, r in got.items()} == {"BACKGROUND": 0.625, "METHOD": 0.8333, "RESULT": 0.5}
    r = got["METHOD"]
    assert (round(r["accuracy"], 4), round(r["macro_f1"], 4), round(r["weighted_f1"], 4)) == (0.65, 0.6528, 0.65)
    table = {r["gold"]: r for r in reports.confusion_table(classify.intent_confusion(rows)).collect()}
    assert table["RESULT"]["METHOD"] == 0 and table["BACKGROUND"]["OTHER"] == 0


def test_worthiness_golden(spark):
    rows = spark.createDataFrame([(True, True)] * 18 + [(True, False)] * 2 + [(None, True)], "gold boolean, pred boolean")
    r = classify.worthiness_metrics(rows).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy"], r["precision"], round(r["f1"], 4)) == (18, 0, 2, 0, 0.9, 1.0, 0.9474)
    missing = classify.worthiness_metrics(spark.createDataFrame([(False, None)], "gold boolean, pred boolean")).first()
    assert (missing["tn"], missing["accuracy"]) == (1, 0.0)


ITEMS = [{"sentence_index": 0, "citation_worthy": True, "citation_intent": "METHOD", "confidence": 0.9}, {"sentence_index": 1}]
GOOD = json.dumps(ITEMS)
CASES = [(GOOD, None), (f"```json\n{GOOD}\n```", None), (f"Sure: {GOOD} done", None), (GOOD[:-1], "truncated"), ('{"a": 1}', "not a JSON array"), ("[]", "wrong count"),
         (json.dumps([ITEMS[0], ITEMS[0]]), "duplicate index"), (json.dumps([ITEMS[0], {"sentence_index": 7}]), "index out of range"), (json.dumps([ITEMS[0], {}]), "invalid index"), (None, "not a JSON array")]


def test_answers(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string")
    got = rows.select("i", classify.problem(F.col("a"), classify.parsed(F.col("a")), F.lit(2)).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [p for _, p in CASES]
    items = rows.where("i = 0").select(F.explode(classify.parsed(F.col("a"))).alias("x")).select("x.*")
    assert [tuple(r) for r in classify.applied(items).orderBy("sentence_index").select("citation_worthy", "citation_intent", "worthiness_score").collect()] == [(True, "METHOD", 0.9), (False, None, 0.5)]


def records(spark, n):
    return spark.createDataFrame([("p", 1, i, f"s{i}") for i in range(n)], "paper_id string, section_ord int, sent_ord int, text string"), spark.createDataFrame([("p", "T", None)], "paper_id string, title string, abstract string")


def test_classify_halves_bad_batches(spark):
    def client(system, prompt):
        lines = prompt.split("Sentences:\n")[1].split("\n")
        if len(lines) > 3:
            return "[{"
        return json.dumps([{"sentence_index": i, "citation_worthy": line.endswith("2"), "citation_intent": "RESULT", "confidence": 0.8} for i, line in enumerate(lines)])

    rows, papers = records(spark, 12)
    got = classify.classify(rows, papers, client).collect()
    assert len(got) == 12 and {r["text"] for r in got if r["citation_worthy"]} == {"s2"} and {r["citation_intent"] for r in got} == {"RESULT"}
    assert [r["n"] for r in classify.prompts(classify.batches(rows), papers).orderBy("batch").collect()] == [10, 2]


def test_classify_gives_up(spark):
    rows, papers = records(spark, 2)
    with pytest.raises(Exception, match="no JSON"):
        classify.classify(rows, papers, lambda s, p: "nothing").collect()


def test_reports(spark):
    rows = spark.createDataFrame([("q", 1, "W" * 20, "v" * 30, "t" * 50, None, 0.5), ("q", 2, "b", None, "x", 2020, 0.25)], "query_id string, rank int, doc_id string, venue string, title string, year int, score double")
    got = reports.result_table(rows).orderBy("rank").collect()
    assert (got[0]["paper"], got[0]["venue"], got[0]["title"], got[0]["year"], got[1]["year"]) == ("W" * 12, "v" * 23, "t" * 38 + "..", "?", "2020")
    assert reports.result_footer(rows).first()["avg_score"] == 0.375
    assert reports.shown(rows.select("rank", "score")).splitlines()[0] == "rank  score"
