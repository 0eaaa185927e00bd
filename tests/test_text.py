import re
import uuid

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.plans import queries


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


@pytest.mark.parametrize(
    ("sentence", "left"),
    [("a [1, 2] b", "a b"), ("[3-5]", ""), ("[1][2]", ""), ("(Smith, 2020)", ""), ("(Smith & Lee, 2020; Jones et al., 2021)", ""), ("(Smith et al., , 2018)", ""),
     ("Smith et al. (2020)", ""), ("Resnik ( 1995 )", ""), ("In (2020)", ""), ("(see Smith, 2020)", "(see Smith, 2020)"), ("(Smith , , 2018)", "(Smith , , 2018)"), ("(Müller, 2020)", "(Müller, 2020)")],
)
def test_citations(spark, sentence, left):
    assert column(spark, [sentence], text.strip_citations) == [left]
    assert column(spark, [sentence], text.has_citation) == [left != sentence]


def test_noise(spark):
    values = ["one two three", "- - - -", "Related Work And Other Things", "This is a sentence with words.", None, ""]
    assert column(spark, values, text.is_noise) == [True, True, True, False, True, True]


def test_tokens_and_clean(spark):
    assert column(spark, ["A b-C 12", None, ""], text.tokens) == [["a", "b", "c", "12"], [], []]
    assert column(spark, [" a  b\n", None], text.clean) == ["a b", ""]
    assert column(spark, ["• a ◦b"], text.without_bullets) == [" a b"]


def test_uuid5(spark):
    values = ["W1", "", "ü", "x" * 300]
    assert column(spark, values, text.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, v)) for v in values]


def test_inputs(spark):
    df = spark.createDataFrame([("T", "A"), ("", None)], "t string, a string")
    assert [r[0] for r in df.select(text.passage(F.col("t"), F.col("a"))).collect()] == ["passage: T. A", "passage: ."]
    assert [r[0] for r in df.select(text.joined(F.col("t"), F.col("a"))).collect()] == ["T A", ""]
    assert column(spark, ["see https://x.y z ( a ) ."], text.tidy) == ["see z (a)."]


def test_sentences_split(spark):
    s = "One two. Three! Four? Five"
    assert column(spark, [s], text.sentences) == [re.split(r"(?<=[.!?])\s+", s)]


#: Sentences that begin or end with the digits of their own place, as addresses and card numbers may
NUMBERED = [
    (1, "en", "0997523947200283 begins this first text 0. 1 of two sentences ends in 11\n2 words follow here! Is 3 the last one of 3? 4 5 6 7. 5 is its own place. "),
    (2, "fr", ". ".join(f"{i} counts its place up to the number {i}" for i in range(14))), (3, "de", None), (4, None, " 0 0 blanks around both ends here 0 0 "), (5, "en", ""),
]


def against_sql(spark, folder, name, rows):
    """The rows of a query over documents and those of its SQL, sorted."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(folder / "documents.parquet"))
    got = queries.QUERIES[name](spark, str(folder))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    wanted = base.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(wanted, key=repr)


def test_sentence_records_keep_digits(spark, tmp_path):
    got, wanted = against_sql(spark, tmp_path, "sentence_records", NUMBERED)
    assert got == wanted and len(got) == 20
    assert column(spark, ["0 a. 1 b 1.  22 c 2"], text.sentences) == [["0 a.", "1 b 1.", "22 c 2"]]


def test_sentence_samples_keep_digits(spark, tmp_path):
    got, wanted = against_sql(spark, tmp_path, "sentence_samples", NUMBERED)
    assert got == wanted and got[0][-1] == "0997523947200283 begins this first text 0."


@pytest.mark.parametrize("name", ["sentence_records", "sentence_samples"])
def test_sentences_know_the_white_space_of_their_sql(spark, tmp_path, name):
    odd = "\t\n\x0b\x0c\r\x01\x1c\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"
    texts = [
        "we go there now.{0}And then we come back again.{0}{0}x y z w v", "we{0}go there{0}now so. {0}and then we come back again{0}", "{0}{0}. 1{0}2 3 4 5", "A Heading Of{0}Many Words{0}",
        "seen by [1,{0}2] and more words. Smith{0}et al. (2020) said these words", "A Heading Of Many Words{0}. B", "first {0} of all • {0} words. \u2022{0} \xa0 then some\x85{0}more words {0}\u2028",
    ]
    rows = [(100 * i + k, "en", t.format(c)) for i, t in enumerate(texts) for k, c in enumerate(odd)]
    got, wanted = against_sql(spark, tmp_path, name, rows)
    assert got == wanted and any("\xa0" in r[-1 if name == "sentence_samples" else 4] for r in got)


def test_citations_on_later_lines(spark, tmp_path):
    texts = ["no title\nsee [4] here\n", "a\n\nb (Smith, 2020)\nSmith et al. (2020) c", "plain\nlines", "[1]\n[2", None, ""]
    rows = [(i * 9 + m, t) for i, t in enumerate(texts) for m in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["has_citation"], r["retrieval_text"]) for r in queries.QUERIES["citation_flags_text"](spark, str(tmp_path)).collect()}
    whole = {i: (t or "") + queries._MARKERS[i % 9] for i, t in rows}
    assert got == {i: (bool(re.search(text.CITATION, s)), " ".join(re.sub(text.CITATION, "", s).split())) for i, s in whole.items()}
    assert got[3] == (True, "no title see here")
