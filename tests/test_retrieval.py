import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.functions import ranking
from citeloom.operators import evaluation, fusion, lexical, matching, vectors
from citeloom.plans import queries, retrieval

DOCS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, "delta"), (5, "alpha alpha gamma gamma")]
ASKED = [(10, "alpha beta alpha"), (11, "nothing"), (12, "")]


def bm25(query, docs, k1=1.5, b=0.75):
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, t in toks.items():
        score = 0
        for q in query.split():
            df = sum(q in x for x in toks.values())
            f = t.count(q)
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avg))
        out[i] = round(score, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def frames(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string"), spark.createDataFrame(DOCS, "doc_id long, text string")


def test_bm25_with_padding(spark):
    asked, docs = frames(spark)
    found = lexical.padded(lexical.top(lexical.scores(asked, docs), 4), asked, docs, 4).collect()
    for i, q in ASKED:
        got = [(r["doc_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == i]
        want = bm25(q, DOCS)[:4]
        assert [d for d, _ in got] == [d for d, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_empty_corpus(spark):
    asked, docs = frames(spark)
    assert lexical.scores(asked, docs.where("false")).count() == 0
    assert lexical.corpus_stats(docs.where("false")).first().asDict() == {"n": 0, "avgdl": 0.0}


def test_fusion_recorded_scores(spark):
    one = spark.createDataFrame([("q", i + 1, d, 0.0) for i, d in enumerate("abcdef")], "query_id string, rank int, doc_id string, score double")
    two = spark.createDataFrame([("q", i + 1, d, 0.0) for i, d in enumerate("xyzwa")], "query_id string, rank int, doc_id string, score double")
    got = {r["doc_id"]: r["score"] for r in fusion.reciprocal_rank_fusion(one, two, k=20).collect()}
    assert got["a"] == pytest.approx(1 / 2 + 1 / 6, abs=1e-6) and got["x"] == 0.5 and got["b"] == pytest.approx(1 / 3, abs=1e-6)


def test_rerank_ties_keep_order(spark):
    rows = spark.createDataFrame([("q", 19, "a", 0.8649), ("q", 22, "b", 0.8649), ("q", 3, "c", 0.7352), ("q", 1, "d", 0.9)], "query_id string, rank int, doc_id string, s double")
    got = [(r["rank"], r["doc_id"]) for r in fusion.rerank(rows, F.col("s"), 3).orderBy("rank").collect()]
    assert got == [(1, "d"), (2, "a"), (3, "b")]
    assert fusion.rerank(rows, F.col("s"), 0).count() == 0
    with pytest.raises(ValueError):
        fusion.rerank(rows, F.col("s"), -1)


def test_rank_changes(spark):
    old = spark.createDataFrame([("q", "a", 17)], "query_id string, doc_id string, rank int")
    new = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    assert {r["doc_id"]: r["delta"] for r in fusion.rank_changes(new, old).collect()} == {"a": 16, "b": None}


CASES = [(["a", "b", "c"], ["b"]), ([], ["a"]), (["a"], []), (["a", "a", "b"], ["a", "b"]), (["a", "b", "c"], ["c", "x"]), (["a"], list("abcdefghijklm")), (None, ["a"])]


def expected(ranked, relevant, k):
    ranked, rel = ranked or [], set(relevant)
    top = ranked[:k]
    hits = len(set(top) & rel)
    dcg = sum(1 / math.log2(top.index(x) + 2) for x in rel if x in top)
    ideal = sum(1 / math.log2(i + 2) for i in range(min(len(rel), k)))
    first = min((ranked.index(x) for x in rel if x in ranked), default=None)
    return hits / len(rel) if rel else 0.0, hits / k, 0.0 if first is None else 1 / (first + 1), dcg / ideal if ideal else 0.0


@pytest.mark.parametrize("k", [1, 2, 10])
def test_metrics(spark, k):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "i int, r array<string>, w array<string>")
    r, w = F.col("r"), F.col("w")
    got = df.select("i", ranking.recall_at(r, w, k), ranking.precision_at(r, w, k), ranking.reciprocal_rank(r, w), ranking.ndcg_at(r, w, k)).orderBy("i").collect()
    for row, (a, b) in zip(got, CASES):
        assert list(row)[1:] == pytest.approx(expected(a, b, k))


def test_strata_and_skipped(spark):
    examples = spark.createDataFrame([(1, ["a"], "s", None, "multi"), (2, [], "s", None, "single"), (3, ["b"], "", "METHOD", "multi")], "query_id long, relevant array<string>, section string, intent string, facet string")
    lists = spark.createDataFrame([(1, ["a"])], "query_id long, ranked array<string>")
    measured = evaluation.per_example(examples, lists)
    assert {r["query_id"]: r["skipped"] for r in measured.collect()} == {1: False, 2: True, 3: False}
    found = {(r["stratum_type"], r["stratum"]): (r["n"], r["mrr"]) for r in evaluation.summary(measured).collect()}
    assert found == {("overall", "all"): (2, 0.5), ("section", "s"): (1, 1.0), ("section", "UNKNOWN"): (1, 0.0), ("intent", "UNKNOWN"): (1, 1.0), ("intent", "METHOD"): (1, 0.0), ("facet", "multi"): (2, 0.5)}


def test_bootstrap(spark):
    pairs = spark.createDataFrame([(i, 1.0, 0.0) for i in range(5)], "i long, a double, b double")
    r = evaluation.paired_bootstrap(pairs, n_boot=50).first()
    assert (r["mean_diff"], r["ci_low"], r["ci_high"], r["n_boot"]) == (1.0, 1.0, 1.0, 50) and r["p_value"] == pytest.approx(1 / 51)
    empty = evaluation.paired_bootstrap(pairs.where("false"), n_boot=10).first()
    assert (empty["mean_a"], empty["p_value"]) == (0.0, 1.0)
    with pytest.raises(ValueError):
        evaluation.paired_bootstrap(pairs, n_boot=0)


def test_bootstrap_of_the_default_size(spark, monkeypatch):
    values = [(0.9, 0.1), (0.2, 0.6), (0.5, 0.5), (1.0, 0.0), (0.0, 0.3), (0.7, 0.2), (0.4, 0.1)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i long, a double, b double")
    monkeypatch.setattr(queries, "_paired", lambda *_: pairs)
    r = queries.QUERIES["paired_bootstrap_2000"](spark, "").first()
    d = [a - b for a, b in values]
    means = sorted(sum(d[int(hashlib.md5(f"13|{k}|{j}".encode()).hexdigest()[:8], 16) % len(d)] for j in range(len(d))) / len(d) for k in range(2000))
    assert (r["n_boot"], r["ci_low"], r["ci_high"]) == (2000, pytest.approx(means[50], abs=1e-8), pytest.approx(means[1950], abs=1e-8))
    mean = sum(d) / len(d)
    assert r["p_value"] == pytest.approx((sum(round(abs(m - mean), 8) >= round(abs(mean), 8) for m in means) + 1) / 2001, abs=1e-8)


def test_dense_and_sparse(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["doc_id"], r["score"]) for r in vectors.dense_top(q, v, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107), (3, 0.0)]
    asked, docs = frames(spark)
    got = vectors.sparse_top(vectors.term_weights(asked, "query_id", "text", "query_id"), vectors.term_weights(docs, "doc_id", "text", "doc_id"), 10).collect()
    a, b = Counter("alpha beta alpha".split()), Counter("alpha beta beta".split())
    want = sum(a[t] * b[t] for t in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    assert {r["doc_id"]: r["score"] for r in got}[1] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_matching_is_exact(spark, kind):
    rng = random.Random(5)
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    words = [f"w{int(rng.expovariate(0.1))}" for _ in range(5000)]
    docs = [(name(i), " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)] + [(name(1000 + i), "W1 w2, w2 w1!") for i in range(60)] + [(name(2000), None), (name(2001), "")]
    asked = [(i, " ".join(rng.choices(words, k=8))) for i in range(30)] + [(90, "w1 w2"), (91, "nothing"), (92, None)]
    q, d = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(7)
    weights = vectors.term_weights(q, "query_id", "text", "query_id")
    for size in (matching.BLOCK_TERMS, 120)[kind == "string" :]:
        blocks = matching.counted(q, d, block_terms=size)
        for got, want in ((matching.bm25_top(blocks, 10), lexical.top(lexical.scores(q, d), 10)), (matching.sparse_top(blocks, 10), vectors.sparse_top(weights, vectors.term_weights(d, "doc_id", "text", "doc_id", weights), 10))):
            got, want = (sorted(map(tuple, x.select("query_id", "rank", "doc_id", "score").collect())) for x in (got, want))
            assert [x[:2] for x in got] == [x[:2] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)
            assert [x[2] for x in got if x[0] == 90] == [x[2] for x in want if x[0] == 90] and sum(a[2] != b[2] for a, b in zip(got, want)) <= 2
    assert len(blocks) > 1 and not matching.repeated(d) and matching.repeated(d.unionAll(d.limit(1)))


def test_texts_and_postings_stay(spark):
    """Nothing is shuffled that grows with the words of the documents, however large the tables look to Spark."""
    asked, docs = frames(spark)
    passages = asked.unionAll(spark.createDataFrame([(13, "one two three four five")], "query_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lexical.containing(passages, docs)._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode" in plan and "BroadcastHashJoin" in plan and "Join" not in plan.replace("BroadcastHashJoin", "").replace("BroadcastNestedLoopJoin", "")
        plan = retrieval.sparse(docs)(asked)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bootstrap_of_tables_needs_no_postings(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    asked = [(i, " ".join(rng.choices(words, k=8))) for i in range(6)]
    docs = [(i, " ".join(rng.choices(words, k=30)) + (f" {asked[i % 6][1]} end" if i % 5 == 0 else ""), "en") for i in range(90)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for module, name in ((lexical, "scores"), (vectors, "term_weights")):
        monkeypatch.setattr(module, name, lambda *_, **__: pytest.fail("postings were built"))
    got = queries.QUERIES["paired_bootstrap_2000"](spark, str(tmp_path))
    base = duckdb.connect()
    for table in ("benchmark", "documents"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['paired_bootstrap_2000']})").fetchall()
    assert tuple(got.first()) == pytest.approx(want[0], abs=2e-9) and want[0][-1] == 2000 and want[0][0] > 0
