"""BM25 over an inverted index that is built for the queries' terms only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

K1, B = 1.5, 0.75


def corpus_stats(documents: DataFrame, body: str = "text") -> DataFrame:
    """One row: n and avgdl (0 for an empty corpus)."""
    return documents.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(text.tokens(F.col(body)))), F.lit(0.0)).alias("avgdl"))


def query_terms(queries: DataFrame, query_id: str, body: str) -> DataFrame:
    """query_id, term, qtf."""
    exploded = queries.select(F.col(query_id).alias("query_id"), F.explode(text.tokens(F.col(body))).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_counts(documents: DataFrame, doc_id: str, body: str) -> DataFrame:
    """term, df and cf over the whole corpus, in one shuffle: in the sorted words of a row each term's first is marked."""

    def marked(words) -> F.col:
        return F.transform(words, lambda t, i: F.struct(t.alias("term"), F.when(F.get(words, i - 1).eqNullSafe(t), 0).otherwise(1).alias("first")))

    sorted_once = F.get(F.transform(F.array(F.array_sort(text.tokens(F.col(body)))), marked), F.lit(0))
    exploded = documents.select(F.explode(sorted_once).alias("x")).select("x.term", "x.first")
    return exploded.groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def postings(documents: DataFrame, terms: DataFrame, doc_id: str, body: str) -> DataFrame:
    """doc_id, dl, term, tf for the given terms: other terms are dropped before anything is shuffled."""
    sized = documents.select(F.col(doc_id).alias("doc_id"), text.tokens(F.col(body)).alias("t"))
    exploded = sized.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return exploded.join(terms.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def idf(found: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf from postings: ln(1 + (n - df + 0.5) / (df + 0.5)), which is always positive."""
    n = F.col("n")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(stats)).select("term", "df", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def scores(queries: DataFrame, documents: DataFrame, query_id: str = "query_id", query_text: str = "text", doc_id: str = "doc_id", body: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score of every pair that shares a term."""
    asked = query_terms(queries, query_id, query_text)
    stats = corpus_stats(documents, body)
    found = postings(documents, asked, doc_id, body)
    weighted = found.join(idf(found, stats), "term").join(F.broadcast(stats))
    length = F.when(F.col("avgdl") > 0, 1 - b + b * F.col("dl") / F.col("avgdl")).otherwise(1.0)
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    return weighted.select("term", "doc_id", weight.alias("w")).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def top(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, rank, doc_id, score (rounded): the k best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rounded = scored.withColumn("score", F.round("score", digits))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def padded(ranked: DataFrame, queries: DataFrame, documents: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """``top`` filled up to k with documents of score 0 in order of id: every query gets min(k, n) rows."""
    first = documents.select(F.col(doc_id).alias("doc_id")).orderBy("doc_id").limit(k)
    asked = queries.select(F.col(query_id).alias("query_id")).distinct()
    rest = asked.join(F.broadcast(first)).join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(ranked.select("query_id", "doc_id", "score").unionByName(rest), k)


GRAM = 3
#: Bytes of passages that are broadcast at once, and how many of them with a key.
BLOCK_BYTES, BLOCK_KEYS = 8 << 20, 50_000


def _grams(words, n: int) -> F.col:
    """Hashes of the n words from each place on, with n; an empty array where there are fewer."""

    def of(w) -> F.col:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(n), *(F.get(w, i + j) for j in range(n))))

    return F.get(F.transform(F.array(words), of), F.lit(0))  # the words are split once


def containing(passages: DataFrame, documents: DataFrame, query_id: str = "query_id", body: str = "text") -> DataFrame:
    """``documents`` with the ``query_id`` of every passage that their text contains, letter for letter.

    A passage's words but for the first and the last stand as whole words in such a document. The least hash of three of
    them in a row (or of all, if they are fewer) is the passage's key; documents meet passages by key and are then
    compared. Passages of one or two words have no key: they are compared with all documents. Passages are broadcast in
    blocks, so that no text is shuffled, let alone once for each of its keys.
    """
    words = F.split(body, r"\s+")
    inner = passages.select(F.col(query_id), F.col(body).alias("passage"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))).alias("w")).where("passage is not null")
    sized = inner.withColumn("n", F.least(F.size("w"), F.lit(GRAM)))
    totals = sized.groupBy("n").agg(F.count("*").alias("rows"), F.sum(F.octet_length("passage")).alias("bytes")).orderBy("n").collect()
    found = None
    for n, rows, size in totals:
        asked = sized.where(F.col("n") == n).select(query_id, "passage", *([F.array_min(_grams(F.col("w"), n)).alias("key")] if n else []))
        keyed = documents.select("*", F.explode(F.array_distinct(_grams(words, n))).alias("key")) if n else documents
        blocks = max(1, -(-size // BLOCK_BYTES), -(-rows // (BLOCK_KEYS if n else 2000)))
        for b in range(blocks):
            part = F.broadcast(asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else asked)
            held = F.col(body).contains(F.col("passage"))
            hit = (keyed.join(part, "key").where(held).drop("key") if n else keyed.join(part, held)).drop("passage")
            found = hit if found is None else found.unionByName(hit)
    return documents.limit(0).join(passages.select(query_id).limit(0)) if found is None else found
