"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hash of each run of ``window`` k-grams. Two texts that share
``k + window - 1`` words have a fingerprint in common at the same place of the shared span, so looking up the
training fingerprints among the benchmark's and extending each hit word by word to both sides finds every shared
span of that length. Benchmark items with fewer words are one window each and are looked up as a whole.

A benchmark of at most ``block_bytes`` is broadcast, and the documents are looked up where they are read. Beyond that
the fingerprints of documents and items are joined on their hash, and only texts that share one with an item are
compared with it; nothing then grows with the benchmark in any one place.

Null and empty texts have no words: such a document has no hits and such an item no window. Repeated documents are
answered each on its own; rows of the benchmark with the same item_id count as one item. Null item ids are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .graph import sieve
from .shared import fresh, stored

SPAN = 10
K = 5
BLOCK_BYTES = 16 << 20


def winnow(g: np.ndarray, window: int, lasts: np.ndarray) -> np.ndarray:
    """Places of the rightmost least hash in each run of ``window``; ``lasts``: for each place, whether a run may begin there."""
    m = len(g) - window + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64)
    best, at = g[window - 1 : window - 1 + m].copy(), np.full(m, window - 1, dtype=np.int64)
    for j in range(window - 2, -1, -1):
        less = g[j : j + m] < best
        np.copyto(best, g[j : j + m], where=less)
        at[less] = j
    places = np.flatnonzero(lasts[:m])
    mark = np.zeros(len(g), dtype=bool)
    mark[places + at[places]] = True
    return np.flatnonzero(mark)


def fits(count: int, bounds: np.ndarray, span: int) -> np.ndarray:
    """For each word place, whether ``span`` words from it on lie in one text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(count) + span <= ends


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], span: int, k: int):
        self.span, self.k = span, k
        self.names = [name for name, _ in items]
        hashes, bounds = bytewords.word_hashes([(text or "").encode() for _, text in items] or [b""], bytewords.NON_ALNUM)
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.short: dict[int, dict[int, list[int]]] = {}
        prints, owner, place = [], [], []
        for i, w in enumerate(self.words[: len(items)]):
            if 0 < len(w) < span:
                self.short.setdefault(len(w), {}).setdefault(int(bytewords.grams(w, len(w))[0]), []).append(i)
            elif len(w) >= span:
                g = bytewords.grams(w, k)
                at = winnow(g, span - k + 1, np.ones(len(g), dtype=bool))
                prints.append(g[at])
                place.append(at)
                owner.append(np.full(len(at), i))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
        prints, self.owner, self.place = cat(prints, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.owner, self.place = prints[order], self.owner[order], self.place[order]
        self.short_keys = {n: np.array(sorted(t), dtype=np.uint64) for n, t in self.short.items()}

    def __bool__(self) -> bool:
        return bool(len(self.prints) or self.short)

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text: (first word, end word, item) of shared spans, words counted in the chunk."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        text_of = lambda p: int(np.searchsorted(bounds, p, side="right")) - 1
        if len(self.prints) and len(h) >= self.span:
            g = bytewords.grams(h, self.k)
            at = winnow(g, self.span - self.k + 1, fits(len(h), bounds, self.span))
            low = np.searchsorted(self.prints, g[at])
            known = low < len(self.prints)
            known[known] = self.prints[low[known]] == g[at[known]]
            reached: dict[tuple[int, int, int], int] = {}
            for p, first in zip(at[known].tolist(), low[known].tolist()):
                d = text_of(p)
                begin, end = int(bounds[d]), int(bounds[d + 1])
                j = first
                while j < len(self.prints) and self.prints[j] == self.prints[first]:
                    i, q = int(self.owner[j]), int(self.place[j])
                    j += 1
                    if reached.get((d, i, p - q), -1) > p:
                        continue
                    w = self.words[i]
                    left = min(p - begin, q)
                    differ = np.flatnonzero(h[p - left : p][::-1] != w[q - left : q][::-1])
                    left = int(differ[0]) if len(differ) else left
                    right = min(end - p, len(w) - q)
                    differ = np.flatnonzero(h[p : p + right] != w[q : q + right])
                    right = int(differ[0]) if len(differ) else right
                    reached[d, i, p - q] = p + max(right, 1)
                    if left + right >= self.span:
                        found.setdefault(d, []).append((p - left, p + right, i))
        for n, keys in self.short_keys.items():
            g = bytewords.grams(h, n)
            low = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for p in np.flatnonzero((keys[low] == g) & fits(len(h), bounds, n)[: len(g)]).tolist():
                for i in self.short[n][int(g[p])]:
                    if np.array_equal(h[p : p + n], self.words[i]):
                        found.setdefault(text_of(p), []).append((p, p + n, i))
        return found


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("item")).where("name is not null and item is not null").distinct()


_SPANS = "array<struct<first:bigint,end:bigint>>"
_FOUND = f"struct<n_words:bigint,hit_spans:{_SPANS},hit_items:array<string>>"
_PAIR = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _found(shared, span: int, k: int):
    """n_words, hit_spans and hit_items of each text, against all items at once."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(shared.value, span, k)
        for column in columns:
            words, spans, names = [], [], []
            for _, held in bytewords.chunks(column):
                h, bounds = bytewords.word_hashes(held, bytewords.NON_ALNUM)
                words += np.diff(bounds).tolist()
                hits = index.hits(h, bounds) if index else {}
                for d in range(len(held)):
                    found, base = hits.get(d, ()), int(bounds[d])
                    spans.append([{"first": a, "end": b} for a, b in union([(a - base, b - base) for a, b, _ in found])])
                    names.append(sorted({index.names[i] for _, _, i in found}))
            yield pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(spans, pa.list_(_PAIR)), pa.array(names, pa.list_(pa.string()))], names=["n_words", "hit_spans", "hit_items"])

    return run


def _fingerprints(text: str, span: int, k: int, short: list[int]):
    """digest (of the whole text) and its distinct keys: winnowed k-gram hashes, and hashes of all runs as long as a short item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in bytewords.chunks(batch.column(text)):
                h, bounds = bytewords.word_hashes(held, bytewords.NON_ALNUM)
                owner, keys = [], []
                if len(h) >= span:
                    g = bytewords.grams(h, k)
                    at = winnow(g, span - k + 1, fits(len(h), bounds, span))
                    owner.append(np.searchsorted(bounds, at, side="right") - 1)
                    keys.append(g[at])
                for n in short:
                    at = np.flatnonzero(fits(len(h), bounds, n)[: max(0, len(h) - n + 1)])
                    owner.append(np.searchsorted(bounds, at, side="right") - 1)
                    keys.append(bytewords.grams(h, n)[at] ^ np.uint64(n))
                if owner:
                    own, key = np.concatenate(owner), np.concatenate(keys)
                    order = np.lexsort((key, own))
                    own, key = own[order], key[order]
                    new = np.ones(len(own), dtype=bool)
                    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
                    names = [digest(t) for t in held]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in own[new].tolist()], pa.binary()), pa.array(key[new].astype(np.int64))], names=["digest", "key"])

    return run


def _item_keys(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, item in zip(batch.column("name").to_pylist(), batch.column("item").to_pylist()):
                h, _ = bytewords.word_hashes([item.encode()], bytewords.NON_ALNUM)
                if len(h) >= span:
                    g = bytewords.grams(h, k)
                    keys, n = np.unique(g[winnow(g, span - k + 1, np.ones(len(g), dtype=bool))]), 0
                else:
                    n = len(h)
                    keys = bytewords.grams(h, n) ^ np.uint64(n) if n else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array([n] * len(keys), pa.int32())], names=["name", "key", "n"])

    return run


def _extended(span: int, k: int):
    """The spans of one item in one text, found again and extended on the words themselves."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names, items in columns:
            out = []
            for i in range(len(texts)):
                h, bounds = bytewords.word_hashes([texts[i].as_py().encode()], bytewords.NON_ALNUM)
                hits = Index([(names[i].as_py(), items[i].as_py())], span, k).hits(h, bounds).get(0, ())
                out.append([{"first": a, "end": b} for a, b in union([(a, b) for a, b, _ in hits])])
            yield pa.array(out, pa.list_(_PAIR))

    return run


def digest(text: bytes) -> bytes:
    return hashlib.md5(text).digest()


def _joined(documents: DataFrame, items: DataFrame, text: str, span: int, k: int) -> DataFrame:
    """digest, hit_spans and hit_items of the texts that hold something of an item.

    Fingerprints of documents and items meet on their hash; a bitmap of fixed size keeps back the documents' that no
    item has. Every pair of text and item that has met is then compared word by word.
    """
    keys = stored(items.mapInArrow(_item_keys(span, k), "name string, key long, n int"), "item-keys")
    short = sorted(r["n"] for r in keys.where("n > 0").select("n").distinct().collect())
    own = documents.select(F.col(text).alias("text")).where("text is not null")
    prints = sieve(own.mapInArrow(_fingerprints("text", span, k, short), "digest binary, key long"), keys, "key")
    # AQE splits the partitions of a fingerprint that very many texts share
    met = stored(prints.join(keys.select("name", "key"), "key").select("digest", "name").distinct(), "met")
    some = sieve(own.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))), met, "digest")
    texts = stored(some.join(met.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"]), "met-texts")
    extended = F.arrow_udf(_extended(span, k), _SPANS).asNondeterministic()
    spans = met.join(items, "name").join(texts, "digest").select("digest", "name", extended("text", "name", "item").alias("spans")).where(F.size("spans") > 0)
    every = spans.groupBy("digest", "name").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = every.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.collect_set("name")).alias("hit_items"))
    merged = F.aggregate("spans", F.array().cast(_SPANS), lambda out, s: F.when((F.size(out) > 0) & (s["first"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))))
    return stored(whole.select("digest", merged.alias("hit_spans"), "hit_items"), "hits")


def _counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([n for _, held in bytewords.chunks(column) for n in np.diff(bytewords.word_hashes(held, bytewords.NON_ALNUM)[1]).tolist()], pa.int64())


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with ``n_words``, ``hit_spans`` (array of {first, end} in words, disjoint, in order) and ``hit_items`` (item ids as sorted strings).

    ``benchmark`` has ``item_id`` and ``text``. Columns of these names that ``documents`` has already are replaced.
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    spark = documents.sparkSession
    names = ("n_words", "hit_spans", "hit_items")
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in names]
    items = stored(_items(benchmark), "items")
    if (items.agg(F.sum(F.octet_length("item") + F.octet_length("name") + 64)).first()[0] or 0) <= block_bytes:
        shared = spark.sparkContext.broadcast([(r["name"], r["item"]) for r in items.collect()])
        answer = fresh(documents, "_found")
        found = F.arrow_udf(_found(shared, span, k), _FOUND).asNondeterministic()
        return documents.select(*kept, found(F.col(text).cast("string")).alias(answer)).select(*kept, *(F.col(f"{answer}.{n}").alias(n) for n in names))
    own, hit = fresh(documents, "_digest"), fresh(documents, "_hit")
    hits = _joined(documents, items, text, span, k).select(F.col("digest").alias(own), F.struct("hit_spans", "hit_items").alias(hit))
    marked = documents.withColumn(own, F.unhex(F.md5(F.col(text).cast("binary"))))
    clear = sieve(marked, hits, own, inside=False)
    rest = sieve(marked, hits, own).join(hits, own, "left")
    none = F.struct(F.array().cast(_SPANS).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    every = clear.withColumn(hit, none).select(*documents.columns, hit).unionAll(rest.withColumn(hit, F.coalesce(hit, none)).select(*documents.columns, hit))
    count = F.arrow_udf(_counted, "long").asNondeterministic()
    return every.select(*kept, count(F.col(text).cast("string")).alias("n_words"), F.col(f"{hit}.hit_spans").alias("hit_spans"), F.col(f"{hit}.hit_items").alias("hit_items"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(found: DataFrame) -> DataFrame:
    """The contract's row for each document of ``decontaminate``."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: DuckDB: the same by comparing all windows of words.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
places AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS g FROM places),
spots AS (
  SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS p
  FROM words d, (SELECT DISTINCT n FROM windows) s WHERE len(d.w) >= s.n),
hits AS (
  SELECT s.doc_id, s.p, s.n, x.item_id FROM (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g FROM spots) s JOIN windows x ON x.n = s.n AND x.g = s.g),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hits) h, range(0, 10) r(k) WHERE k < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.l, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
