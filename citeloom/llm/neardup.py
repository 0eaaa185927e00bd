"""Near-duplicates: fast similarity sketching, banding, exact verification, components.

A text's set holds the hashes of its distinct word shingles (64 bits). Texts with one and the same set are one class,
which its least doc_id stands for; only these go on. A sketch of ``bands * rows`` coordinates is filled by rounds of
hashed bin placement: in round i every element goes to a hashed bin with a hashed value, later rounds only count for
bins that are empty so far, and after as many rounds as bins each round serves one bin with all elements, so that
every coordinate fills. Two sketches agree in a coordinate with the probability of the sets' similarity, with
Chernoff bounds as for independent ones.

Documents that share a band meet in a bucket. No bucket is expanded into all pairs:

1. each member is compared with the bucket's least id on the full sets; links make components;
2. buckets whose members all lie in one component are done. The rest is compared across components only: buckets of up
   to ``small`` members by pairs, larger ones in blocks of at most about ``block`` members and ``ELEMENTS`` elements,
   dealt by component and by set size: blocks meet if they can hold a pair that is alike and not yet joined. A meeting
   multiplies sets as matrices and returns no more links than join the components. Nothing is capped.

At the default bands a pair with similarity 0.8 misses every band with a probability of 5e-6.

Null and empty texts have no words, an empty set and no links. A null doc_id is never linked: it stays, with a null
component. Rows with the same doc_id and the same text share a class and are both kept. Of rows with the same doc_id
and different texts each is judged by its own text; those that carry the least id of their group are all kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .graph import components, sieve, without
from .shared import LONG_BYTES, TEXT_ROWS, fresh, stored

SHINGLE, THRESHOLD = 2, 80
BANDS, ROWS = 40, 6
SMALL, BLOCK = 48, 1024
#: Elements of the sets in one block (32 MB), and elements that a meeting of blocks numbers at a time.
ELEMENTS, SLICE = 1 << 22, 1 << 19
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list, n: int) -> Iterator[np.ndarray]:
    """For each byte string the sorted distinct hashes of its ``n``-word shingles (all words, if fewer)."""
    h, bounds = bytewords.word_hashes(texts, bytewords.SPACE_BYTES)
    g = bytewords.grams(h, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        else:
            yield bytewords.grams(h[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64)


class Sketcher:
    def __init__(self, size: int):
        self.size = size
        self.seeds = bytewords.mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        t, i = self.size, 0
        v = np.full(t, _EMPTY)
        while i < t:
            k = min(t - i, 2 * t // len(s) + 1)
            h = bytewords.mix(s[None, :] ^ self.seeds[i : i + k, None])
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            values = (h & np.uint64(0xFFFFFFFF)) | (np.arange(i, i + k, dtype=np.uint64) << np.uint64(32))[:, None]
            np.minimum.at(v, bins.ravel().astype(np.int64), values.ravel())
            i += k
            if not (v == _EMPTY).any():
                return v
        for j in np.flatnonzero(v == _EMPTY).tolist():
            v[j] = (bytewords.mix(s ^ self.seeds[t + j]) & np.uint64(0xFFFFFFFF)).min() | np.uint64((t + j) << 32)
        return v


def _describe(text: str, shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(bands * rows)
        band = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            kept = batch.drop_columns([text])
            for first, held in bytewords.chunks(batch.column(text)):
                sizes, digests, keys = [], [], np.zeros((len(held), bands), dtype=np.uint64)
                for d, s in enumerate(shingle_sets(held, shingle)):
                    sizes.append(len(s))
                    digests.append(_digest(s))
                    if len(s):
                        v, keys[d] = sketch(s).reshape(bands, rows), band
                        for j in range(rows):
                            keys[d] = bytewords.mix(keys[d] + v[:, j])
                bounds = np.concatenate([[0], np.cumsum(np.where(np.array(sizes) > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[np.array(sizes) > 0].ravel().astype(np.int64)))
                part = kept.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=[*kept.schema.names, "n_shingles", "digest", "keys"])

    return run


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in bytewords.chunks(batch.column("text")):
                found = [(_digest(s), s.tobytes()) for s in shingle_sets(held, shingle)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], names=["digest", "elements"])

    return run


def _digests(shingle: int):
    """The digest of each text's set; null without words."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([_digest(s) for _, held in bytewords.chunks(column) for s in shingle_sets(held, shingle)], pa.binary())

    return run


def _alike(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _elements(x: pa.Scalar) -> np.ndarray:
    """A set where it lies in the Arrow buffer."""
    return np.frombuffer(x.as_buffer(), dtype=np.uint64)


def _verify(threshold: int):
    """Whether two sets are alike."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, other in columns:
            yield pa.array([_alike(_elements(x), _elements(y), threshold) for x, y in zip(one, other)], pa.bool_())

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("other")), "b").join(sets.select(F.col("id").alias("a"), F.col("elements").alias("one")), "a")
    alike = F.arrow_udf(_verify(threshold), "boolean")
    return joined.where(alike("one", "other")).select("a", "b")


def _shared(elements: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many elements the ``first`` of the sorted sets share with the ``second``.

    Elements are taken by ranges of their values, which are hashes: about ``SLICE`` at a time, so that little is held
    beside the sets however long they are.
    """
    row_of, col_of = np.full(len(elements), -1), np.full(len(elements), -1)
    row_of[first], col_of[second] = np.arange(len(first)), np.arange(len(second))
    both = np.zeros((len(first), len(second)), dtype=np.float32)
    parts = -(-sum(map(len, elements)) // SLICE)
    inner = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    cuts = np.array([[0, *np.searchsorted(e, inner), len(e)] for e in elements])
    for p in range(parts):
        low, high = cuts[:, p], cuts[:, p + 1]
        owner = np.repeat(np.arange(len(elements)), high - low)
        distinct, code, count = np.unique(np.concatenate([e[a:b] for e, a, b in zip(elements, low, high)]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        column = np.full(len(distinct), -1)
        column[shared] = np.arange(len(shared))
        code = column[code]
        owner, code = owner[code >= 0], code[code >= 0]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for c in range(0, len(shared), 2048):
            a, b = np.searchsorted(code, (c, c + 2048))
            o, k = owner[a:b], code[a:b] - c
            x, y = np.zeros((len(first), 2048), dtype=np.float32), np.zeros((len(second), 2048), dtype=np.float32)
            x[row_of[o[row_of[o] >= 0]], k[row_of[o] >= 0]] = 1
            y[col_of[o[col_of[o] >= 0]], k[col_of[o] >= 0]] = 1
            both += x @ y.T
    return both


def _across(threshold: int):
    """Links between the components of two blocks (or of one): no more than join what they can join."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        side = np.array([x == low for x in rows.column("block").to_pylist()])
        first = np.flatnonzero(side)
        second = np.flatnonzero(~side) if high != low else first
        if not len(first) or not len(second):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids, comp = rows.column("id").to_numpy(), rows.column("comp").to_numpy()
        elements = [_elements(x) for x in rows.column("elements")]
        sizes = np.fromiter(map(len, elements), dtype=np.int64, count=len(elements))
        both = _shared(elements, first, second)
        common = both.astype(np.int64)
        linked = (100 * common >= threshold * (sizes[first][:, None] + sizes[second][None, :] - common)) & (comp[first][:, None] != comp[second][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked)):
            p, q = int(first[i]), int(second[j])
            r, s = root(int(comp[p])), root(int(comp[q]))
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((int(ids[p]), int(ids[q])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with ``comp``, the component that ``found`` gives their id."""
    return members.join(found, "id", "left").select(*members.columns, F.coalesce("root", "id").alias("comp"))


def _met(large: DataFrame, sets: DataFrame, threshold: int, block: int) -> DataFrame:
    """id, comp, elements and block of the members of large buckets, once for each pair of blocks (first, second) that has to meet.

    A family is what large buckets connect. Its members are dealt by component, where one fills a block by its members or
    their elements (the other members are dealt together), and by the logarithm of the set's size, in steps of the size
    ratio that the threshold asks for. Blocks of one and the same component have nothing to join, and blocks more than one step apart no
    pair that is alike; all others meet.
    """
    family = components(large.select(F.col("hub").alias("a"), F.col("id").alias("b"))).withColumnRenamed("root", "family")
    members = large.select("id", "comp").distinct().join(family, "id").join(sets, "id")
    size = F.octet_length("elements") / 8
    fills = F.greatest(F.count("*") / F.lit(block), F.sum(size) / F.lit(ELEMENTS))
    own = members.groupBy("family", "comp").agg(fills.alias("n")).where("n >= 1").select("family", "comp", F.col("comp").alias("own"))
    step = F.floor(F.log(size) / F.lit(math.log(100 / threshold) * (1 + 1e-9) if threshold < 100 else 1e-6))
    placed = stored(members.join(own, ["family", "comp"], "left").withColumn("step", step), "family-members")
    cells = placed.groupBy("family", "own", "step").agg(F.ceil(fills).alias("blocks"))
    cells = stored(cells.withColumn("cell", F.monotonically_increasing_id()), "family-cells")
    name = lambda cell, i: F.struct(F.col(cell).alias("cell"), F.col(i).cast("long").alias("i"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = cells.select("family", F.col("own").alias("own1"), F.col("step").alias("step1"), F.col("cell").alias("cell1"), F.col("blocks").alias("n1"))
    two = cells.select("family", F.col("own").alias("own2"), F.col("step").alias("step2"), F.col("cell").alias("cell2"), F.col("blocks").alias("n2"))
    near = one.join(two, "family").where("cell1 <= cell2 and abs(step1 - step2) <= 1 and not coalesce(own1 = own2, false)")
    pairs = near.withColumn("i1", every("n1")).withColumn("i2", every("n2")).where("cell1 < cell2 or i1 <= i2").select(name("cell1", "i1").alias("first"), name("cell2", "i2").alias("second"))
    pairs = stored(pairs, "block-pairs")
    sides = pairs.select("first", "second", F.col("first").alias("block")).unionAll(pairs.where("first <> second").select("first", "second", F.col("second").alias("block")))
    dealt = placed.join(cells, placed["family"].eqNullSafe(cells["family"]) & placed["own"].eqNullSafe(cells["own"]) & (placed["step"] == cells["step"]))
    dealt = dealt.select("id", "comp", "elements", F.struct(F.col("cell"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("i")).alias("block"))
    return dealt.join(sides, "block")


def links(classes: DataFrame, documents: DataFrame, text: str, shingle: int, threshold: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes (id, rep, digest, keys) that join all whose sets are similar enough."""
    keyed = stored(classes.select("id", F.explode("keys").alias("key")), "band-keys")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = stored(keyed.join(buckets, "key").select("id", "key", "hub", "n"), "buckets")
    wanted = stored(classes.select("id", "rep", "digest").join(members.select("id").distinct(), "id", "left_semi"), "wanted")
    rows = sieve(documents.select(F.col("doc_id").alias("rep"), F.col(text).alias("text")).where("rep is not null"), wanted, "rep")
    found = rows.join(wanted, "rep", "left_semi").mapInArrow(_sets(shingle), "digest binary, elements binary").dropDuplicates(["digest"])
    sets = stored(found.join(wanted, "digest").select("id", "elements"), "sets", batch_rows=TEXT_ROWS, batch_bytes=LONG_BYTES)
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = stored(_verified(pairs, sets, threshold), "links", batch_rows=TEXT_ROWS, batch_bytes=LONG_BYTES)

    labelled = stored(_labelled(members, components(first)), "labelled")
    open_ = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rest = stored(labelled.join(open_, "key"), "open-buckets")
    few = rest.where(F.col("n") <= small).groupBy("key").agg(F.collect_list(F.struct("id", "comp")).alias("m"))
    crossed = few.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x["id"] < y["id"]) & (x["comp"] != y["comp"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))).alias("p"))
    second = _verified(crossed.select("p.a", "p.b").distinct().join(pairs, ["a", "b"], "left_anti"), sets, threshold)
    found = first.unionAll(second)

    large = rest.where(F.col("n") > small)
    if not large.isEmpty():
        found = found.unionAll(_met(large, sets, threshold, block).groupBy("first", "second").applyInArrow(_across(threshold), "a long, b long"))
    return stored(found, "links", batch_rows=TEXT_ROWS, batch_bytes=LONG_BYTES)


def _classified(documents: DataFrame, text: str, shingle: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest, component_id and kept for each row of ``documents``."""
    own = documents.select("doc_id", F.col(text).alias("text"))
    described = stored(own.mapInArrow(_describe("text", shingle, bands, rows), "doc_id long, n_shingles long, digest binary, keys array<long>"), "sketches", batch_rows=TEXT_ROWS, batch_bytes=LONG_BYTES)
    classes = described.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"))
    classes = stored(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    # a class goes by its least doc_id, and by a number where classes share that
    shared = not classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    classes = classes.select("digest", "rep", "keys", F.col("number" if shared else "rep").alias("id"))
    roots = components(links(classes, own, "text", shingle, threshold))
    named = classes.select("digest", "id", "rep").join(roots, "id", "left").select("digest", "rep", F.coalesce("root", "id").alias("component"))
    if shared:
        least = stored(named.groupBy("component").agg(F.min("rep").alias("least")), "least-ids")
        named = named.join(least, "component").withColumn("component", F.col("least"))
    out = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named.select("digest", "component"), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", "digest", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def classify(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``documents`` (doc_id and a text)."""
    return _classified(documents, text, shingle, threshold, bands, rows).drop("digest")


def deduplicate(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``documents`` without those that aren't the least id of their group."""
    found = stored(_classified(documents, text, shingle, threshold, BANDS, ROWS), "near-duplicates")
    gone = found.where("not kept").select("doc_id", F.col("digest").alias("_digest"))
    # ids that some row keeps and another loses: there the text decides
    split = stored(found.groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("any")).where("any and not all").select("doc_id"), "split-ids")
    if split.isEmpty():
        return without(documents, gone.select("doc_id"), "doc_id")
    whole = without(documents, gone.select("doc_id").unionAll(split), "doc_id")
    digest = fresh(documents, "_digest")
    own = F.arrow_udf(_digests(shingle), "binary")
    part = sieve(documents, split, "doc_id").join(split, "doc_id", "left_semi").select(documents.columns).withColumn(digest, own(F.col(text)))
    # a row without words has a null digest, equals none and stays
    return whole.unionAll(part.join(gone.withColumnRenamed("_digest", digest).distinct(), ["doc_id", digest], "left_anti").select(documents.columns))


#: DuckDB: the same from all pairs of texts that share a shingle, with components by walking the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
classes AS (SELECT min(doc_id) AS rep, any_value(s) AS s FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s HAVING len(any_value(s)) > 0),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM classes),
counted AS (SELECT rep, n, t, count(*) OVER (PARTITION BY t) AS df FROM tokens),
ranked AS (SELECT rep, n, t, row_number() OVER (PARTITION BY rep ORDER BY df, t) AS r FROM counted WHERE df > 0),
prefix AS (SELECT rep, n, t FROM ranked WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
candidates AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
verified AS (
  SELECT a, b, len(list_intersect(x.s, y.s)) AS k, len(x.s) AS p, len(y.s) AS q
  FROM candidates JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b),
edges AS (SELECT a, b FROM verified WHERE 100 * k >= 80 * (p + q - k)),
both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
walk AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT walk.a, e.b FROM walk JOIN both_ways e ON e.a = walk.b),
roots AS (SELECT a AS rep, min(b) AS root FROM walk GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, coalesce(r.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN roots r ON r.rep = c.rep
"""
