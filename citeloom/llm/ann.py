"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Several rotations are learned on a bounded sample by iterative quantisation (turn the centred vectors so that their
signs lie near them); the signs of all rotations are a vector's code. A code is split into substrings of about as many
bits as the logarithm of the number of rows, and a stored table (part, value, id) holds all vectors by each substring.
By the pigeonhole principle a code within Hamming radius r of the query's has a substring within r divided by the number of
substrings, rounded down: a query's ball of values around each of its substrings, joined with the table, and a check of
the whole codes find every code within r. What is found is ranked by the inner product of the original vectors in
double precision. The radius is learned too: such that on the sample ``recall`` of the true neighbours lie within it
(in more data the nearest are nearer).

Where neighbours lie far apart, the balls hold more values than the table has vectors; looking at every value of the
table is then less work than looking them up, and gives the same codes. So if the balls of a query hold more than
``PROBE_SHARE`` of the vectors, every code is compared with those of the queries, in blocks of queries that are
broadcast at a bounded size while the vectors stay where they are. Queries with fewer than k codes within the radius
are answered in that way too, the radius growing until k are found: k results are always there if the data has them.

Equal vectors are one entry, with the k + 1 least of their ids: no other id of theirs can be among anyone's k nearest.
Queries with equal vectors are asked once. So no vector, however common, is a group that grows.

Rows whose id or vector is null, whose vector is zero or holds a null or a number that isn't finite, and those whose length
isn't the commonest one take no part. Rows of one id count once, with the least vector. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

ROTATIONS, SAMPLE_ROWS, RECALL = 4, 16_000, 0.97
#: Queries in a broadcast block; balls of up to this share of the vectors are probed.
QUERY_ROWS, PROBE_SHARE = 16_384, 0.25


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int = 0

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        bits = np.packbits((x - self.mean) @ self.rotation > 0, axis=1)
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)

    def parts(self, x: np.ndarray, bits: int) -> np.ndarray:
        """Codes as rows of substrings of ``bits`` (8, 16 or 32) bits, without those that only pad."""
        used = -(-self.rotation.shape[1] // bits)
        return self.of(x).view({8: np.uint8, 16: np.uint16, 32: np.uint32}[bits])[:, :used].astype(np.int64)


def ball(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]


def ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, n) for n in range(min(radius, bits) + 1))


def part_bits(rows: int) -> int:
    """Of 8, 16 and 32 bits what is nearest to the logarithm of the rows."""
    return min((8, 16, 32), key=lambda b: abs(b - log2(max(rows, 2))))


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=1, dtype=np.int64)


def products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each row summed alike wherever it stands: equal vectors get equal scores."""
    return (x * query).sum(axis=1)


def within(codes: np.ndarray, query: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Rows whose code is within ``radius`` of the query's; within more, if they are fewer than ``least``."""
    far = distances(codes, query)
    rows = np.flatnonzero(far <= radius)
    least = min(least, len(far))
    return rows if len(rows) >= least else np.flatnonzero(far <= np.partition(far, least - 1)[least - 1])


def learn(sample: np.ndarray, k: int, rotations: int = ROTATIONS, rounds: int = 20, recall: float = RECALL, probes: int = 300) -> Codes:
    """Rotations by iterative quantisation of ``sample``, and the radius that holds ``recall`` of its probes' k nearest."""
    rng = np.random.default_rng(11)
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    centred = sample - mean
    found = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(rounds if len(sample) > 1 else 0):
            turned = centred @ r
            u, _, vt = np.linalg.svd(centred.T @ np.where(turned > 0, 1.0, -1.0))
            r = u @ vt
        found.append(r)
    codes = Codes(mean, np.column_stack(found))
    packed = codes.of(sample)
    spread: list[np.ndarray] = []
    for i in range(min(probes, len(sample))):
        score = products(sample, sample[i])
        score[i] = -np.inf
        near = np.argsort(-score)[: min(k, len(sample) - 1)]
        spread.append(distances(packed[near], packed[i]))
    every = np.concatenate(spread) if spread else np.zeros(0)
    codes.radius = int(np.quantile(every, recall)) if len(every) else codes.rotation.shape[1]
    return codes


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a column of lists that are all of one length."""
    return np.array(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(vectors), -1)


def _scan(shared, k: int):
    """The k + 1 nearest of each query of a block among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, names, queries = shared.value
        asked = codes.of(queries)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch.column("vector")), batch.column("id").to_numpy()
                held = codes.of(x)
                for i, query in enumerate(queries):
                    at = within(held, asked[i], codes.radius, k + 1)
                    score, name = np.concatenate([found[i][0], products(x[at], query)]), np.concatenate([found[i][1], ids[at]])
                    best = np.lexsort((name, -score))[: k + 1]
                    found[i] = score[best], name[best]
        for i in range(0, len(names), 1024):
            part = found[i : i + 1024]
            columns = [pa.array(names[i : i + 1024], pa.int64()), pa.array([n.tolist() for _, n in part], pa.list_(pa.int64())), pa.array([s.tolist() for s, _ in part], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "ids", "scores"])

    return run


def _parts(shared, bits: int):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(shared.value.parts(_matrix(column), bits).tolist() if len(column) else [], pa.list_(pa.int64()))

    return run


def _scored(shared):
    """The inner product of two vectors whose codes lie within the radius; null beyond."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codes: Codes = shared.value
        for one, other in columns:
            x, y = _matrix(one), _matrix(other)
            far = np.bitwise_count(codes.of(x) ^ codes.of(y)).sum(axis=1, dtype=np.int64) if len(x) else np.zeros(0, np.int64)
            yield pa.array((x * y).sum(axis=1), pa.float64(), mask=far > codes.radius)

    return run


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vector (double) of the rows that take part."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))
    some = stored(some.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    width = some.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return some.where(F.size("vector") == F.lit(width["d"] if width else 0))


def _probed(entries: DataFrame, queries: DataFrame, shared, bits: int, radius: int) -> DataFrame:
    """query, id and score of every entry whose code lies within the radius of the query's.

    The table of substrings and the queries' balls are joined on (part, value); AQE splits what many entries share.
    """
    parts = F.arrow_udf(_parts(shared, bits), "array<long>")
    held = stored(entries.select("id", F.posexplode(parts("vector")).alias("part", "value")), "substrings")
    near = F.array(*(F.lit(x).cast("long") for x in ball(bits, radius)))
    probes = queries.select(F.col("id").alias("query"), F.posexplode(parts("vector")).alias("part", "value")).withColumn("value", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("value")))))
    pairs = stored(probes.join(held, ["part", "value"]).select("query", "id").distinct(), "candidates")
    both = pairs.join(entries.select("id", F.col("vector").alias("other")), "id").join(queries.select(F.col("id").alias("query"), "vector"), "query")
    score = F.arrow_udf(_scored(shared), "double").asNondeterministic()
    return both.select("query", "id", score("vector", "other").alias("score")).where("score is not null")


def _scanned(spark, entries: DataFrame, queries: DataFrame, codes: Codes, k: int, query_rows: int) -> DataFrame:
    """query, id and score of the k + 1 nearest entries of each task, a block of queries at a time."""
    blocks = max(1, -(-queries.count() // query_rows))
    found = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").select("id", "vector").toArrow()
        shared = spark.sparkContext.broadcast((codes, part.column("id").to_numpy(), _matrix(part.column("vector").combine_chunks())))
        one = entries.select("id", "vector").mapInArrow(_scan(shared, k), "query long, ids array<long>, scores array<double>")
        one = one.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
        one = stored(_best(one, k), "scanned") if blocks > 1 else one
        found = one if found is None else found.unionAll(one)
    return found


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "id", "score")


def search(rows: DataFrame, asked: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, query_rows: int = QUERY_ROWS, probe_share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each row for which ``asked`` (of ``id``) holds.

    The index holds every row; ``sample_rows`` bounds (by expectation) what rotations and radius are learned on.
    """
    spark = rows.sparkSession
    own = usable(rows, vec_id, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    total, queries = own.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    if not total or not queries:
        return spark.createDataFrame([], schema)
    # two hashes tell vectors apart
    marked = own.withColumn("u", F.xxhash64("vector")).withColumn("v", F.xxhash64(F.lit(1), "vector"))
    least = marked.withColumn("n", F.row_number().over(Window.partitionBy("u", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = stored(least.groupBy("u", "v").agg(F.min("id").alias("id"), F.any_value("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    members = marked.where(asked).select(F.col("id").alias("query_id"), "u", "v")
    wanted = stored(entries.join(members.select("u", "v").distinct(), ["u", "v"], "left_semi").select("id", "vector"), "asked")

    draw = F.crc32(F.concat(F.lit("nearest:"), F.col("id").cast("string")).cast("binary")) / F.lit(2.0**32)
    sample = own.where(draw < F.lit(min(1.0, sample_rows / total))).orderBy("id").select("vector").toArrow()
    width = len(own.first()["vector"])
    codes = learn(_matrix(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((0, width)), k)
    size = entries.count()
    bits = part_bits(size)
    parts = -(-codes.rotation.shape[1] // bits)
    near = codes.radius // parts
    found = None
    if parts * ball_size(bits, near) <= probe_share * size:
        found = stored(_best(_probed(entries, wanted, spark.sparkContext.broadcast(codes), bits, near), k), "probed")
        full = found.join(entries.select("id", F.size("ids").alias("n")), "id").groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") > k)
        left = stored(wanted.join(full, F.col("id") == F.col("query"), "left_anti"), "unanswered")
        found = found.join(left, F.col("query") == F.col("id"), "left_anti") if not left.isEmpty() else found
    else:
        left = wanted
    if found is None or not left.isEmpty():
        more = _scanned(spark, entries, left, codes, k, query_rows)
        found = more if found is None else found.unionAll(more)
    # all ids of the entries found, then each query's own list
    every = _best(found, k).join(entries.select("id", "ids"), "id").select("query", F.explode("ids").alias("id"), "score")
    lists = _best(every, k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "score"))).alias("list"))
    named = lists.join(entries.select(F.col("id").alias("query"), "u", "v"), "query").select("u", "v", "list")
    each = members.join(named, ["u", "v"]).select("query_id", F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k).alias("list"))
    return each.select("query_id", F.posexplode("list").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
