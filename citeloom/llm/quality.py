"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics of each whole text are counted once where the text lies, with numpy over bytes; only those few numbers
go on. Their random Fourier features approximate a Gaussian kernel. The normal equations of the ridge regression are
summed per partition and then by row of the matrix, so neither grows with the input. The scores of the training rows,
added up in fixed bins, are made monotone by pool-adjacent-violators, which gives the calibrated score.

Labels with a null are left out; several labels of one document count as their mean. The fit uses rows drawn by a hash of their
id so that about ``sample_rows`` are expected. Null and empty texts have the statistics of an empty text and get a
score as well. Without a usable label every score is 0.5. Repeated documents are answered each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords
from .shared import TEXT_ROWS, stored

SAMPLE_ROWS, FEATURES, RIDGE, BINS = 50_000, 192, 1e-3, 2000
#: Classes of bytes whose share of a text is a statistic.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?", b"!", b"#$%&*", b"|_=<>{}[]\\^~/@+", b"\"'()-", bytes(range(128, 256)))
STATISTICS = ["length", *(f"class_{i}" for i in range(len(CLASSES))), "words", "word_bytes", "distinct_words", "distinct_lines", "lines", "top_word", "marked_words", "few_words"]


def _line_hashes(buffer: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines that aren't empty, and where each text's begin."""
    outside = buffer == 10
    outside[places - 1] = True
    edge = np.flatnonzero(outside[1:] != outside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    starts = starts[: len(ends)]
    power, inverse = bytewords._power_tables(len(buffer) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], dtype=np.uint64)])
    return bytewords.mix((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, places)


def _distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and the count of its commonest one."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    own = h[bounds[0] : bounds[-1]]
    order = np.lexsort((own, owner))
    o, v = owner[order], own[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, o[at], runs)
    return np.bincount(o[at], minlength=n), most


def statistics(texts: list) -> np.ndarray:
    """One row of ``STATISTICS`` for each byte string."""
    n = len(texts)
    buffer, places = bytewords.joined(texts)
    sizes = np.diff(places) - 1
    kind = np.full(256, len(CLASSES), dtype=np.uint8)
    for i, members in enumerate(CLASSES):
        kind[list(members)] = i
    kinds = kind[buffer]
    at = places[:-1]
    columns = [np.log1p(sizes)]
    share = 1.0 / np.maximum(sizes, 1)
    for i in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == i, dtype=np.int64)])
        columns.append((sums[at + sizes] - sums[at]) * share)
    words, bounds = bytewords.word_hashes(texts, bytewords.SPACE_BYTES)
    count = np.diff(bounds)
    distinct, most = _distinct(words, bounds)
    lines, line_bounds = _line_hashes(buffer, places)
    line_count = np.diff(line_bounds)
    distinct_lines, _ = _distinct(lines, line_bounds)
    per_word = 1.0 / np.maximum(count, 1)
    # words that end in two or more marks
    marks = (kinds == 6) | (kinds == 7) | (kinds == 8)
    ended = np.zeros(len(buffer) + 1, dtype=np.int64)
    ended[3:] = np.cumsum(marks[:-2] & marks[1:-1] & bytewords.SPACE_BYTES[buffer[2:]])
    marked = ended[at + sizes + 1] - ended[at]
    few = np.minimum(count, 20) / 20.0
    columns += [np.log1p(count), (sizes - count) * per_word, distinct / np.sqrt(np.maximum(count, 1)), distinct_lines / np.maximum(line_count, 1), np.log1p(line_count), most * per_word, marked * per_word, few]
    return np.column_stack(columns).astype(float).reshape(n, len(STATISTICS))


def _stats(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.drop_columns([text])
            for first, held in bytewords.chunks(batch.column(text)):
                values = pa.array(statistics(held).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, len(STATISTICS), dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([*kept.slice(first, len(held)).columns, lists], names=[*kept.schema.names, "stats"])

    return run


def describe(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``stats`` in place of the text, stored: the texts are read once."""
    out = documents.drop("stats")
    schema = T.StructType([*(f for f in out.schema.fields if f.name != text), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return stored(out.mapInArrow(_stats(text), schema), "quality-stats", batch_rows=TEXT_ROWS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([np.ones(len(z)), waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))


def _normal_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = shared.value.features(_stats_of(batch))
                part = x.T @ np.column_stack([x, batch.column("label").to_numpy()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

    return run


def _add_rows(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum(np.array(rows.column("sums").to_pylist()), axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _bin_scores(shared, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good, weight = np.zeros(bins), np.zeros(bins), np.zeros(bins)
        for batch in batches:
            raw = shared.value.raw(_stats_of(batch))
            at = np.minimum(((raw + 1) / 3 * bins).astype(int), bins - 1)
            n += np.bincount(at, minlength=bins)
            good += np.bincount(at, batch.column("label").to_numpy(), minlength=bins)
            weight += np.bincount(at, raw, minlength=bins)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(good[at]), pa.array(weight[at])], names=["bin", "n", "good", "weight"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots (mean x of each block) and their values, which never fall."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(described: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, ridge: float = RIDGE, width: float = 1.0) -> Model:
    """A model from stored statistics and labels 0 or 1. ``width``: of the kernel, in units that suit the dimension."""
    spark = described.sparkSession
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.avg(label).cast("double").alias("label"))
    total = labels.count()
    draw = F.crc32(F.concat(F.lit("quality:"), F.col(doc_id).cast("string")).cast("binary")) / F.lit(2.0**32)
    chosen = marks.where(draw < F.lit(min(1.0, sample_rows / max(total, 1))))
    rows = stored(described.select(doc_id, "stats").join(chosen, doc_id).select("stats", "label"), "quality-train")
    k = len(STATISTICS)
    row = rows.agg(F.count("*").alias("n"), *(f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(7)
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.maximum(np.array([row[f"s{i}"] or 0.0 for i in range(k)]), 1e-3)
    model = Model(mean, scale, rng.normal(size=(k, features)) / (width * np.sqrt(k)), rng.uniform(0, 2 * np.pi, features))
    if not row["n"]:
        return model
    shared = spark.sparkContext.broadcast(model)
    parts = rows.mapInArrow(_normal_rows(shared), "i long, sums array<double>").groupBy("i").applyInArrow(_add_rows, "i long, sums array<double>")
    matrix = np.array([r["sums"] for r in sorted(parts.collect(), key=lambda r: r["i"])])
    gram, moment = matrix[:, :-1], matrix[:, -1]
    model.weights = np.linalg.solve(gram + ridge * row["n"] * np.diag([1e-9, *[1.0] * features]) / features, moment)
    shared = spark.sparkContext.broadcast(model)
    bins = rows.mapInArrow(_bin_scores(shared, BINS), "bin long, n double, good double, weight double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("weight").alias("weight")).toPandas().sort_values("bin")
    n = bins["n"].to_numpy()
    model.knots, model.values = isotonic((bins["weight"] / n).to_numpy(), (bins["good"] / n).to_numpy(), n)
    return model


def _score(shared, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shared.value.score(_stats_of(batch)))
            kept = batch.drop_columns(["stats"])
            yield pa.RecordBatch.from_arrays([*kept.columns, found], names=[*kept.schema.names, into])

    return run


def score(described: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """The stored rows without their statistics, with a calibrated score."""
    schema = T.StructType([*(f for f in described.schema.fields if f.name != "stats"), T.StructField(into, T.DoubleType())])
    return described.mapInArrow(_score(described.sparkSession.sparkContext.broadcast(model), into), schema)


def folds(doc_id: Column) -> Column:
    """Whether a document is held out: its CRC-32's remainder by 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
