"""Language identification with language-bitmask n-gram filters.

Training counts byte n-grams of a sample of labelled texts. An n-gram belongs to every language in which it is
common enough beside the language where it is most common. The members go into bit-sliced Bloom filters: a slice is
one table of language bitmasks, an n-gram's bits are set at one place in each slice, and the AND of its places in all
slices is the set of all languages that contain it (or that filter falsely seems to contain it). A text's n-grams
are looked up once for all languages; per-language popcounts, corrected for each language's false-positive rate,
decide, and ties go to the language that is first in order.

Training reads a bounded sample: rows are taken by a hash of their id so that about ``sample_rows`` rows of each
language are expected. Prediction reads every whole text once where it lies, without a shuffle.

A null text and one without a letter give ``und`` and score 0, as does every text when there is nothing to learn
from. Null languages are not learnt from. Repeated rows are answered each on its own; columns of the input named as
the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .shared import TEXT_ROWS, batches_of, fresh

#: Lengths of the n-grams in bytes, slices of the filter, and the logarithm of a slice's places.
LENGTHS, SLICES, PLACES_LOG = (3, 4), 3, 18
SAMPLE_ROWS = 1500
UNDETERMINED = "und"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Letters as bytes: A-Z lower-cased, and all of non-ASCII; the rest becomes one border.
_CLASS = bytewords.LOWER.copy()
_CLASS[[*range(0, 97), *range(123, 128)]] = 32
_CLASS[65:91] = np.arange(97, 123, dtype=np.uint8)


@dataclass
class Model:
    """``names`` by bit; ``slices``: [slice][word of 64 languages, place]; ``false``: each language's false-positive rate."""

    names: list[str]
    slices: list[np.ndarray]
    false: np.ndarray


def gram_codes(texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length: the n-grams of all texts as numbers that tell lengths apart, and where each text's begin."""
    buffer, places = bytewords.joined(texts)
    low = _CLASS[buffer]
    border = low == 32
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(border[1:] & border[:-1])
    before = np.concatenate([[0], np.cumsum(keep)])
    low = low[keep]
    inner = low == 32
    starts = before[places - 1]  # the border before the text, or what stands for it
    starts = starts - (starts > 0) * ~keep[np.minimum(places - 1, len(keep) - 1)]
    codes, bounds = [], []
    for n in LENGTHS:
        m = max(0, len(low) - n + 1)
        code = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | low[j : j + m]
        whole = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            whole &= ~inner[j : j + m]
        count = np.concatenate([[0], np.cumsum(whole)])
        codes.append(code[whole])
        bounds.append(count[np.minimum(starts, m)])
    return codes, bounds


def places_of(code: np.ndarray, places_log: int) -> list[np.ndarray]:
    return [((code * np.uint64(_MULTIPLIERS[s]) ^ (code >> np.uint64(17))) * np.uint64(_MULTIPLIERS[3]) >> np.uint64(64 - places_log)).astype(np.int64) for s in range(SLICES)]


def _count(text: str, lang: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(lang).to_pylist()
            rows = batch.column(text)
            for name in sorted(set(langs)):
                for _, held in bytewords.chunks(rows.filter(pa.array([x == name for x in langs]))):
                    for code in gram_codes(held)[0]:
                        gram, n = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return run


def train(labelled: DataFrame, doc_id: Column, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, share: float = 0.15, least: int = 2, places_log: int = PLACES_LOG) -> Model:
    """A model from rows with a text and a language.

    ``sample_rows``: rows of each language to expect in the sample. ``share``: an n-gram belongs to the languages
    where its rate is at least this share of its highest rate; ``least``: and its count at least this.
    """
    rows = labelled.select(doc_id.alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_text is not null and _lang is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    words = max(1, -(-len(names) // 64))
    slices = [np.zeros((words, 1 << places_log), dtype=np.uint64) for _ in range(SLICES)]
    if not names:
        return Model([], slices, np.zeros(0))
    draw = F.crc32(F.concat(F.lit("language:"), F.col("_id").cast("string")).cast("binary")) / F.lit(2.0**32)
    rate = F.create_map(*(x for name in names for x in (F.lit(name), F.lit(min(1.0, sample_rows / sizes[name])))))
    counted = rows.where(draw < F.element_at(rate, F.col("_lang"))).mapInArrow(_count("_text", "_lang"), "lang string, gram long, n long")
    with batches_of(labelled.sparkSession, TEXT_ROWS):
        counts = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    bit = {name: i for i, name in enumerate(names)}
    of = np.array([bit[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    gram, n = counts.column("gram").to_numpy().astype(np.uint64), counts.column("n").to_numpy().astype(float)
    if len(of):
        part = n / np.bincount(of, n, len(names))[of]
        distinct, where = np.unique(gram, return_inverse=True)
        highest = np.zeros(len(distinct))
        np.maximum.at(highest, where, part)
        member = part >= share * highest[where]
        for s, at in enumerate(places_of(gram[member], places_log)):
            np.bitwise_or.at(slices[s], (of[member] // 64, at), np.uint64(1) << (of[member] % 64).astype(np.uint64))
    false = np.array([np.prod([((t[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for t in slices]) for i in range(len(names))])
    return Model(names, slices, np.minimum(false, 0.99))


def popcounts(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each text, and of these how many each language seems to contain."""
    total, counts = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), len(model.names)))
    places_log = int(model.slices[0].shape[1]).bit_length() - 1
    for code, bounds in zip(*gram_codes(texts)):
        total += np.diff(bounds)
        at = places_of(code, places_log)
        for w in range(model.slices[0].shape[0]):
            held = model.slices[0][w][at[0]]
            for s in range(1, SLICES):
                held &= model.slices[s][w][at[s]]
            for i in range(64 * w, min(64 * w + 64, len(model.names))):
                sums = np.concatenate([[0], np.cumsum((held >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                counts[:, i] += sums[bounds[1:]] - sums[bounds[:-1]]
    return total, counts


def has_letter(text: bytes) -> bool:
    return any(x.isalpha() for x in text[:256].decode(errors="ignore")) or len(text) > 256 and any(x.isalpha() for x in text.decode(errors="replace"))


def _predict(shared):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = shared.value
        for column in columns:
            langs, scores = [UNDETERMINED] * len(column), np.zeros(len(column))
            for first, held in bytewords.chunks(column) if model.names else ():
                total, counts = popcounts(model, held)
                true = np.maximum(counts - model.false * total[:, None], 0) / (1 - model.false)
                best = true.argmax(axis=1)
                hit = true[np.arange(len(held)), best]
                second = np.where(np.arange(len(model.names)) == best[:, None], 0, true).max(axis=1)
                # how much of the text the language explains, and by how much more than any other
                score = np.clip(hit / np.maximum(total, 1), 0, 1) * hit / np.maximum(hit + second, 1e-12)
                for d, raw in enumerate(held):
                    if has_letter(raw):
                        langs[first + d], scores[first + d] = model.names[best[d]], score[d]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return run


def predict(documents: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with the predicted language and a score from 0 to 1. Only these two come back from Python."""
    found = F.arrow_udf(_predict(documents.sparkSession.sparkContext.broadcast(model)), "lang string, score double").asNondeterministic()
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in into]
    answer = fresh(documents, "_answer")
    answered = documents.select(*kept, found(F.col(text)).alias(answer))
    return answered.select(*kept, F.col(f"{answer}.lang").alias(into[0]), F.col(f"{answer}.score").alias(into[1]))
