"""Byte-level BPE, encoding and decoding.

A word (a match of the pattern) is an array of pieces, at first its bytes, later tokens; it is written as a string of one
character of four bytes for each piece. A round finds the adjacent pair of least rank and replaces all its occurrences from
left to right, which the string function ``replace`` does; Spark's higher-order functions fold the rounds until no pair
has a rank. Ranks come from a literal map of pairs, in hashed buckets because Spark's map lookup is a scan.

Replacing all occurrences of the least pair at once is what merging them one by one would do if every token of the
vocabulary encodes to itself, and then each token has one pair that makes it. Both hold for vocabularies that BPE
training made; ``Vocabulary`` checks it and refuses others.

The fold runs once for each distinct word of a task (of as many batches as bring 500,000 words, when it forgets them):
Arrow's dictionary encoding turns a batch's words into numbers, and the words that are new travel on the batch's first
row, as bytes already; a word that is itself a token needs no fold. Words are told apart by 128 bits of hash. After the fold the numbers are looked up in what came so
far. All of it is one stage over the texts where they lie: nothing is shuffled, and memory is bounded by the words
remembered and by a batch. Jobs that encode long texts do well to use small batches (``shared.WORD_ROWS``).
Decoding concatenates the tokens' bytes, a batch at a time.

Null texts are empty; an empty text has no ids. Repeated rows are encoded each on its own. Columns named like the
new one are replaced.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords
from .pii import let

# Letters and numbers of Unicode 14 to 16, in hexadecimal, which Java 17 doesn't know as such.
LATER_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A "
    "1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 "
    "10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF "
    "11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB "
    "1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE "
    "1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF "
)
LATER_NUMBERS = (
    "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA "
)


def _later(*ranges: str) -> str:
    """A class of such characters; what lies before the first of them is told by one comparison."""
    return r"[\x{870}-\x{323AF}&&[" + "".join("-".join("\\x{" + x + "}" for x in r.split("-")) for part in ranges for r in part.split()) + "]]"


_LETTER, _NUMBER = rf"[\p{{L}}{_later(LATER_LETTERS)}]", rf"[\p{{N}}{_later(LATER_NUMBERS)}]"
_OTHER = rf"[^\p{{IsWhite_Space}}\p{{L}}\p{{N}}{_later(LATER_LETTERS, LATER_NUMBERS)}]"
#: Splits texts into words, as Java reads it. White space is Unicode's; the rest is as in the vocabulary's own pattern.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?{_OTHER}+|\p{{IsWhite_Space}}+(?!\P{{IsWhite_Space}})|\p{{IsWhite_Space}}+"
#: Ids become characters from here on, all of four bytes in UTF-8; the last one marks a word that is done.
FIRST, LIMIT = 0x10000, 0xFFFFF
DONE = chr(FIRST + LIMIT)
RANK_BUCKETS = 1 << 14
#: Rows whose ids or bytes are gathered in one go.
ROWS_AT_ONCE = 512
#: Words that a task remembers at most, and up to how many bytes each.
KNOWN_WORDS, LONGEST = 500_000, 256


class Vocabulary:
    """Tokens by id, and the pair of ids that makes each token of more than one byte."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        if len(tokens) > LIMIT or len(ids) < len(tokens) or any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("need all single bytes and at most %d distinct tokens" % LIMIT)
        self.tokens = tokens
        self.bytes = [ids[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = self._merge(t)
                pair = tuple(parts)
                if len(pair) != 2 or tokens[pair[0]] + tokens[pair[1]] != t:
                    raise ValueError(f"token {i} does not encode to itself")
                self.pairs[pair] = i

    def _merge(self, t: bytes) -> list[int]:
        """The pieces of a token by the merges of the tokens before it."""
        parts = [self.bytes[b] for b in t]
        while len(parts) > 2:
            rank, at = min(((self.pairs.get(p, len(self.tokens)), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(0, 0))
            if rank == len(self.tokens):
                break
            parts[at : at + 2] = [rank]
        return parts


def load(path: str) -> Vocabulary:
    """A rank file (base64 token, space, rank on each line) that the driver reads."""
    with open(path, "rb") as file:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return Vocabulary([found[i] for i in range(len(found))])


def _literal(value: object, kind: str) -> Column:
    """A constant that the optimizer folds, whatever its size."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))), kind)


def _bucketed(items: Iterable[tuple[str, str]], keys: list[int], buckets: int) -> Column:
    """A literal array of small maps; ``keys``: the bucket of each item."""
    table: list[dict] = [{} for _ in range(buckets)]
    for (k, v), b in zip(items, keys):
        table[b][k] = v
    return _literal(table, "array<map<string,string>>")


def _bucket(key: Column, buckets: int) -> Column:
    return F.hash(key).bitwiseAND(buckets - 1)


def _buckets_of(spark, names: list[str], buckets: int) -> list[int]:
    rows = spark.createDataFrame([(n,) for n in names], "k string").select(_bucket(F.col("k"), buckets).alias("b")) if names else None
    return [r["b"] for r in rows.collect()] if rows is not None else []


class Encoder:
    """Columns that encode with one vocabulary."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.spark, self.vocabulary = spark, vocabulary
        pairs = [(chr(FIRST + a) + chr(FIRST + b), chr(FIRST + z) + chr(FIRST + a) + chr(FIRST + b)) for (a, b), z in vocabulary.pairs.items()]
        self._ranks = _bucketed(pairs, _buckets_of(spark, [k for k, _ in pairs], RANK_BUCKETS), RANK_BUCKETS)

    def folded(self, word: Column) -> Column:
        """The word's tokens, from its bytes, both as a string of characters."""

        def ranked(s: Column) -> Column:
            """For each adjacent pair what it becomes and the pair itself, or null; characters are in the order of ranks."""
            pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2)))
            return F.transform(pairs, lambda p: F.try_element_at(F.get(self._ranks, _bucket(p, RANK_BUCKETS)), p))

        def step(s: Column, _: Column) -> Column:
            def merged(m: Column) -> Column:
                return F.coalesce(F.replace(s, F.substring(m, 2, 2), F.substring(m, 1, 1)), F.concat(F.lit(DONE), s))

            return F.when((F.octet_length(s) < 8) | s.startswith(F.lit(DONE)), s).otherwise(let(F.array_min(ranked(s)), merged))

        rounds = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
        return F.ltrim(F.aggregate(rounds, word, step), F.lit(DONE))


def _numbered(words: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Each list as numbers of its distinct words, and these."""
    flat = words.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.indices.cast(pa.int32())), flat.dictionary


def _characters(ids: np.ndarray) -> np.ndarray:
    """Rows of the four bytes that write each id."""
    c = (ids + FIRST).astype(np.uint32)
    return np.column_stack([0xF0 | c >> 18, 0x80 | c >> 12 & 63, 0x80 | c >> 6 & 63, 0x80 | c & 63]).astype(np.uint8)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings one after another, and where each string's begin (one more for the end)."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


class Words:
    """Numbers of words, by 128 bits of hash: the memory is 20 bytes a word, whatever its length."""

    def __init__(self):
        self.hashes, self.others, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.numbers)

    def add(self, first: np.ndarray, second: np.ndarray, numbers: np.ndarray) -> None:
        hashes = np.concatenate([self.hashes, first])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.others, self.numbers = hashes[order], np.concatenate([self.others, second])[order], np.concatenate([self.numbers, numbers.astype(np.int32)])[order]

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those that aren't known."""
        if not len(self):
            return np.full(len(first), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, first), len(self) - 1)
        return np.where((self.hashes[at] == first) & (self.others[at] == second), self.numbers[at], -1).astype(np.int32)


def _written(words: pa.Array, single: np.ndarray, tokens: np.ndarray) -> pa.Array:
    """The words as strings of characters: one for a word that is a token (its id in ``tokens``, else -1), else one for each byte (``single``)."""
    raw, ends = _bytes_of(words)
    flat, lengths = single[raw], np.diff(ends)
    known = tokens >= 0
    keep = ~np.repeat(known, lengths)
    keep[ends[:-1][known]] = True
    flat[ends[:-1][known]] = tokens[known]
    cuts = np.concatenate([[0], np.cumsum(np.where(known, 1, lengths))]) * 4
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(_characters(flat[keep]).tobytes()))


def _distinct(shared):
    """Texts' words as numbers; each batch's first row carries the words that are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, single = Words(), np.array([shared.value.index(bytes([b])) for b in range(256)])
        vocabulary.add(*bytewords.string_hashes(*_bytes_of(pa.array(shared.value, pa.binary()))), np.arange(len(shared.value)))
        known, total = Words(), 0
        for batch in batches:
            if batch.num_rows:
                numbers, words = _numbered(batch.column("_words"))
                hashes = bytewords.string_hashes(*_bytes_of(words))
                if total + len(words) > KNOWN_WORDS:
                    known, total = Words(), 0
                before = total
                # very long words are folded anew each time: their hashes could be made to collide
                short = pc.binary_length(words).to_numpy() <= LONGEST
                places = np.where(short, known.find(*hashes), -1).astype(np.int32)
                new = np.flatnonzero(places < 0)
                places[new] = total + np.arange(len(new))
                kept_new = new[short[new]]
                known.add(hashes[0][kept_new], hashes[1][kept_new], places[kept_new])
                total += len(new)
                flat = places[numbers.values.to_numpy()] if len(words) else np.zeros(0, np.int32)
                cuts = (numbers.offsets.to_numpy().astype(np.int64) * 4).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat.tobytes())])
                later = pa.array([i > 0 for i in range(batch.num_rows)])
                written = _written(words.take(pa.array(new)), single, np.where(short[new], vocabulary.find(hashes[0][new], hashes[1][new]), -1))
                first = pa.ListArray.from_arrays(pa.array([0, *[len(new)] * batch.num_rows], pa.int32()), written, mask=later)
                kept = batch.drop_columns(["_words"])
                yield pa.RecordBatch.from_arrays([*kept.columns, packed, first, pa.array([before] * batch.num_rows, pa.int32())], names=[*kept.schema.names, "_numbers", "_words", "_before"])
                pa.default_memory_pool().release_unused()

    return run


def _codes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after another, and where each piece's begin."""
    raw, ends = _bytes_of(pieces)
    c = raw.reshape(-1, 4).astype(np.int32) & [0x07, 0x3F, 0x3F, 0x3F]
    return (c[:, 0] << 18 | c[:, 1] << 12 | c[:, 2] << 6 | c[:, 3]).astype(np.int32) - FIRST, ends // 4


def gathered(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``flat`` that ``numbers`` name, one after another, and their lengths. Part i lies from starts[i] to starts[i + 1]."""
    lengths = (starts[1:] - starts[:-1])[numbers]
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    return flat[np.repeat(starts[:-1][numbers] - before, lengths) + np.arange(lengths.sum())], lengths


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes one after another, and where each one's begin."""
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _bytes(table: tuple[np.ndarray, np.ndarray], lists: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids."""
    found, lengths = gathered(*table, lists.flatten().to_numpy())
    ends = np.concatenate([[0], np.cumsum(lengths)])
    rows = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])].tolist()
    raw = found.tobytes()
    return pa.array([raw[a:b] for a, b in zip(rows, rows[1:])], pa.binary())


def _looked_up(into: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        table = _table(shared.value) if shared else None
        for batch in batches:
            lists = batch.column("_pieces")
            kept = batch.drop_columns(["_numbers", "_pieces", "_before"])
            marks = [*np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            cuts = sorted({0, *marks, *range(0, batch.num_rows, ROWS_AT_ONCE)})
            for a, b in zip(cuts, cuts[1:]):
                if a in marks[:-1]:
                    if batch.column("_before")[a].as_py() == 0:
                        flat, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
                    codes, places = _codes(lists[a].values)
                    flat, starts = np.concatenate([flat, codes]), np.concatenate([starts, starts[-1] + places[1:]])
                if b > a:
                    numbers = [np.frombuffer(x, dtype=np.int32) for x in batch.column("_numbers").slice(a, b - a).to_pylist()]
                    ids, lengths = gathered(flat, starts, np.concatenate(numbers))
                    ends = np.concatenate([[0], np.cumsum(lengths)])
                    rows = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
                    column = pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), pa.array(ids.astype(np.int32)))
                    more = {into: column} | ({"decoded": _bytes(table, column)} if table else {})
                    yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, *more.values()], names=[*kept.schema.names, *more])

    return run


def encode(documents: DataFrame, encoder: Encoder, text: str = "text", into: str = "ids", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """``documents`` (or the columns ``keep`` of it) with the ids of each whole text.

    ``check``: the ids are decoded on the way, into ``decoded``, which spares a second pass through Python.
    """
    own = [c for c in (documents.columns if keep is None else keep) if c not in (into, "_words", "_numbers", "_pieces", "_before", *["decoded"] * check)]
    fields = [documents.schema[c] for c in own]
    sc = documents.sparkSession.sparkContext
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    strings, integer = T.ArrayType(T.StringType()), T.IntegerType()
    more = [T.StructField("_numbers", T.BinaryType()), T.StructField("_words", strings), T.StructField("_before", integer)]
    shared = sc.broadcast(encoder.vocabulary.tokens)
    distinct = documents.select(*own, words.alias("_words")).mapInArrow(_distinct(shared), T.StructType([*fields, *more]))
    folded = distinct.select(*own, "_numbers", "_before", F.transform("_words", encoder.folded).alias("_pieces"))
    return folded.mapInArrow(_looked_up(into, shared if check else None), T.StructType([*fields, T.StructField(into, T.ArrayType(integer)), *[T.StructField("decoded", T.BinaryType())] * check]))


def _joined(ids: str, into: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, max(b.num_rows, 1), ROWS_AT_ONCE)):
            lists = batch.column(ids).fill_null([]) if batch.column(ids).null_count else batch.column(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(table, lists)], names=[*batch.schema.names, into])

    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each array of ids; null for none counts as empty."""
    out = encoded.drop(into)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    return out.mapInArrow(_joined(ids, into, shared), T.StructType([*out.schema.fields, T.StructField(into, T.BinaryType())]))


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's row for each document of ``encode`` with ``check``."""
    ids = F.col("ids")
    return encoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
