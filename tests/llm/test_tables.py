"""Sharding and nearest neighbours against brute force."""
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import ann, shards


def placed(spark, rows, n=8):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash"))
    return shards.shard(df, shards=n).collect()


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "é" * int(rng.integers(1, 300)), "en" if i % 3 else None, f"s{i % 2 and 7}") for i in range(3000)] + [(5000 + i, "same text", "en", "s7") for i in range(1500)] + [(9000, None, None, None)]
    got = placed(spark, rows)
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) / min(sizes.values()) < 1.01
    for s in sizes:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("rows", [[], [(1, "a", "x", "y")], [(1, "a", "x", "y"), (1, "a", "x", "y"), (None, "b", None, None)]])
def test_few_rows(spark, rows):
    got = placed(spark, rows)
    assert len(got) == len(rows) and all(0 <= r["shard"] < 8 for r in got)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[300:700] = x[300]  # one very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0] * 3), (None, [1.0] * 16), (5, [9.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.search(df, F.col("id") % 20 == 0, k=10, query_rows=16).collect()
    y = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 1200, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        score = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -np.round(score, 9))) if i != q]
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - score[m[1]]) < 1e-9 for m in mine)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(mine, mine[1:]))
        hits += len({m[1] for m in mine} & set(order[:10]))
        total += 10
    assert hits / total >= 0.9


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("id") % 2 == 0, k=20).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert ann.search(df.where("false"), F.col("id") % 2 == 0).count() == 0 and ann.search(df, F.lit(False)).count() == 0


def test_balls_and_scans_find_every_code_within_the_radius(spark):
    """Close groups of vectors: the balls are small, and give what comparing all codes gives."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    x = (centres[:, None, :] + 0.02 * rng.normal(size=(150, 12, 32))).reshape(-1, 32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    probed = ann.search(df, F.col("id") % 20 == 0, k=5, probe_share=0.5)
    scanned = ann.search(df, F.col("id") % 20 == 0, k=5, probe_share=0.0)
    got, want = (sorted(tuple(r) for r in d.collect()) for d in (probed, scanned))
    hits = len({r[::2][:2] for r in got} & {r[::2][:2] for r in want})
    assert hits / len(want) > 0.95 and len(got) == len(want) == 90 * 5
    codes = ann.learn(x, 5)
    bits = ann.part_bits(len(x))
    held, parts = codes.of(x), codes.parts(x, bits)
    near = codes.radius // parts.shape[1]
    assert parts.shape[1] * ann.ball_size(bits, near) <= 0.5 * len(x) and len(ann.ball(bits, near)) == ann.ball_size(bits, near)
    values = set(ann.ball(bits, near))
    for q in range(0, len(x), 90):
        by_ball = {i for i in range(len(x)) if any(int(a ^ b) in values for a, b in zip(parts[i], parts[q]))}
        assert by_ball >= set(np.flatnonzero(ann.distances(held, held[q]) <= codes.radius))
        assert len(ann.within(held, held[q], 0, 50)) >= 50


def exact_cut(keys, sizes, goal):
    """How near the bytes up to a key can come to the goal."""
    order = np.argsort(keys, kind="stable")
    sums = np.concatenate([[0], np.cumsum(sizes[order])])
    ends = np.flatnonzero(np.append(np.diff(keys[order]) > 0, True)) + 1
    return min(abs(int(sums[e]) - goal) for e in [0, *ends])


def test_splits_against_exact_weighted_medians(spark):
    rng = np.random.default_rng(5)
    n = 900
    table = {"doc_id": np.arange(n), "size": rng.lognormal(5, 1, n).astype(int) + 16, "_a": rng.integers(0, 2**40, n), "_b": rng.integers(0, 4, n) * 2**50 + rng.integers(0, 2**32, n)}
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in zip(*table.values())], "doc_id long, size long, _a long, _b long")
    root = shards._tree(df, ["_a", "_b"], 7)
    keys = [table["_a"], table["_b"]]

    def check(node, rows):
        if node.left is None:
            return [(node.first, int(table["size"][rows].sum()))]
        key, sizes = keys[node.dim][rows], table["size"][rows]
        goal = sizes.sum() * (node.shards // 2) / node.shards
        left = key <= node.bound
        slack = shards.TOLERANCE * sizes.sum()
        assert abs(int(sizes[left].sum()) - goal) <= exact_cut(key, sizes, goal) + slack
        spread = [np.ptp(k[rows]) / np.ptp(k) for k in keys]
        assert spread[node.dim] >= shards.WIDE * max(spread) - 1e-9
        left = left != np.isin(key, node.moved)
        return check(node.left, rows[left]) + check(node.right, rows[~left])

    leaves = check(root, np.arange(n))
    assert [name for name, _ in leaves] == list(range(7))
    assert max(b for _, b in leaves) / min(b for _, b in leaves) < 1.02


def test_documents_larger_than_a_shard(spark):
    rows = [(i, "x" * 50, "en", "s") for i in range(400)] + [(1000, "y" * 200_000, "en", "s"), (1001, None, None, None)]
    got = placed(spark, rows)
    assert len(got) == len(rows) and {r["size"] for r in got} == {66, 200_016, 16}
    by_shard = Counter(r["shard"] for r in got)
    for s in by_shard:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by_shard[s]))
