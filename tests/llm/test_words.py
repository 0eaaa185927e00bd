"""Operators on words: near-duplicates, decontamination, languages, quality, against brute force."""
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import bytewords, decontam, graph, langid, neardup, quality, shared

SYLLABLES = ["an", "er", "on", "th", "re", "st", "le", "ou", "ti", "ha", "da", "ko", "mi", "ru"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def words_of(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_word_hashes_agree_with_words():
    texts = ["The cat THE", "", " cat\n", "é É ẞ", "a-b 9z", "\x00x"]
    for outside, pattern in ((bytewords.SPACE_BYTES, r"[^\x20\x09-\x0D]+"), (bytewords.NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, bounds = bytewords.word_hashes([t.encode() for t in texts], outside)
        want = [words_of(t, pattern) for t in texts]
        assert np.diff(bounds).tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def brute_groups(rows, n=2):
    sets = {}
    for i, t in rows:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append(" ".join(w))
    rows += ["", None, "one", "ONE", "two words", rows[0], rows[0].upper(), "  "]
    return list(enumerate(rows))


@pytest.mark.parametrize(("small", "block"), [(48, 1024), (2, 8)])
def test_near_duplicates(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup.links, "__defaults__", (small, block))
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classify(df).collect()}
    assert got == brute_groups(rows)
    kept = {r["doc_id"] for r in neardup.deduplicate(df.withColumn("keys", F.lit(1)).withColumn("digest", F.lit("x"))).collect()}
    assert kept == {i for i, (_, root) in brute_groups(rows).items() if i == root}


def test_near_duplicates_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classify(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]
    assert neardup.classify(df.where("false")).count() == 0


@pytest.mark.parametrize(("small", "block"), [(48, 1024), (2, 8)])
def test_near_duplicates_with_repeated_ids(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup.links, "__defaults__", (small, block))
    texts = near_copies()
    rows = [(i % 40, t) for i, t in texts] + [(0, "quite another text"), (7, "quite another text"), (7, "alone in the world")]
    unique = brute_groups([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, (_, root) in unique.items():
        least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    # a text without words is a group of its own
    want = sorted((rows[i][0], n, least[root] if n else rows[i][0]) for i, (n, root) in unique.items())
    df = spark.createDataFrame([(d, t, str(i)) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row string").repartition(3)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.classify(df).collect()) == want
    kept = {r["row"] for r in neardup.deduplicate(df).collect()}
    assert kept == {str(i) for i, (n, root) in unique.items() if not n or least[root] == rows[i][0]}
    assert any(rows[i][0] == rows[j][0] for i in map(int, kept) for j in range(len(rows)) if str(j) not in kept)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    sketch = neardup.Sketcher(400)
    for n in (1, 5, 30, 800):
        s = bytewords.mix(rng.integers(0, 2**62, n).astype(np.uint64))
        assert (sketch(s) == sketch(s)).all() and not (sketch(s) == neardup._EMPTY).any()
    a = bytewords.mix(np.arange(1000, dtype=np.uint64))
    assert abs((sketch(a[:800]) == sketch(a[200:])).mean() - 0.6) < 0.1


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)] + [(100, 200 + i) for i in range(50)] + [(i, i + 1) for i in range(1000, 1040)], "a long, b long")
    got = {r["id"]: r["root"] for r in graph.components(edges).collect()}
    assert [got[i] for i in range(1, 6)] == [1] * 5 and got[9] == 8 and got[249] == 100 and got[1040] == 1000 and 7 not in got


def test_sieve(spark):
    rows, ids = spark.range(1000), spark.range(0, 1000, 7)
    inside = {r["id"] for r in graph.sieve(rows, ids, "id").collect()}
    assert inside >= set(range(0, 1000, 7)) and len(inside) < 200
    assert {r["id"] for r in graph.without(rows, ids, "id").collect()} == set(range(1000)) - set(range(0, 1000, 7))


def brute_hits(docs, items, span=10):
    out = {}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for i, t in docs:
        w = words_of(t, pattern)
        hit, names = set(), set()
        for name, text in items:
            b = words_of(text, pattern)
            n = min(len(b), span)
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination(spark, block_bytes):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(30)] + [(30, None), (31, ""), (32, "the " * 30), (33, "the " * 30), (0, "again one more passage of words")]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1] or ""
            w = w.split()
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a : a + rng.choice([5, 10, 15, 100])]).upper(), prose(rng, rng.randint(0, 4))]
        docs.append((i, ", ".join(parts)))
    docs += [(60, None), (61, ""), (62, "the, " * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    found = decontam.report(decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute_hits(docs, items)


def test_decontamination_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert tuple(decontam.report(decontam.decontaminate(docs, items)).first())[1:4] == (2, 0, 0)
    assert decontam.decontaminate(docs.where("false"), items).count() == 0


LANGS = {"xx": ["the", "and", "ing", "tion"], "yy": ["que", "eau", "oux", "lle"], "zz": ["sch", "ung", "kei", "ein"]}


def labelled(rng, n):
    for i in range(n):
        lang = rng.choice(list(LANGS))
        yield i, " ".join("".join(rng.choices(LANGS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 40))).title(), lang


def test_languages(spark):
    rows = [*labelled(random.Random(1), 400), (400, None, "xx"), (401, "123 !?", "yy"), (402, "thing", None), (403, "", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(df.where("doc_id % 2 = 0"), F.col("doc_id"))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:400]) >= 398
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (400, 401, 403)) and got[402]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_without_training(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.train(df, F.col("doc_id"))).first()["lang_pred"] == "und"


def test_popcounts_agree_with_sets():
    texts = [b"The cat", b"", "é-x 12 yé".encode(), b"a"]
    codes, bounds = langid.gram_codes(texts)
    for n, code, at in zip(langid.LENGTHS, codes, bounds):
        for d, t in enumerate(texts):
            clean = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + t.lower() + b" ")
            want = [clean[i : i + n] for i in range(len(clean) - n + 1) if b" " not in clean[i + 1 : i + n - 1]]
            assert [int(c).to_bytes(8, "big")[-n:] for c in code[at[d] : at[d + 1]]] == want


def test_quality(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(5, 80))
        rows.append((i, text if good else rng.choice([text.upper() + "!!", " ".join(w + "###" for w in text.split()), (text[:20] + "\n") * 9])))
        marks.append((i, int(good), 0))
    rows += [(600, None), (601, "")]
    described = quality.describe(spark.createDataFrame(rows, "doc_id long, text string").withColumn("stats", F.lit(0)))
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(described, labels.where(~quality.folds(F.col("doc_id"))))
    got = {r["doc_id"]: r["score"] for r in quality.score(described, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _, _ in marks if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(marks[i][1]) for i in held]) > 0.95
    empty = quality.train(described, labels.where("false"))
    assert quality.score(described, empty).first()["score"] == 0.5


def test_isotonic():
    rng = np.random.default_rng(0)
    x = np.sort(rng.random(200))
    y = (rng.random(200) < x).astype(float)
    knots, values = quality.isotonic(x, y, np.ones(200))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and abs(np.average(values) - 0.5) < 0.5


def brute_statistics(text):
    raw = text.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+".encode(), raw)
    lower = [re.sub(rb"[A-Z]", lambda m: m.group().lower(), w) for w in words]
    lines = [x for x in raw.split(b"\n") if x]
    share = [sum(b in c for b in raw) / max(len(raw), 1) for c in quality.CLASSES]
    most = max((lower.count(w) for w in set(lower)), default=0)
    return [
        np.log1p(len(raw)), *share, np.log1p(len(words)), (len(raw) - len(words)) / max(len(words), 1), len(set(lower)) / np.sqrt(max(len(words), 1)), len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)),
        most / max(len(words), 1), len(re.findall(rb"[!#$%&*|_=<>{}\[\]\\^~/@+]{2}(?=[\x20\x09-\x0D]|\Z)", raw)) / max(len(words), 1), min(len(words), 20) / 20,
    ]


def test_statistics_against_brute_force():
    rng = random.Random(8)
    texts = ["", "a", "The the THE\n\nthe\nthe", "x!! y## z!#", "é É 12 <b> -- ''", "\n\n\n", "tab\tsep  two", "wow!!"] + [prose(rng, 40) + rng.choice(["!!", " ##", "\n"]) * 3 for _ in range(20)]
    marks = {6, 7, 8}
    assert [i for i, c in enumerate(quality.CLASSES) if i in marks] == [6, 7, 8]
    got = quality.statistics([t.encode() for t in texts])
    for row, text in zip(got, texts):
        assert row == pytest.approx(brute_statistics(text), abs=1e-9), text


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(4)
    k = 6
    model = quality.Model(np.zeros(k), np.ones(k), rng.normal(size=(k, 4000)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, 4000))
    x = rng.normal(size=(40, k))
    waves = model.features(x)[:, 1:]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(waves @ waves.T - np.exp(-far / (2 * k))).max() < 0.08


def test_normal_equations_against_a_direct_solution(spark):
    rng = np.random.default_rng(6)
    n = 500
    stats = rng.normal(size=(n, len(quality.STATISTICS)))
    label = (stats[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(float)
    described = spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(stats)], "doc_id long, stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)], "doc_id long, quality int")
    model = quality.train(described, labels)
    assert model.mean == pytest.approx(stats.mean(axis=0)) and model.scale == pytest.approx(stats.std(axis=0))
    x = model.features(stats)
    penalty = quality.RIDGE * n / quality.FEATURES * np.diag([1e-9, *[1.0] * quality.FEATURES])
    direct = np.linalg.solve(x.T @ x + penalty, x.T @ label)
    assert x @ model.weights == pytest.approx(x @ direct, abs=1e-6)
    raw = model.raw(stats)
    at = np.minimum(((raw + 1) / 3 * quality.BINS).astype(int), quality.BINS - 1)
    bins = np.unique(at)
    knots, values = quality.isotonic(np.array([raw[at == b].mean() for b in bins]), np.array([label[at == b].mean() for b in bins]), np.array([(at == b).sum() for b in bins]))
    assert model.knots == pytest.approx(knots) and model.values == pytest.approx(values)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    rows = [(1, "good text here"), (1, "good text here"), (2, "!!! ###"), (3, "word " * 200_000), (None, None)]
    described = quality.describe(spark.createDataFrame(rows, "doc_id long, text string"))
    got = quality.score(described, quality.train(described, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    empty = quality.describe(spark.createDataFrame([], "doc_id long, text string"))
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_very_long_and_empty_tables(spark):
    long = " ".join(f"w{i % 5000}x" for i in range(150_000))
    df = spark.createDataFrame([(1, long, "xx"), (2, long + " end", "xx"), (3, "short the text", "yy"), (3, None, None)], "doc_id long, text string, lang string").withColumn("_answer", F.lit(1)).withColumn("_found", F.lit(2)).withColumn("_digest", F.lit(3))
    assert {r["doc_id"]: r["component_id"] for r in neardup.classify(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r["doc_id"] for r in neardup.deduplicate(df, shingle=5).collect()) == [1, 3, 3]
    model = langid.train(df, F.col("doc_id"))
    got = langid.predict(df, model)
    assert got.columns == [*df.columns, "lang_pred", "score"] and [r["lang_pred"] for r in got.where("doc_id = 1").collect()] == ["xx"]
    none = df.where("false")
    assert langid.predict(none, langid.train(none, F.col("doc_id"))).count() == 0 and neardup.deduplicate(none).count() == 0
    items = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(30)))], "item_id long, text string")
    for size in (1 << 20, 0):
        found = decontam.decontaminate(df, items, block_bytes=size)
        assert found.columns == [*df.columns, "n_words", "hit_spans", "hit_items"] and sorted((r["doc_id"], len(r["hit_spans"])) for r in found.collect()) == [(1, 30), (2, 30), (3, 0), (3, 0)]


def test_a_hot_family_meets_only_where_links_can_be(spark, monkeypatch):
    """One large group of near copies beside texts that share much of it: blocks of one component never meet."""
    monkeypatch.setattr(neardup.links, "__defaults__", (4, 16))
    rng = random.Random(12)
    base = prose(rng, 60).split()
    rows = []
    for i in range(220):
        w = list(base)
        if i % 11 == 0:
            w[10:30] = prose(rng, 20).split()
        else:
            w[rng.randrange(60)] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classify(df).collect()}
    assert got == brute_groups(rows)


def test_meetings_of_long_sets_hold_little_beside_them(monkeypatch):
    """Two blocks of 40 sets of 20,000 elements: the links are those of all pairs, the memory far less than the sets."""
    monkeypatch.setattr(neardup, "SLICE", 1 << 16, raising=False)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    sets = []
    for _ in range(80):
        own = base.copy()
        n = rng.integers(1000, 3000)
        own[rng.choice(20000, n, replace=False)] = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        sets.append(np.unique(own))
    rows = pa.table({"block": pa.array([i % 2 for i in range(80)], pa.int64()), "id": pa.array(range(80), pa.int64()), "comp": pa.array(range(80), pa.int64()), "elements": pa.array([s.tobytes() for s in sets], pa.binary())})
    run = neardup._across(80)
    tracemalloc.start()
    found = run((pa.scalar(0), pa.scalar(1)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.7 * sum(s.nbytes for s in sets)

    def groups(links):
        root = list(range(80))
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
        return root

    want = groups((a, b) for a in range(0, 80, 2) for b in range(1, 80, 2) if neardup._alike(sets[a], sets[b], 80))
    assert groups(zip(found["a"].to_pylist(), found["b"].to_pylist())) == want and 1 < len(set(want)) < 80


def test_blocks_are_bounded_by_their_elements(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ELEMENTS", 1000, raising=False)
    large = spark.createDataFrame([(i, 0, i) for i in range(64)], "id long, hub long, comp long")
    sets = spark.createDataFrame([(i, bytes(800)) for i in range(64)], "id long, elements binary")
    met = neardup._met(large, sets, 80, 1024).groupBy("first", "second", "block").agg(F.sum(F.octet_length("elements") / 8).alias("n")).collect()
    assert max(r["n"] for r in met) <= 2000
    # every two blocks meet, and each meets itself
    blocks = {r["block"] for r in met}
    assert len({(r["first"], r["second"]) for r in met}) >= len(blocks) * (len(blocks) + 1) // 2


@pytest.mark.parametrize("elements", [1, 200])
def test_near_duplicates_in_blocks_of_few_elements(spark, monkeypatch, elements):
    monkeypatch.setattr(neardup.links, "__defaults__", (2, 1024))
    monkeypatch.setattr(neardup, "ELEMENTS", elements, raising=False)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_arrow_batches_of_few_bytes(spark):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    long = spark.range(300).coalesce(1).select(F.repeat(F.lit("x"), 10000).alias("text"))
    most = shared.stored(long.mapInArrow(count, "n long"), "counts", batch_bytes=1 << 20).agg(F.max("n"), F.sum("n")).first()
    assert most[0] < 120 and most[1] == 300 and spark.conf.get(key) == before
