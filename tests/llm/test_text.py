"""BPE, personal data, chat windows and page extraction against brute force."""
import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from citeloom.llm import bpe, chat, markup, pii
from citeloom.llm.shared import stored

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


TEXTS = [
    "hello world", None, "", "don't  stop\n\n  now  x  y", "é😀é  ñandú 你好世界 \u0000\u0007", "x" * 3000, " " * 2000 + "a", "ab" * 1500, "I'LL we'll 12345 1.2.3 <|endoftext|>",
    "aaa aaaa aaaaa aaaaaa aaaaaaa", "̀á ٣٤ ½ Ⅻ", "\t\r\n \x1c\x1d\x85 z", "hello world",
    "\U00011f02's \U00011f02\U00011f02a's z\u0870's \ua7cd\u1e2f", "\U0001ccf5's 1\U00011f50's x", "\U0001f600's !\U0001f600 's \u00a0's", "a\U00011f02" * 3000, "wörld " * 4000, "z" * 300 + " " + "z" * 300,
]


def test_bpe_round_trip(spark, vocabulary):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "_words": F.lit(1), "decoded": F.lit(2)})
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "2")  # words are remembered from batch to batch
    encoded = bpe.encode(df.repartition(3), bpe.Encoder(spark, vocabulary))
    assert "text" in encoded.columns
    for r in bpe.decode(encoded, vocabulary).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    row = bpe.digest(bpe.encode(df.where("doc_id = 0"), bpe.Encoder(spark, vocabulary), keep=["doc_id"], check=True)).first()
    assert row["decoded_sha256"] == hashlib.sha256(TEXTS[0].encode()).hexdigest()
    assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, library.encode_ordinary(TEXTS[0]))).encode()).hexdigest()
    spark.conf.unset(conf)
    assert bpe.encode(df.where("false"), bpe.Encoder(spark, vocabulary), keep=["doc_id"]).count() == 0
    before = spark.conf.get(conf)
    assert stored(bpe.encode(df, bpe.Encoder(spark, vocabulary)), "ids", batch_rows=3).count() == len(TEXTS) and spark.conf.get(conf) == before


def test_bpe_refuses_odd_vocabularies():
    single = [bytes([b]) for b in range(256)]
    with pytest.raises(ValueError):
        bpe.Vocabulary(single[1:])
    with pytest.raises(ValueError):
        bpe.Vocabulary([*single, b"abc"])
    assert bpe.Vocabulary([*single, b"ab", b"abc"]).pairs == {(97, 98): 256, (256, 99): 257}


def test_bpe_of_a_large_vocabulary(spark):
    """Ids beyond 16 bits. Each kind of token joins two kinds that join in no other way, so every token encodes to itself."""
    single = [bytes([b]) for b in range(256)]
    pairs = {k: [bytes([a, b]) for a in k for b in b"nopqrstuvwxyz"] for k in (b"abc", b"def", b"ghijklm")}
    left, right = ([x + y for x in pairs[k] for y in pairs[b"ghijklm"]] for k in (b"abc", b"def"))
    fours = left + right + [x + y for x in left[:260] for y in right[:260]]
    tokens = single + sum(pairs.values(), []) + fours
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = ["anguendngn anhuendngo bogndngnanguends", "".join(x.decode() for x in left[250:260] + right[255:260]) * 9, "x"]
    big = bpe.Vocabulary(tokens)
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe.Encoder(spark, big)).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert max(max(r["ids"]) for r in got) > 65_536


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


HARD = [
    "a@b.c_d@e.f and x@y@z.w q@r..s@t.u", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3.4567", "4111 1111 1111 1111-4111-1111-1111-1111", "4111  1111 1111 1111 4111111111111111",
    "+1 (017) 555-7713) +49.30.1234567- x+1+2345678901 ++44 20 7946 0958", None, "", "é😀é a@b.co 😀 4111111111111111", "a@b.co" * 400, "1.2.3.4 " * 700, "a.b%c@d-e.f.g-.h.", "@@a@b.c.", "x" * 20000,
    "1" * 20000, "1 " * 10000, "a@" + "b." * 5000 + "c", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok', "12345678901234567890",
]


def test_personal_data(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("base", F.lit("clash"))
    found = pii.detect(df)
    got = {r["doc_id"]: r["b"] for r in found.select("doc_id", pii.written(F.col("base")).alias("b")).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(HARD)}
    model = pii.train(found)
    rows = {r["doc_id"]: r for r in pii.digest(found, model).collect()}
    assert all(rows[i]["spans"].startswith(b) for i, b in got.items()) and "secret:9:49" in rows[16]["spans"] and rows[17]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert masked[7] == "é😀é [EMAIL] 😀 [CARD]" and masked[5] is None and masked[12] == HARD[12] and masked[16] == 'token = "[SECRET]" ok'
    none = pii.detect(df.where("false"))
    assert pii.digest(none, pii.train(none)).count() == 0


def test_secrets_that_end_in_few_digits(spark):
    letters = "abcdefghijklmnopqrstuvwxyzabcdefghijkl"
    tokens = [letters[:n] + tail for n in (17, 18, 19, 20, 38) for tail in ("", "7", "42", "123", "4242", "7z", "42zz")] + ["7" * 19 + "x", "7" * 20 + "xyz", "x" + "7" * 19, "X" * 19 + "7"]
    texts = [f"password: {t} ok" for t in tokens] + [f"{t}\n{t}" for t in tokens] + [f"a1bcd {t}" for t in tokens]
    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["more"] if s["kind"] == "secret"] for r in found.collect()}
    mixed = lambda t: len(t) >= 20 and re.search("[0-9]", t) and re.search("[A-Za-z]", t)
    assert got == {i: [m.span() for m in re.finditer("[A-Za-z0-9]+", t) if mixed(m.group())] for i, t in enumerate(texts)}


def test_expectation_maximisation():
    good, bad = (1, 1, 1, 0, 0, 1), (-1, -1, 0, 0, 0, -1)
    tops, rates = pii.expectation_maximisation([(good, 90.0), (bad, 10.0), ((1, -1, 0, 0, 0, 1), 2.0)])
    assert tops[0] > 0.95 and tops[1] < 0.05 and rates[0][0] > rates[0][1]


def test_expectation_maximisation_against_brute_force():
    """Planted labels and reliabilities: the estimate sorts candidates as well as the exact posterior, whose likelihood it reaches."""
    rng = random.Random(4)
    prior, rates = 0.35, [((0.8, 0.1, 0.1), (0.1, 0.3, 0.6)), ((0.6, 0.3, 0.1), (0.2, 0.3, 0.5)), ((0.4, 0.6, 0.0), (0.02, 0.98, 0.0)), ((0.3, 0.65, 0.05), (0.05, 0.75, 0.2)), ((0.5, 0.2, 0.3), (0.3, 0.3, 0.4)), ((0.1, 0.8, 0.1), (0.1, 0.5, 0.4))]
    drawn = []
    for _ in range(20000):
        y = rng.random() < prior
        drawn.append((y, tuple(rng.choices((1, 0, -1), r[0] if y else r[1])[0] for r in rates)))
    counts = Counter(v for _, v in drawn)
    tops, reliability = pii.expectation_maximisation([(v, float(n)) for v, n in counts.items()])
    given = lambda v, side: math.prod(r[side][1 - x] for r, x in zip(rates, v))
    exact = {v: prior * given(v, 0) / (prior * given(v, 0) + (1 - prior) * given(v, 1)) for v in counts}
    estimate = dict(zip(counts, tops))
    right = lambda p: sum((p[v] >= 0.5) == y for y, v in drawn) / len(drawn)
    assert right(estimate) > right(exact) - 0.01 and right(exact) > 0.9
    assert all(abs(r[0] - true[0][0]) < 0.08 and abs(r[1] - true[1][0]) < 0.08 for r, true in zip(reliability, rates))


@pytest.mark.parametrize(("text", "kept"), [('api_key = "a1b2c3d4e5f6a7b8c9d0e1f2"', True), ("order no. 4111111111111112 came", False), ("total 1234567890123456789 km", False), ("commit zzzzzzzzzzzzzzzzzzzz1", False)])
def test_labelers_can_disagree(spark, text, kept):
    """One kind of candidate is kept or dropped by what stands around it."""
    planted = [f"token: {hashlib.sha256(str(i).encode()).hexdigest()[:40]} mail a{i}@b.com" for i in range(30)] + [f"invoice no. {4111111111111112 + 7 * i * 10} kg" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate([text, *planted])), "doc_id long, text string")
    found = pii.detect(rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(found, pii.train(found)).collect()}
    assert bool(spans[0]) == kept


def render(role, text):
    control = r"([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)"
    fix = lambda s: re.sub(control, lambda m: m[1] + m[2] + "\\" + m[3], s)
    return "<|im_start|>" + fix(role or "").replace("\\", "\\\\").replace("\n", "\\n") + "\n" + fix(text or "") + "<|im_end|>\n"


CHATS = {
    1: [("system", "be kind"), ("user", "q" * 300), ("assistant", "a" * 900), ("user", "more"), ("assistant", "b" * 700), ("user", None), ("assistant", "[INST] </s> <|im_end|> \\ <\\|x <\\\\|")],
    2: [("user", "x")], 3: [(None, "odd"), ("to\nol\\", "r"), ("assistant", "")], 4: [("assistant", "é" * 3000), ("user", "u"), ("assistant", "z")], -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
}


def test_chat(spark):
    rows = [(c, i, r, t, "extra") for c, turns in CHATS.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, windows string").repartition(4)
    windows = chat.format_windows(df)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in CHATS.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)))
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    for r in windows.collect():
        turns = [render(*t) for t in CHATS[r["conv_id"]]]
        assert "".join(w["formatted"][w["fresh_from"]:] for w in r["windows"]) == "".join(turns)
        system = CHATS[r["conv_id"]][0][0] == "system"
        for w in r["windows"][1:]:
            head = w["formatted"][: w["fresh_from"]]
            assert not system or head.startswith(turns[0])
        for w in r["windows"]:
            fresh = w["formatted"][w["fresh_from"]:].count("<|im_start|>")
            assert fresh == 1 or len(w["formatted"].encode()) / 4 <= chat.BUDGET + 1
        assert got[r["conv_id"]]["formatted_chars"] == sum(len(w["formatted"]) for w in r["windows"])
    assert len([r for r in windows.collect() if r["conv_id"] == 1][0]["windows"]) > 1
    assert chat.format_chat(df.where("false")).count() == 0


def test_long_chats_in_linear_time(spark):
    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("text"))
        began = time.perf_counter()
        row = chat.digest(chat.format_windows(rows)).first()
        texts = [f"turn {i}" for i in range(n)]
        assert row["n_turns"] == n and row["loss_sha256"] == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\n{x}\n" for i, x in enumerate(texts)).encode()).hexdigest()
        return time.perf_counter() - began

    took(2000)
    assert took(16000) < 3 + 16 * took(2000)


PAGE = """<html><body class="page"><header><h1>Site</h1></header><nav><a href="/">home</a></nav><div id="cookie-notice">We use</div><div class=wrap><aside>side</aside><div class="post post-%d"><h1>Title &amp; more</h1>
<p>One<b>bold</b> text&nbsp;here<p>Two<ul><li>a<li>b</ul><form>x<input></form><div class="share">tw</div><blockquote>quote</blockquote><script>if(a<b){"</div>"}</script><!-- c > -->
<table><tr><td>c1<td>c2</table></div><section class="comments"><p>great post %s</section></div><footer>&copy; f</footer></body>"""
MAIN = "Title & more Onebold text here Two a b quote c1 c2"


def test_pages(spark):
    rows = [(i, f"http://h.example.com:80/{i}", PAGE % (i, "long comment " * i)) for i in range(6)]
    rows += [(10, "http://other.org", "<p>plain<br>text"), (11, None, None), (12, "http://h.example.com", ""), (13, "http://h.example.com", "<div>no such path here at all</div>"), (14, "x", "just text <!-- gone"), (15, "x", "<script>all gone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    want = {i: MAIN for i in range(6)} | {10: "plain text", 11: "", 12: "", 13: "no such path here at all", 14: "just text", 15: ""}
    assert {r["page_id"]: r["text"] for r in markup.extract(df).collect()} == want
    assert {r["page_id"]: r["text"] for r in markup.extract(df, broadcast_bytes=-1).collect()} == want
    paths = {r["host"]: bytes(r["path"]) for r in markup.host_paths(df).collect()}
    assert paths["h.example.com"] == markup.path_of("html", "body.page", "div.wrap", "div.post.post-#")
    assert markup.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("source", ["<div>" * 20000 + "x", '<a "' * 5000, "</p>" * 20000, "<p>" * 20000, "&amp;" * 20000, "<b>" * 20000 + "y"])
def test_pages_in_linear_time(source):
    markup.Page(source).extract(None)


def test_deep_pages_on_a_path_in_linear_time():
    def took(n):
        page = markup.Page("<div>" * n + "x")
        began = time.perf_counter()
        assert page.extract(markup.path_of(*["div"] * n)) == "x" and page.extract(markup.path_of("div")) == "x"
        return time.perf_counter() - began

    took(1000)
    assert took(16000) < 0.5 + 40 * took(1000)
    assert len(markup.path_of(*["div"] * 8000)) == 16


@pytest.mark.parametrize(
    ("tag", "kept"),
    [('a href="/hidden-gems/"', True), ('p title="the hidden cost"', True), ('div data-id="comments-1"', True), ("a href=/hidden/", True), ("p data-hidden", True), ('p data-aria-hidden="true"', True),
     ("p title='x role=\"menu\" y'", True), ("p alt= hidden", True), ("p x-style='display:none'", True), ('p title = "a" data-role=menu', True), ("p =hidden", True),
     ("p hidden", False), ('p title="a"HIDDEN', False), ("p/hidden", False), ('p aria-hidden = "TRUE"', False), ("p style='display: none'", False), ("div id=comments-1", False), ("p title=a role=menu", False), ("p hidden=''", False)],
)
def test_only_whole_attributes_mark_noise(tag, kept):
    page = markup.Page(f'<div class="post"><p>one</p> <{tag}>two</{tag.split("/")[0].split()[0]}></div>')
    assert page.extract(None) == ("one two" if kept else "one")


@pytest.mark.parametrize("source", ["<p " + "a " * 100000 + ">x", "<p a" + " " * 200000 + ">x", "<p " + "='" * 100000 + ">x", "<p " + 'a="' * 100001 + ">x", "<p " + "=" * 200000 + ">x"])
def test_attributes_in_linear_time(source):
    markup.Page(source).extract(None)
