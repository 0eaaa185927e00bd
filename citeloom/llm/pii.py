"""Personal data: base patterns, and more spans by weak supervision. DataFrame functions only.

Base spans are the leftmost matches of four patterns that pass their checks. Further candidates are long tokens of
letters and digits (``secret``), numbers of 13 to 19 digits that fail the card check (``number``) and phone numbers
without a plus sign (``contact``). Regex, gazetteer and context labelers vote on every candidate, base ones included.
Expectation-maximisation over the counted vote patterns (their number is bounded by the labelers, not by the data)
estimates how reliable each labeler is and so a probability for each pattern; a logistic regression learns these from
votes, length and whether there are letters, and decides which further candidates are kept. Base spans always stay, and a further candidate
that overlaps one is dropped.

Places come from splitting a text at its matches: a match begins after the pieces and matches before it. All
repetitions in the patterns are possessive or of single characters, so that time and stack stay in proportion to the
text; this does not change what they match (nothing after a repetition could use what it gives back).

Null texts are empty. Repeated rows are answered each on its own. Columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

LOCAL = "[A-Za-z0-9._%+-]"
#: Kind, pattern, and what a text must hold for the pattern to be worth trying: every match of the pattern holds it.
BASE = (
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9]){12,}+", r"[0-9][0-9 -]{11,}[0-9]"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
)
MORE = (
    ("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+", r"(?<![A-Za-z0-9])[A-Za-z0-9]{20}"),
    ("contact", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
)
#: Gazetteers: words that announce personal data, words that announce counts and references, country codes of phone
#: numbers, endings of domains, and values that are nobody's.
ANNOUNCING = "token|key|secret|password|passwd|pwd|api|auth|bearer|tel|telephone|phone|fax|mobile|call|mail|email|contact|card|visa|iban|account|ip|host|user|login|pin"
COUNTING = "order|invoice|item|part|page|figure|fig|table|section|version|isbn|issn|doi|no|nr|number|ref|reference|commit|checksum|sha|md5|build|total|sum"
COUNTRIES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ENDINGS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|uk|us|ch|at|be|pl|se|ca|au|jp|cn|in|br"
NOBODYS = r"^(?:0\.0\.0\.0|127\..*|255\..*|(.)\1*|(?:0123456789)+|1234567890.*)$|noreply|no-reply"
LABELERS = 6
_STEP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, 1, 64).substr(F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _matches(text: Column, kind: str, pattern: str, hint: str, context: int = 24) -> Column:
    """Array of {kind, start, end, surface, before, after} of a pattern's matches, in order."""
    empty = F.lit(None).cast("array<struct<kind:string,start:long,end:long,surface:string,before:string,after:string>>")

    def spans(s: Column) -> Column:
        pieces, found = s["pieces"], s["found"]
        lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("long"))
        total = lambda a, first, n: F.aggregate(F.slice(a, first + 1, n), F.lit(0).cast("long"), lambda x, y: x + y)

        def placed(t: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(t["l"]) / _STEP).cast("int")), lambda b: total(t["l"], b * _STEP, F.lit(_STEP)))

            def of(u: Column) -> Column:
                before = F.transform(u["s"], lambda _, b: total(u["s"], F.lit(0), b))

                def one(v: Column) -> Column:
                    def span(m: Column, i: Column) -> Column:
                        block = F.floor(i / _STEP).cast("int")
                        start = F.get(v["b"], block) + total(u["l"], block * _STEP, i % _STEP) + F.length(F.get(pieces, i))
                        after = F.substring(F.get(pieces, i + 1), 1, 12)
                        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("surface"), F.right(F.get(pieces, i), F.lit(context)).alias("before"), after.alias("after"))

                    return F.transform(found, span)

                return let(F.struct(before.alias("b")), one)

            return let(F.struct(sums.alias("s"), t["l"].alias("l")), of)

        return let(F.struct(lengths.alias("l")), placed)

    value = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    worth = text.contains(hint) if hint == "@" else text.rlike(hint)
    return F.coalesce(F.when(worth, let(value, lambda s: F.when(F.size(s["found"]) > 0, spans(s)))), F.coalesce(empty, F.array().cast("array<struct<kind:string,start:long,end:long,surface:string,before:string,after:string>>")))


def candidates(text: Column) -> Column:
    """{base, more}: base spans by kind as listed and start, and the further candidates that overlap none of them."""
    text = F.coalesce(text, F.lit(""))
    found = F.struct(*(_matches(text, *x).alias(x[0]) for x in (*BASE, *MORE)))

    def checked(f: Column) -> Column:
        sized = lambda s, low, high: F.length(_digits(s["surface"])).between(low, high)
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        cards = F.filter(f["card"], lambda s: sized(s, 13, 19))
        passes = lambda s: luhn(_digits(s["surface"]))
        base = F.concat(
            f["email"], F.filter(f["ip"], lambda s: s["surface"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")),
            F.filter(cards, passes), F.filter(f["phone"], lambda s: sized(s, 9, 15)),
        )
        numbers = F.transform(F.filter(cards, lambda s: ~passes(s)), lambda s: s.withField("kind", F.lit("number")))
        return F.struct(base.alias("base"), F.concat(f["secret"], numbers, f["contact"]).alias("more"))

    def apart(c: Column) -> Column:
        free = F.filter(c["more"], lambda m: ~F.exists(c["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.struct(c["base"].alias("base"), F.when(F.size(c["more"]) > 0, free).otherwise(c["more"]).alias("more"))

    return let(let(found, checked), apart)


def votes(s: Column) -> list[Column]:
    """The labelers: 1 for personal data, -1 against, 0 for no opinion. None knows the kind; they look at the text and around it."""
    surface, before, after = s["surface"], s["before"], s["after"]
    pick = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(surface, "")))
    digits = _digits(surface)
    numeric, payable = ~surface.rlike("[A-Za-z@]"), F.length(digits).between(13, 19)
    word = lambda words: before.rlike(rf"(?i)(?<![a-z])(?:{words})[^A-Za-z0-9]{{0,6}}$")
    return [
        # regex: a strict form, or nothing but a run of digits
        pick(surface.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[^@]+@[a-z0-9.-]+|\+[0-9 ().-]+|[0-9]+(?:\.[0-9]+){3}|[0-9]{4}(?:[ -][0-9]{4}){2,3}.*)$"), surface.rlike("^(?:[0-9]+|[a-z]+[0-9]{1,3})$")),
        # checksum of numbers that could be a card's, variety of characters of anything else
        F.when(numeric & payable, F.when(luhn(digits), 1).otherwise(-1)).when(~numeric & (distinct >= 10), 1).when(distinct <= 4, -1).otherwise(0),
        # gazetteer: words that announce it, or announce something else
        pick(word(ANNOUNCING), word(COUNTING)),
        # gazetteer: endings of domains and country codes, or values that are nobody's
        F.when(surface.rlike(NOBODYS), -1).when(surface.rlike(rf"(?i)@.*\.(?:{ENDINGS})$|^\+(?:{COUNTRIES})"), 1).otherwise(0),
        # context: between quotes or after a sign of assignment; glued to other characters
        pick(before.rlike("[=:\"'(<\\[]\\s?[\"']?$"), before.rlike("[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")),
        # context: a person's words around, or an amount
        pick(before.rlike(r"(?i)(?:\b(?:my|your|his|her|write|reach|at|to|from|is)\s+)$"), after.rlike("^ ?(?:%|€|\\$|km|kg|mm|MB|GB)") | before.rlike("[$€£#] ?$")),
    ]


@dataclass
class Model:
    """Weights of the span classifier: of all, of letters beside digits, of each labeler's yes and no, and of length."""

    bias: float
    mixed: float
    yes: list[float]
    no: list[float]
    length: float
    reliability: list[tuple[float, float]]

    def probability(self, s: Column) -> Column:
        z = F.lit(self.bias) + F.when(_mixed(s), self.mixed).otherwise(0.0)
        for v, yes, no in zip(votes(s), self.yes, self.no):
            z = z + F.when(v == 1, yes).when(v == -1, no).otherwise(0.0)
        return 1 / (1 + F.exp(-(z + self.length * _long(s))))


def _mixed(s: Column) -> Column:
    return s["surface"].rlike("[A-Za-z]")


def _long(s: Column) -> Column:
    return F.least(F.floor(F.length(s["surface"]) / 8), F.lit(5)).cast("double")


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 40) -> tuple[list[float], list[tuple[float, float]]]:
    """Probability of each vote pattern, and each labeler's chance to vote yes given personal data and given none."""
    tops = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in patterns]
    rates = [[{}, {}] for _ in range(LABELERS)]
    for _ in range(rounds):
        mass = [1.0 + sum(n * (p if y else 1 - p) for (_, n), p in zip(patterns, tops)) for y in (0, 1)]
        for k in range(LABELERS):
            for y in (0, 1):
                rates[k][y] = {v: (1.0 / 3 + sum(n * (p if y else 1 - p) for (vs, n), p in zip(patterns, tops) if vs[k] == v)) / mass[y] for v in (-1, 0, 1)}
        tops = []
        for vs, _ in patterns:
            odds = log(mass[1] / mass[0]) + sum(log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(vs))
            tops.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
    return tops, [(r[1].get(1, 0.0), r[0].get(1, 0.0)) for r in rates]


def _logistic(rows: list[tuple[list[float], float, float]], rounds: int = 300, ridge: float = 0.02) -> list[float]:
    """Weights by gradient steps over (features, soft label, weight), the weights summing to one."""
    w = [0.0] * len(rows[0][0])
    for step in range(rounds):
        grad = [ridge * x for x in w]
        for f, y, n in rows:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f))))))
            for i, x in enumerate(f):
                if x:
                    grad[i] += n * (p - y) * x
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def train(found: DataFrame) -> Model:
    """The model from the counted votes on all candidates of stored rows with ``base`` and ``more``."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    voted = spans.select(_mixed(F.col("s")).alias("mixed"), _long(F.col("s")).alias("long"), *(v.alias(f"v{i}") for i, v in enumerate(votes(F.col("s")))))
    names = [f"v{i}" for i in range(LABELERS)]
    counted = [((r["mixed"], r["long"], tuple(r[v] for v in names)), r["n"]) for r in voted.groupBy("mixed", "long", *names).agg(F.count("*").alias("n")).collect()]
    counted.sort()
    if not counted:
        return Model(0.0, 0.0, [0.0] * LABELERS, [0.0] * LABELERS, 0.0, [])
    patterns: dict[tuple[int, ...], float] = {}
    for (_, _, vs), n in counted:
        patterns[vs] = patterns.get(vs, 0.0) + n
    tops, reliability = expectation_maximisation(list(patterns.items()))
    soft = dict(zip(patterns, tops))
    total = sum(n for _, n in counted)
    rows = [([1.0, float(mixed), *(float(v == 1) for v in vs), *(float(v == -1) for v in vs), size / 5], soft[vs], n / total) for (mixed, size, vs), n in counted]
    w = _logistic(rows)
    return Model(w[0], w[1], w[2 : 2 + LABELERS], w[2 + LABELERS : 2 + 2 * LABELERS], w[-1] / 5, reliability)


def detect(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without the text, with ``base`` and ``more`` candidates, stored."""
    kept = [F.col(c) for c in documents.columns if c not in (text, "base", "more")]
    found = documents.select(*kept, candidates(F.col(text)).alias("_c"))
    return stored(found.select(*kept, F.col("_c.base").alias("base"), F.col("_c.more").alias("more")), "pii")


def accepted(model: Model, base: Column, more: Column) -> Column:
    """All spans: the base ones, then the further ones that the classifier keeps, by kind and start."""
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    kept = F.filter(more, lambda s: model.probability(s) >= 0.5) if model.reliability else F.filter(more, lambda s: F.lit(False))
    return F.concat(F.transform(base, slim), F.transform(F.when(F.size(more) > 0, kept).otherwise(more), slim))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, model: Model) -> DataFrame:
    """The contract's row for each document of ``detect``."""
    base = F.col("base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind, _, _ in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(accepted(model, base, F.col("more"))).alias("spans"))


def redact(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with each span in the text replaced by its kind in brackets; overlapping spans by that of the first."""
    def cut(s: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            inside = x["start"] < a["at"]
            piece = F.concat(s["t"].substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))
            return F.struct(F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

        ordered = F.array_sort(F.transform(s["s"], lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["end"].alias("end"), x["kind"].alias("kind"))))
        first = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
        return F.aggregate(ordered, first, step, lambda a: F.concat(F.array_join(a["out"], ""), s["t"].substr((a["at"] + 1).cast("int"), F.length(s["t"]))))

    def masked(c: Column) -> Column:
        spans = F.struct(F.col(text).alias("t"), accepted(model, c["base"], c["more"]).alias("s"))
        return F.when(F.size(c["base"]) + F.size(c["more"]) == 0, F.col(text)).otherwise(let(spans, cut))

    out = F.when(F.col(text).isNull(), F.col(text)).otherwise(let(candidates(F.col(text)), masked))
    return documents.withColumn(text, out)
