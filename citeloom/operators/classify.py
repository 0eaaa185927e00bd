"""Sentence classification through an injected model: batches, prompts, reading, checking and applying its answers."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
BATCH = 10
INTENTS = ("BACKGROUND", "METHOD", "RESULT")
ANSWER = "array<struct<sentence_index:int,citation_worthy:boolean,citation_intent:string,confidence:double>>"
SYSTEM_PROMPT = (
    "You label sentences of research papers. Say for every numbered sentence whether a reader would expect a reference (citation_worthy), "
    "whether it gives context (BACKGROUND), describes a procedure (METHOD), reports a finding (RESULT) or does none of these (OTHER), and how sure you are "
    "from 0 to 1. Answer with a JSON array of objects with the fields sentence_index (from 0), citation_worthy, citation_intent and confidence."
)


def batches(records: DataFrame, size: int = BATCH) -> DataFrame:
    """paper_id, batch, index in the batch, and the sentence: batches in order of the sentences of each paper."""
    w = Window.partitionBy("paper_id").orderBy("section_ord", "sent_ord")
    numbered = records.withColumn("_n", F.row_number().over(w) - 1)
    return numbered.withColumn("batch", F.floor(F.col("_n") / size)).withColumn("sentence_index", (F.col("_n") % size).cast("int")).drop("_n")


def prompts(batched: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, batch, n and prompt: title, abstract and the numbered sentences."""
    lines = F.array_sort(F.collect_list(F.struct("sentence_index", "text")))
    body = F.array_join(F.transform(lines, lambda s: F.concat(s["sentence_index"].cast("string"), F.lit(". "), s["text"])), "\n")
    grouped = batched.groupBy("paper_id", "batch").agg(F.count("*").cast("int").alias("n"), body.alias("lines"))
    head = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce("abstract", F.lit("")), F.lit("\n\nSentences:\n"), F.col("lines"))
    return grouped.join(papers.select("paper_id", "title", "abstract"), "paper_id", "left").select("paper_id", "batch", "n", head.alias("prompt"))


def unfenced(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def parsed(answer: Column) -> Column:
    """The array of an answer: fences removed, else from the first [ to the last ]; null where there is none."""
    plain = unfenced(answer)
    inner = F.regexp_extract(plain, r"\[[\s\S]*\]", 0)
    read = lambda c: F.when(c.startswith("[") & F.try_parse_json(c).isNotNull(), F.from_json(c, ANSWER))
    return F.coalesce(read(plain), read(inner))


def problem(answer: Column, items: Column, n: Column) -> Column:
    """What is wrong with an answer to n sentences; null if nothing is."""
    indices = F.transform(items, lambda x: x["sentence_index"])
    truncated = unfenced(answer).contains("[") & ~unfenced(answer).contains("]")
    return (
        F.when(items.isNull() & truncated, "truncated").when(items.isNull(), "not a JSON array").when(F.size(items) != n, "wrong count")
        .when(F.exists(indices, lambda i: i.isNull()), "invalid index").when(F.exists(indices, lambda i: (i < 0) | (i >= n)), "index out of range")
        .when(F.size(F.array_distinct(indices)) < F.size(indices), "duplicate index")
        .when(F.size(F.array_except(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), indices)) > 0, "missing index")
    )


def applied(items: DataFrame) -> DataFrame:
    """citation_worthy, citation_intent and worthiness_score from rows with an answer's fields; absent ones have defaults."""
    worthy = F.coalesce("citation_worthy", F.lit(False))
    sure = F.coalesce("confidence", F.lit(0.5))
    intent = F.when(F.col("citation_intent").isin(*INTENTS), F.col("citation_intent"))
    return items.withColumns({"citation_worthy": worthy, "citation_intent": intent, "worthiness_score": F.when(worthy, sure).otherwise(1 - sure)}).drop("confidence")


def classify(records: DataFrame, papers: DataFrame, client: Callable[[str, str], str], size: int = BATCH, pause: float = 0.0) -> DataFrame:
    """``records`` with the model's labels. ``client``: (system prompt, prompt) -> answer text, run in the executors.

    A batch whose answer is not usable is halved and asked again; a single sentence that fails raises. ``pause``:
    seconds between a task's calls.
    """
    batched = batches(records, size)

    asked_before = []  # of this task: no pause before its first call, nor after its last

    def ask(rows: pd.DataFrame, title: str, abstract: str) -> list[dict]:
        lines = "\n".join(f"{i}. {t}" for i, t in enumerate(rows["text"]))
        if pause and asked_before:
            time.sleep(pause)
        asked_before.append(True)
        answer = completed(client, SYSTEM_PROMPT, f"Title: {title}\nAbstract: {abstract}\n\nSentences:\n{lines}")
        try:
            return read_answer(answer, len(rows))
        except ValueError:
            if len(rows) == 1:
                raise
            half = len(rows) // 2
            later = ask(rows.iloc[half:], title, abstract)
            return ask(rows.iloc[:half], title, abstract) + [x | {"sentence_index": x["sentence_index"] + half} for x in later]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sentence_index")
        found = {x["sentence_index"]: x for x in ask(rows, rows["title"].iloc[0] or "", rows["abstract"].iloc[0] or "")}
        out = rows[["paper_id", "section_ord", "sent_ord"]].copy()
        for name, default in (("citation_worthy", False), ("citation_intent", "OTHER"), ("confidence", 0.5)):
            out[name] = [found[i].get(name, default) for i in range(len(rows))]
        return out

    kinds = dict(records.dtypes)
    schema = f"paper_id {kinds['paper_id']}, section_ord {kinds['section_ord']}, sent_ord {kinds['sent_ord']}, citation_worthy boolean, citation_intent string, confidence double"
    asked = batched.join(papers.select("paper_id", "title", "abstract"), "paper_id", "left").select("paper_id", "section_ord", "sent_ord", "batch", "sentence_index", "text", "title", "abstract")
    return records.join(applied(asked.groupBy("paper_id", "batch").applyInPandas(run, schema)), ["paper_id", "section_ord", "sent_ord"], "left")


def read_answer(answer: str, n: int) -> list[dict]:
    """The answer's items, each of n indices once; ValueError otherwise."""
    text = answer.strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("json").strip().removesuffix("```").rstrip()
    try:
        items = json.loads(text)
    except json.JSONDecodeError:
        first, last = text.find("["), text.rfind("]")
        if first < 0 or last < first:
            raise ValueError("truncated array" if first >= 0 else "no JSON in the answer") from None
        items = json.loads(text[first : last + 1])  # JSONDecodeError is a ValueError
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        raise ValueError("not an array of objects")
    indices = [x.get("sentence_index") for x in items]
    if not all(isinstance(i, int) and not isinstance(i, bool) for i in indices):
        raise ValueError("an index is no integer")
    if sorted(indices) != list(range(n)):
        raise ValueError("not one item for each sentence")
    return items


class EmptyAnswer(RuntimeError):
    """The model answered with nothing."""


def completed(client: Callable[[str, str], str], system: str, prompt: str) -> str:
    """The client's answer; what it raises is logged and raised again, and an empty answer is an error."""
    try:
        answer = client(system, prompt)
        if not answer:
            raise EmptyAnswer("empty answer of the model")
        return answer
    except Exception:
        log.exception("the model's call failed")
        raise


def to_classify(examples: DataFrame) -> DataFrame:
    """Sentence records of labelled examples (example_id, text, section, citation_worthy), without their gold labels.

    A sentence whose worthiness isn't known counts as cited. All are one paper's, in order of ``ordinal`` if there is one, else of the id.
    """
    order = Window.orderBy(*[c for c in ("ordinal", "example_id") if c in examples.columns])
    return examples.select(
        "example_id", F.lit("evaluation").alias("paper_id"), F.lit(1).alias("section_ord"), F.coalesce(F.nullif("section", F.lit("")), F.lit("UNKNOWN")).alias("section"),
        F.row_number().over(order).alias("sent_ord"), "text", F.lit(0.5).alias("position_in_section"), F.coalesce("citation_worthy", F.lit(True)).alias("has_citation"),
    )


def labelled_both(examples: DataFrame, most: int | None = 100) -> DataFrame:
    """The first ``most`` examples, in order of ``ordinal`` (of the id without one), that have an intent and a worthiness."""
    both = examples.where(F.col("citation_intent").isNotNull() & F.col("citation_worthy").isNotNull())
    return both if most is None else both.orderBy("ordinal" if "ordinal" in examples.columns else "example_id").limit(most)


def evaluate(examples: DataFrame, client: Callable[[str, str], str], size: int = BATCH, pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Intent and worthiness metrics of a model over labelled examples.

    ``examples``: example_id, text, section, citation_intent, citation_worthy; the model sees neither label.
    """
    spark = examples.sparkSession
    paper = spark.createDataFrame([("evaluation", "Labelled sentences", "Sentences with known labels, from several papers.")], "paper_id string, title string, abstract string")
    found = classify(to_classify(examples), paper, client, size, pause)
    pairs = examples.select("example_id", F.col("citation_intent").alias("gold_intent"), F.col("citation_worthy").alias("gold_worthy")).join(found.select("example_id", "citation_intent", "citation_worthy"), "example_id")
    intents = intent_metrics(pairs.select(F.col("gold_intent").alias("gold"), F.col("citation_intent").alias("pred")))
    return intents, worthiness_metrics(pairs.select(F.col("gold_worthy").alias("gold"), F.col("citation_worthy").alias("pred")))


def intent_confusion(rows: DataFrame) -> DataFrame:
    """gold, pred and n for every gold class and prediction (OTHER for none), zeros included; rows without gold are left out."""
    pred = F.when(F.col("pred").isin(*INTENTS), F.col("pred")).otherwise("OTHER")
    found = rows.where(F.col("gold").isNotNull()).groupBy("gold", pred.alias("pred")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    every = spark.createDataFrame([(g, p) for g in INTENTS for p in (*INTENTS, "OTHER")], "gold string, pred string")
    return every.join(found, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def intent_metrics(rows: DataFrame) -> DataFrame:
    """A row for each class (precision, recall, f1, support) with accuracy, macro and weighted f1 beside it. 0/0 is 0."""
    table = intent_confusion(rows)
    hit = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    by_gold = table.groupBy("gold").agg(hit.alias("tp"), F.sum("n").alias("support"))
    by_pred = table.groupBy("pred").agg(F.sum("n").alias("predicted")).withColumnRenamed("pred", "gold")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    each = by_gold.join(by_pred, "gold").select(F.col("gold").alias("label"), "support", "tp", p.alias("precision"), r.alias("recall")).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = each.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    out = each.join(F.broadcast(total)).drop("tp")
    return out.select("label", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1")))


def worthiness_metrics(rows: DataFrame) -> DataFrame:
    """One row over boolean gold and pred: a missing prediction counts as no, but never as right."""
    known = rows.where(F.col("gold").isNotNull())
    yes = F.coalesce("pred", F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    counted = known.agg(count(F.col("gold") & yes, "tp"), count(~F.col("gold") & yes, "fp"), count(F.col("gold") & ~yes, "fn"), count(~F.col("gold") & ~yes, "tn"), count(F.col("gold") == F.col("pred"), "right"), F.count("*").alias("n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.select("tp", "fp", "fn", "tn", *(F.round(c, 9).alias(name) for name, c in (("accuracy", ratio(F.col("right"), F.col("n"))), ("precision", p), ("recall", r), ("f1", ratio(2 * p * r, p + r)))))
