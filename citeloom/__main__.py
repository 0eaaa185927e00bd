"""Command line: measure a sentence classifier or a retrieval run on a benchmark file.

    python -m citeloom classifier scicite test.jsonl --client package.module:answer --most 100
    python -m citeloom retrieval examples.jsonl documents.parquet --rankings run.json
"""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import classify, evaluation, reports
from .plans import retrieval
from .sources import readers
from .sources.scratch import stored

LOADERS = {"scicite": readers.scicite_jsonl, "acl-arc": readers.acl_arc_jsonl}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="citeloom", description=__doc__.partition("\n")[0])
    jobs = top.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("classifier", help="intent and worthiness metrics of a model")
    one.add_argument("dataset", choices=sorted(LOADERS))
    one.add_argument("path")
    one.add_argument("--client", required=True, help="module:function, (system prompt, prompt) -> answer")
    one.add_argument("--most", type=int, default=100)
    one.add_argument("--size", type=int, default=classify.BATCH)
    one.add_argument("--pause", type=float, default=60.0)
    two = jobs.add_parser("retrieval", help="ranking metrics of BM25 or of given rankings")
    two.add_argument("path", help="hide-and-seek rows")
    two.add_argument("documents", help="Parquet with doc_id and text")
    two.add_argument("--rankings", help="JSON of ranked ids")
    two.add_argument("--k", type=int, default=10)
    two.add_argument("--candidates", type=int, default=50)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run one job; returns (and prints) its tables."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("citeloom").getOrCreate()
    if a.job == "classifier":
        module, _, name = a.client.partition(":")
        examples = stored(classify.labelled_both(LOADERS[a.dataset](spark, a.path), a.most), "examples")
        if examples.isEmpty():
            raise ValueError("no example has both labels")
        tables = classify.evaluate(examples, getattr(import_module(module), name), a.size, a.pause)
    else:
        documents = retrieval.checked(spark.read.parquet(a.documents), a.k, a.candidates)
        rows = readers.hide_seek_jsonl(spark, a.path)
        examples = rows.select(F.col("example_id").alias("query_id"), F.col("query_text").alias("text"), F.col("hidden_paper_ids").alias("relevant"), "section", F.lit(None).cast("string").alias("intent"), evaluation.facet(F.col("is_multi_facet")).alias("facet"))
        predict = retrieval.external(readers.rankings(spark, a.rankings), a.k) if a.rankings else retrieval.bm25(documents, a.candidates)
        tables = (evaluation.summary(retrieval.evaluate(examples, predict)),)
    out = "\n\n".join(reports.shown(t) for t in tables)
    print(out)
    return out


if __name__ == "__main__":
    main()
