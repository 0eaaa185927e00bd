"""Sections to sentence records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def with_abstract(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, section_ord, section, body: the abstract first; a section of that name takes its text and keeps its place.

    ``papers``: paper_id, abstract. ``sections``: paper_id, section_ord (from 1), section, body. Blank sections go.
    """
    abstract = papers.where(F.trim(F.coalesce("abstract", F.lit(""))) != "").select("paper_id", F.lit(0).alias("section_ord"), F.lit("Abstract").alias("section"), F.col("abstract").alias("body"))
    every = abstract.unionByName(sections.select("paper_id", "section_ord", "section", "body"))
    merged = every.groupBy("paper_id", "section").agg(F.min("section_ord").alias("section_ord"), F.max_by("body", "section_ord").alias("body"))
    return merged.where(F.trim(F.coalesce("body", F.lit(""))) != "").select("paper_id", "section_ord", "section", "body")


def extract(sections: DataFrame, sentences=text.sentences) -> DataFrame:
    """One row for each sentence that isn't noise: its place in the section, neighbours, citation flag and stripped text.

    ``sentences``: a column function that splits a body into an array; a model can stand in for the default rule.
    """
    split = sections.select("paper_id", "section_ord", "section", F.posexplode(sentences(F.col("body"))).alias("sent_ord", "raw"))
    kept = split.withColumn("text", text.clean(text.without_bullets(F.col("raw")))).where(~text.is_noise(F.col("text"), cleaned=True))
    w = Window.partitionBy("paper_id", "section_ord", "section").orderBy("sent_ord")
    return kept.select(
        "paper_id", "section_ord", "section", "sent_ord", "text", F.percent_rank().over(w).alias("position_in_section"), text.has_citation(F.col("text")).alias("has_citation"),
        text.strip_citations(F.col("text")).alias("retrieval_text"), F.lag("text").over(w).alias("previous_sentence"), F.lead("text").over(w).alias("next_sentence"),
    )


def section_counts(records: DataFrame, over: int = 2) -> DataFrame:
    """Sections with more than ``over`` sentences."""
    return records.groupBy("section").agg(F.count("*").alias("n")).where(F.col("n") > over)


def samples(records: DataFrame, cited: int = 3, uncited: int = 2) -> DataFrame:
    """The first sentences of each paper with and without a citation."""
    w = Window.partitionBy("paper_id", "has_citation").orderBy("section_ord", "sent_ord")
    return records.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("has_citation"), cited).otherwise(uncited)).drop("n")
