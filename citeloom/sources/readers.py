"""Readers of JSON lines, delimited files, rankings, line samples, tables and paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.hideseek import examples
from . import benchmarks


def numbered(rows: DataFrame, file: Column, start: Column, counted: Column) -> DataFrame:
    """``rows`` of files, in the order of files and places, with ``line`` (from 0 over all rows) and ``ordinal`` (over the ``counted`` ones).

    Rows are numbered within the piece of a file that one task reads, after the totals of the pieces before it; only
    those totals, one row for each piece, come together.
    """
    placed = rows.withColumns({"_file": file, "_start": start, "_at": F.monotonically_increasing_id(), "_counted": counted.cast("long")})
    totals = placed.groupBy("_file", "_start").agg(F.count("*").alias("_lines"), F.sum("_counted").alias("_rows"))
    above = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_file", "_start", F.coalesce(F.sum("_lines").over(above), F.lit(0)).alias("_lines"), F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_rows"))
    piece = Window.partitionBy("_file", "_start").orderBy("_at")
    joined = placed.withColumns({"_line": F.row_number().over(piece) - 1, "_row": F.sum("_counted").over(piece) - 1}).join(before, ["_file", "_start"])
    return joined.select(*rows.columns, (F.col("_lines") + F.col("_line")).alias("line"), (F.col("_rows") + F.col("_row")).alias("ordinal"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``v`` (variant), ``ordinal`` among the lines that aren't blank and ``line`` among all; bad JSON raises.

    Several files are numbered through, in the order of their paths. Lines are read in pieces, wherever they are.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    full = ~F.col("value").rlike(rf"^{text.SPACE}*$")
    lines = numbered(raw, F.col("_path"), F.col("_block"), full)
    return lines.where(full).select(F.parse_json(text.strip(F.col("value"))).alias("v"), "ordinal", "line")


def acl_arc_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return benchmarks.acl_arc(jsonl(spark, path))


def scicite_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return benchmarks.scicite(jsonl(spark, path))


def hide_seek_jsonl(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    return examples(benchmarks.hide_seek_rows(jsonl(spark, path)), seed=seed)


def delimited(spark: SparkSession, path: str, body: str, label: str, row_id: str | None, sep: str = "\t") -> DataFrame:
    """``v`` and ``ordinal`` from a file with a header: the named columns as text, label and example_id, all cells strings.

    A column that the file doesn't have, and an empty cell, is an empty string.
    """
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True)
    cells = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in raw.columns}
    named = raw.select("*", F.col("_metadata.file_path").alias("_path"))
    rows = numbered(named, F.col("_path"), F.lit(0), F.lit(True))
    cells |= {"text": cells.get(body, F.lit("")), "label": cells.get(label, F.lit(""))}
    if row_id and row_id in raw.columns:
        cells["example_id"] = cells[row_id]
    fields = F.struct(*(c.alias(name) for name, c in cells.items()))
    return rows.select(F.parse_json(F.to_json(fields)).alias("v"), "ordinal")


def acl_arc_tsv(spark: SparkSession, path: str, body: str = "text", label: str = "label", row_id: str | None = "id", sep: str = "\t") -> DataFrame:
    keys = {"text": ("text",), "label": ("label",), "id": ("example_id",)}
    return benchmarks.adapt(delimited(spark, path, body, label, row_id, sep), "v", "ordinal", keys, benchmarks.acl_arc_intent, "acl-arc-")


def scicite_tsv(spark: SparkSession, path: str, body: str = "string", label: str = "label", row_id: str | None = None, sep: str = "\t") -> DataFrame:
    keys = {"text": ("text",), "label": ("label",), "id": ("example_id", "id", "cite_id")}
    return benchmarks.adapt(delimited(spark, path, body, label, row_id, sep), "v", "ordinal", keys, benchmarks.scicite_intent, "scicite-")


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """example_id and ranked from an object of lists, or an array of objects (id and the first list that isn't empty).

    Other entries are skipped, the last of repeated ids wins, any other top level raises.
    """
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    checked = whole.where(F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID") & F.lit(False), True).otherwise(F.raise_error(F.lit("rankings must be an object or an array")).cast("boolean")))
    checked.createOrReplaceTempView("_rankings")
    each = spark.sql("SELECT e.pos, e.key, e.value, schema_of_variant(v) LIKE 'OBJECT%' AS named FROM _rankings, LATERAL variant_explode(v) e")
    value = lambda k, t="string": F.try_variant_get("value", f"$.{k}", t)
    name = F.when(F.col("named"), F.col("key")).otherwise(F.coalesce(F.nullif(value("example_id"), F.lit("")), F.nullif(value("id"), F.lit(""))))
    full = lambda c: F.when(F.size(c) > 0, c)
    of_object = F.coalesce(*(full(value(k, "array<string>")) for k in ("ranked_paper_ids", "ranking", "paper_ids")))
    ranked = F.when(F.col("named"), F.try_variant_get("value", "$", "array<string>")).otherwise(of_object)
    rows = each.select("pos", name.alias("example_id"), ranked.alias("ranked")).where("example_id is not null and ranked is not null")
    return rows.groupBy("example_id").agg(F.max_by("ranked", "pos").alias("ranked"))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``v`` and ``ordinal`` of the rows in the first n lines; blank lines take a place."""
    return jsonl(spark, path).where(F.col("line") < n)


def papers(rows: DataFrame) -> DataFrame:
    """paper_id, title and abstract from table rows with paperId or paper_id; nulls become empty."""
    have = set(rows.columns)
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("paperId", "paper_id") if c in have]
    part = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
    return rows.select(F.coalesce(*ids, F.lit("")).alias("paper_id"), part("title"), part("abstract"))


def table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def evaluation_papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("paper_id string, indexed_reference_count int, total_reference_count int, coverage double").json(path, multiLine=True)


TABLES = {
    "papers": "paperId STRING, doi STRING, title STRING, abstract STRING, publication_date DATE, cited_by_count INT, referenced_works_count INT, paper_type STRING, venue STRING, topics VARIANT",
    "citations": "source_paper_id STRING, target_paper_id STRING",
    "corpus_papers": "paper_id STRING, role STRING, in_eval_set BOOLEAN, reference_coverage FLOAT, indexed_reference_count INT, added_at TIMESTAMP",
}


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    """The stored tables, where they don't exist."""
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({schema}) USING parquet")
