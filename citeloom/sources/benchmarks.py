"""Benchmark rows of any shape to examples: first usable key wins, labels mapped to intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Labels of two public citation datasets and the intent each one means.
ACL_ARC_INTENTS = {
    "background": "BACKGROUND", "basis": "BACKGROUND", "motivation": "BACKGROUND", "compare": "METHOD", "contrast": "METHOD", "model": "METHOD",
    "investigation": "METHOD", "method": "METHOD", "result": "RESULT", "outcome": "RESULT", "other": "BACKGROUND",
}
SCICITE_INTENTS = {
    "background": "BACKGROUND", "bg": "BACKGROUND", "method": "METHOD", "compare": "METHOD", "comparison": "METHOD", "result": "RESULT",
    "results": "RESULT", "implicit": "BACKGROUND", "none": "BACKGROUND",
}
# The keys under which datasets hold text, label and id, in order of preference.
ACL_ARC_KEYS = {"text": ("text", "sentence", "string", "citation_string"), "label": ("label", "gold", "y", "citation_class"), "id": ("id", "example_id", "idx")}
SCICITE_KEYS = {"text": ("text", "string", "sentence", "citing_string"), "label": ("label", "cite_type", "gold", "y", "class"), "id": ("example_id", "id", "cite_id")}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for intent in sorted(set(table.values())):
        out = F.when(key.isin(*(k for k, v in table.items() if v == intent)), intent).otherwise(out)
    return out


def _key(label: Column) -> Column:
    return F.regexp_replace(text.strip(F.lower(label)), rf"{text.SPACE}+", "_")


def acl_arc_intent(label: Column) -> Column:
    """Intent of a label, also without a trailing _background, _method or _result; null if it has none."""
    key = F.ltrim(_key(label), F.lit("_"))
    stem = F.ltrim(F.regexp_replace(key, "_(?:background|method|result)$", ""), F.lit("_"))
    return F.coalesce(_lookup(key, ACL_ARC_INTENTS), _lookup(stem, ACL_ARC_INTENTS))


def scicite_intent(label: Column) -> Column:
    return _lookup(_key(label), SCICITE_INTENTS)


def _value(row: Column, key: str) -> Column:
    return F.try_variant_get(row, f"$.{key}", "string")


def _is(row: Column, key: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(row, f"$.{key}", "variant")) == kind


def adapt(rows: DataFrame, row: str, ordinal: str, keys: dict[str, tuple[str, ...]], intent, prefix: str) -> DataFrame:
    """Examples from a variant column ``row``; ``ordinal`` names those without an id, after ``prefix``.

    Text is the first string that isn't blank; the label the first value that is neither null nor empty (UNKNOWN if none, or blank); the id
    the first that isn't blank; citation_worthy only a real boolean.
    """
    v = F.col(row)
    blank = lambda c: F.nullif(text.strip(c), F.lit(""))
    body = F.coalesce(*(F.when(_is(v, k, "STRING"), blank(_value(v, k))) for k in keys["text"]), F.lit(""))
    raw = text.strip(F.coalesce(*(F.nullif(_value(v, k), F.lit("")) for k in keys["label"]), F.lit("")))
    example = F.coalesce(*(blank(_value(v, k)) for k in keys["id"]), F.concat(F.lit(prefix), F.col(ordinal).cast("string")))
    fields = {k for group in keys.values() for k in group}
    meta = F.map_filter(F.from_json(F.to_json(v), "map<string,string>"), lambda k, _: ~k.isin(*fields))
    return rows.select(
        F.col(ordinal).alias("ordinal"), example.alias("example_id"), body.alias("text"), F.coalesce(F.nullif(raw, F.lit("")), F.lit("UNKNOWN")).alias("gold_label"), F.when(raw != "", intent(raw)).alias("citation_intent"),
        F.when(_is(v, "citation_worthy", "BOOLEAN"), F.try_variant_get(v, "$.citation_worthy", "boolean")).alias("citation_worthy"), _value(v, "section").alias("section"), meta.alias("metadata"),
    )


def acl_arc(rows: DataFrame, row: str = "v", ordinal: str = "ordinal") -> DataFrame:
    return adapt(rows, row, ordinal, ACL_ARC_KEYS, acl_arc_intent, "acl-arc-")


def scicite(rows: DataFrame, row: str = "v", ordinal: str = "ordinal") -> DataFrame:
    return adapt(rows, row, ordinal, SCICITE_KEYS, scicite_intent, "scicite-")


def hide_seek_rows(rows: DataFrame, row: str = "v") -> DataFrame:
    """example_id, query_text, section, is_multi_facet, citing_paper_id, indexed_reference_ids (null if no list), total_reference_count, metadata.

    ``metadata`` holds, as strings, all other keys and the citing paper's id.
    """
    v = F.col(row)
    first = lambda *ks: F.coalesce(*(F.nullif(_value(v, k), F.lit("")) for k in ks))
    ids = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<string>") for k in ("indexed_reference_ids", "indexed_references")))
    named = F.coalesce(first("sentence_id", "example_id", "id"), F.concat(F.lit("citing_paper_id:"), _value(v, "citing_paper_id")), F.lit("unknown"))
    known = ("query_text", "sentence", "text", "sentence_id", "example_id", "id", "section")
    meta = F.map_filter(F.from_json(F.to_json(v), "map<string,string>"), lambda k, x: ~k.isin(*known) & ((k != "citing_paper_id") | x.isNotNull()))
    facet = F.when(_is(v, "is_multi_facet", "BOOLEAN"), F.try_variant_get(v, "$.is_multi_facet", "boolean"))
    return rows.select(
        named.alias("example_id"), text.strip(F.coalesce(first("query_text", "sentence", "text"), F.lit(""))).alias("query_text"), _value(v, "section").alias("section"), facet.alias("is_multi_facet"),
        _value(v, "citing_paper_id").alias("citing_paper_id"), ids.alias("indexed_reference_ids"), F.try_variant_get(v, "$.total_reference_count", "int").alias("total_reference_count"), meta.alias("metadata"),
    )
