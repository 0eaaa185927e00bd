"""Column functions on text: cleaning, noise, citations, tokens, ids and model inputs. Null counts as empty unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what a citation, a heading and noise are, and the models' prefixes.
_NAME = r"[A-Z][A-Za-z'`-]+"
_MORE = rf"(?:\s+(?:et al\.|&|and)\s+{_NAME}|\s+et al\.)?"
_YEAR = r"(?:(?:,\s*)+)\d{4}[a-z]?"
CITATION = rf"\[\s*\d+(?:\s*[-,;]\s*\d+)*\s*\]|\((?:{_NAME}{_MORE}{_YEAR}(?:\s*;\s*{_NAME}{_MORE}{_YEAR})*)\)|{_NAME}{_MORE}\s*\(\s*\d{{4}}[a-z]?\s*\)"
BULLETS = "[•●▪■◦]"
BARE_PUNCTUATION = r"^[^A-Za-z0-9]+$"
HEADING_LIKE = r"^(?:[A-Z][A-Za-z0-9'&/-]*)(?:\s+[A-Z][A-Za-z0-9'&/-]*){0,7}:?$"
TOKEN = "[a-z0-9]+"
SENTENCE_END = r"(?<=[.!?])\s+"
MIN_TOKENS = 4
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "Instruct: Given a scientific claim, retrieve research papers whose title and abstract provide evidence or prior work supporting this claim\nQuery: "
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
#: White space as Python's ``str.strip`` knows it.
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"


#: What ``tidy`` takes out of running text, by name, and what it puts there instead.
TIDY = {
    "links": (r"(?i)\b(?:(?:https?|ftp)://|www\.)[^\s]+", ""),
    "footnote_marks": (r"(?i)\bfoot[_ ]\d+\b", ""),
    "leading_numbers": (r"^\s*\d{1,3}(?:\.\d+)*\.?\s*(?=\p{Lu})", ""),
    "space_before_marks": (r"\s+(?=[,.;:!?)\]])", ""),
    "space_after_brackets": (r"(?<=[(\[])\s+", ""),
}


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def strip(column: Column) -> Column:
    """Without white space of any kind at both ends; null for null."""
    return F.regexp_replace(column, rf"^{SPACE}+|{SPACE}+$", "")


def clean(column: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(_text(column), r"(?U)\s+", " "))


def without_bullets(column: Column) -> Column:
    return F.regexp_replace(_text(column), BULLETS, "")


def token_count(column: Column, cleaned: bool = False) -> Column:
    """Words of a text, which may have been ``cleaned`` before."""
    plain = column if cleaned else clean(column)
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def is_noise(column: Column, cleaned: bool = False) -> Column:
    """Fewer than four words, no letter or digit, or like a heading."""
    plain = column if cleaned else clean(column)
    return (token_count(plain, True) < MIN_TOKENS) | plain.rlike(BARE_PUNCTUATION) | plain.rlike(HEADING_LIKE)


def has_citation(column: Column) -> Column:
    return _text(column).rlike(CITATION)


def strip_citations(column: Column) -> Column:
    return clean(F.regexp_replace(_text(column), CITATION, ""))


def sentences(column: Column) -> Column:
    """Array of trimmed sentences, split after a full stop, exclamation or question mark and white space."""
    return F.transform(F.split(_text(column), SENTENCE_END), lambda s: F.trim(s))  # F.trim itself would take the place for its second argument


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(_text(column)), F.lit(TOKEN), F.lit(0))


def joined(*columns: Column) -> Column:
    """The parts that aren't empty, with spaces between; trimmed."""
    return F.trim(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in columns)))


def passage(title: Column, abstract: Column) -> Column:
    return F.trim(F.concat(F.lit(PASSAGE_PREFIX), _text(title), F.lit(". "), _text(abstract)))


def instructed(column: Column) -> Column:
    """A query as the dense encoder wants it."""
    return F.concat(F.lit(QUERY_PREFIX), _text(column))


def searched(stripped: Column, text: Column) -> Column:
    """What a sentence is searched by: its text without citations, where there is one."""
    return F.coalesce(stripped, text)


def full_text(title: Column, abstract: Column, sections: Column) -> Column:
    """``sections``: array of {name, text}. Parts with a blank line between; empty title or abstract left out."""
    head = lambda label, c: F.when(_text(c) != "", F.concat(F.lit(label), c))
    body = F.transform(sections, lambda s: F.concat(s["name"], F.lit(":\n"), s["text"]))
    return F.concat_ws("\n\n", head("Title: ", title), head("Abstract: ", abstract), body)


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version-5 UUID of a name; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4).substr(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def tidy(column: Column, *names: str) -> Column:
    """The named rules of ``TIDY`` (all of them, if none is named), then ``clean``."""
    out = _text(column)
    for name in names or TIDY:
        pattern, by = TIDY[name]
        out = F.regexp_replace(out, pattern, by)
    return clean(out)


def markdown_title(column: Column) -> Column:
    """The first heading of the first level; empty if there is none."""
    return F.regexp_extract(_text(column), r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)


def markdown_section(column: Column, name: str) -> Column:
    """The text below the first heading that is ``name`` in any case, up to the next heading; empty if there is none."""
    return strip(F.regexp_extract(_text(column), rf"(?im)^#+[ \t]+{name}[ \t]*$\R((?:(?!#+[ \t]).*(?:\R|\z))*+)", 1))
