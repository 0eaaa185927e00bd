"""TEI documents to papers: title, abstract, references and ordered sections. Malformed XML raises."""

from __future__ import annotations

import urllib.request
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "paper_id string, title string, abstract string, references array<string>, sections array<struct<ord:int,name:string,text:string>>"


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _below(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in node.iter() if x is not node and _local(x) == name)


def _children(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in node if _local(x) == name)


def _own(node: ET.Element | None) -> str:
    """Text before the first child."""
    return ((node.text or "") if node is not None else "").strip()


def _title_of(entry: ET.Element) -> ET.Element | None:
    """The analytic title; the monograph's only where there is no such element."""
    for part in ("analytic", "monogr"):
        for x in _children(entry, part):
            for title in _children(x, "title"):
                return title
    return None


def parse(xml: str) -> dict:
    root = ET.fromstring(xml)
    title = next((t for s in _below(root, "titleStmt") for t in _children(s, "title")), None)
    paragraphs = [p.text for d in _below(root, "profileDesc") for a in _children(d, "abstract") for p in _below(a, "p") if p.text]
    references = [name for group in _below(root, "listBibl") for entry in _children(group, "biblStruct") if (name := _own(_title_of(entry)))]
    sections: dict[str, list[str]] = {}

    todo = [(div, "") for body in _below(root, "body") for div in _children(body, "div")][::-1]
    while todo:  # depth first, in document order
        div, above = todo.pop()
        head = _own(next(_children(div, "head"), None))
        name = " / ".join(filter(None, (above, head)))
        found = [text for p in _children(div, "p") if (text := "".join(p.itertext()).strip())]
        if found:
            sections.setdefault(name or "Untitled Section", []).extend(found)
        todo.extend([(x, name) for x in _children(div, "div")][::-1])
    return {
        "title": _own(title), "abstract": " ".join(paragraphs).strip(), "references": references,
        "sections": [{"ord": i, "name": name, "text": "\n".join(texts)} for i, (name, texts) in enumerate(sections.items(), 1)],
    }


def papers(documents: DataFrame) -> DataFrame:
    """One paper for each row of ``documents`` (paper_id, xml)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{"paper_id": i} | parse(x) for i, x in zip(rows["paper_id"], rows["xml"])], columns=["paper_id", "title", "abstract", "references", "sections"])

    return documents.selectExpr("cast(paper_id as string) paper_id", "xml").mapInPandas(run, SCHEMA)


def post(url: str) -> Callable[[bytes], str]:
    """A client of a parser service that takes a PDF as the form field ``input`` and answers with TEI."""
    address = url.rstrip("/") + "/api/processFulltextDocument"

    def send(content: bytes) -> str:
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="input"; filename="paper.pdf"\r\nContent-Type: application/pdf\r\n\r\n'
        request = urllib.request.Request(address, head.encode() + content + f"\r\n--{mark}--\r\n".encode(), {"Content-Type": f"multipart/form-data; boundary={mark}"})
        with urllib.request.urlopen(request) as answer:  # an HTTP error raises
            return answer.read().decode()

    return send


def fetch(spark: SparkSession, path: str, client: Callable[[bytes], str]) -> DataFrame:
    """paper_id (the path) and xml of every PDF under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"paper_id": rows["path"], "xml": [client(bytes(c)) for c in rows["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "paper_id string, xml string")
