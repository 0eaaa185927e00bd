"""Main text of web pages by consensus host paths.

Every page is parsed in time linear in its length into elements and the text that is not boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, told by tag, role, class and id). Its containers are
scored by the paragraph text they hold, less links; an outer container gets a fixed share of what the inner ones have.
The best containers of each page vote, by their scores, for their path: tags and classes from the root, digits
generalised. Votes are summed by host in Spark, which is all that is shuffled; the path with most votes is the host's. Then each
page is extracted again: the text of the elements on its host's path, or of its own best container where it has none.

A path goes by a hash of 128 bits, chained from the root, so that votes have a fixed size and an element's path costs the same
at any depth. The hosts' paths are broadcast while they take at most ``broadcast_bytes``, and joined otherwise.

Null and empty pages give an empty text. Null URLs share one host. Repeated rows are answered each on its own. Columns
named like the new one are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

#: Bytes of hosts and paths that may be broadcast, and of markup that is Python's at a time.
BROADCAST_BYTES, CHUNK_BYTES = 16 << 20, 4 << 20
_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|[!?/][^>]*+>)""", re.S)
#: An attribute as a whole, name and value, so that nothing is found inside another one; an open quote runs to the end.
_ATTRIBUTE = re.compile(r"""([^\s/][^\s/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+)))?""")
_READ = frozenset("class id role hidden aria-hidden style itemprop".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe xmp noembed noframes noscript select svg math object video audio canvas".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table tbody thead tfoot tr td th figcaption figure caption details summary".split())
_NOISE_TAGS = frozenset("nav aside footer form menu dialog button label fieldset head".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|shar(?:e|ing)|social|sidebar|related|recommend\w*|"
    r"comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|login|signup|widgets?|toolbar|pagination|pager|skip|topbar)(?:$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|text|body)(?:$|[\s_-])", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_PARAGRAPH = frozenset("p")
_DECAY = 0.8


ROOT = b""


def path_key(above: bytes, name: str) -> bytes:
    """The path of an element with this tag and these classes, below the path ``above``."""
    return hashlib.blake2b(above + name.encode(errors="replace"), digest_size=16).digest()


def path_of(*names: str) -> bytes:
    """The path through elements of these names, from the root."""
    key = ROOT
    for name in names:
        key = path_key(key, name)
    return key


def _sliced(batch: pa.RecordBatch, markup: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``CHUNK_BYTES`` of markup (a longer page is a part of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(markup)), 0).to_numpy(zero_copy_only=False).astype("int64") + 64
    first = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > CHUNK_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    yield batch.slice(first)


class Page:
    """Elements by number (0 is the root) and the text pieces; element e holds pieces first[e] to last[e]."""

    def __init__(self, source: str):
        self.parent, self.tag, self.key, self.first, self.last, self.bonus = [-1], [""], [ROOT], [0], [0], [1.0]
        self.pieces: list[str] = []
        own: dict[int, float] = defaultdict(float)
        self.stack, self.noisy, self.noise, self.open = [0], [False], 0, defaultdict(int)
        stack, open_, at, end, low = self.stack, self.open, 0, len(source), None
        holder = [0]  # of each element, the container that its text counts for
        limit = source.rfind(">") + 1  # no tag ends after it
        while True:
            m = _TOKEN.search(source, at, limit)
            text = source[at : m.start()] if m else source[at:end].partition("<!--")[0]
            if text and not self.noise:
                if "&" in text:
                    text = entities.unescape(text)
                self.pieces.append(text)
                if not open_["a"] and (size := len(text.strip())):
                    own[holder[stack[-1]]] += size
            if not m:
                break
            at = m.end()
            closing, tag = m.group(1), m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in _BLOCK
            if block:
                self.pieces.append(" ")
            if closing:
                if tag in _VOID or tag in _RAW or not open_[tag]:
                    continue
                for d in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[d]] == tag:
                        self._pop(d)
                        break
                    if not block and self.tag[stack[d]] in _BLOCK:
                        break  # a stray end tag closes no block
                continue
            if tag in _VOID:
                continue
            attributes = m.group(3)
            if tag in _RAW:
                if not attributes.endswith("/"):
                    low = source.lower() if low is None else low
                    found = low.find("</" + tag, at)
                    if found < 0:
                        if tag not in ("svg", "math", "object", "video", "audio", "canvas", "select", "noscript"):
                            break
                    else:
                        at = found
                continue
            if block:
                self._imply(tag)
            names, bad, good = tag, tag in _NOISE_TAGS, tag in ("article", "main")
            if attributes:
                for a in _ATTRIBUTE.finditer(attributes):
                    key = a.group(1).lower()
                    if key not in _READ:
                        continue
                    value = entities.unescape(a.group(2) or a.group(3) or a.group(4) or "")
                    if key in ("class", "id"):
                        bad = bad or tag not in ("body", "html", "article", "main") and bool(_NOISE.search(value))
                        good = good or bool(_GOOD.search(value))
                        if key == "class":
                            names += "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(value.split())))
                    elif key == "role":
                        bad, good = bad or value.strip().lower() in _NOISE_ROLES, good or value == "main"
                    elif key == "itemprop":
                        good = good or value.lower() == "articlebody"
                    elif key == "style":
                        bad = bad or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                    else:
                        bad = bad or key == "hidden" or value.lower() == "true"
            if tag == "header":  # a site's, unless it stands in the article
                bad = bad or not (open_["article"] or open_["main"])
            e = len(self.tag)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.key.append(path_key(self.key[stack[-1]], names))
            self.first.append(len(self.pieces))
            self.last.append(-1)
            self.bonus.append(1.5 if good and not bad else 1.0)
            holder.append(e if block and tag not in _LEAF else holder[stack[-1]])
            stack.append(e)
            self.noisy.append(bad)
            self.noise += bad
            open_[tag] += 1
        for e, x in enumerate(self.last):
            if x < 0 or e == 0:
                self.last[e] = len(self.pieces)
        self.score = [0.0] * len(self.tag)
        for e in range(len(self.tag) - 1, -1, -1):
            self.score[e] += own.get(e, 0.0)
            if e:
                self.score[self.parent[e]] += (1.0 if self.tag[e] in _LEAF or self.tag[e] not in _BLOCK else _DECAY) * self.score[e]

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.last[e] = len(self.pieces)
            self.open[self.tag[e]] -= 1
            self.noise -= self.noisy.pop()

    def _imply(self, tag: str) -> None:
        """End tags that a block's start tag implies."""
        for names, stops in ((_CLOSES.get(tag), _STOPS.get(tag)), (_PARAGRAPH, _BLOCK)):
            if names and any(self.open[x] for x in names):
                for d in range(len(self.stack) - 1, 0, -1):
                    name = self.tag[self.stack[d]]
                    if name in names:
                        self._pop(d)
                        break
                    if name in stops:
                        break

    def containers(self, most: int = 3) -> list[tuple[float, int]]:
        """The best containers with their scores, best first; ties to the outer one."""
        ranked = [(-self.score[e] * self.bonus[e], e) for e in range(len(self.tag)) if self.score[e] > 0 and (e == 0 or self.tag[e] in _BLOCK and self.tag[e] not in _LEAF)]
        ranked.sort()
        return [(-s, e) for s, e in ranked[:most]]

    def text(self, e: int) -> str:
        return " ".join("".join(self.pieces[self.first[e] : self.last[e]]).split())

    def on(self, path: bytes) -> list[int]:
        """Outermost elements on a path, in page order."""
        out: list[int] = []
        for e, key in enumerate(self.key):
            if key == path and not (out and self.first[e] < self.last[out[-1]]):
                out.append(e)
        return out

    def extract(self, path: bytes | None) -> str:
        if path is not None:
            if found := " ".join(t for e in self.on(path) if (t := self.text(e))):
                return found
        best = self.containers(1)
        return self.text(best[0][1]) if best else ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(markup: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, bytes], float] = defaultdict(float)
            for part in _sliced(batch, markup):
                for host, source in zip(part.column("_host").to_pylist(), part.column(markup).to_pylist()):
                    if source:
                        page = Page(source)
                        best = page.containers()
                        total = sum(s for s, _ in best)
                        for s, e in best:
                            votes[host, page.key[e]] += s / total
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.binary()), pa.array(list(votes.values()), pa.float64())], names=["host", "path", "votes"])

    return run


def host_paths(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """host and its winning path, stored; ties go to the path that is first in order."""
    sources = pages.select(host_of(F.col(url)).alias("_host"), F.col(markup))
    votes = sources.mapInArrow(_votes(markup), "host string, path binary, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return stored(votes.withColumn("n", first).where("n = 1").select("host", "path"), "host-paths")


def _extract(markup: str, into: str, paths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = paths.value if paths is not None else None
        for batch in (part for whole in batches for part in _sliced(whole, markup)):
            chosen = batch.column("_path").to_pylist() if known is None else map(known.get, batch.column("_host").to_pylist())
            texts = [Page(source).extract(path) if source else "" for source, path in zip(batch.column(markup).to_pylist(), chosen)]
            kept = batch.drop_columns([c for c in (markup, "_host", "_path") if c in batch.schema.names])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], names=[*kept.schema.names, into])

    return run


def extract(pages: DataFrame, url: str = "url", markup: str = "html", into: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with the main text in place of the markup."""
    paths = host_paths(pages, url, markup)
    out = pages.drop(*(c for c in (into, "_host", "_path") if c != markup))
    schema = T.StructType([*(f for f in out.schema.fields if f.name != markup), T.StructField(into, T.StringType())])
    placed = out.withColumn("_host", host_of(F.col(url)))
    shared = None
    if (paths.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0) <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["path"]) for r in paths.collect()})
    else:
        placed = placed.join(paths.select(F.col("host").alias("_host"), F.col("path").alias("_path")), "_host", "left")
    return placed.mapInArrow(_extract(markup, into, shared), schema)
