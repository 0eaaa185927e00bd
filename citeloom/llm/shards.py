"""Sharding by a k-d tree over document metadata. DataFrame functions only.

The text is read once for its size and checksum; the tree works on a stored table of a few numbers a row. A node that
has to hold k shards is split where the bytes of the left part come nearest to floor(k / 2) / k of the node's, along the
dimension in which its rows spread widest (as a share of the dimension's whole range); of dimensions about as wide (at
least ``WIDE`` times the widest) the one whose weighted median comes nearest. So it goes on until each leaf is one
shard of the target bytes. The weighted quantiles of all nodes and dimensions of a level are found together: sums over a fixed
number of bins between known keys, narrowed to the bin that holds the quantile until the rest is negligible. What
reaches the driver has a fixed size. Keys are a coordinate followed by a hash of the id, so that a value which many
rows share (one source, one language, copies of a text) is split as well. A tree is a nested CASE over stored
columns: no level moves a row.

Whole documents leave a split a part of one document off. Where that is more than ``LEVEL`` of the node's bytes, as in small
tables, up to ``EXCHANGES`` single documents go over to the sibling, each the one whose size is nearest to what is
too much; the node remembers their keys. Every other row lies in the leaf that its keys give.

Sizes are UTF-8 bytes of the text plus ``overhead`` (null texts: none). Nulls in metadata are coordinate 0. Rows that
repeat a doc_id and a size stay together. Empty tables give no rows. A document that is larger than a shard's target makes
its shard larger. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, text_bytes

SHARDS, OVERHEAD, SLOT_BUCKETS = 40, 16, 64
#: Bins of a level, dealt to its nodes.
BINS = 8192
#: Part of a node's bytes by which a quantile may be missed, and by which a split may miss before documents are exchanged.
#: What a split misses by is shared by all shards below it.
TOLERANCE, LEVEL = 5e-5, 5e-4
WIDE, EXCHANGES = 0.5, 4
_COORDINATE = 1 << 30


@dataclass
class Node:
    """``ranges``: of each dimension's keys; rows with ``dim``'s key up to ``bound`` are left, but those ``moved`` on the other side."""

    name: int
    shards: int
    first: int
    ranges: list[tuple[int, int]]
    dim: int | None = None
    bound: int = 0
    bytes: int = 0
    moved: list[int] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None

    def goes_left(self, dims: list[str]) -> Column:
        key = F.col(dims[self.dim])
        return (key <= self.bound) != key.isin(self.moved) if self.moved else key <= self.bound


def _placed(node: Node, dims: list[str], value) -> Column:
    """``value`` of the leaf that a row falls into (an empty node has no deeper leaves)."""
    if node.left is None or node.right is None:
        return F.lit(value(node))
    return F.when(node.goes_left(dims), _placed(node.left, dims, value)).otherwise(_placed(node.right, dims, value))


def _keys(rows: DataFrame, numbers: list[str], categories: list[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with a sort key for each dimension: 30 bits of coordinate and 32 of a hash of the id."""
    spread = rows.agg(*(f(c).cast("double").alias(f"{f.__name__}_{c}") for c in numbers for f in (F.min, F.max))).first()
    tie = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    out, names = rows, []
    for c in numbers:
        low, high = spread[f"min_{c}"] or 0.0, spread[f"max_{c}"] or 0.0
        at = (F.col(c).cast("double") - F.lit(low)) / F.lit(max(high - low, 1e-9)) * (_COORDINATE - 1)
        out, names = out.withColumn(f"_{c}", F.coalesce(at, F.lit(0.0)).cast("long") * (1 << 32) + tie), [*names, f"_{c}"]
    for c in categories:
        at = F.shiftright(F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)), 2)
        out, names = out.withColumn(f"_{c}", at * (1 << 32) + tie), [*names, f"_{c}"]
    return out, names


def _constants(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A few rows that are part of the plan: no job makes them."""
    names = [c.split() for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(f"CAST({x!r} AS {kind})" for x, (_, kind) in zip(v, names)) + ")" for v in values)
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(n for n, _ in names)})")


def _histograms(rows: DataFrame, leaf: Column, dims: list[str], ranges: dict[tuple[int, int], tuple[int, int]], bins: int) -> dict[tuple[int, int], list]:
    """For each (node, dimension) the bytes, least and greatest key of the bins of its range, in order."""
    spec = [(n, d, low, (high - low) // bins + 1, high) for (n, d), (low, high) in ranges.items()]
    asked = _constants(rows, spec, "leaf int, dim int, low long, width long, high long")
    used = sorted({d for _, d in ranges})
    keys = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(dims[d]).alias("key")) for d in used)))
    cells = rows.select(leaf.cast("int").alias("leaf"), "size", keys.alias("k")).select("leaf", "size", "k.dim", "k.key")
    cells = cells.join(F.broadcast(asked), ["leaf", "dim"]).where("key between low and high")
    found = cells.groupBy("leaf", "dim", F.expr("(key - low) div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
    out: dict[tuple[int, int], list] = {}
    for r in sorted(found, key=lambda r: (r["leaf"], r["dim"], r["bin"])):
        out.setdefault((r["leaf"], r["dim"]), []).append(r)
    return out


def _cuts(rows: DataFrame, leaf: Column, dims: list[str], nodes: list[Node], whole: list[int]) -> dict[int, tuple[int, int, int]]:
    """For each node that has rows the chosen dimension, the bound, and the bytes up to it. Sets the nodes' bytes and ranges."""
    bins = max(64, BINS // len(nodes))
    seen = _histograms(rows, leaf, dims, {(n.name, d): n.ranges[d] for n in nodes for d in range(len(dims))}, bins)
    open_: dict[tuple[int, int], list] = {}
    width: dict[tuple[int, int], float] = {}
    by_name = {n.name: n for n in nodes if (n.name, 0) in seen}
    for n in by_name.values():
        n.bytes = sum(r["bytes"] for r in seen[n.name, 0])
        n.ranges = [(seen[n.name, d][0]["least"], seen[n.name, d][-1]["most"]) for d in range(len(dims))]
        spread = [(high - low) / max(whole[d], 1) for d, (low, high) in enumerate(n.ranges)]
        for d, x in enumerate(spread):
            if x >= WIDE * max(spread):
                open_[n.name, d], width[n.name, d] = seen[n.name, d], x
    below = dict.fromkeys(open_, 0)
    last = {at: by_name[at[0]].ranges[at[1]][0] - 1 for at in open_}
    ends: dict[tuple[int, int], tuple[int, int]] = {}
    while open_:
        again = {}
        for at, cells in open_.items():
            n = by_name[at[0]]
            goal, slack = n.bytes * (n.shards // 2) / n.shards, TOLERANCE * n.bytes
            ends[at] = (last[at], below[at])
            for r in cells:
                if below[at] + r["bytes"] < goal:
                    below[at], last[at] = below[at] + r["bytes"], r["most"]
                    ends[at] = (last[at], below[at])
                    continue
                if r["bytes"] > slack and r["least"] < r["most"]:
                    again[at] = (r["least"], r["most"])
                elif below[at] + r["bytes"] - goal <= goal - below[at]:
                    ends[at] = (r["most"], below[at] + r["bytes"])
                break
        open_ = _histograms(rows, leaf, dims, again, bins) if again else {}
    chosen: dict[int, tuple[int, int, int]] = {}
    for (name, d), (bound, left) in sorted(ends.items(), key=lambda x: -width[x[0]]):
        goal = by_name[name].bytes * (by_name[name].shards // 2) / by_name[name].shards
        if name not in chosen or abs(left - goal) < abs(chosen[name][2] - goal):
            chosen[name] = (d, bound, left)
    return chosen


def _exchange(rows: DataFrame, leaf: Column, dims: list[str], nodes: list[Node], off: dict[int, float]) -> None:
    """Move single documents between the parts of each node until what is too much on the left (``off``) is small."""
    by_name = {n.name: n for n in nodes}
    open_ = {name: x for name, x in off.items() if abs(x) > LEVEL * by_name[name].bytes}
    for _ in range(EXCHANGES):
        if not open_:
            return
        heavy, key = F.lit(False), F.lit(None).cast("long")
        for name, x in open_.items():
            n = by_name[name]
            left = n.goes_left(dims)
            heavy = F.when(leaf == name, left if x > 0 else ~left).otherwise(heavy)
            key = F.when(leaf == name, F.col(dims[n.dim])).otherwise(key)
        asked = _constants(rows, [(name, abs(x)) for name, x in open_.items()], "leaf int, off double")
        group = rows.where(heavy).select(leaf.cast("int").alias("leaf"), key.alias("key"), "size").groupBy("leaf", "key").agg(F.sum("size").alias("size"))
        near = group.join(F.broadcast(asked), "leaf").groupBy("leaf").agg(F.min(F.struct(F.abs(F.col("size") - F.col("off")).alias("rest"), "key", "size")).alias("best"))
        found = {r["leaf"]: r["best"] for r in near.collect()}
        later = {}
        for name, x in open_.items():
            best = found.get(name)
            if best and best["rest"] < abs(x):
                by_name[name].moved.append(best["key"])
                x += -best["size"] if x > 0 else best["size"]
                if abs(x) > LEVEL * by_name[name].bytes:
                    later[name] = x
        open_ = later


def _tree(rows: DataFrame, dims: list[str], shards: int) -> Node:
    whole = rows.agg(*(f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max))).first()
    ranges = [(whole[f"min_{d}"] or 0, whole[f"max_{d}"] or 0) for d in dims]
    root = Node(0, shards, 0, ranges)
    level, names = [root] if shards > 1 else [], 1
    while level:
        leaf = _placed(root, dims, lambda n: n.name)
        chosen = _cuts(rows, leaf, dims, level, [high - low for low, high in ranges])
        level = [n for n in level if n.name in chosen]
        for n in level:
            n.dim, n.bound, _ = chosen[n.name]
        _exchange(rows, leaf, dims, level, {n.name: chosen[n.name][2] - n.bytes * (n.shards // 2) / n.shards for n in level})
        below = []
        for n in level:
            half, (low, high) = n.shards // 2, n.ranges[n.dim]
            parts = [list(n.ranges), list(n.ranges)]
            if not n.moved:
                parts[0][n.dim], parts[1][n.dim] = (low, max(low, n.bound)), (min(high, n.bound + 1), high)
            n.left, n.right = Node(names, half, n.first, parts[0]), Node(names + 1, n.shards - half, n.first + half, parts[1])
            below, names = [*below, n.left, n.right], names + 2
        level = [n for n in below if n.shards > 1]
    return root


def _slots(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless number in their shard, counted by fixed buckets so that no shard is one task's."""
    bucket = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLOT_BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")))
    return numbered.join(F.broadcast(before), ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("i") - 1).cast("long")).drop("bucket", "before", "i")


def shard(documents: DataFrame, shards: int = SHARDS, text: str = "text", categories: tuple[str, ...] = ("lang", "source"), overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``documents``.

    Dimensions are the size (its logarithm), the id and ``categories``. The target of a leaf is the total divided by ``shards``.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    meta = documents.select(F.col("doc_id").cast("long"), (text_bytes(F.col(text)) + overhead).alias("size"), crc.alias("text_crc32"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categories)))
    meta = stored(meta.withColumn("log_size", F.log2("size")).withColumn("id", F.col("doc_id")), "shard-meta")
    keyed, dims = _keys(meta, ["log_size", "id"], [f"c{i}" for i in range(len(categories))])
    keyed = stored(keyed.select("doc_id", "size", "text_crc32", *dims), "shard-keys")
    tree = _tree(keyed, dims, shards)
    placed = keyed.select("doc_id", "size", "text_crc32", _placed(tree, dims, lambda n: n.first).cast("int").alias("shard"))
    return _slots(stored(placed, "shards")).select("doc_id", "size", "text_crc32", "shard", "slot")
