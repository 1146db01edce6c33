"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards are the leaves of a tree of regions and racks; a node's weight is the
sum of the leaves' weights below it. A document descends level by level: at
each node every child draws an exponential arrival time, -ln(u) / weight, with
u from a hash of doc_id and the child's path, and the least draw wins. A
child's draw changes only with its own weight, so a change of weights moves
rows only into or out of the subtrees whose weights changed: other regions
keep their rows, and so do the unchanged racks of a changed region among each
other. Which regions and racks there are decides too: the same leaves in
another tree place rows otherwise. A child without weight takes nothing.

A new shard becomes a region of its own (``grow``), so that it takes rows only
into itself.

Law: ``key``. Cases: a null text has size 8 and crc32 0; a null doc_id is
placed as the word "null"; rows with equal ids go to the same shard and take
slots in order of id, size and checksum; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import partitions, written

#: Regions of racks of (shard, weight) leaves.
Tree = list[list[list[tuple[int, float]]]]


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards 0.. of weight 1, ``per_rack`` to a rack and ``racks`` racks to a region."""
    leaves = [(k, 1.0) for k in range(shards)]
    rows = [leaves[i : i + per_rack] for i in range(0, shards, per_rack)]
    return [rows[i : i + racks] for i in range(0, len(rows), racks)]


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, a region of its own."""
    return [*tree, [[(shard, weight)]]]


def draw(doc_id: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight, null without weight; u lies strictly between 0 and 1, from 48 bits of md5(doc_id:path)."""
    n = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), path)), 1, 12), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((n + 0.5) / F.lit(float(1 << 48))) / weight)


def _pick(draws: list[Column]) -> Column:
    """The place of the least draw, the first of equals."""
    least = F.least(*draws) if len(draws) > 1 else draws[0]
    return reduce(lambda rest, k: F.when(draws[k] == least, k).otherwise(rest), range(len(draws) - 2, -1, -1), F.lit(len(draws) - 1))


def _table(values: list) -> Column:
    """A literal array, of arrays if the values are lists."""
    return F.array(*(_table(v) if isinstance(v, list) else F.lit(v) for v in values))


def _even(rows: list[list], fill) -> list[list]:
    """The lists, each filled up to the length of the longest."""
    n = max(map(len, rows))
    return [[*r, *[fill] * (n - len(r))] for r in rows]


def place(df: DataFrame, tree: Tree, out: str, draws: str | None = None) -> DataFrame:
    """Add ``out``, the shard; ``draws`` may name the first regions' draws in an array column, made before."""
    weight = [[[float(w) for _, w in rack] for rack in region] for region in tree]
    if any(w < 0 for region in weight for rack in region for w in rack) or sum(w for region in weight for rack in region for w in rack) <= 0:
        raise ValueError("weights must not be negative, and some must be positive")
    racks = _even([[sum(rack) for rack in region] for region in weight], 0.0)
    most = len(racks[0])
    leaves = [_even([*region, *[[0.0]] * (most - len(region)), [0.0] * max(len(k) for r in weight for k in r)], 0.0)[:-1] for region in weight]
    shards = [_even([*[[s for s, _ in rack] for rack in region], *[[-1]] * (most - len(region)), [-1] * max(len(k) for r in weight for k in r)], -1)[:-1] for region in tree]
    doc = F.col("doc_id")
    first = [F.col(draws)[k] if draws else draw(doc, F.lit(str(k)), F.lit(sum(map(sum, region)))) for k, region in enumerate(weight)]
    df = df.withColumn("__region", _pick(first))
    path = F.col("__region").cast("string")
    second = [draw(doc, F.concat(path, F.lit(f".{k}")), F.get(F.get(_table(racks), F.col("__region")), F.lit(k))) for k in range(most)]
    df = df.withColumn("__rack", _pick(second))
    path = F.concat(path, F.lit("."), F.col("__rack").cast("string"))
    own = F.get(F.get(_table(leaves), F.col("__region")), F.col("__rack"))
    third = [draw(doc, F.concat(path, F.lit(f".{k}")), F.get(own, F.lit(k))) for k in range(len(leaves[0][0]))]
    df = df.withColumn("__leaf", _pick(third))
    shard = F.get(F.get(F.get(_table(shards), F.col("__region")), F.col("__rack")), F.col("__leaf"))
    return df.withColumn(out, shard.cast("int")).drop("__region", "__rack", "__leaf")


def shard_documents(docs: DataFrame, shards: int = 24, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document."""
    tree = tree or even_tree(shards)
    grown = grown or grow(tree, shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    if grown[: len(tree)] == tree and len(grown) == len(tree) + 1 and len(grown[-1]) == len(grown[-1][0]) == 1:
        # only a region of one shard more: a row goes there, or where it was
        weights = [sum(w for rack in region for _, w in rack) for region in grown]
        df = df.withColumn("__draws", F.array(*(draw(F.col("doc_id"), F.lit(str(k)), F.lit(w)) for k, w in enumerate(weights))))
        df = place(df, tree, "shard", "__draws")
        new = _pick([F.col("__draws")[k] for k in range(len(grown))]) == len(tree)
        df = df.withColumn("grown_shard", F.when(new, F.lit(grown[-1][0][0][0])).otherwise(F.col("shard"))).drop("__draws")
    else:
        df = place(place(df, tree, "shard"), grown, "grown_shard")
    return with_slots(df).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def with_slots(df: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 in order of doc_id.

    Rows are dealt by ranges of (shard, doc_id), so that a shard's rows spread
    over tasks; each task numbers its part of a shard, and the parts' counts,
    a row for each task and shard, give where each part begins.
    """
    order = ["shard", "doc_id", "size", "text_crc32"]
    dealt = df.repartitionByRange(partitions(df), *order).withColumn("__part", F.spark_partition_id())
    part = Window.partitionBy("__part", "shard").orderBy("doc_id", "size", "text_crc32")
    # written, as another run of the same plan may draw other ranges
    numbered = written(dealt.withColumn("__n", F.row_number().over(part) - 1))
    counts = numbered.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__rows"))
    past = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__part", F.coalesce(F.sum("__rows").over(past), F.lit(0)).alias("__before"))
    return numbered.join(before, ["shard", "__part"]).withColumn("slot", (F.col("__n") + F.col("__before")).cast("long"))
