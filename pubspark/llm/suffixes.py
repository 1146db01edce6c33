"""Exact removal of repeated byte strings by a sampled suffix array.

Every string of ``LENGTH`` bytes that starts at two places of the corpus is
found, and all bytes under such strings are removed. Sorting every suffix
would ship the corpus many times over, so suffixes are sampled without loss:
each window of LENGTH bytes picks the suffix in it whose leading ``GRAM`` bytes
hash lowest (the first of equals). Equal windows pick the same place, so a
window can only be repeated if its suffix's leading bytes are. Consecutive
windows with one pick form a segment, which is what is sorted:

1. Splitters from a sample of documents deal segments by ranges of the suffix's
   leading bytes, as they are, then of a 128-bit BLAKE2 digest of the segment's
   bytes, then of its place; a frequent suffix thus spreads over buckets.
   Buckets are as many as the size of the texts asks for (``BUCKET`` bytes
   each); each sorts its suffixes by multikey quicksort and compares every entry
   with its neighbours, across bucket boundaries too. A segment that a neighbour
   equals is repeated as a whole, one whose suffix no neighbour shares not at all.
2. The segments between, which begin or end a repeat, are compared window by
   window: those of a suffix that few have side by side, equal windows byte by
   byte; those of a frequent one by sorting all their windows as above.

Rows are known by partition and position, written once.

Cases: a null text counts as an empty one; texts of under LENGTH bytes keep
all; equal rows are repeats of each other; strings are judged on the input, so
nothing is kept for being the first; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, written
from .words import Chunk, Spans, U, chunks, mix

LENGTH, GRAM = 200, 40
BIG = 4096  # segments of one suffix that are compared in one place; those of more frequent ones are sorted window by window
BUCKET = 16 << 20
SAMPLED = 40  # suffixes that are sampled for each bucket
SMALL = 512  # suffixes that quicksort leaves to a plain sort
PIECE_BITS = 22  # texts are cut into pieces of 4 MiB, whose windows overlap
_SHIFT = 16  # low bits of a place: the number of windows
_ODD = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MARKS = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def _ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place; it only chooses suffixes, so that collisions do no harm."""
    n = len(data)
    up = np.full(n + 1, _ODD, U)
    up[0] = 1
    down = np.full(n + 1, _INVERSE, U)
    down[0] = 1
    sums = np.zeros(n + 1, U)
    np.cumsum(_MARKS[data] * np.multiply.accumulate(up)[:n], out=sums[1:])
    return mix((sums[gram:] - sums[: n - gram + 1]) * np.multiply.accumulate(down)[: n - gram + 1])


def _picks(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of the window that starts at each place, the place of its suffix; at most 2^PIECE_BITS windows."""
    wide, place = length - gram + 1, U((1 << PIECE_BITS + 1) - 1)
    low = (_ranks(data, gram) & ~place) | np.arange(len(data) - gram + 1, dtype=U)
    have = 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < wide:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    return (low & place).astype(np.int64)


def segments(c: Chunk, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window and number of windows of each segment, and the place of its suffix in the chunk."""
    n = len(c.data)
    found = []
    for a in range(0, max(n - length + 1, 0), 1 << PIECE_BITS):
        part = c.data[a : a + (1 << PIECE_BITS) + length - 1]
        pick = _picks(part, length, gram) + a
        at = np.arange(len(pick)) + a
        doc = np.searchsorted(c.at, at, side="right") - 1
        use = np.flatnonzero(at + length <= c.at[doc + 1])
        if not len(use):
            continue
        at, pick, doc = at[use], pick[use], doc[use]
        head = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)]))
        found.append((doc[head], at[head] - c.at[doc[head]], np.diff(np.append(head, len(use))), pick[head]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keys(raw: memoryview, suffix: np.ndarray, first: np.ndarray, count: np.ndarray, length: int, gram: int) -> pa.Array:
    """The leading bytes of each suffix (filled up to whole words) and the digest of its segment."""
    fill = b"\0" * (-gram % 8)
    return pa.array([
        bytes(raw[s : s + gram]) + fill + hashlib.blake2b(raw[a : a + k - 1 + length], digest_size=16).digest()
        for s, a, k in zip(suffix.tolist(), first.tolist(), count.tolist(), strict=True)
    ], pa.binary())


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of strings of 64-bit characters (characters x strings).

    Each step parts the strings by one character's pivot into smaller, equal
    and larger ones; only the equal ones go on to the next character.
    """
    order = np.arange(words.shape[1])
    todo = [(0, words.shape[1], 0)]
    while todo:
        a, b, d = todo.pop()
        if b - a < 2 or d == len(words):
            continue
        some = order[a:b]
        if b - a <= SMALL:
            order[a:b] = some[np.lexsort(words[d:, some][::-1])]
            continue
        key = words[d, some]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        less, more = key < pivot, key > pivot
        order[a:b] = np.concatenate([some[less], some[~(less | more)], some[more]])
        i, j = a + int(less.sum()), b - int(more.sum())
        todo += [(a, i, d), (i, j, d + 1), (j, b, d)]
    return order


def _matrix(keys: pa.Array, *longs: pa.Array) -> np.ndarray:
    """The keys' bytes and the longs as 64-bit characters in order (characters x rows)."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    wide = int(at[1] - at[0]) // 8
    body = np.frombuffer(keys.buffers()[2], ">u8", wide * len(keys), int(at[0])).reshape(-1, wide)
    return np.concatenate([body.T.astype(U), np.stack([np.asarray(x).view(U) for x in longs])])


def _strings(words: np.ndarray) -> np.ndarray:
    """The same as fixed-width byte strings, which sort alike."""
    x = np.ascontiguousarray(words.T.astype(">u8"))
    return x.view(f"S{8 * x.shape[1]}").ravel()


def repeated(rows: DataFrame, sample: DataFrame, buckets: int, outer: int) -> DataFrame:
    """Sort (k, row, at) rows and give key, segment, row, at, full of those whose first ``outer`` bytes another row shares.

    ``key`` numbers the equal first bytes, ``segment`` the equal k; ``full`` says
    that another row shares the whole of k. ``sample`` holds some of the rows,
    for the splitters. The first and last row of each bucket, the only ones it
    can't decide, are compared on the driver.
    """
    drawn = sample.orderBy(F.xxhash64("row", "at")).limit(SAMPLED * buckets).select("k", "row", "at").toArrow()
    some = np.sort(_strings(_matrix(drawn["k"], drawn["row"].combine_chunks(), drawn["at"].combine_chunks()))) if len(drawn) else np.zeros(0, "S8")
    splitters = some[np.linspace(0, len(some), buckets, endpoint=False).astype(int)[1:]] if len(some) >= buckets > 1 else some[:0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                to = np.searchsorted(splitters, _strings(_matrix(b.column("k"), b.column("row"), b.column("at"))), side="right") if len(splitters) else np.zeros(len(b), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to.astype(np.int32))], [*b.schema.names, "bucket"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, parts = TaskContext.get().partitionId(), [b for b in batches if len(b)]
        if not parts:
            return
        words = np.concatenate([_matrix(b.column("k"), b.column("row"), b.column("at")) for b in parts], axis=1)
        del parts
        words = words[:, multikey_quicksort(words)]
        n, size = words.shape[1], len(words)
        edge = np.zeros(n, np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        flags, numbers = [], []
        for k in (outer // 8, size - 2):
            same = (words[:k, 1:] == words[:k, :-1]).all(0) if n > 1 else np.zeros(0, bool)
            flags.append(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            numbers.append((part << 40) + np.concatenate([[0], np.cumsum(~same)]))
        use = flags[0] | (edge > 0)
        k = _strings(words[: size - 2, edge > 0]).tolist()
        keys = np.full(n, None, object)
        keys[edge > 0] = [x.ljust(8 * (size - 2), b"\0") for x in k]
        cols = [*(pa.array(x[use]) for x in numbers), *(pa.array(words[i, use].view(np.int64)) for i in (size - 2, size - 1)), *(pa.array(x[use]) for x in flags), pa.array(edge[use]), pa.array(keys[use], pa.binary())]
        out = pa.RecordBatch.from_arrays(cols, ["key", "segment", "row", "at", "again", "full", "edge", "k"])
        for i in range(0, len(out), 50_000):
            yield out.slice(i, 50_000)

    dealt = rows.select("k", "row", "at").mapInArrow(deal, "k binary, row bigint, at bigint, bucket int").repartitionById(buckets, F.col("bucket")).select("k", "row", "at")
    found = written(dealt.mapInArrow(sort, "key bigint, segment bigint, row bigint, at bigint, again boolean, full boolean, edge int, k binary"))
    # two rows of each bucket at most
    edges = [r.asDict() for r in found.where("edge > 0").collect()]
    edges.sort(key=lambda r: (r["key"] >> 40, r["edge"] == 2))
    names: list[tuple[int, int]] = []  # of groups that go on from one bucket into the next
    for r, s in zip(edges, edges[1:]):
        if r["key"] >> 40 < s["key"] >> 40 and r["k"][:outer] == s["k"][:outer]:
            r["again"] = s["again"] = True
            names.append((s["key"], r["key"]))
            if r["k"] == s["k"]:
                r["full"] = s["full"] = True
                names.append((-1 - s["segment"], -1 - r["segment"]))
    whole: dict[int, int] = {}
    for late, early in names:
        whole[late] = whole.get(early, early)
    spark, kind = rows.sparkSession, "key bigint, segment bigint, row bigint, at bigint, full boolean"
    out = found.where("again AND edge = 0").select("key", "segment", "row", "at", "full")
    out = out.unionByName(spark.createDataFrame([tuple(r[c] for c in ("key", "segment", "row", "at", "full")) for r in edges if r["again"]], kind))
    if whole:  # a row for each bucket at most
        first = lambda sign: F.broadcast(spark.createDataFrame([(a if a >= 0 else -1 - a, b if b >= 0 else -1 - b) for a, b in whole.items() if (a >= 0) == sign], "a bigint, b bigint"))
        out = out.join(first(True), F.col("key") == F.col("a"), "left").withColumn("key", F.coalesce("b", "key")).drop("a", "b")
        out = out.join(first(False), F.col("segment") == F.col("a"), "left").withColumn("segment", F.coalesce("b", "segment")).drop("a", "b")
    return out.select("key", "segment", "row", "at", "full")


def repeats(docs: DataFrame, length: int = LENGTH, big: int = BIG) -> DataFrame:
    """row, first, last (byte after the end): intervals of repeated bytes of written (row, text) rows."""
    gram = min(GRAM, length)
    if length - gram + 1 >= 1 << _SHIFT:
        raise ValueError("strings of at most 65,000 bytes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.asarray(b.column("row"))
            for c in chunks(b.column("text")):
                doc, first, count, suffix = segments(c, length, gram)
                for i in range(0, len(doc), 100_000):
                    d, f, k = (x[i : i + 100_000] for x in (doc, first, count))
                    key = _keys(memoryview(c.data), suffix[i : i + 100_000], f + c.at[d], k, length, gram)
                    yield pa.RecordBatch.from_arrays([key, pa.array(row[d + c.first]), pa.array(f << _SHIFT | k)], ["k", "row", "at"])

    size, kind = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, "k binary, row bigint, at bigint"
    buckets = max(partitions(docs), -(-size // BUCKET))
    share = min(1.0, 4 * SAMPLED * buckets * (length - gram + 2) / 2 / max(size, 1))
    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    lead = gram + -gram % 8
    again = written(repeated(docs.mapInArrow(cut, kind), some.mapInArrow(cut, kind), buckets, lead))
    first, n = F.shiftrightunsigned("at", _SHIFT), F.col("at").bitwiseAND((1 << _SHIFT) - 1)
    whole = again.where("full").select("row", first.alias("first"), (first + n + (length - 1)).alias("last"))
    unsure = again.where("NOT full").select("key", "row", "at")
    # a window may also be repeated inside a segment that is repeated as a whole: one of each kind stands for all
    stand = again.where("full").groupBy("key", "segment").agg(F.min(F.struct("row", "at")).alias("m")).select("key", "m.row", "m.at")
    look = written(unsure.unionByName(stand.join(unsure.select("key").distinct(), "key", "left_semi")))
    look = look.join(look.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    runs = look.groupBy("row").agg(F.collect_set(F.struct("key", "at", "size")).alias("runs"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments' bytes, or of the suffixes that more than ``big`` of them have, their windows as segments of one."""
        names = ["key", "row", "at", "bytes", "k"]
        for b in batches:
            for i in range(len(b)):
                raw = memoryview(b.column("text")[i].as_buffer())
                runs = b.column("runs")[i].values
                row = b.column("row")[i].as_py()
                key, at, size = (np.asarray(runs.field(c)) for c in ("key", "at", "size"))
                first, n = at >> _SHIFT, at & ((1 << _SHIFT) - 1)
                for few in np.array_split(np.flatnonzero(size <= big), max(1, len(at) // 10_000)):
                    texts = [bytes(raw[f : f + k - 1 + length]) for f, k in zip(first[few].tolist(), n[few].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[few]), pa.array(np.full(len(few), row)), pa.array(at[few]), pa.array(texts, pa.binary()), pa.nulls(len(few), pa.binary())], names)
                for hot in np.array_split(np.flatnonzero(size > big), max(1, len(at) // 1000)):
                    a = np.repeat(first[hot], n[hot]) + np.arange(int(n[hot].sum())) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    k = _keys(raw, a, a, np.ones(len(a), np.int64), length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key[hot], n[hot])), pa.array(np.full(len(a), row)), pa.array(a << _SHIFT | 1), pa.nulls(len(a), pa.binary()), k], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each suffix's segments (at most ``big``, and those that stand for others), the windows that two have."""
        at, pool, group, size = None, [], [], 0

        def give() -> pa.RecordBatch:
            """Equal windows have one suffix, so whole groups can be looked through together."""
            row, first, texts = zip(*pool, strict=True)
            n = np.array([len(x) - length + 1 for x in texts])
            begin = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            twice = equal_windows(np.frombuffer(b"".join(texts), np.uint8), np.repeat(begin, n) + place, length)
            on = twice & ~(np.concatenate([[False], twice[:-1]]) & (place > 0))
            off = twice & ~(np.concatenate([twice[1:], [False]]) & (np.append(place[1:], 0) > 0))
            k = np.repeat(np.arange(len(n)), n)
            row, first = np.array(row), np.array(first)
            return pa.RecordBatch.from_arrays([pa.array(row[k[on]]), pa.array(first[k[on]] + place[on]), pa.array(first[k[off]] + place[off] + length)], ["row", "first", "last"])

        for b in batches:
            for key, row, place, x in zip(*(b.column(c).to_pylist() for c in ("key", "row", "at", "bytes")), strict=True):
                if key != at:
                    if len(group) > 1:
                        pool += group
                        size += sum(len(g[2]) for g in group)
                    at, group = key, []
                    if size > 1_000_000:
                        yield give()
                        pool, size = [], 0
                group.append((row, place >> _SHIFT, x))
        if len(group) > 1:
            pool += group
        if pool:
            yield give()

    fine = written(docs.join(runs, "row").mapInArrow(pieces, "key bigint, row bigint, at bigint, bytes binary, k binary"))
    small = fine.where("bytes IS NOT NULL").select("key", "row", "at", "bytes")
    small = small.repartition(partitions(docs), "key").sortWithinPartitions("key", "row", "at").mapInArrow(compare, "row bigint, first bigint, last bigint")
    out = whole.unionByName(small)
    hot = fine.where("k IS NOT NULL").select("k", "row", "at")
    if windows := hot.count():
        per = max(partitions(docs), -(-windows // 400_000))
        share = min(1.0, 4 * SAMPLED * per / windows)
        some = hot.where(F.pmod(F.xxhash64("row", "at"), F.lit(1 << 20)) <= int(share * (1 << 20)))
        out = out.unionByName(repeated(hot, some, per, lead).where("full").select("row", first.alias("first"), (first + length).alias("last")))
    return out


def equal_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows that start at ``at`` another one equals: hashes bring them together, their bytes decide."""
    h = Spans(data).hash(at, at + length)
    order = np.argsort(h, kind="stable")
    pairs = np.flatnonzero(h[order][1:] == h[order][:-1])
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    out = np.zeros(len(at), bool)
    wrong = []
    for i in range(0, len(pairs), 20_000):
        a, b = order[pairs[i : i + 20_000]], order[pairs[i : i + 20_000] + 1]
        same = (view[at[a]] == view[at[b]]).all(1)
        out[a[same]] = out[b[same]] = True
        wrong += a[~same].tolist()
    for x in {int(h[k]) for k in wrong}:  # two strings of one hash: each with all others of it
        seen: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(h == U(x)).tolist():
            seen.setdefault(view[at[k]].tobytes(), []).append(k)
        for ks in seen.values():
            out[ks] = len(ks) > 1
    return out


def _strip(text: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for t, s in zip(text, spans, strict=True):
        raw = t.as_py() or b""
        if not s.is_valid:
            rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
            continue
        depth = np.zeros(len(raw) + 1, np.int64)
        np.add.at(depth, np.asarray(s.values.field("first")), 1)
        np.add.at(depth, np.asarray(s.values.field("last")), -1)
        gone = np.cumsum(depth)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        rows.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


_strip.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    base = written(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")))
    found = repeats(base.select("row", "text"), length)
    spans = found.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])
    strip = F.arrow_udf(_strip, kind)
    return base.join(spans, "row", "left").select("doc_id", strip("text", "spans").alias("v")).select("doc_id", "v.*")
