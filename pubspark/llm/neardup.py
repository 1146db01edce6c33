"""MinHash near-duplicates by a multi-index Hamming join, with exact links.

Each document's set of word shingles gets ``SYMBOLS`` MinHash values cut to 16
bits, in chunks of ``WIDTH``. By the pigeonhole principle two signatures that
differ in at most CHUNKS * (ERRORS + 1) - 1 = 15 symbols have a chunk that
differs in at most one; the allowed error is enumerated, so that each chunk
gives a key for each symbol left out, and such pairs share a key for certain.
A pair of similarity 0.85 shares none with probability 2e-8 (at 0.8: 1e-6).

Documents with the same words in the same order (by a 128-bit BLAKE2 digest of
them) are one class from the start, and classes are what is compared: a class
is known by its smallest doc_id and 64 bits of its digest, so that an id with
several texts has several. In each bucket all classes are first compared with
one of the smallest id: most groups of near copies become one component that
way, in linear time. Only classes of buckets that are still in several
components go on: prefix filtering, which loses nothing, gives their pairs of
different components that may be similar; a frequent shingle's pairs are split
by set size and salt over many tasks. Every link is confirmed on the full sets.

Cases: null and empty texts, and those without words, have no shingles and are
linked with nothing; a text of fewer than five words has its whole sequence as
its one shingle; rows without doc_id are linked with nothing, have no
component and are kept (``drop_near_duplicates`` keeps one row of each
component, and of equal texts without doc_id one, or none if a row with an id
has that text); equal rows are one class; rows with one doc_id but different
texts share a component; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .shared import TEXTS, tasks, written
from .words import LOWER, Chunk, Spans, U, chunks, mix, windows

SHINGLE = 5
SALTED = 2000  # so many sets of one shingle and size are compared in one task
SHINGLES = 1 << 18  # rows of shingles that a task writes at least, if there are so many
SYMBOLS, WIDTH, ERRORS = 32, 4, 1
CHUNKS = SYMBOLS // WIDTH
_RNG = np.random.default_rng(85)
_A = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * U(2) + U(1)
_B = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_SIGN = T.StructType([T.StructField("n", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def shingle_hashes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes and documents, in order of documents."""
    start, end, doc = c.words()
    h = Spans(LOWER[c.data]).hash(start, end)
    g, at = windows(h, doc, SHINGLE)
    parts, docs = [g], [doc[at]]
    words = np.bincount(doc, minlength=c.n)
    for k in range(1, SHINGLE):
        short = words[doc] == k if len(doc) else np.zeros(0, bool)
        if short.any():
            g, at = windows(h[short], doc[short], k)
            parts.append(mix(g + U(k)))
            docs.append(doc[short][at])
    g, d = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if not len(g):
        return g, d
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
    return g[new], d[new]


def digests(c: Chunk) -> np.ndarray:
    """Of each document a digest of its words in lower case, as two numbers (n x 2)."""
    raw = c.data.tobytes()
    words = (b" ".join(raw[a:b].lower().split()) for a, b in zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True))
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words), U).reshape(-1, 2)


def sign(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: set size, two halves of its words' digest, and the keys (n x CHUNKS * WIDTH)."""
    g, d = shingle_hashes(c)
    n = np.bincount(d, minlength=c.n).astype(np.int64)
    full = np.flatnonzero(n)
    lo, hi = digests(c).T
    keys = np.zeros((c.n, CHUNKS * WIDTH), U)
    if len(full):
        head = np.searchsorted(d, full)
        sym = np.stack([np.minimum.reduceat(g * a + b, head) for a, b in zip(_A, _B, strict=True)], 1)
        sym = mix(sym) & U(0xFFFF)
        for c_ in range(CHUNKS):
            for j in range(WIDTH):
                k = np.full(len(full), c_ * WIDTH + j + 1, U)
                for i in range(WIDTH):
                    if i != j:
                        k = k << U(16) | sym[:, c_ * WIDTH + i]
                keys[full, c_ * WIDTH + j] = mix(k)
    return n, lo, hi, keys


@F.arrow_udf(_SIGN)
def signature(text: pa.Array) -> pa.Array:
    parts = [sign(c) for c in chunks(text)]
    n, lo, hi, keys = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros((0, CHUNKS * WIDTH), U))
    at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1])
    return pa.StructArray.from_arrays([pa.array(n), pa.array(np.ascontiguousarray(lo).view(np.int64)), pa.array(np.ascontiguousarray(hi).view(np.int64)), pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))], ["n", "lo", "hi", "keys"])


def shingles(text: bytes) -> set:
    """A text's exact set."""
    w = text.lower().split()
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs of classes (a, ta), (b, tb) whose sets' intersection is at least ``percent`` of their union."""
    ta = texts.select(F.col("rep").alias("a"), F.col("tie").alias("ta"), F.col("text").alias("xa"))
    tb = texts.select(F.col("rep").alias("b"), F.col("tie").alias("tb"), F.col("text").alias("xb"))
    rows = pairs.join(tb, ["b", "tb"]).join(ta, ["a", "ta"]).select("a", "ta", "b", "tb", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict = OrderedDict()  # sets of a few texts on the side that repeats

        for batch in batches:
            keep = []
            for a, tie, xa, xb in zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("xa"), batch.column("xb"), strict=True):
                if (a, tie) not in recent:
                    recent[a, tie] = shingles(xa.as_buffer().to_pybytes())
                    if len(recent) > 16:
                        recent.popitem(last=False)
                x, y = recent[a, tie], shingles(xb.as_buffer().to_pybytes())
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text (as bytes) and signature of each row, written once."""
    return written(docs.select("doc_id", F.col("text").cast("binary").alias("text"), signature("text").alias("s")).select("doc_id", "text", "s.*"))


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    return _components(_signed(docs), percent).select("doc_id", "n_shingles", "component_id", "kept")


def _components(signed: DataFrame, percent: int) -> DataFrame:
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    size = signed.count()
    sets = written(full.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.any_value("keys").alias("keys")), size, TEXTS)
    ids = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))  # an id with several texts links its classes
    many = written(ids.where("rows > 1").select("doc_id"), size)
    again = not many.isEmpty()
    own = full.join(many, "doc_id", "left_semi").join(sets, ["lo", "hi"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    keyed = sets.select("rep", F.col("lo").alias("tie"), F.explode("keys").alias("key"))
    leads = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.min_by("tie", "rep").alias("lead_tie"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared = written(keyed.join(leads, "key"), size * CHUNKS * WIDTH)
    inside = shared.select("rep", "tie").distinct()
    texts = full.select(F.col("doc_id").alias("rep"), F.col("lo").alias("tie"), "n", "text").join(inside, ["rep", "tie"], "left_semi")
    if again:  # one text of each class; without repeated ids there is only one
        texts = texts.groupBy("rep", "tie").agg(F.min("n").alias("n"), F.min("text").alias("text"))
    texts = written(texts, size, TEXTS)
    pairs = shared.where("rep <> lead OR tie <> lead_tie").select(F.col("lead").alias("a"), F.col("lead_tie").alias("ta"), F.col("rep").alias("b"), F.col("tie").alias("tb")).distinct()
    links = written(confirmed(pairs, texts, percent), size, dealt=True)
    parts = written(components(links.unionByName(own), size), size)
    # buckets of several components: every pair of different ones that can be similar
    part = shared.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = part.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = written(part.join(mixed, "key", "left_semi").select("rep", "tie", "component").distinct(), size)
    met = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("tb").alias("ta"), F.col("a").alias("b"), F.col("ta").alias("tb")))
    more = _prefix_pairs(texts, rest, percent).join(met, ["a", "ta", "b", "tb"], "left_anti")
    late = written(confirmed(more, texts, percent), size, dealt=True)
    if not late.isEmpty():
        parts = written(components(links.unionByName(late).unionByName(own), size), size)
    found = signed.select("doc_id", F.col("n").alias("n_shingles"), "lo", "hi").join(sets.select("lo", "hi", "rep"), ["lo", "hi"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("n_shingles") > 0, F.col("rep")), "doc_id"))
    return found.select("doc_id", "n_shingles", "lo", "hi", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _prefix_pairs(texts: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, ta), (b, tb) of different components that may be similar, by prefix filtering.

    Of two sets whose similarity is at least the threshold, each has a shingle
    of the other's among its n - ceil(threshold * n) + 1 rarest. Shingles that
    one document alone has fill a prefix without meeting any other, so a group
    of copies that differ too much makes few pairs or none. Shingles of one
    component are left out; the rest meet by shingle and size, as sizes of
    similar sets lie in the same band of the threshold's powers or in
    neighbouring ones, and a band of many sets is split by salt.
    """
    kind = texts.schema["rep"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text")):
                g, d = shingle_hashes(c)
                at = pa.array(d + c.first)
                yield pa.RecordBatch.from_arrays([b.column("rep").take(at), b.column("tie").take(at), b.column("n").take(at), pa.array(g.view(np.int64))], ["rep", "tie", "n", "g"])

    each = texts.join(rest.select("rep", "tie"), ["rep", "tie"], "left_semi").select("rep", "tie", "n", "text").mapInArrow(cut, f"rep {kind}, tie bigint, n bigint, g bigint")
    each = written(each)
    most = each.count()
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    n_often = each.join(often, "g")
    # the shingles that are a document's alone come first in its order; they meet nobody
    own = Window.partitionBy("rep", "tie")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "g"))
    head = n_often.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 1e-9) if percent < 100 else F.col("n")
    head = written(head.join(rest, ["rep", "tie"]).select("g", "rep", "tie", "n", "component", "place", band.cast("long").alias("band")), most, SHINGLES)
    mixed = head.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("g")
    head = written(head.join(mixed, "g", "left_semi"), most, SHINGLES)
    salts = head.groupBy("g", "band").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
    a = head.join(salts, ["g", "band"]).select("g", "band", F.pmod(F.xxhash64("rep", "tie"), "salts").cast("int").alias("salt"), F.col("rep").alias("a"), F.col("tie").alias("ta"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("place").alias("pa"))
    near = head.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(salts, ["g", "band"])
    b = near.select("g", "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("rep").alias("b"), F.col("tie").alias("tb"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("place").alias("pb"))
    can = (F.col("ca") < F.col("cb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    # at a pair's first common shingle, what is left of both sets must hold the overlap that the threshold asks for
    left = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    can = can & (left * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return a.join(b, ["g", "band", "salt"]).where(can).select("a", "ta", "b", "tb").distinct()


def _one(rows: DataFrame, *by: str) -> DataFrame:
    """One row of each group: of the least text, then of the least hash of all columns."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    order = F.struct(F.coalesce(F.col("text"), F.lit("")), F.xxhash64(*(F.col(c).cast("string") for c in rows.columns)))
    return rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min_by(whole, order).alias("__r")).select("__r.*")


def text_digest() -> Column:
    """A column: the digest of the text's words, the same for all that are one class."""

    @F.arrow_udf(T.BinaryType())
    def digest(text: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for c in chunks(text) for x in digests(c)], pa.binary())

    return digest(F.col("text"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component, of its smallest doc_id, and one of each text that only rows without doc_id have, with all columns."""
    signed = _signed(docs)
    size = signed.count()
    found = written(_components(signed, percent), size)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
    ids = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0")
    if not ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        worded = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
        some = left.where("doc_id IS NOT NULL")
        left = _one(some.where(worded), "doc_id").unionByName(some.where(~F.coalesce(worded, F.lit(False)))).unionByName(left.where("doc_id IS NULL"))
    if not found.where("doc_id IS NULL").isEmpty():
        known = found.where("doc_id IS NOT NULL").select("lo", "hi").distinct()
        none = left.where("doc_id IS NULL").withColumn("__d", text_digest())
        worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        fresh = none.where(worded).join(known.select(F.concat(_bytes("lo"), _bytes("hi")).alias("__d")), "__d", "left_anti")
        left = left.where("doc_id IS NOT NULL").unionByName(_one(fresh, "__d").drop("__d")).unionByName(none.where(~worded).drop("__d"))
    return left.coalesce(tasks(size, TEXTS))


def _bytes(c: str) -> Column:
    """A long as its 8 bytes, the lowest first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8))))
