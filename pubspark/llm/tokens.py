"""Token ids in Parquet files for selective reads.

``write_tokens`` deals documents by ranges of doc_id, as many as the texts' size
asks for (``FILE_BYTES`` each) and at least ``PER_CORE`` for each core (but no more than shuffle partitions),
encodes each range in order and writes one file for each, with the columns doc_id, part, local_start
(ids before the row in its file), n_tokens and tokens, a list of 32-bit ids.
Tokens are dictionary-encoded (a vocabulary is far smaller than a row group),
the other columns delta-encoded (version 2 pages). Row groups and pages have
fixed sizes and the page index is written, so a reader that filters by doc_id
or leaves out ``tokens`` reads only the pages it needs. ``read_tokens`` reads
such a folder and turns local starts into starts in the whole token stream.

Encoding goes word by word through a bounded cache: the vocabulary's pattern
never crosses white space, so a text's ids are its words' ids in a row.

Cases: a null or empty text has the end id alone; rows with the same doc_id
all stay, in order of their text's hash; null ids come first; further columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import partitions, shared_dir

CACHE = 600_000  # words that a worker keeps; beyond it the cache starts anew
FILE_BYTES = 64 << 20  # of text, about, in one file
PER_CORE = 4  # files for each core, where the texts fill fewer; Hadoop starts processes for each local file
FEW_FILES = 1_000_000  # files whose starts are broadcast (24 bytes each); those of more are joined by a shuffle
GROUP = 256  # documents whose unknown words are encoded in one call
_WRITE = {
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false", "parquet.enable.dictionary#n_tokens": "false",
    "parquet.page.row.count.limit": "2000", "parquet.page.size": str(256 << 10), "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}
MARKS = string.punctuation.replace("'", "").encode()  # an apostrophe may begin a contraction
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as little-endian 32-bit integers, by a cache of words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        # the same model for words that its normaliser and pattern leave whole, in the byte alphabet, with spaces between
        from tokenizers import normalizers, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.inner.normalizer = normalizers.Sequence([])
        self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)} | {0x20: 0x20}  # that one parts the words

    @staticmethod
    def of(path: str) -> WordEncoder:
        return _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))

    @staticmethod
    def whole(w: bytes) -> bytes | None:
        """A word of composed letters of the Latin blocks in lower case, which is all that normaliser and pattern make of it; else none."""
        t = w.decode("utf-8", "replace")
        if t.isalpha() and max(t) < "\u0250" and unicodedata.is_normalized("NFC", t):
            u = t.lower()
            if len(u) == len(t) and max(u) < "\u0250":
                return u.encode()
        return None

    def parted(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """The words that end in marks, and both parts: the pattern parts a letter or digit from the marks after it."""
        for w in words:
            v = w.rstrip(MARKS)
            if 0 < len(v) < len(w):
                last = v[-1:] if v[-1] < 128 else v[-2:].decode("utf-8", "replace")[-1]
                if last.isalnum() if v[-1] < 128 else last.isalpha() and last.lower().isalpha() and last < "\u0250":  # not a letter that becomes two
                    yield w, v, w[len(v) :]

    def learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        both = list(self.parted(other))
        heads = {v for _, v, _ in both}.difference(self.cache, plain)
        plain += [v for v in heads if v.isalpha()]
        rest = list({v for v in heads if not v.isalpha()}.union(other).difference([w for w, _, _ in both]))
        latin = {w: u for w in rest if (u := self.whole(w))}
        rest = [w for w in rest if w not in latin]
        for some, shown in ((plain, plain), (list(latin), list(latin.values()))):
            for i in range(0, len(some), 1024):
                part = some[i : i + 1024]
                text = b" ".join(shown[i : i + 1024]).decode("latin-1")
                if some is not plain:
                    text = text.translate(self.alphabet)
                ids = np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                cuts = np.flatnonzero(self.ends[ids]) + 1  # each of these words ends in one word-end piece
                if len(cuts) != len(part):
                    rest += part
                    continue
                raw, at = ids.tobytes(), (cuts * 4).tolist()
                self.cache.update(zip(part, [raw[a:b] for a, b in zip([0, *at], at)], strict=True))
        rest += {m for _, _, m in both}.difference(self.cache)
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        self.cache.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(rest, found, strict=True))
        self.cache.update([(w, self.cache[v] + self.cache[m]) for w, v, m in both])

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for i in range(0, len(texts), GROUP):
            split = [(t or b"").lower().split() for t in texts[i : i + GROUP]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = [list(map(self.cache.get, s)) for s in split]
            holes = [[k for k, x in enumerate(f) if x is None] if None in f else () for f in found]
            if fresh := {s[k] for s, h in zip(split, holes, strict=True) for k in h}:
                self.learn(list(fresh))
            for s, f, h in zip(split, found, holes, strict=True):
                for k in h:
                    f[k] = self.cache[s[k]]
            yield from map(b"".join, found)  # only now: whoever takes them may encode other texts between


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, row_group_bytes: int = 32 << 20) -> None:
    end = np.int32(end_id).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = WordEncoder.of(tokenizer), 0
        for batch in batches:
            for i in range(0, len(batch), 1024):
                b = batch.slice(i, 1024)
                raw = [x + end for x in enc.encode(b.column("text").cast(pa.binary()).to_pylist())]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(start + at[:-1]), pa.array(n), tokens], ["doc_id", "part", "local_start", "n_tokens", "tokens"])
                start += int(at[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-size // FILE_BYTES), min(partitions(docs), PER_CORE * docs.sparkSession.sparkContext.defaultParallelism))
    # by text too, so that the rows of one id may lie in several files
    dealt = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    rows = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, f"doc_id {kind}, part int, local_start bigint, n_tokens bigint, tokens array<int>")
    rows.write.options(**_WRITE, **{"parquet.block.size": str(row_group_bytes)}).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and tokens (or the named ones of them)."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    parts = parts.select("part", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    few = rows.groupBy("part").agg(F.lit(1)).count() <= FEW_FILES
    out = rows.join(F.broadcast(parts) if few else parts, "part").withColumn("start", F.col("local_start") + F.col("__before"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "tokens"]))


def _crc(tokens: pa.Array) -> pa.Array:
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    at = np.asarray(tokens.offsets)
    values = np.asarray(tokens.values).astype("<u4", copy=False)
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())


def ids_crc32():
    """A column function: unsigned crc32 of a list of ids as little-endian unsigned 32-bit integers."""
    return F.arrow_udf(_crc, T.LongType())


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files, read them back: doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    write_tokens(docs, path, tokenizer, end_id)
    rows = read_tokens(spark, path)
    return rows.select("doc_id", "start", "n_tokens", ids_crc32()("tokens").alias("ids_crc32"))
