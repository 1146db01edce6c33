"""SentencePiece models run by the tokenizers library.

``load`` parses the model's protobuf by its wire format and rebuilds the
normaliser (dummy prefix, metaspace marker), the unigram scores or the merges
that a BPE model's scores stand for, and byte fallback. ``PieceCodec`` encodes
batches in the library's threads (``spark.task.cpus`` of them), chunk by chunk through a bounded cache: where
no piece has a marker after another character, texts can be cut before each
run of markers (a marker character in the text counts as a space, as in the
model). Decoding is the library's decoder, batch by batch, too. ``parity``
compares ids with the sentencepiece library itself.

Cases: a null or empty text has no ids and decodes to the empty text; rows
with equal ids or texts are encoded alike; every byte has a piece, so only a
marker character in the text itself does not come back (it decodes to a space).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Spans, U

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # the protobuf's piece types
UNIGRAM, BPE = 1, 2  # its model types
CACHE = 3_000_000  # chunks that a worker keeps (some 40 bytes each); beyond it the cache starts anew
RECENT = 200_000  # so many new ones are kept apart before they are sorted in
GROUP = 256


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    charsmap: bytes = b""
    suffix: bool = False


def parse(raw: bytes) -> Model:
    m = Model()
    for k, v in _fields(raw):
        if k == 1:
            p: dict = {1: b"", 2: 0.0, 3: NORMAL}
            p.update(_fields(v))
            m.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if p[2] else 0.0, p[3]))
        elif k == 2:
            t = dict(_fields(v))
            m.kind, m.byte_fallback, m.suffix = t.get(3, UNIGRAM), bool(t.get(35, 0)), bool(t.get(24, 0))
        elif k == 3:
            t = dict(_fields(v))
            m.charsmap, m.dummy_prefix, m.trim, m.escape = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
    return m


def build(m: Model):
    """A tokenizers.Tokenizer of the parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if any(t == USER for *_, t in m.pieces) or m.suffix or not m.escape:
        raise ValueError("user-defined pieces, suffix markers and plain spaces are not supported")
    unknown = next(i for i, (*_, t) in enumerate(m.pieces) if t == UNKNOWN)
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, m.byte_fallback)
    elif m.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        score = {p: s for p, s, t in m.pieces if t == NORMAL}
        # a merge makes the piece of highest score that two neighbours form, however they split it
        merges = sorted(((-score[p], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score))
        core = models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    # fused first, so that one text is searched for markers instead of every piece
    t.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


@dataclass
class Table:
    """Chunks by their sorted hashes: where each one's ids begin (n + 1), and all ids."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginning and number of the ids of each hash, and whether it is here."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.at[k], self.at[k + 1] - self.at[k], self.hashes[k] == h

    def with_more(self, other: Table) -> Table:
        both = np.concatenate([self.hashes, other.hashes])
        order = np.argsort(both, kind="stable")
        begin = np.concatenate([self.at[:-1], other.at[:-1] + len(self.ids)])[order]
        size = np.concatenate([np.diff(self.at), np.diff(other.at)])[order]
        return Table(both[order], np.concatenate([[0], np.cumsum(size)]), _gather(np.concatenate([self.ids, other.ids]), begin, size))


class PieceCodec:
    _loaded: dict[str, PieceCodec] = {}

    def __init__(self, path: str):
        # as many of the library's threads as the task has cores: more of them only wait for each other
        task = TaskContext.get()
        cores = task.cpus() if task else os.cpu_count() or 1
        os.environ.setdefault("RAYON_NUM_THREADS", str(cores))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if cores > 1 else "false")
        self.path = path
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.tokenizer = build(self.model)
        plain = [p for p, _, t in self.model.pieces if t == NORMAL]
        #: Whether texts may be cut before markers and line breaks: no piece crosses such a place, and nothing else changes the text.
        self.cuts = not (self.model.charsmap or self.model.trim) and self.model.dummy_prefix and all(MARK not in p.lstrip(MARK) and "\n" not in p for p in plain)
        #: Marks that no piece has right after a letter, so that a chunk can be cut there too.
        self.stops = "".join(x for x in ".,;:!?" if not any(a.isalpha() and b == x for p in plain for a, b in zip(p, p[1:])))
        from tokenizers import normalizers, pre_tokenizers

        self.inner = build(self.model)  # encodes chunks, which have their markers already
        self.inner.normalizer = normalizers.Sequence([])
        self.joined = build(self.model)  # encodes many chunks of one marker each as one text
        self.joined.normalizer = normalizers.Sequence([])
        self.joined.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.begins = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.forget()
        kinds = np.array([t for *_, t in self.model.pieces])
        self.silent, self.unknown = kinds == CONTROL, int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.mark = next((i for i, (p, *_) in enumerate(self.model.pieces) if p == MARK), self.unknown)

    @staticmethod
    def of(path: str) -> PieceCodec:
        return PieceCodec._loaded.get(path) or PieceCodec._loaded.setdefault(path, PieceCodec(path))

    def forget(self) -> None:
        """Empty the cache: a large and a small table of chunks."""
        self.old, self.recent = Table(), Table()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        found: dict[str, bytes] = {}
        stop = [c for c in chunks if c[-1] in self.stops and c[-2:-1].isalpha()]
        apart = set(stop)
        todo = list(dict.fromkeys([*(c for c in chunks if c not in apart), *(x for c in stop for x in (c[:-1], c[-1]))]))
        plain = [c for c in todo if c[0] == " " and c[1:2] not in ("", " ")]
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self.joined.encode_batch_fast(["".join(some).replace(" ", MARK)], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.begins[ids])  # a marker begins a chunk, and each chunk has one
            if len(at) == len(some) and at[0] == 0:  # else one by one, below
                raw, cut = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
                found.update(zip(some, (raw[a:b] for a, b in zip(cut, cut[1:])), strict=True))
        todo = [c for c in todo if c not in found]
        for i in range(0, len(todo), 8192):
            some = todo[i : i + 8192]
            each = self.inner.encode_batch_fast([c.replace(" ", MARK) for c in some], add_special_tokens=False)
            found.update((c, np.array(e.ids, np.int32).tobytes()) for c, e in zip(some, each, strict=True))
        return [found[c[:-1]] + found[c[-1]] if c in apart else found[c] for c in chunks]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers."""
        for i in range(0, len(texts), GROUP):
            some = [t or "" for t in texts[i : i + GROUP]]
            if not self.cuts:
                yield from (np.array(e.ids, np.int32).tobytes() if t else b"" for t, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True))
            else:
                yield from self._by_chunks([(" " + t.replace(MARK, " ")).encode() if t else b"" for t in some])

    def _by_chunks(self, texts: list[bytes]) -> list[bytes]:
        """Cut before each run of spaces or line breaks (a word goes with the spaces before it) and put the chunks' ids together."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(data):
            return [b""] * len(texts)
        space, line = data == 32, data == 10
        after = lambda x: np.concatenate([[False], x[:-1]])
        new = (space & ~after(space)) | (line & ~after(line)) | (~space & ~line & after(line))
        new[first[:-1][first[:-1] < first[1:]]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))
        h = Spans(data).hash(start, end)
        if len(self.old.hashes) > CACHE:
            self.forget()
        if len(self.recent.hashes) > RECENT:
            self.old, self.recent = self.old.with_more(self.recent), Table()
        begin, sizes, there = self.old.look(h)
        rest = np.flatnonzero(~there)
        fresh = rest[~self.recent.look(h[rest])[2]]
        if len(fresh):
            hashes, where = np.unique(h[fresh], return_index=True)
            where, raw = fresh[where], data.tobytes()
            learnt = self.learn([raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in learnt])]).astype(np.int64)
            self.recent = self.recent.with_more(Table(hashes, at, np.frombuffer(b"".join(learnt), np.int32)))
        begin[rest], sizes[rest], _ = self.recent.look(h[rest])
        to = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        for table, some in ((self.old, np.flatnonzero(there)), (self.recent, rest)):
            ids[_places(to[some], sizes[some])] = table.ids[_places(begin[some], sizes[some])]
        out = ids.tobytes()
        total = np.concatenate([[0], np.cumsum(sizes)])
        cut = (total[np.searchsorted(start, first)] * 4).tolist()
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, raw: list[bytes]) -> list[str]:
        """The texts of lists of ids (little-endian 32-bit integers), by the library's decoder; control pieces say nothing."""
        out: list[str] = []
        for i in range(0, len(raw), GROUP):
            some = [np.frombuffer(x, np.int32) for x in raw[i : i + GROUP]]
            some = [x[~self.silent[x]] if self.silent[x].any() else x for x in some]
            found = self.tokenizer.decode_batch([x.tolist() for x in some], skip_special_tokens=False)
            for k, x in enumerate(some):
                if (x == self.unknown).any():  # the library has no sign for it
                    found[k] = self._with_unknown(x)
            out += found
        return out

    def _with_unknown(self, ids: np.ndarray) -> str:
        """The unknown piece stands as a sign between spaces, as in the sentencepiece library."""
        parts = [p for p in np.split(ids, np.flatnonzero(ids == self.unknown))]
        texts = [self.tokenizer.decode([self.mark, *p[p != self.unknown].tolist()], skip_special_tokens=False) for p in parts]
        text = " \u2047 ".join(texts)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def parity(self, text: str, raw: bytes | None = None) -> bool:
        """Whether the sentencepiece library gives the same ids (``raw``, where the text is encoded already)."""
        import sentencepiece

        if not hasattr(self, "other"):
            self.other = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return np.array(self.other.encode(text), np.int32).tobytes() == (next(self.encode([text])) if raw is None else raw)


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values of given beginnings and sizes, one after another."""
    return values[_places(begin, size)]


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of each run."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encode_column(path: str):
    """A column function of the text: its ids."""

    def run(text: pa.Array) -> pa.Array:
        raw = list(PieceCodec.of(path).encode(text.to_pylist()))
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


def decode_column(path: str):
    """A column function of the ids: the text."""

    def run(ids: pa.Array) -> pa.Array:
        at, values = np.asarray(ids.offsets), np.asarray(ids.values).astype(np.int32, copy=False)
        return pa.array(PieceCodec.of(path).decode([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]), pa.string())

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens (ids) and n_tokens of each document, round_trip (the decoded text is the text) and parity (the sentencepiece library's ids are the same)."""
    kind = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])

    def run(text: pa.Array) -> pa.Array:
        codec, texts = PieceCodec.of(path), [t or "" for t in text.to_pylist()]
        raw = list(codec.encode(texts))
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int32)))
        back = pa.array([x == t for t, x in zip(texts, codec.decode(raw), strict=True)], pa.bool_())
        same = pa.array([codec.parity(t, x) for t, x in zip(texts, raw, strict=True)], pa.bool_())
        return pa.StructArray.from_arrays([ids, back, same], kind.names)

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    out = docs.select("doc_id", F.arrow_udf(run, kind)(F.col("text")).alias("v"))
    return out.select("doc_id", "v.tokens", F.size("v.tokens").cast("long").alias("n_tokens"), "v.round_trip", "v.parity")


def codec_digest(docs: DataFrame, path: str, every: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32 (of the decoded text's UTF-8), round_trip (the decoded text is the text) and parity.

    parity compares with the sentencepiece library where crc32(doc_id as text) is divisible by ``every`` (every row by default), and is null elsewhere.
    """
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])

    def run(text: pa.Array, test: pa.Array) -> pa.Array:
        codec, texts = PieceCodec.of(path), [t or "" for t in text.to_pylist()]
        ids, rows = list(codec.encode(texts)), []
        for t, asked, raw, back in zip(texts, test.to_pylist(), ids, codec.decode(ids), strict=True):
            rows.append((len(raw) // 4, zlib.crc32(raw), zlib.crc32(back.encode()), back == t, codec.parity(t, raw) if asked else None))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], kind.names)

    run.__annotations__ = {"text": pa.Array, "test": pa.Array, "return": pa.Array}
    test = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(every == 1))
    return docs.select("doc_id", F.arrow_udf(run, kind)(F.col("text"), test).alias("v")).select("doc_id", "v.*")
