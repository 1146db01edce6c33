"""Quality rules: an isolation forest on rule statistics.

Each text gets counts (words, symbols, repeated lines and windows, letters of
several kinds). Fixed base rules reject the worst. For the rest, an isolation
forest measures how few random splits set a document's statistics apart; the
score is 2^(-mean path / expected path), high for anomalies. The forest is
grown from all good labelled rows, dealt among its trees by a hash of their
id, ``size`` of them or more to a tree (of few rows each goes to several trees).
The threshold is the lowest one at which at most ``max_false`` of all good
labelled rows are lost. Every document is then scored. Only trees, counts and
the threshold reach the driver; texts are read once, for their statistics.

Cases: a null or empty text has no words, fails the base rules and is not
kept; without any good labelled row there is no forest and base rules alone
decide; several labels of one document count as their lowest, and of several texts of a
labelled id one is learnt from; repeated rows
are judged alike; further columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import TEXTS, tasks, written
from .words import LOWER, Chunk, Spans, chunks, mix, U, windows

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_bangs", "n_lines", "n_adjacent"]
STATS = BASE + MORE
_STRUCT = pa.struct([(c, pa.int64()) for c in STATS])
_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in STATS])
_TREE = "tree int, n long, feature array<long>, cut array<double>, left array<long>, right array<long>, path array<double>"
_VERDICT = T.StructType([T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
_SYMBOL, _UPPER, _BANG = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"!?"))


def _repeated(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries have a (group, key) that another entry has too."""
    h = mix(key + mix(group.astype(U)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def _later(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries have a (group, key) that an earlier entry has too."""
    h = mix(key + mix(group.astype(U)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    out = np.zeros(len(s), bool)
    if len(s) > 1:
        out[order[1:]] = s[1:] == s[:-1]
    return out


def chunk_stats(c: Chunk) -> dict[str, np.ndarray]:
    data, n = c.data, c.n
    start, end, doc = c.words()
    spans = Spans(data)
    per = lambda d: np.bincount(d, minlength=n)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    out = {"n_words": per(doc), "word_chars": np.bincount(doc, (heads[end] - heads[start]), n).astype(np.int64)}
    for name, lut in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_bangs", _BANG)):
        out[name] = c.per_doc(lut[data])
    # lines: cut after each \n and at each document's end
    cut = np.union1d(np.flatnonzero(data == 10) + 1, c.at)
    ls, le = cut[:-1], cut[1:]
    ld = np.searchsorted(c.at, ls, side="right") - 1
    le = np.where((le > ls) & (data[np.maximum(le - 1, 0)] == 10), le - 1, le) if len(data) else le
    worded = np.searchsorted(start, ls) < np.searchsorted(start, le)
    ls, le, ld = ls[worded], le[worded], ld[worded]
    out["n_lines"] = per(ld)
    out["n_dup_lines"] = per(ld[_later(ld, spans.hash(ls, le))])
    h = spans.hash(start, end)
    g, at = windows(h, doc, 5)
    hit = at[_repeated(doc[at], g)] if len(at) else at
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + 5, -1)
    out["n_repeat_words"] = per(doc[np.cumsum(covered)[:-1] > 0]) if len(h) else np.zeros(n, np.int64)
    low = Spans(LOWER[data]).hash(start, end)
    out["n_adjacent"] = per(doc[1:][(low[1:] == low[:-1]) & (doc[1:] == doc[:-1])])
    return out


@F.arrow_udf(_TYPE)
def text_stats(text: pa.Array) -> pa.Array:
    """The statistics of each text."""
    parts = [chunk_stats(c) for c in chunks(text)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in STATS], fields=list(_STRUCT))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates, drawn towards a usual text's where a text is short, and flattened where they are large."""
    f = {k: np.asarray(v, np.float64) for k, v in s.items()}
    words, chars, lines = f["n_words"] + 30, f["word_chars"] + 150, f["n_lines"] + 5
    flat = lambda x, unit: np.log1p(x / unit)
    return np.stack([
        flat(f["n_symbols"] / chars, 0.01), flat(f["n_bangs"] / words, 0.05), flat(f["n_upper"] / chars, 0.1),
        flat(f["n_adjacent"] / words, 0.02), flat(f["n_dup_lines"] / lines, 0.2), flat(f["n_repeat_words"] / words, 0.2),
    ], axis=1)


def _c(n: float) -> float:
    """Mean path of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, size: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree over all rows of x, as deep as one of ``size`` rows."""
    limit = int(np.ceil(np.log2(max(size, 2))))
    feature, cut, left, right, path = [], [], [], [], []

    def node(pts: np.ndarray, depth: int) -> int:
        k = len(feature)
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (path, depth + _c(len(pts)))):
            a.append(v)
        if depth < limit and len(pts) > 1:
            j = int(rng.integers(pts.shape[1]))
            low, high = pts[:, j].min(), pts[:, j].max()
            # the range is widened, so that values beyond those of the grown-on rows part from them
            c = float(rng.uniform(low, high + max(high - low, 0.5)))
            under = pts[:, j] < c
            feature[k], cut[k] = j, c
            left[k] = node(pts[under], depth + 1)
            right[k] = node(pts[~under], depth + 1)
        return k

    node(x, 0)
    return tuple(map(np.array, (feature, cut, left, right, path)))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), cut, children, path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float
    threshold: float = 1.0

    @staticmethod
    def grow(x: np.ndarray, trees: int, size: int, seed: int) -> Forest:
        """From rows in memory, of which each tree draws ``size``."""
        rng = np.random.default_rng(seed)
        size = min(size, len(x))
        return Forest([_tree(x[rng.choice(len(x), size, replace=False)], size, rng) for _ in range(trees)], max(_c(size), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                j = feature[at]
                go = np.flatnonzero(j >= 0)
                if not len(go):
                    break
                k = at[go]
                at[go] = np.where(x[go, j[go]] < cut[k], left[k], right[k])
            total += path[at]
        return np.exp2(-total / len(self.trees) / self.norm)


def nth(rows: DataFrame, key: str, k: int) -> int:
    """The k-th least (from 0) of a column of longs that are not negative: counts of 16 bits at a time lead to it."""
    for shift in (48, 32, 16, 0):
        bits = F.shiftright(key, shift)
        for at, n in sorted(rows.groupBy(bits.alias("at")).count().collect()):
            if k < n:
                break
            k -= n
        rows = rows.where(bits == at)
    return at


def train(seen: DataFrame, labels: DataFrame, *, trees: int = 100, size: int = 256, max_false: float = 0.002, seed: int = 7) -> Forest | None:
    """Grow and calibrate on every labelled row of ``seen`` (doc_id and statistics s)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    each = seen.join(marks, "doc_id").groupBy("doc_id", "quality").agg(F.min("s").alias("s"))  # a row for each id, however often it occurs
    rows = written(each.select(F.xxhash64("doc_id").alias("h"), (F.col("quality") > 0).alias("good"), "s.*").where(~base_failed({c: F.col(c) for c in STATS})), seen.count())
    good = rows.where("good")
    n = good.count()
    if not n:
        return None
    copies = min(trees, -(-trees * size // n))  # trees that a row goes to

    def grow(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        t = _tree(features({c: x[c].to_numpy() for c in STATS}), min(size, len(x)), np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame([[key[0], len(x), *t]], columns=["tree", "n", "feature", "cut", "left", "right", "path"])

    places = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: F.pmod(F.pmod("h", F.lit(trees)) + i, F.lit(trees)).cast("int"))
    grown = sorted(good.select(*STATS, F.explode(places).alias("tree")).groupBy("tree").applyInPandas(grow, _TREE).collect())
    forest = Forest([tuple(map(np.array, t[2:])) for t in grown], max(float(np.mean([_c(t.n) for t in grown])), 1e-9))

    @F.arrow_udf(T.LongType())
    def bits(s: pa.Array) -> pa.Array:  # of a score: they are in the same order, as no score is negative
        return pa.array(forest.score(features(_columns(s))).view(np.int64))

    scored = written(rows.select("good", bits(F.struct(*STATS)).alias("bits")))
    clean, score = scored.where("good"), lambda x: float(np.int64(x).view(np.float64))
    # the lowest cut that loses max_false of the good rows; above it, the one that loses the fewest and finds as many bad rows
    low = nth(clean, "bits", min(n - 1, int(np.ceil(n * (1 - max_false)))))
    found = scored.where(~F.col("good") & (F.col("bits") > low)).agg(F.min("bits")).first()[0]
    forest.threshold = score(clean.agg(F.max("bits")).first()[0]) if found is None else (score(low) + score(found)) / 2
    return forest


def _columns(s: pa.Array) -> dict[str, np.ndarray]:
    if isinstance(s, pa.ChunkedArray):
        s = s.combine_chunks()
    return {c: s.field(c).to_numpy(zero_copy_only=False) for c in STATS}


def base_failed(s):
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def verdicts(forest: Forest | None):
    """A column function of the statistics: score and verdict."""

    @F.arrow_udf(_VERDICT)
    def judge(stats: pa.Array) -> pa.Array:
        s = _columns(stats)
        failed = base_failed(s)
        score = forest.score(features(s)) if forest else np.zeros(len(failed))
        kept = ~failed & (score <= forest.threshold if forest else True)
        return pa.StructArray.from_arrays([pa.array(failed), pa.array(score), pa.array(kept)], ["base_failed", "score", "kept"])

    return judge


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of each document."""
    seen = written(docs.select("doc_id", text_stats("text").alias("s")))
    judge = verdicts(train(seen, labels, **options))
    return seen.select("doc_id", "s", judge(F.col("s")).alias("v")).select("doc_id", "s.*", "v.*")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    seen = written(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), text_stats("text").alias("s")))
    judge = verdicts(train(seen.select("row.doc_id", "s"), labels, **options))
    return seen.where(judge(F.col("s")).getField("kept")).select("row.*").coalesce(tasks(seen.count(), TEXTS))
