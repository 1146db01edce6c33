"""Each operator against brute force on a small table with every odd case."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pubspark.llm import decontaminate, hmm, neardup, pieces, pii, quality, sharding, suffixes, tokens, urls
from pubspark.llm.words import chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard string, key int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(120)
    near = []
    for k in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"new{k}"
        near.append(" ".join(w))
    passage = text(60)
    texts = [None, "", " \n\t ", "one", "Two words", "a b c d", base, base, base.upper(), *near, *(f"{text(30)} {passage} {text(30)}" for _ in range(5))]
    texts += [text(rng.randint(5, 90)) for _ in range(30)] + [text(9000), "\n".join(["same line here"] * 6 + [""] * 3), "x y É z 日本 😀 " * 8, "word " * 50, "%%% ### $$$ ab " * 30]
    return [(i * 3 - 9, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, False, "x", 7) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got, start = by_id(tokens.token_digest(docs, path)), 0
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_digest(empty, path).count() == 0


def test_token_files_allow_selective_reads(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and number "), F.col("id").cast("string")).alias("text"))
    again = df.unionByName(spark.createDataFrame([(5, "other text"), (None, "no id"), (5, None)], "doc_id long, text string"))
    tokens.write_tokens(again, f"file://{tmp_path}/t", path, row_group_bytes=20_000)
    files = list((tmp_path / "t").glob("*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_offset_index and (col.has_column_index or not col.is_stats_set)
                if col.path_in_schema.startswith("tokens"):
                    assert "RLE_DICTIONARY" in col.encodings
                elif col.path_in_schema in ("doc_id", "local_start", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in col.encodings and "RLE_DICTIONARY" not in col.encodings
    assert groups > len(files)
    got = tokens.read_tokens(spark, f"file://{tmp_path}/t")
    assert got.count() == 9003 and got.where("doc_id = 5").count() == 3 and got.where("doc_id IS NULL AND start = 0").count() == 1
    rows = sorted(got.select("start", "n_tokens").collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    monkeypatch.setattr(tokens, "FEW_FILES", 0)  # joined by a shuffle
    assert rows == sorted(tokens.read_tokens(spark, f"file://{tmp_path}/t").select("start", "n_tokens").collect())
    plan = tokens.read_tokens(spark, f"file://{tmp_path}/t", ["doc_id", "n_tokens"]).where("doc_id = 77")
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in text.splitlines() if "FileScan" in x and "doc_id" in x)
    assert "tokens:array" not in scan and "EqualTo(doc_id,77)" in scan and plan.count() == 1


def test_quality_on_labels_that_it_has_not_seen(spark):
    """Half of the labelled documents calibrate, the other half counts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality.quality_scores(docs, labels.where(even)).join(labels.where(~even), "doc_id")
    rate = {q: [r["kept"] for r in got.where(F.col("quality") == q).collect()] for q in (0, 1)}
    assert len(rate[0]) > 15 and np.mean(rate[0]) < 0.1 and np.mean(rate[1]) > 0.97


def brute_stats(t):
    w = WORD.findall(t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(repeat)


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int("%%%" not in (t or "")), 0) for i, t in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_scores(docs, labels))
    for i, t in rows:
        want = brute_stats(t)
        assert tuple(got[i][c] for c in quality.BASE) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    none = labels.limit(0)
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.quality_scores(docs, none).collect())
    assert quality.quality_scores(empty, labels).count() == 0


def test_isolation_forest_finds_held_out_anomalies():
    rng = np.random.default_rng(1)
    good, odd = rng.normal(0, 0.1, (600, 6)) ** 2, rng.normal(0, 0.1, (50, 6)) ** 2
    odd[:, 2] += 2
    f = quality.Forest.grow(good[:400], 100, 256, 3)
    assert (f.score(odd)[:, None] > np.quantile(f.score(good[400:]), 0.98)).mean() > 0.95


def test_pseudonyms(spark, docs, empty):
    f = pii.Feistel("k")
    for n in (2, 10, 97, 1000):
        assert sorted(f.permute(x, n, "t") for x in range(n)) == list(range(n))
        assert all(f.permute(f.permute(x, n, "t"), n, "t", back=True) == x for x in range(n))
    text = "a 4111 1111 1111 1111, b@example.com +1 (743) 555-3824 10.0.0.1 2024-02-29 123-45-6789 GB82 WEST 1234 5698 7654 32 but 4111111111111112 and 999.1.1.1 and 2024-13-01"
    one = pii.pseudonymise(text, f)
    for v in ("4111 1111", "b@example", "555-3824", "10.0.0.1", "2024-02-29", "123-45-6789", "WEST"):
        assert v not in one
    for v in ("4111111111111112", "999.1.1.1", "2024-13-01"):
        assert v in one
    assert len(re.findall(r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}", one)) == 1
    card = re.search(r"(?:[0-9]{4} ){3}[0-9]{4}", one)[0].replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == card[-1]
    df = spark.createDataFrame([(1, text, 3), (2, text + " again", 3), (3, None, 3), (4, "", 3), (5, "clean", 3)], "doc_id long, text string, n_card int")
    got = by_id(pii.pseudonymise_documents(df, "k"))
    assert got[1]["text"] == one
    assert got[2]["text"] == got[1]["text"] + " again" and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "clean"
    assert pii.pseudonymise_documents(docs, "k").columns == docs.columns
    assert pii.pseudonym_report(empty, "k").count() == 0
    with pytest.raises(ValueError, match="key"):
        pii.pseudonym_report(docs)


def test_hex_secrets_of_any_length_and_case():
    f, g = pii.Feistel("k"), pii.Feistel("other")
    rng = random.Random(6)
    for n in (32, 33, 64, 128, 129, 300, 9000):
        for alphabet in ("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEF"):
            v = "a0B1"[: 2 if "A" not in alphabet else 4].upper() if "a" not in alphabet else "a0B1"[: 4 if "A" in alphabet else 2]
            v += "".join(rng.choice(alphabet) for _ in range(n - len(v)))
            new = pii.pseudonymise(f"key {v}.", f)
            assert len(new) == n + 5 and v not in new and set(new[4:-1]) <= set(alphabet), (n, alphabet)
            if len(alphabet) > 16:
                assert [pii.HEX[0].find(c) >= 0 for c in v] == [pii.HEX[0].find(c) >= 0 for c in new[4:-1]]
            assert pii.pseudonymise(f"again {v}", f) == "again " + new[4:-1] and pii.pseudonymise(f"key {v}.", g) != new
    assert len({pii.pseudonymise("aB0" * 200 + c, f) for c in "0123456789"}) == 10


def test_pseudonyms_against_texts_put_together_by_hand(spark):
    """Every value of every kind in random texts, replaced by a plain walk over the pieces that the text was made of."""
    rng, f = random.Random(8), pii.Feistel("k")

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + number(14)
        d = body + next(c for c in "0123456789" if sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(body + c))) % 10 == 0)
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    make = {
        "card": card,
        "phone": lambda: rng.choice([f"+1 ({rng.randint(200, 999)}) 555-{number(4)}", f"({rng.randint(200, 999)}) 555-{number(4)}"]),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        "ssn": lambda: f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}",
        "email": lambda: f"{rng.choice(['ann', 'bo.lee', 'x9'])}{number(2)}@mail{number(1)}.example.org",
        "secret": lambda: "a1" + "".join(rng.choice("0123456789abcdef") for _ in range(38)),
    }
    rows, want = [], {}
    for i in range(300):
        text, new, counts = "", "", Counter()
        for _ in range(rng.randint(0, 6)):
            plain = " ".join(rng.choice(["plain", "words", "v2", "7", "x-ray", "Zürich"]) for _ in range(rng.randint(1, 4)))
            kind = rng.choice(list(make))
            value = make[kind]()
            text += f"{plain}: {value}; "
            new += f"{plain}: {pii._DO[kind](f, value)}; "
            counts[kind] += 1
        rows.append((i, text))
        want[i] = (new, counts)
    got = by_id(pii.pseudonym_report(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    for i, (new, counts) in want.items():
        assert got[i]["text"] == new and {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: counts[k] for k in pii.KINDS}
    seen = {}  # a permutation: different values stay different, and their form and checks stay
    for kind, one in make.items():
        for _ in range(300):
            v = one()
            w = pii._DO[kind](f, v)
            assert seen.setdefault((kind, w), re.sub("[ -]", "", v) if kind == "card" else v) == (re.sub("[ -]", "", v) if kind == "card" else v)
            assert pii._DO[kind](f, w) is not None and re.sub("[0-9a-f]", "0", v) == re.sub("[0-9a-f]", "0", w) if kind not in ("ip", "email") else True


def test_pseudonyms_beside_other_numbers():
    f = pii.Feistel("k")
    card = "4111111111111111"
    new = pii.pseudonymise(card, f)
    for form in ("card {} 12/27", "{} 123 cvv", "order 12 {}", "order 12 34 56 {} 7 8", "1 2 3 {}", "{} 2024", "AB12 3456 7890 {}"):
        assert pii.pseudonymise(form.format(card), f) == form.format(new), form
    four = "4111 1111 1111 1111"
    for k in range(1000):
        for form in ("{} " + f"{k:03}", f"{k} " + "{}", f"{k} 55 66 77 " + "{} 12/27"):
            assert pii.pseudonymise(form.format(four), f) == form.format(pii.pseudonymise(four, f)), form
            assert pii.pseudonymise(form.format(card), f) == form.format(new), form
    assert "WEST" not in pii.pseudonymise("GB82 WEST 1234 5698 7654 32 CODE", f)
    for v in ("+14155552671", "(415) 555-2671", "415-555-2671", "+49 30 123456", "+33 1 23 45 67 89"):
        counts = {}
        got = pii.pseudonymise(f"call {v}, please", f, counts)
        assert counts == {"phone": 1} and re.sub("[0-9]", "0", got) == re.sub("[0-9]", "0", f"call {v}, please") and v not in got, v
    digits = lambda v: re.sub("[^0-9]", "", pii.pseudonymise(v, f))
    assert digits("+14155552671") == digits("+1 (415) 555-2671")
    got = pii.pseudonymise("2024-02-29T12:30:00Z 2024-02-29", f)
    assert got[10:21] == "T12:30:00Z " and got[:10] == got[21:] != "2024-02-29"


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    for n, top in ((0, 3), (1, 3), (700, 2), (5000, 3), (20_000, 40), (3000, 2**63)):
        x = rng.integers(0, top, (4, n), dtype=np.uint64)
        order = suffixes.multikey_quicksort(x)
        assert sorted(order.tolist()) == list(range(n)) and x[:, order].T.tolist() == sorted(x.T.tolist())


def test_windows_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "Spans", lambda data: type("Flat", (), {"hash": lambda self, a, b: np.zeros(len(a), np.uint64)})())
    data = np.frombuffer(b"abcabdabcx", np.uint8)
    assert suffixes.equal_windows(data, np.arange(8), 3).tolist() == [True, False, False, False, False, False, True, False]


def test_repeats_in_documents_of_several_pieces(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range((4 << 20) + 900_000))
    cuts = [(4 << 20) - 150, (4 << 20) + 5, 4_900_000, 77]
    shorts = [f"{k}" * 50 + long[a : a + 300] + "Z" * 30 for k, a in enumerate(cuts)]
    df = spark.createDataFrame([(0, long), *((k + 1, t) for k, t in enumerate(shorts))], "doc_id long, text string")
    got = by_id(suffixes.repeat_report(df))
    gone = np.zeros(len(long), bool)
    for a in cuts:
        gone[a : a + 300] = True
    assert got[0]["n_removed"] == gone.sum() and got[0]["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(long.encode(), np.uint8)[~gone])).hexdigest()
    assert all((got[k + 1]["n_removed"], got[k + 1]["n_spans"]) == (300, 1) for k in range(4))


@pytest.mark.parametrize("big, bits", [(4096, 22), (1, 9)])
def test_suffixes(spark, docs, rows, empty, monkeypatch, big, bits):
    monkeypatch.setattr(suffixes, "repeats", lambda d, n, f=suffixes.repeats: f(d, n, big))
    monkeypatch.setattr(suffixes, "PIECE_BITS", bits)
    monkeypatch.setattr(suffixes, "SMALL", 8 if bits < 22 else 512)
    more = [*rows, (1000, rows[6][1]), (1001, "q" * 700), (1002, "ab" * 100), (1003, "é" * 100)]
    df = spark.createDataFrame(more, "doc_id long, text string").repartition(4)
    got, seen = by_id(suffixes.repeat_report(df)), Counter()
    raw = {i: (t or "").encode() for i, t in more}
    for t in raw.values():
        seen.update(t[k : k + 200] for k in range(len(t) - 199))
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = len(re.findall(r"1+", "".join("01"[int(g)] for g in gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), gone.sum(), spans, hashlib.sha256(kept).hexdigest()), i
    if big > 1:
        assert suffixes.repeat_report(empty).count() == 0


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(pieces.codec_digest(docs, path, every=1))
    for i, t in rows:
        ids = np.array(sp.encode(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes())), t
        assert got[i]["round_trip"] and got[i]["parity"]
    back = pieces.encode_documents(docs, path).select("doc_id", pieces.decode_column(path)("tokens").alias("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows}
    assert pieces.codec_digest(empty, path).count() == 0


def test_sentencepiece_checks_every_row(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    odd = docs.unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), allowMissingColumns=True)
    for got in (pieces.codec_digest(odd, path), pieces.encode_documents(odd, path)):
        assert got.count() == odd.count() == got.where("round_trip AND parity").count()
    marks = spark.createDataFrame([(1, "a\u2581b"), (2, "a\u2581 b"), (3, "\u2581 \u2581\u2581x \u2581")], "doc_id long, text string")
    got = pieces.encode_documents(marks, path)
    assert got.where("parity AND NOT round_trip").count() == 3  # the marker comes back as a space


def test_odd_texts_have_the_library_s_ids():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path), random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(["\u2581", " ", "a", "b", ".", "\n", "é", "e\u0301", "😀", "1", "  ", "the", "\x00", "\t", "Ⅷ", "日本", "<s>", "<unk>"]) for _ in range(rng.randint(0, 14)))
        raw = next(codec.encode([t]))
        assert sp.encode(t) == np.frombuffer(raw, np.int32).tolist(), t
        assert codec.decode([raw])[0] == sp.decode(np.frombuffer(raw, np.int32).tolist()) == t.replace("\u2581", " "), t
    assert codec.decode([np.array([1, *sp.encode("x y"), 2], np.int32).tobytes()]) == ["x y"]


def test_a_unigram_model(tmp_path):
    """A model written by hand: pieces with scores, with and without byte fallback."""
    import sentencepiece
    import struct

    def message(*fields):
        out = b""
        for k, v in fields:
            if isinstance(v, int):
                out += bytes([k << 3 & 127 | 128, k >> 4]) + bytes([v]) if k > 15 else bytes([k << 3, v])
            elif isinstance(v, float):
                out += bytes([k << 3 | 5]) + struct.pack("<f", v)
            else:
                n = len(v)
                out += bytes([k << 3 | 2]) + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])) + v
        return out

    words = {"\u2581": -2.0, "\u2581the": -3.0, "\u2581cat": -4.5, "s": -3.5, "c": -5.1, "a": -5.2, "t": -5.3, "at": -4.9, "\u2581c": -5.0, "h": -6.1, "e": -6.2, "he": -5.7, ".": -3.9, "\u2581\u2581": -4.1}
    for fallback in (False, True):
        pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []) + [(p, x, 1) for p, x in words.items()]
        raw = b"".join(message((1, message((1, p.encode()), (2, x), (3, k)))) for p, x, k in pieces_)
        raw += message((2, message((3, 1), (35, int(fallback))))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
        path = tmp_path / f"unigram{fallback}.model"
        path.write_bytes(raw)
        sp, codec, rng = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceCodec(str(path)), random.Random(1)
        assert codec.model.kind == pieces.UNIGRAM and codec.model.byte_fallback == fallback and codec.cuts
        for _ in range(500):
            t = "".join(rng.choice(["the", "cat", "s", " ", "  ", "c", "a", "t", "h", "é" if fallback else "e", "."]) for _ in range(rng.randint(1, 12)))
            ids = codec.encode([t])
            raw_ids = next(ids)
            assert sp.encode(t) == np.frombuffer(raw_ids, np.int32).tolist(), t
            assert codec.decode([raw_ids]) == [t]
        if not fallback:
            odd = sp.encode("the xcat")
            assert np.frombuffer(next(codec.encode(["the xcat"])), np.int32).tolist() == odd and codec.decode([np.array(odd, np.int32).tobytes()]) == [sp.decode(odd)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, docs, rows, empty, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    got = by_id(neardup.near_components(docs, percent))
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)
    left = neardup.drop_near_duplicates(docs, percent)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in sets if find(i) == i}
    assert neardup.near_components(empty).count() == 0


def brute_place(doc, tree):
    def least(path, weights):
        u = lambda k: (int(hashlib.md5(f"{doc}:{path}{k}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return min((-math.log(u(k)) / w, k) for k, w in enumerate(weights) if w)[1]

    region = least("", [sum(w for k in r for _, w in k) for r in tree])
    rack = least(f"{region}.", [sum(w for _, w in k) for k in tree[region]])
    return tree[region][rack][least(f"{region}.{rack}.", [w for _, w in tree[region][rack]])][0]


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    text = dict(rows)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    n = Counter(r["shard"] for r in sharding.shard_documents(many).collect())
    assert len(n) == 24 and max(n.values()) < 240
    grown = Counter(r["grown_shard"] for r in sharding.shard_documents(many).collect())
    assert 100 < grown[24] < 230 and len(grown) == 25
    heavy = [[[(0, 1.0), (1, 3.0)], [(2, 1.0), (3, 1.0)]], [[(4, 1.0)], [(5, 2.0)]], [[(6, 1.0)]]]
    lighter = [[[(0, 1.0), (1, 1.0)], [(2, 1.0), (3, 1.0)]], [[(4, 1.0)], [(5, 2.0)]], [[(6, 1.0)]]]
    rows_ = sharding.shard_documents(many, tree=heavy, grown=lighter).collect()
    region, rack = {k: min(k // 4 + (k == 6), 2) for k in range(7)}, {0: 0, 1: 0, 2: 1, 3: 1}
    for r in rows_:  # brute force: each level's least draw
        for c, tree in (("shard", heavy), ("grown_shard", lighter)):
            assert r[c] == brute_place(r["doc_id"], tree)
        a, b = r["shard"], r["grown_shard"]
        if a != b:  # only out of the lighter region, of its lighter rack, or out of the lighter shard
            assert region[a] == 0 and (region[b] > 0 or (rack[a] == 0 and (rack[b] == 1 or (a, b) == (1, 0))))
    assert {r["shard"] for r in rows_ if r["shard"] != r["grown_shard"]} == {0, 1, 2, 3}
    flat = [[[(k, 1.0)]] for k in range(8)]
    assert sharding.shard_documents(many, tree=sharding.even_tree(8, 2, 2), grown=flat).where("shard <> grown_shard").count() > 2000  # the tree decides, not the leaves alone
    none = sharding.shard_documents(many.limit(50), tree=[[[(0, 1.0), (1, 0.0)]], [[(2, 0.0)]]]).select("shard").distinct().collect()
    assert [r[0] for r in none] == [0]
    assert sharding.shard_documents(empty).count() == 0


def test_language_model(spark, docs, rows, empty):
    got = by_id(hmm.score_documents(docs, init_rounds=2))
    split = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).alias("train"))
    m = hmm.train(split, init_rounds=2)
    cls, at = {}, {}
    for i, t in rows:
        for c in chunks(pa.array([t])):
            h, at[i] = hmm.tokens(c)
            cls[i] = (hmm.classes(h), h)
    toks = {i: [*WORD.findall(lower(t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    inside, kinds = Counter(), Counter()
    count = Counter(x for i in toks if not held[i] for x in cls[i][1].tolist())
    for x, k in count.items():
        inside[int(hmm.classes(np.array([x], np.uint64))[0])] += k
        kinds[int(hmm.classes(np.array([x], np.uint64))[0])] += 1
    for i in toks:  # the classes' probability by plain recursion, then each word's within its class
        want = brute_forward(m, cls[i][0]) + sum(np.log10((count[x] + 0.1) / (inside[k] + 0.1 * (kinds[k] + 1))) for k, x in zip(cls[i][0].tolist(), cls[i][1].tolist()))
        assert got[i]["score"] == pytest.approx(want, rel=1e-6)
    assert hmm.score_documents(empty, init_rounds=1).count() == 0


def brute_forward(m, cls):
    a, total = None, 0.0
    for o in cls:
        a = (m.start if a is None else a @ m.move) * m.emit[:, o]
        total += np.log10(a.sum())
        a = a / a.sum()
    return total


def test_forward_and_counts_are_exact_over_the_borders_of_pieces():
    rng = np.random.default_rng(2)
    m = hmm.begin(3, 1)
    m.move = rng.dirichlet(np.ones(3), 3)
    cls, at = rng.integers(0, 40, 700), np.array([0, 1, 150, 700])
    got = hmm.forward(m, cls, at)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES + 1))
    for k in range(3):
        o = cls[at[k] : at[k + 1]]
        assert got[k] == pytest.approx(brute_forward(m, o))
        n = len(o)
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.move) * m.emit[:, o[t]]
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = m.move @ (m.emit[:, o[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        for t in range(n):
            g = alpha[t] * beta[t]
            g /= g.sum()
            emit[:, o[t]] += g
            start += g if t == 0 else 0
            if t:
                x = np.outer(alpha[t - 1], m.emit[:, o[t]] * beta[t]) * m.move
                move += x / x.sum()
    for a, b in zip(hmm.expect(m, cls, at), (start, move, emit, got.sum())):
        assert np.allclose(a, b, atol=1e-9)
    assert move.sum() == pytest.approx(697)


def test_baum_welch_raises_the_likelihood_and_beats_one_state(spark):
    rng = random.Random(4)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(2)]
    rows = [(i, " ".join(rng.choice(topics[i % 2]) for _ in range(200))) for i in range(120)]
    df = spark.createDataFrame([(i, t, i < 80) for i, t in rows], "doc_id long, text string, train boolean").coalesce(2)
    m, means = hmm.begin(2, 3), []
    for _ in range(6):
        m, mean = hmm._round(df, m)
        means.append(mean)
    assert all(b > a - 1e-6 for a, b in zip(means[1:], means[2:])) and means[-1] > means[0]
    one = hmm._round(df, hmm.begin(1, 3))[0]
    held = [hmm.classes(hmm.tokens(next(iter(chunks(pa.array([t])))))[0]) for i, t in rows if i >= 80]
    assert sum(brute_forward(m, c) for c in held) > sum(brute_forward(one, c) for c in held) + 40 * 20


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(9)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
    changed = item.copy()
    changed[7] = "other"
    more = [*rows, (900, "x y " + " ".join(item).upper() + " z"), (901, "q " + " ".join(changed)), (902, " ".join(item[:6])), (903, " ".join(rng.sample(item, 16))), (None, " ".join(item))]
    df = spark.createDataFrame([(i, t, 1) for i, t in more], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    got = by_id(decontaminate.contamination_report(df, bench))
    assert {i for i, r in got.items() if r["contaminated"]} == {900, 901, None}
    assert got[901]["n_equal"] >= 14 and got[900]["item_id"] == 1
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == len(more) - 3
    assert decontaminate.contamination_report(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination_report(df, bench.limit(0)).collect())
    for k in range(10):  # any one change in ten words
        w = item[:10].copy()
        w[k] = "changed"
        one = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
        assert decontaminate.contamination_report(one, spark.createDataFrame([(1, " ".join(item[:10]))], "item_id long, text string")).first()["contaminated"], k


def test_decontamination_finds_all_that_the_verdict_allows(spark):
    rng, bench, texts, want = random.Random(3), [], [], {}

    def put(text, found):
        want[len(texts)] = found
        texts.append((len(texts), text))

    for n in [*range(8, 17), 20, 40]:
        item = [f"w{n}-{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        need = -(-4 * min(n, 13) // 5)
        for changes in (n - need, n - need + 1) if n < 17 else (n // 5,):
            patterns = list(itertools.combinations(range(n), changes))
            for gone in patterns if len(patterns) < 100 else rng.sample(patterns, 60):
                put(" ".join(["before", *("other" if k in gone else w for k, w in enumerate(item)), "after"]), n - changes >= need)
        if n > 14:
            put(" ".join("other" if k % 4 == 3 else w for k, w in enumerate(item)), True)
    eight = [f"w8-{k}" for k in range(8)]
    put(" ".join(eight[1:] + ["after"]), True)  # cut at the document's start and end
    put(" ".join(["before", *eight[:-1]]), True)
    bench += [(1, "Five words stand in here"), (2, "solitary")]
    for text, found in (("so five words stand in here", True), ("five words stand in there", False), ("five words stand in", False), ("solitary", True), ("a solitary b", True), ("solitar y", False), ("", False)):
        put(text, found)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = by_id(decontaminate.contamination_report(df, spark.createDataFrame(bench, "item_id long, text string")))
    assert {i: r["contaminated"] for i, r in got.items()} == want
    assert all(any(m[a] == m[b] == "0" for m in decontaminate.MASKS) for a, b in itertools.combinations(range(decontaminate.SPAN), 2))


def test_benchmark_items_of_any_id(spark):
    words = lambda k: " ".join(f"{k}x{i}" for i in range(12))
    df = spark.createDataFrame([(1, "a " + words("p") + " " + words("q")), (2, words("r")), (3, words("s")), (4, "clean text"), (5, words("p"))], "doc_id long, text string")
    bench = spark.createDataFrame([("b", words("p")), ("a", words("q")), (None, words("r")), ("b", words("s")), ("c", words("s")), (None, None)], "item_id string, text string")
    got = {i: tuple(r)[1:] for i, r in by_id(decontaminate.contamination_report(df, bench)).items()}
    assert got == {1: (True, "a", 12, 12, 2), 2: (True, None, 12, 12, 1), 3: (True, "b", 12, 12, 1), 4: (False, None, None, None, 0), 5: (True, "b", 12, 12, 1)}


def test_urls(spark):
    pages = [(1, "http://www.a.com/en/5?x=1#y"), (2, "https://Example.com/en/77"), (3, "https://b.net/de/8"), (4, "http://c.example.net/de/8x"), (5, None), (6, "no scheme"), (7, "ftp://org/es/"), (8, "http://bcom/en/"), (9, "http://com"), (1, "http://www.a.com/en/5?x=1#y"), (11, "http://x.org/en?://q")]
    pages += [(100 + k, f"http://spam.example.org/fr/{k}.html") for k in range(40)] + [(200 + k, f"http://fine.example.org/fr/{k}") for k in range(40)]
    labels = spark.createDataFrame([(100 + k, True) for k in range(30)] + [(200 + k, False) for k in range(30)] + [(None, True), (5, None)], "page_id long, bad boolean")
    df = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge_urls(df, labels).collect()}
    assert urls.judge_urls(df, labels).count() == len(pages)
    want = {1: ("www.a.com", "/en/5", "com/en/", "block"), 2: ("example.com", "/en/77", "example.com/en/7", "allow"), 3: ("b.net", "/de/8", "net/de/", "block"), 4: ("c.example.net", "/de/8x", "example.net/de/8", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("org", "/es/", "org/es/", "block"), 8: ("bcom", "/en/", None, "allow"), 9: ("com", "", None, "allow"), 11: ("x.org", "/en", None, "allow")}
    for k, v in want.items():
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == v, k
    assert all(got[130 + k]["verdict"] == "block" for k in range(10)) and all(got[230 + k]["verdict"] == "allow" for k in range(10))
    none = urls.judge_urls(df, labels.limit(0))
    assert {r["verdict"] for r in none.where("page_id >= 100").collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), labels).count() == 0


def test_many_implied_rules_push_out_no_other(spark):
    long = "http://aa.bb.cc.dd.ee.ff.gg/ha/hb/hc/hd/he/hf/hg"  # 14 tokens, 16,383 sets
    rows = [(k, long, True) for k in range(30)] + [(100 + k, "http://other/way", k < 27) for k in range(30)]
    df = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    got = urls.judge_urls(df, spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad boolean")).collect()
    assert {r["verdict"] for r in got} == {"block"}


def test_copies_of_a_long_url_are_mined_at_once(spark):
    long = "http://" + ".".join(f"h{k}" for k in range(20)) + "/" + "/".join(f"p{'abcdefghijklmnopqrst'[k]}" for k in range(20))
    rows = [(k, long, True) for k in range(25)] + [(100 + k, "http://h0.h1/pa/fine", False) for k in range(40)] + [(200 + k, "http://h2/pb", k < 26) for k in range(30)]
    df = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    began = time.perf_counter()
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad boolean")).collect()}
    assert time.perf_counter() - began < 60
    assert all(got[i] == ("allow" if 100 <= i < 200 else "block") for i, *_ in rows)


def test_rules_against_all_sets_of_tokens(spark):
    rng = random.Random(12)
    words = [f"t{c}" for c in "abcdefg"]
    rows = []
    for k in range(160):
        w = rng.sample(words, rng.randint(1, 5))
        bad = ("ta" in w and "tb" in w and rng.random() < 0.9) or ("tc" in w and "td" in w and "te" in w) or rng.random() < 0.1
        rows.append((k, "http://host/" + "/".join(w), bad))
    df = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(1000, "http://host/ta/tb"), (1001, "http://other/tc/td/te/tq"), (1002, "http://other/ta")], "page_id long, url string")
    tokens = {i: frozenset(["host:" + u.split("/")[2], *("path:" + x for x in u.split("/")[3:])]) for i, u, _ in [*rows, (1000, "http://host/ta/tb", 0), (1001, "http://other/tc/td/te/tq", 0), (1002, "http://other/ta", 0)]}
    every = {frozenset(c) for t in tokens.values() for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}
    rules = set()
    for s in every:
        have = [b for i, _, b in rows if s <= tokens[i]]
        if sum(have) >= 8 and sum(have) >= 0.8 * len(have):
            rules.add(s)
    want = {i: "block" if any(s <= t for s in rules) else "allow" for i, t in tokens.items()}
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, bad boolean"), min_count=8).collect()}
    assert got == want and {"block", "allow"} <= set(want.values()) and any(len(s) > 1 and not any(r < s for r in rules) for s in rules)


def test_support_is_a_row_count_at_every_size(spark):
    df = spark.range(30_000).select(F.col("id").alias("page_id"), F.when(F.col("id") < 25, "http://rare/way").otherwise(F.concat(F.lit("http://fine/"), F.char(F.col("id") % 26 + 97))).alias("url"))
    labels = df.select("page_id", (F.col("page_id") < 25).alias("bad"))
    got = urls.judge_urls(df, labels).where("verdict = 'block'").collect()
    assert sorted(r["page_id"] for r in got) == list(range(25))
    few = df.where("page_id < 19")
    assert {r["verdict"] for r in urls.judge_urls(few, labels).collect()} == {"allow"}


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    n = got.count()
    assert 0 < n < 200 and got.where("doc_id IS NULL").count() == 0 and got.select("doc_id").distinct().count() == n
