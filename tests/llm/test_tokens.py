import itertools

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from pubspark.llm import tokens


def test_words_with_marks_are_learnt_by_their_parts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, enc = Tokenizer.from_file(path), tokens.WordEncoder(path)
    lib.encode_special_tokens = True
    enc.learn([b"hehast$$$", "cióÓn!!".encode()])
    assert {b"hehast", b"$$$", b"!!", "cióÓn".encode()} <= set(enc.cache)
    heads = ["a", "it's", "x'", "É", "İ", "ſ", "ª", "7", "a1", "é", "é", "ß", "Σ", "日", "😀", "ÿ", "\x85", "it'", "'ll", "ab-cd", ""]
    tails = ["", "!!", "'", "'s", ".'", "&&&", "<|endoftext|>", "̸", ",", "$'d", "²"]
    words = [h + t for h, t in itertools.product(heads, tails)]
    for w, got in zip(words, tokens.WordEncoder(path).encode([w.encode() for w in words]), strict=True):
        assert np.frombuffer(got, np.int32).tolist() == lib.encode(w, add_special_tokens=False).ids, w


def test_files_are_as_many_as_texts_and_cores_ask_for(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and number "), F.col("id").cast("string")).alias("text"))
    few = tokens.token_digest(docs, path, path=f"file://{tmp_path}/few").sort("doc_id").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert tokens.token_digest(docs, path, path=f"file://{tmp_path}/cores").sort("doc_id").collect() == few
        assert len(list((tmp_path / "few").glob("*.parquet"))) == 4 and len(list((tmp_path / "cores").glob("*.parquet"))) == tokens.PER_CORE * 4
        monkeypatch.setattr(tokens, "FILE_BYTES", 2000)
        assert tokens.token_digest(docs, path, path=f"file://{tmp_path}/texts").sort("doc_id").collect() == few
        assert len(list((tmp_path / "texts").glob("*.parquet"))) > 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
