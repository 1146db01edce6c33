"""Near-duplicates where ids repeat or are missing, and where words are made to collide."""

import random

from pubspark.llm import neardup

TYPE = "doc_id long, text string, lo int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in rows], TYPE)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_an_id_with_several_texts_links_by_each(spark):
    rng = random.Random(1)
    one, two = words(rng, 200), words(rng, 200)
    near = two.copy()
    near[100] = "other"
    t1, t2, t3 = " ".join(one), " ".join(two), " ".join(near)
    rows = [(11, t1), (11, t2), (11, t2), (12, t3), (12, t3), *((i + 100, " ".join(words(rng, 50))) for i in range(3))]
    more = [(5, "x " + t1), (5, "y " + " ".join(words(rng, 99))), (9, "y")]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_components(frame(spark, rows + more)).collect()}
    assert got == {(11, 5), (12, 5), (5, 5), (9, 9), (100, 100), (101, 101), (102, 102)}
    left = neardup.drop_near_duplicates(frame(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [11, 100, 101, 102] and left.columns == ["doc_id", "text", "lo", "component"]


def test_rows_without_id_and_repeated_rows(spark):
    rng = random.Random(2)
    a, b = " ".join(words(rng, 50)), " ".join(words(rng, 50))
    rows = [(None, a), (None, a.upper()), (None, b), (4, b), (4, b), (None, None), (None, ""), (6, None), (6, None), (8, " ")]
    got = neardup.near_components(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(frame(spark, rows)).collect()), key=str)
    assert left == sorted([(None, min(a, a.upper())), (4, b), (None, None), (None, ""), (6, None), (6, None), (8, " ")], key=str)


def test_structured_words_are_not_linked(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = neardup.near_components(frame(spark, [(1, word), (2, other), (3, word)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (3, 1)}


def test_frequent_shingles_are_split_by_size_and_salt(spark, monkeypatch):
    """Every pair of different groups shares frequent shingles; the result is that of all pairs."""
    monkeypatch.setattr(neardup, "SALTED", 2)
    rng = random.Random(3)
    shared = words(rng, 60)
    rows, sets = [], {}
    for k in range(40):
        w = shared[: rng.randint(30, 60)] + words(rng, rng.randint(0, 20))
        rows.append((k, " ".join(w)))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    top = list(range(40))
    for _ in range(40):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_components(frame(spark, rows), 80).collect()}
    assert got == dict(enumerate(top))
