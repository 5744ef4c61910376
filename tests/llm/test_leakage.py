import random

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import leakage
from tidelog.llm.leakage import find_leaks, longest_overlap, words

VOCABULARY = [f"w{i}" for i in range(400)]


def runs(doc, item):
    """The longest common run of words, by brute force."""
    a, b = words(doc), words(item)
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    items = [" ".join(r.choices(VOCABULARY, k=r.randrange(5, 60))) for _ in range(30)] + [None, "", "short one"]
    docs = []
    for i in range(120):
        text = r.choices(VOCABULARY, k=r.randrange(0, 150))
        if i % 2:
            source = words(r.choice(items[:30]))
            n = r.choice([8, 11, 12, 13, 30])
            at = r.randrange(len(source))
            text[len(text) // 2 : len(text) // 2] = source[at : at + n]
        docs.append(" ".join(text))
    docs += [docs[1], None, "", items[0].upper().replace(" ", " ** "), items[1].replace("w", "ｗ").replace(" ", " \n> ")]
    return docs, items


def test_against_brute_force(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, hits string, mask int")
    e = spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(items)], "item_id long, text string, h string")
    got = {(r["doc_id"], r["item_id"]): r["exact_words"] for r in find_leaks(d, e, substitutions=0).collect()}
    want = {(i, 1000 + j): n for i, t in enumerate(docs) if t for j, u in enumerate(items) if u and (n := runs(t, u)) >= 12}
    assert got == want
    assert find_leaks(d.where("false"), e).collect() == [] and find_leaks(d, e.where("false")).collect() == []


def test_shuffled_index_gives_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    e = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    first = key(find_leaks(d, e))
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 1)
    assert key(find_leaks(d, e)) == first


def test_replaced_words_are_tolerated(spark):
    r = random.Random(2)
    item = r.sample(VOCABULARY, 40)
    docs = []
    for i in range(20):
        part = item[5 : 5 + 25]
        part[r.randrange(3, 22)] = "other"
        docs.append((i, " ".join(r.choices(VOCABULARY, k=30) + part + r.choices(VOCABULARY, k=30))))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert len(got) == 20 and all(x["similar_words"] >= 25 for x in got)


def test_one_replaced_word_at_every_inner_place(spark):
    item = VOCABULARY[:12]
    docs = [(i, " ".join(["other" if j == i else w for j, w in enumerate(item)])) for i in range(12)]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["similar_words"]) for r in got) == [(i, 12) for i in range(1, 11)]


def test_overlap_of_a_line():
    a = np.array([1, 2, 3, 9, 5, 6, 7, 8])
    b = np.array([2, 3, 4, 5, 6, 0, 8])
    assert longest_overlap(a, b, 1, 0) == (2, 2) and longest_overlap(a, b, 1, 1) == (2, 5) and longest_overlap(a, b, 1, 2) == (2, 7) and longest_overlap(a, b, 50, 1) == (0, 0)


def test_very_long_text(spark):
    item = " ".join(VOCABULARY[:20])
    text = "x y z " * 300_000 + item + " q" * 100_000
    got = find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["exact_words"]) for r in got] == [(1, 2, 20)]


@pytest.mark.parametrize("length", [12, 13, 16, 24])
def test_recall_with_one_replaced_word(spark, length):
    """Every passage of at least 12 words is found with any one inner word replaced: recall 1 at these lengths."""
    r = random.Random(length)
    items, docs = [r.choices(VOCABULARY, k=40) for _ in range(12)], []
    for j, item in enumerate(items):
        for place in range(1, length - 1):
            part = item[7 : 7 + length]
            part[place] = "other"
            docs.append((len(docs), j, " ".join(r.choices(VOCABULARY, k=20) + part + r.choices(VOCABULARY, k=20))))
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, n int, text string"), spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got if x["similar_words"] >= length}
    assert all((d, j) in found for d, j, _ in docs)


def test_filter_grows_with_the_items_up_to_a_bound():
    assert leakage.filter_bits(0) == 24 and leakage.filter_bits(3_000_000) == 26 and leakage.filter_bits(10**9) == 28


def test_words_beyond_a_chunk(corpus, monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 300)
    rows = [{"id": i, "text": t} for i, t in enumerate(corpus[0]) if t]
    parts = list(leakage._chunks(iter([pa.RecordBatch.from_pylist(rows)])))
    assert len(parts) > 5 and [i for p in parts for i in p[0]] == [x["id"] for x in rows]
    assert np.array_equal(np.concatenate([p[1] for p in parts]), np.concatenate([leakage.word_hashes(x["text"]) for x in rows]))
    assert all(len(p[1]) == p[2][-1] and len(p[0]) == len(p[2]) - 1 for p in parts)
