import random
import unicodedata

import pytest

from tidelog.llm import lookalike
from tidelog.llm.lookalike import Transducer, form

SAME = [
    ("Cafe", "Ｃａｆｅ"), ("Café", "Café"), ("Café", "Ca​fé"), ("a b", "a b"), ("a b", "a　b"), ("a b", "a b"), ("error", "еrrоr"), ("TOKEN", "ТОΚΕΝ"), ("fine", "ﬁne"), ("é", "е́"),
    ("Å", "Å"), ("Å", "Ａ‍̊"), ("ë", "ё"), ("soft", "so­ft"), ("x", "﻿x"), ("q̣̇", "q̣̇"), ("한", "한"),
]
APART = [("resume", "résumé"), ("Error", "error"), ("v1", "v2"), ("a b", "ab"), ("a\nb", "a b"), ("и", "u"), ("ü", "u"), ("a", "á"), ("ñ", "n")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert form(a) == form(b) and form(form(b)) == form(b)


@pytest.mark.parametrize("a, b", APART)
def test_different_look(a, b):
    assert form(a) != form(b)


def test_ascii_and_null_are_untouched():
    text = "".join(map(chr, range(128)))
    assert form(text) == text and form("") == "" and form(None) is None


def test_every_code_point_is_stable():
    t = lookalike.transducer()
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        once = t.apply("a" + chr(cp) + "b")
        assert t.apply(once) == once, hex(cp)


def test_one_pass_gives_what_composing_the_whole_text_would():
    t, r = lookalike.transducer(), random.Random(1)
    pool = [chr(c) for c in [*range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x386, 0x460), *range(0x1100, 0x1180), *range(0x11A8, 0x11C3), *range(0x1E00, 0x1F00), 0x200B, 0xFF9E, 0xFF76, 0x9C7, 0x9BE, 0xAC00, 0xFB01]]
    for _ in range(30_000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(1, 7)))
        assert form(text) == unicodedata.normalize("NFC", "".join(t._parts.get(c, c) for c in text)), [hex(ord(c)) for c in text]


def test_sequences_are_in_the_table():
    table = lookalike.transducer().table
    assert table["e\u0301"] == "\u00e9" and table["a\u0302\u0301"] == table["\u00e2\u0301"] == "\u1ea5" and table["\u1112\u1161\u11ab"] == "\ud55c"
    assert sum(len(k) > 1 for k in table) > 10_000


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        Transducer([("а", "a"), ("а", "o")])
    with pytest.raises(ValueError):
        Transducer([("А", "a")])


def test_long_texts_without_ascii():
    text = "検索ログ" * 50_000 + "é" * 1000
    assert form(text) == "検索ログ" * 50_000 + "é" * 1000


def variants(text, r):
    out = []
    for ch in text:
        k = r.random()
        if k < 0.1 and ch.isascii() and ch.isalnum():
            ch = chr(ord(ch) + 0xFEE0)
        elif k < 0.2 and ch in "aeopcxy":
            ch = "аеорсху"["aeopcxy".index(ch)]
        elif k < 0.3:
            ch = unicodedata.normalize("NFD", ch) + "​"
        elif k < 0.5 and ch == " ":
            ch = " "
        out.append(ch)
    return "".join(out)


@pytest.mark.parametrize("members", [100_000, 2])
def test_pairs_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(lookalike, "MEMBERS", members)
    r = random.Random(4)
    base = ["the alert of Peñalta é", "index main 42", "index main 43", "Index main 42", "", "naïve"]
    texts = [variants(t, r) if r.random() < 0.6 else t for t in base for _ in range(6)] + [None, None]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, form string, n_texts int")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if None not in (texts[i], texts[j]) and texts[i] != texts[j] and form(texts[i]) == form(texts[j])}
    got = [tuple(x) for x in lookalike.look_alike_pairs(df, "doc_id", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    classes = {c["doc_id"]: c for c in lookalike.look_alike_classes(df, "doc_id", "text").collect()}
    assert len(classes) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if t is not None and u is not None and form(u) == form(t)]
        c = classes[i]
        assert (c["form_id"], c["n_docs"], c["n_texts"]) == ((min(same), len(same), len({texts[j] for j in same})) if same else (None, 1, 1))
    assert lookalike.look_alike_pairs(df.where("false"), "doc_id", "text").collect() == []
    assert {x["doc_id"]: x["form"] for x in lookalike.with_form(df, "text").collect()} == {i: form(t) for i, t in enumerate(texts)}
