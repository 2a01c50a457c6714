import itertools
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import leak, unify

ALIKE = [("Ｆｕｌｌ　width", "Full width"), ("ﬁne ﬂow", "fine flow"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("Тһе саѕе", "The case"), ("ё", "ë"), ("Α Ο", "A O"), ("a\r\nb", "a\nb"), ("a\x0cb", "a\nb"), ("a\rb", "a\nb"), ("a\x1fb", "a b")]
DIFFERENT = [("Case", "case"), ("cafe", "café"), ("a1", "al"), ("a.", "a"), ("O", "0"), ("x²", "x2"), ("a  b", "a b"), ("й", "и"), ("a\nb", "a b")]


@pytest.mark.parametrize("a,b", ALIKE)
def test_alike(a, b):
    assert unify.unified(a) == unify.unified(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert unify.unified(a) != unify.unified(b)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_one_form_is_stable(s):
    u = unify.unified(s)
    assert unify.unified(u) == u and unify.unified(unicodedata.normalize("NFD", s)) == unify.unified(unicodedata.normalize("NFC", s))


def test_look_pairs_against_all_pairs(spark):
    texts = [a for p in ALIKE for a in p] + ["abc", "abc", "", "", None, "x" * 200_000, "х" * 200_000, "unlike"]
    df = spark.createDataFrame([(i, t, "look", "own") for i, t in enumerate(texts)], "doc_id long, text string, look string, k string")
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if None not in (texts[i], texts[j]) and texts[i] != texts[j] and unify.unified(texts[i]) == unify.unified(texts[j])}
    got = [tuple(r) for r in unify.look_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    classes = {r.doc_id: r.class_id for r in unify.look_classes(df).collect()}
    for i, j in want:
        assert classes[i] == classes[j]
    assert unify.look_pairs(df.limit(0)).count() == 0


def _words(rng, n):
    return [rng.choice("the a of to shop order page state who asks alpha beta gamma delta".split()) for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    items = [(f"q{i}", " ".join(_words(rng, rng.randint(5, 40))), None if i % 3 else " ".join(_words(rng, 20))) for i in range(40)] + [("none", None, None), ("short", "one two", "")]
    docs = []
    for i in range(60):
        w = _words(rng, rng.randint(0, 200))
        q, run = rng.choice(items[:40])[1].split(), rng.choice([5, 11, 12, 13, 30])
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + q[:run] + w[at:]).replace("a", "а" if i % 4 == 0 else "a").upper() if i % 5 == 0 else " ".join(w[:at] + q[:run] + w[at:])))
    docs += [(100, None), (101, ""), (102, " ".join(docs[1][1] for _ in range(50)))]
    want = set()
    for d, t in docs:
        x = unify.words(t) if t else []
        runs = {tuple(x[k : k + 12]) for k in range(len(x) - 11)}
        for i, q, f in items:
            for text in (q, f):
                y = unify.words(text) if text else []
                if any(tuple(y[k : k + 12]) in runs for k in range(len(y) - 11)):
                    want.add((d, i))
    c = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as id", "'y' as item")
    s = spark.createDataFrame(items, "id string, query string, facts string")
    assert want
    assert {tuple(r) for r in leak.leaked_pairs(c, s).collect()} == want
    assert {tuple(r) for r in leak.leaked_pairs(c, s, items_per_index=7).collect()} == want
    assert leak.leaked_pairs(c.limit(0), s).count() == 0 and leak.leaked_pairs(c, s.limit(0)).count() == 0


def test_scores_reach_one_for_every_item_on_itself():
    rng = random.Random(2)
    texts = [" ".join(_words(rng, 14)) for _ in range(50)]
    ix = leak.ItemIndex([(i, "f", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert i in {ix.items[d][0] for d, _ in ix.above(t.split())}


def test_an_index_is_never_taken_for_another():
    class Held:
        value = None

    held = Held()  # one address for both shards
    for token in ("a", "b", "a"):
        held.value = [(token, "query", " ".join(f"{token}{k}" for k in range(20)))]
        assert [i for i, *_ in leak._index(token, held, 12).items] == [token]
