import itertools
import random
import re

import numpy as np
import pytest

from corpusloom.llm import pairs as P

SCHEMA = "id string, group_id string, split string, target_source string, instruction string, response string, k string, n int, h string"
W = re.compile(r"[^\W_]+")


def corpus(seed=1, n=150):
    rng, rows, words = random.Random(seed), [], ["w%d" % i for i in range(400)]
    base = []
    for i in range(n):
        if base and rng.random() < 0.55:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 9)):
                op = rng.random()
                if op < 0.4 and w:
                    w[rng.randrange(len(w))] = rng.choice(words)
                elif op < 0.7:
                    w.insert(rng.randint(0, len(w)), rng.choice(words))
                elif w:
                    w.pop(rng.randrange(len(w)))
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = rng.sample(words, rng.choice([1, 2, 5, 8, 20, 40, 60]))
        base.append(w)
        cut = rng.randint(0, len(w))
        rows.append((f"r{i:03d}", rng.choice([None, "", f"g-{rng.randint(0, 60):04d}", f"G {rng.randint(0, 60)}"]), rng.choice(["train", "Train", "train", "val", "validation", "TEST", None]), rng.choice(["s", None]), " ".join(w), " ".join(w[:cut]).upper(), "k", 1, "h"))
    rows += [("z1", "7", "train", "s", None, None, "", 0, ""), ("z2", "7", "test", "s", "", " - ", "", 0, ""), ("z3", None, "val", "s", "long " * 30_000 + "x", "", "", 0, ""), ("z4", None, "train", "s", "long x", "", "", 0, "")]
    return rows


def over(a, b):
    a, b = set(W.findall(a.lower())), set(W.findall(b.lower()))
    return len(a & b) / len(a | b) if a and b else 0


def num(g):
    d = re.sub("[^0-9]", "", g or "")
    return int(d) if d else None


@pytest.mark.parametrize("seed", [1, 2])
def test_split_overlaps_against_all_pairs(spark, seed):
    rows = corpus(seed)
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[2] and b[2] and (a[2].lower() == "train") != (b[2].lower() == "train"):
            if (num(a[1]) is not None and num(a[1]) == num(b[1])) or over(a[4] or "", b[4] or "") >= 0.85:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in P.split_overlaps(df, per_task=3).collect()]
    assert set(got) == want and len(got) == len(want)
    links = {r.id: r.n_links for r in P.overlap_links(df).collect()}
    assert all(links.get(r[0], 0) == sum(r[0] in p for p in want) for r in rows)
    report = P.overlap_report(df, P.overlap_links(df)).collect()
    assert sum(r.n_pairs for r in report) == len(want) and {r.split for r in report} <= {"val", "test"}
    assert P.split_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = corpus(seed)
    text = {r[0]: (r[4] or "") + "\n" + (r[5] or "") for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(text), 2) if over(text[a], text[b]) >= 0.75}
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in P.near_duplicate_pairs(df).collect()]
    assert len(set(got)) == len(got) and set(got) <= want and len(want - set(got)) <= 0.002 * len(want) + 0
    groups = {r.id: r for r in P.near_duplicate_groups(df).collect()}
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id
    for i, r in groups.items():
        assert r.n_links == sum(i in p for p in want)
    assert P.near_duplicate_pairs(df.limit(0)).count() == 0 and P.near_duplicate_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("t", [0.7, 0.85, 0.95])
def test_blocks_lose_no_pair(t):
    """Any two sets with an overlap of at least t share a block code and are within the Hamming radius."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(2, 120))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)])
        j = (n - drop) / (n + len(b) - (n - drop))
        if j < t or len(b) == n == n - drop:
            continue
        if j < 1:
            assert set(P.block_codes(a, t)) & set(P.block_codes(b, t)), (n, len(b), j)
            far = int((P.parity_sketch(a, 64) ^ P.parity_sketch(b, 64)).sum())
            assert far <= (1 - t) / (1 + t) * (n + len(b)) + 1e-9


def test_reference_distances_never_discard_a_true_pair():
    rng = np.random.default_rng(9)
    pivots = np.array([P.parity_sketch(rng.integers(0, 1 << 63, 90, dtype=np.uint64), P.SKETCH) for _ in range(P.PIVOTS)])
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.concatenate([a[10:], rng.integers(0, 1 << 63, 9, dtype=np.uint64)])
        d = [np.abs((P.parity_sketch(x, P.SKETCH) ^ pivots).sum(1).astype(int)) for x in (a, b)]
        assert np.abs(d[0] - d[1]).max() <= (1 - 0.75) / (1 + 0.75) * (len(a) + len(b))


def test_codes_of_long_texts_are_bounded():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[300:], rng.integers(0, 1 << 63, 250, dtype=np.uint64)])
    assert len(P.block_codes(a, 0.85)) <= 3 * P.SEGMENTS**2 / 2 + P.LONG_BANDS
    assert set(P.block_codes(a, 0.85)) & set(P.block_codes(b, 0.85))
    for n in (150, 200, 260, 400):  # around the level where the codes change, both sets use the same ones
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[int(n * 0.07) :], rng.integers(0, 1 << 63, int(n * 0.07), dtype=np.uint64)])
            assert set(P.block_codes(a, 0.85)) & set(P.block_codes(b, 0.85))


def test_long_texts(spark):
    rng = random.Random(6)
    w = [f"w{i}" for i in range(4000)]
    edit = lambda n: [rng.choice(w) + "x" if i < n else x for i, x in enumerate(w)]
    rows = [("a", None, "train", "s", " ".join(w), ""), ("b", None, "test", "s", " ".join(edit(150)), ""), ("c", None, "val", "s", " ".join(edit(1000)), "")]
    df = spark.createDataFrame(rows, "id string, group_id string, split string, target_source string, instruction string, response string")
    assert [tuple(r) for r in P.split_overlaps(df).collect()] == [("a", "b")]
    assert ("a", "b") in {tuple(r) for r in P.near_duplicate_pairs(df).collect()}


near = lambda x, y: (x[:, 0] + y[:, 0]) % 3 > 0  # noqa: E731  # sent to the workers by value


def pairs_of(rows, sided):
    return {(a, b) for c, a, x, s in rows for d, b, y, t in rows if c == d and (x + y) % 3 and (a != b and s and not t if sided else a < b)}


@pytest.mark.parametrize("longest", [1, 4, 1000])
def test_met_forms_each_pair_once(spark, longest):
    rng = random.Random(7)
    rows = [(rng.randint(0, 12), r, r % 5, rng.random() < 0.6) for r in (rng.randint(0, 40) for _ in range(160))]
    df = spark.createDataFrame(rows, "code long, r long, x0 long, side boolean")
    assert sorted(map(tuple, P._met(df.drop("side"), near, 1, None, longest, 4).collect())) == sorted(pairs_of(rows, False))
    assert sorted(map(tuple, P._met(df, near, 1, "side", longest, 4).collect())) == sorted(pairs_of(rows, True))


@pytest.mark.parametrize("longest", [1, 3, 6, 1000])
@pytest.mark.parametrize("cut", [1, 2, 7, 500])
def test_runs_over_any_batches(longest, cut):
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.choice([1, 2, 2, 2, 3, 4, 5, 5]), r, r % 5, rng.random() < 0.5) for r in (rng.randint(0, 9) for _ in range(60)))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("code", "r", "x0", "side"), x)) for x in rows[i : i + cut]]) for i in range(0, len(rows), cut)]
    for sided in (False, True):
        got, hot = set(), []
        for b in P._runs(iter(batches), near, 1, sided, longest):
            for x in b.to_pylist():
                hot.append((x["code"], x["ra"], x["x"][0], x["side"])) if x["rb"] is None else got.add((x["ra"], x["rb"]))
        assert got | pairs_of(hot, sided) == pairs_of(rows, sided)


def test_thinning_keeps_every_true_pair():
    rng = np.random.default_rng(12)
    pivots = np.array([P.parity_sketch(rng.integers(0, 1 << 63, 90, dtype=np.uint64), P.SKETCH) for _ in range(P.PIVOTS)])
    of, close, prints = P._measures(pivots), P._near_pivots(0.75), P._near_prints(0.85)
    for n, drop, new in ((90, 10, 9), (8, 1, 1), (3000, 300, 300), (94, 0, 20)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
        assert close(np.array([of(a)]), np.array([of(b)]))[0]
        if (n - drop) / (n + new) >= 0.85:
            assert prints(np.array([[len(a), *P._print(a)]]), np.array([[len(b), *P._print(b)]]))[0]
    x, y = (rng.integers(0, 1 << 63, 90, dtype=np.uint64) for _ in range(2))
    assert not close(np.array([of(x)]), np.array([of(y)]))[0]
