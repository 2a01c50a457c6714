import math
import random

import pytest

from corpusloom.llm import mixture, residue, splits

GOOD = ("Open the page of your order and note the state.", "The letter may show <old> and <new> prices.", "Give it as [number] then [town].", "The code below it is {7}.", "It told me to enable JavaScript, which I did.", "A 404 message flashed up for a second.", "If the page answers with error 500, wait and reload it.", "The sample text on the box is smudged.")
BAD = ("Dear {{customer_name}}, your order is on its way.", "Leave it with __AGENT__ please.", "Your parcel [shop name] is here.", "Error 502: Bad Gateway. Request id 3f", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet.", "503 Service Unavailable", "TBD", "Your text here", "Hello [[ORDER_NUMBER]]", "{\"status\": 500, \"error\": \"Internal Server Error\"}", "Order {shop name} now")


def test_residue(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        bad = i % 10 == 0
        texts = [" ".join(rng.sample(GOOD, 3)), " ".join(rng.sample(GOOD, 3))]
        if bad:
            texts[i % 2] = BAD[i // 10 % len(BAD)] if i % 20 else texts[i % 2] + " " + BAD[i // 10 % len(BAD)]
        # the names of slots are learnt from the unmistakable ones
        if i % 50 == 10:
            texts[0] += " {{shop name}}"
        rows.append((f"r{i}", *texts, bad))
    df = spark.createDataFrame([(*r[:3], "x", 1) for r in rows], "id string, instruction string, response string, passage string, n int")
    got = {r.id for r in residue.residue(df).collect()}
    want = {r[0] for r in rows if r[3]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 2, (want - got, got - want)


def test_residue_odd_rows(spark):
    df = spark.createDataFrame([(None, "{{x}}", "y"), ("a", None, None), ("b", "", ""), ("c", "{{name}}", None), ("c", "{{name}}", None), ("d", "word " * 50_000, "x")], "id string, instruction string, response string")
    assert [r.id for r in residue.residue(df).collect()] == ["c"]
    assert residue.residue(df.limit(0)).count() == 0


DOCS = "doc_id long, source string, text string, tokens string, use int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mixture_conditions(spark):
    rng, rows = random.Random(6), []
    for i in range(600):
        s = "a" if i % 3 else rng.choice(["b", "B ", "c-d", "c_d", None, "other"])
        rows.append((i, s, " ".join(["word"] * rng.randint(1, 120)) if i % 50 else None, "t", 1))
    docs = spark.createDataFrame(rows, DOCS)
    want = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c_d", 0.2, 5), ("missing", 0.1, 3), ("zero", 0.0, 0)], TARGETS)
    got = mixture.mixture(docs, want, least_block=50).collect()
    uses, tokens = {}, {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r.use)
        tokens[r.source] = tokens.get(r.source, 0) + r.tokens
    repeats = {"a": 1, "b": 2, "c_d": 5}
    assert all(sorted(u) == list(range(1, len(u) + 1)) and len(u) <= repeats[s] for (s, _), u in uses.items())
    total, share = sum(tokens.values()), {"a": 3 / 9, "b": 4 / 9, "c_d": 2 / 9}
    assert all(abs(tokens[s] - share[s] * total) <= 130 for s in share)
    table = {r.source: r for r in mixture.shares(mixture.mixture(docs, want, least_block=50), want).collect()}
    assert table["missing"].tokens == 0 and table["a"].actual_share == pytest.approx(tokens["a"] / total, abs=1e-6)


@pytest.mark.parametrize("weights", [[1, 1, 1], [0.6, 0.3, 0.1], [0.9, 0.05, 0.05], [0.123, 0.456, 0.2, 0.221]])
def test_every_prefix_is_within_a_block(weights):
    n = 400
    w = {f"s{i}": x / sum(weights) for i, x in enumerate(weights)}
    blocks = {s: round(n * x) for s, x in w.items()}
    slots = mixture.schedule(blocks, w)
    assert sorted(slots.values())[-1] <= n + len(w) and len(set(slots.values())) == len(slots)
    done = dict.fromkeys(w, 0)
    by_slot = {k: s for (s, _), k in slots.items()}
    for t in range(n - len(w)):
        if t in by_slot:
            done[by_slot[t]] += 1
        assert all(abs(done[s] - w[s] * (t + 1)) < 1 + 1e-9 for s in w), t


def test_mixture_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", "", 1), (2, "a", None, "", 1), (3, "a", "", "", 1), (4, "a", "long " * 40_000, "", 1), (4, "a", "long " * 40_000, "", 1)], DOCS)
    want = spark.createDataFrame([("a", 1.0, 2), (None, 0.0, 1), ("b", None, None)], TARGETS)
    got = mixture.mixture(docs, want).collect()
    assert [(r.doc_id, r.use) for r in sorted(got, key=lambda r: r.use)] == [(4, 1), (4, 2)]
    assert mixture.mixture(docs.limit(0), want).count() == 0 and mixture.mixture(docs, want.limit(0)).count() == 0


CTX = "id string, group_id string, thread_ref string, intent string, root string, n int, s string"


def corpus(spark, n=900):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        g = 7 if rng.random() < 0.3 else rng.randint(10, 200)
        t = f"th-{rng.randint(0, 2000)}" if rng.random() < 0.1 else rng.choice([None, "", "-", "none", "unknown"])
        rows.append((f"r{i:04d}", rng.choice([f"g-{g:05d}", f" G{g}", f"{g}", f"g‑{g}"]) if rng.random() < 0.95 else None, t, rng.choice(["ask", "Ask", "tell it", "tell_it", None]), "x", 1, "y"))
    return rows, spark.createDataFrame(rows, CTX)


def related(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def num(g):
        d = "".join(c for c in g or "" if c.isdigit())
        return int(d) if d else None

    for r in rows:
        for k in (("g", num(r[1])) if num(r[1]) is not None else None, ("t", r[2]) if r[2] and any(c.isdigit() for c in r[2]) else None):
            if k:
                parent[find(("r", r[0]))] = find(k)
    sets = {}
    for r in rows:
        sets.setdefault(find(("r", r[0])), []).append((r[0], num(r[1])))
    return list(sets.values())


def test_related_sets(spark):
    rows, df = corpus(spark)
    want = {(i, min(x for x, _ in s)) for s in related(rows) if len({g for _, g in s if g is not None}) > 1 for i, _ in s}
    got = [tuple(r) for r in splits.related_sets(df).collect()]
    assert want and set(got) == want and len(got) == len(want)
    assert splits.related_sets(df.limit(0)).count() == 0


def test_splits_keep_sets_and_shares(spark):
    rows, df = corpus(spark)
    got = {r.id: r.split_new for r in splits.assign_splits(df).collect()}
    assert set(got) == {r[0] for r in rows}
    largest = 0
    for s in related(rows):
        assert len({got[i] for i, _ in s}) == 1
        largest = max(largest, len(s))
    n = {k: sum(v == k for v in got.values()) / len(got) for k in ("train", "val", "test")}
    slack = max(0.03, math.ceil(0) / len(got))
    assert abs(n["train"] - 0.8) <= max(slack, largest / len(got) - 0.8) and abs(n["val"] - 0.1) <= slack and abs(n["test"] - 0.1) <= slack
    assert splits.assign_splits(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    "Test, test, test|test-test|test bar|test; asdf sdf|Test sdf|test test test|foo bar|asdf asdf|blah blah|xxx xxx|qwerty asdf|Lorem ipsum|dolor sit amet|Please enable JavaScript to view this page|You need to allow scripts|script blocker and reload|If nothing appears, JavaScript|"
    "JavaScript is disabled|This browser does not support it|This app needs JavaScript|Traceback (most recent call last)|404 not found|503 service unavailable|403 forbidden|401 unauthorised|502 bad gateway|400 bad request|500 internal server error|429 too many requests|408 request timeout|"
    "Request timed out|Rate limit reached|Your title goes here|Description here|Sample text to be written|Filler copy is added|Insert your message here|Content coming soon|TBD|TBA|TODO|FIXME|Dummy text, do not use|Copy to follow|Something went wrong on our side|Your session has expired|Session timed out|Access denied|"
    "The page you requested was not there|Page not found|An unexpected error occurred|Internal error has happened|Connection reset|Connection timed out|Unhandled exception|This service is temporarily down|Checking your browser before it|Loading needs javascript".split("|"),
)
def test_every_trusted_branch_passes_the_column_search(text):
    import pyarrow as pa
    import pyarrow.compute as pc

    assert residue.TRUSTED.search(text.lower())
    assert pc.match_substring_regex(pa.array([text]), residue.MAY_TRUST, ignore_case=True)[0].as_py()
    assert any(trusted for _, trusted in residue.passages(text))


def test_slots_of_any_length_and_script():
    got = residue.passages("Dear {{the full legal name of the customer as it is printed on the contract}}, {{имя клиента}} and [名前] write.")
    assert [p.split("\t")[2] for p, _ in got if p.startswith("slot")] == ["the full legal name of the customer as it is printed on the contract", "имя клиента", "名前"]


def test_hidden_seeds_are_found_by_the_model(spark):
    """Trusted passages that the fit sees as unlabelled are found again: the model decides, not the seeds."""
    rng, rows = random.Random(5), []
    codes = ["502: Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "500 Internal Server Error", "404 Not Found", "403 Forbidden"]
    names = "customer name,shop name,order number,agent name,order id,customer id,agent id,shop town,customer town,order date".split(",")
    for i in range(600):
        texts = [" ".join(rng.sample(GOOD, 3)), " ".join(rng.sample(GOOD, 3))]
        if i % 6 == 0:
            texts[i % 2] = "Error " + rng.choice(codes) + rng.choice([".", " for this page.", " while loading.", ""])
        if i % 6 == 1:
            texts[0] += f" Ask {{{{{rng.choice(names)}}}}} about it."
        rows.append((f"r{i}", *texts))
    df = spark.createDataFrame(rows, "id string, instruction string, response string")
    found, hidden = residue.held_out_recall(df)
    assert hidden >= 5 and found >= 0.8 * hidden
    assert residue.held_out_recall(df.limit(0)) == (0, 0)
    assert all(abs(r.log_odds) < 1e4 for r in residue.scored(df).collect())
