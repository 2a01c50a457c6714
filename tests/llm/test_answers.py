import random

import pytest

from corpusloom.llm import answers as A
from corpusloom.llm.textbits import CAN, CANNOT, CUES, REFUSE, is_empty_answer, language, refusal_votes

SCHEMA = "answer_id long, id string, tag string, answer string, gen_tokens int, truncated boolean, error string, key string, votes string"
QUERY = "My parcel was sent to the old flat and the page shows it as waiting. Who would I have to ask in order to change the address?"
GERMAN = "Ich habe bei dem Laden bestellt und die Sendung ist noch nicht da. Wer kann mir bitte sagen, was ich tun soll?"
SENTENCES = (
    "Please open the address page and note the state that it shows.", "You could ask for a record of the chat.", "A reply before the weekend would be normal.",
    "Keep the label and the photos together in one folder.", "Ask the support desk to confirm the change in writing.", "Leave the parcel sealed until the shop has answered.",
    "Sign out, wait a few minutes, and open the page once more.", "The outcome depends on the terms that you accepted.",
)


def labelled(n=400, seed=11):
    """(answer, defect) rows: a fixture with known defects. Seed 21 is the one that the cutoffs are chosen from."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        s = " ".join(rng.sample(SENTENCES, rng.randint(2, 6)))
        kind = rng.choice(["ok"] * 8 + ["dropped", "list", "truncated", "empty", "refusal", "copied_question", "other_language"])
        if kind == "dropped":
            out.append((s[:-1], None))
        elif kind == "list":
            out.append((s + "\n\nWhat to have ready:\n- order number\n- date of purchase", None))
        elif kind == "truncated":
            last = rng.choice(SENTENCES)
            out.append((s + " " + last[: rng.randint(3, len(last) - 8)] + rng.choice(["", "", "...", " [...]"]), "truncated"))
        elif kind == "empty":
            out.append((rng.choice(["", " ", None, "N/A", "...", "Answer:", "<|im_end|>", "​"]), "empty"))
        elif kind == "refusal":
            out.append((rng.choice(["I'm sorry, but I can't help with that.", "I must decline this one. Is there something else?", "Unfortunately I am unable to assist with this request."]), "refusal"))
        elif kind == "copied_question":
            out.append((rng.choice([QUERY, "Question: " + QUERY, QUERY.lower(), QUERY + " " + QUERY, QUERY.replace("old", "former")]), "copied_question"))
        elif kind == "other_language":
            out.append((rng.choice([GERMAN + " Das ist auf der Seite nicht zu sehen.", "Il faut que vous demandiez une copie de la facture et que vous la gardiez avec le colis.", "Puede pedir una copia de la factura en la tienda y si no llega hay que esperar.", "Guten Tag! " + GERMAN]), "other_language"))
        else:
            out.append((rng.choice(["", "I cannot change anything from here, but here is what you can do. ", "Guten Tag! ", "Bonjour! ", "You asked: " + QUERY + "\n", "Yes: the fee table. "]) + s, None))
    return out


def frame(spark, rows):
    rng = random.Random(3)
    data = [(i, "q1", f"t{i % 3}", a, rng.choice([None, 40, 256]), rng.choice([None, False, False, True]), rng.choice([None, None, "TimeoutError: x"]), "k", "v") for i, (a, _) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("q1", QUERY), ("q2", GERMAN), ("q3", None)], "id string, query string")


def test_held_out_accuracy(spark, items):
    rows = labelled(800, 12)
    got = {r.answer_id: r.defect for r in A.answer_defects(frame(spark, rows), items).collect()}
    for d in A.DEFECTS:
        want = {i for i, (_, x) in enumerate(rows) if x == d}
        have = {i for i, x in got.items() if x == d}
        hit = len(want & have)
        assert hit >= 0.9 * len(want) and hit >= 0.9 * len(have), (d, len(want), len(have), [rows[i] for i in want ^ have][:5])


def chosen_cutoffs(spark, items, seed):
    rows = labelled(1500, seed)
    votes, counts = A.vote_patterns(frame(spark, rows), items)
    post, v = A.posteriors(counts), {r.answer_id: r.v for r in votes.collect()}
    at = {d: [i for i, (x, _) in enumerate(A.LFS) if x == d] for d in A.DEFECTS}
    out = {}
    for d in A.DEFECTS:
        of = lambda i: post.get(d + ":" + "".join(v[i][k] for k in at[d]), 0.0) if i in v else 0.0  # noqa: B023,E731
        # an answer with another defect is no row for this one: only one is the label
        out[d] = A.best_cutoff([(of(i), x == d) for i, (_, x) in enumerate(rows) if x in (None, d)])
    return out


def test_cutoffs_are_those_of_the_labelled_rows(spark, items):
    got = chosen_cutoffs(spark, items, 21)
    assert {d: round(x, 2) for d, x in got.items()} == A.CUTOFFS


def test_best_cutoff():
    assert A.best_cutoff([(0.9, True), (0.8, True), (0.2, False)]) == 0.5
    assert A.best_cutoff([(0.9, True), (0.4, False), (0.3, True)]) == pytest.approx(0.15)
    assert A.best_cutoff([]) == 0.5 and A.best_cutoff([(0.7, False)]) == 0.5


def test_rates_follow_the_found_rows(spark, items):
    rows = labelled()
    df = frame(spark, rows)
    cut = {r.answer_id for r in A.truncated_answers(df, items).collect()}
    for r in A.truncation_rates(df, items).collect():
        mine = [i for i in range(len(rows)) if f"t{i % 3}" == r.tag]
        assert r.n_answers == len(mine) and r.n_truncated == len(cut & set(mine))


def test_odd_rows(spark, items):
    rows = [(None, 0), ("", 0), ("word " * 60_000, 0), ("word " * 60_000, 0), ("🙂", 0), ("-", 0), ("a", 0), ("…", 0), ("One. Two", 0)]
    df = frame(spark, rows)
    df = df.unionByName(df.limit(1).selectExpr("cast(null as long) answer_id", "cast(null as string) id", "cast(null as string) tag", "answer", "gen_tokens", "truncated", "error", "key", "votes"))
    df = df.unionByName(df.where("answer_id = 8").selectExpr("900 as answer_id", "cast(null as string) id", "cast(null as string) tag", "answer", "cast(null as int) gen_tokens", "cast(null as boolean) truncated", "cast(null as string) error", "key", "votes"))
    got = {r.answer_id: r.defect for r in A.answer_defects(df, items).collect()}
    assert {got.get(i) for i in (0, 1, 4, 5, 7)} == {"empty"} and None not in got
    assert A.answer_defects(df.limit(0), items).count() == 0 and A.truncated_answers(df.limit(0), items).count() == 0
    assert A.answer_defects(df, items.limit(0)).count() >= 5


def test_joined_queries_give_the_same(spark, items, monkeypatch):
    rows = labelled(120)
    df = frame(spark, rows)
    a = {tuple(r) for r in A.answer_defects(df, items).collect()}
    monkeypatch.setattr(A, "MAX_ITEMS", 0)
    assert {tuple(r) for r in A.answer_defects(df, items).collect()} == a


@pytest.mark.parametrize("text,want", [(None, True), ("n/a", True), ("Assistant:", True), ("<|im_end|>", True), ("[]", True), ("No.", False), ("42", False), ("Yes, within 3 days.", False)])
def test_empty(text, want):
    assert is_empty_answer(text) is want


def test_refusals_with_guidance_are_none():
    assert refusal_votes("i'm sorry, but i can't help with that.") == (True, True)
    assert refusal_votes("i can't help from here. open the order page and note the state.") == (True, False)
    assert refusal_votes("a reply cannot be expected before monday.") == (False, False)


def test_languages():
    assert language("ich habe das nicht auf der seite gesehen".split())[0] == "de"
    assert language("the page shows that it is not there".split())[0] == "en"
    assert language([])[0] is None


def test_label_model_recovers_a_planted_model():
    rng = random.Random(1)
    fns = tuple(("refusal", f"f{i}") for i in range(4))
    from collections import Counter

    seen, truth = Counter(), Counter()
    for _ in range(20_000):
        y = rng.random() < 0.06
        p = "".join(("+" if rng.random() < (0.85 if y else 0.03) else "-") if rng.random() < 0.9 else "0" for _ in fns)
        seen[p] += 1
        truth[p] += y
    post = A.fit_label_model(seen, fns)["refusal"]
    wrong = sum(min(n, abs(truth[p] - n)) if (post[p] > 0.5) else truth[p] for p, n in seen.items())
    assert wrong < 0.02 * 20_000


def test_every_tail_text_of_a_context_counts(spark):
    rows = [(k, "a", "t", f"Text {chr(97 + k % 26)}{chr(97 + k // 26)}x is here.\nKind regards from the desk", 30, None, None) for k in range(200)]
    answers = spark.createDataFrame(rows, "answer_id long, id string, tag string, answer string, gen_tokens int, truncated boolean, error string")
    prof = A.profile(answers, spark.createDataFrame([("a", QUERY)], "id string, query string"), False)
    eot = prof.where("kind = 'eot'").groupBy("key").count()
    assert eot.agg({"count": "max"}).first()[0] == 200


@pytest.mark.parametrize(
    "text",
    "i will not discuss this.|that is beyond my scope.|i could not answer.|i am not going to comment.|i do not wish to talk.|i don't wish to talk.|i don’t wish to talk.|i cant help.|this is against my rules.|against my policy.|"
    "no reply can be given.|no comment can be given.|i am refusing.|je ne puis pas répondre.|i am not in a position to help.|i would pass on it.|das kann man nicht beantworten.|outside what i do|i am unable to help|not able to help|"
    "not permitted to say; not permitted to answer|not allowed to help|not comfortable to talk|i won't be able to help|i won’t help|i cannot help|i can not help|i must decline|i'd rather not say|i prefer not to get|it cannot be processed|"
    "not something we can do|beyond of my remit|no answer can be given|speak about something else|against my guidelines|ne peux pas vous aider|no puedo ayudar|kann ich leider nicht helfen|não posso ajudar|не могу помочь".split("|"),
)
def test_every_refusal_passes_the_cues(text):
    assert REFUSE.search(text)
    cues = [c for c in CUES if c in text]
    assert cues and (not CAN.issuperset(cues) or CANNOT.search(text))
    assert refusal_votes(text)[0]


def test_cant_is_a_whole_word():
    assert not refusal_votes("this gives significant support.")[0]


@pytest.mark.parametrize("text", ["<|endoftext|>" * 7, "N/A" + " " * 90, "-" * 90 + " N/A", "Answer:" + " " * 90, "</s>" * 40 + "no answer"])
def test_empty_whatever_the_length(text):
    assert len(text) > 80 and is_empty_answer(text) and not is_empty_answer(text + " Open the page.")


def test_long_words_and_long_endings(spark, items):
    """Words beyond the longest node, ellipses and closing marks of any length are looked at whole."""
    word = "a" * 30 + "b" * 40
    rows = [(f"The {word} is open until the shop has answered. Keep it.", None)] * 3 + [("Please ask about the " + word[:60], 1), ("Keep it in one folder" + " ..." * 40, 1), ("Keep it in one folder." + ")" * 30, None)]
    rows += [(s + " " + t, None) for s in SENTENCES for t in SENTENCES]
    got = {r.answer_id for r in A.truncated_answers(frame(spark, rows), items).collect()}
    assert got == {i for i, (_, x) in enumerate(rows) if x}


def test_language_votes_are_measured():
    """German with a few English words is in another language, whatever the share of those."""
    german = "ich habe das nicht gesehen und die Seite ist mit dem Paket auf der Liste, aber es wird noch bei uns sein wenn sie the of this with that they has"
    q = A._Queries({"q": QUERY}).get("q")
    v = A._votes(german, A._tokens(german), False, 40, None, q, False)
    assert v[9] == "+" and v[11] == "+"


@pytest.mark.parametrize("text", ["i will not discuss this.", "I CANNOT help", "that is beyond my scope.", "ne peux pas vous aider", "can’t help", "не могу помочь"])
def test_the_column_search_covers_the_cues(text):
    import pyarrow as pa
    import pyarrow.compute as pc

    assert pc.match_substring_regex(pa.array([text]), A.MAY_DECLINE)[0].as_py()


def test_every_evidence_string_is_fitted():
    """The fit recovers planted classes, and a few tails are judged by where it starts."""
    rng, seen, truth = random.Random(2), {}, {}
    for _ in range(5000):
        y = rng.random() < 0.25
        e = "".join(rng.choices(values, [A.START[n][v][0 if y else 1] for v in values])[0] for n, values in A.EVIDENCE)
        seen[e] = seen.get(e, 0) + 1
        truth[e] = truth.get(e, 0) + y
    odds = A.fit_cut_model(seen)
    assert sum(n - truth[e] if odds[e] > 0 else truth[e] for e, n in seen.items()) < 0.05 * 5000
    assert A.fit_cut_model({}) == {} and A.fit_cut_model({"100000000": 1})["100000000"] > 0 > A.fit_cut_model({"005000000": 1})["005000000"]
