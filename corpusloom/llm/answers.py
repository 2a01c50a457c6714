"""Defective and cut-off answers (problems 1 and 3).

One Arrow pass over the answers (``profile``) gives everything both operators need: counts for the corpus vocabulary and
for word contexts, combined inside each task before anything is shuffled; a row for each answer that does not end with a
final stop (a *tail*); and the votes of the labelling functions.

Cut-off answers. The corpus vocabulary trie is a table of (prefix -> known longer words): every word seen at least twice
before the end of an answer, and each of its proper prefixes as a node. A tail whose final token is no known word but a
node of the trie is cut inside a word. Cuts between words are found by the contexts of 4, 2 and 1 masked words: the share
of their occurrences that a sentence end follows, without the tail's own. Length evidence (a character length or token
count at which far more tails end than near it) and the flags decide what stays open.

Defects. Each labelling function votes for, against or abstains; votes are counted by pattern in every task, and an
expectation-maximization label model (conditionally independent multinomial votes, fitted on all pattern counts) gives
each pattern its posterior by defect. Posteriors above the cutoff give labels, several if need be.

Defined results: a null answer is empty; an answer of an unknown item has no query, so the functions that compare with it
abstain; null hints abstain; copies each get a row; an empty table gives no rows; extra columns are ignored; texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textbits import ANY_STOP, CAN, CANNOT, CUES, MAY_DECLINE, is_empty_answer, language, refusal_votes, script_language
from corpusloom.session import materialize, spread

DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")
#: Labelling functions in the order of the vote string; those of "truncated" come from the tails.
LFS = (
    ("empty", "no_own_words"), ("empty", "few_tokens"), ("empty", "error_hint"),
    ("refusal", "declines"), ("refusal", "nothing_else"), ("refusal", "short"),
    ("copied_question", "covers_query"), ("copied_question", "overlap"), ("copied_question", "little_of_its_own"),
    ("other_language", "function_words"), ("other_language", "script"), ("other_language", "sentences"),
    ("truncated", "model"), ("truncated", "cut_word"), ("truncated", "open_context"), ("truncated", "length"), ("truncated", "flag"),
)
N_TEXT = sum(d != "truncated" for d, _ in LFS)
#: Posterior cutoffs: best_cutoff() over the labelled rows of tests/llm/test_answers.py, whose other rows measure the accuracy.
CUTOFFS = {"empty": 0.49, "refusal": 0.5, "copied_question": 0.5, "other_language": 0.5, "truncated": 0.32}
#: At most so many items are sent to the workers as a dictionary; beyond it the queries are joined.
MAX_ITEMS = 50_000
FLUSH = 200_000

#: Words in lower case first, as most are, but for those that may begin an address; then addresses, reference numbers,
#: other words, numbers, line ends and marks. The second one gives the same for texts of ASCII only, in less time.
_TOK = re.compile(r"[a-gi-z][a-z]*(?:['’-][^\W\d_]+|[^\W\d_]+)*|https?://\S+|[A-Z]{2}-\d+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d(?:[\d.,:]*\d)?|\n|[^\w\s]")
_TOK_ASCII = re.compile(r"[a-gi-z][a-z]*(?:['-][A-Za-z]+|[A-Z][A-Za-z]*)*|https?://\S+|[A-Z]{2}-\d+|[A-Za-z]+(?:['-][A-Za-z]+)*|\d(?:[\d.,:]*\d)?|\n|[^\w\s]", re.A)
_SENT = re.compile(r"(?<=[.!?])\s+|\n+")
#: What stands in brackets where a text was cut.
_CUT_NOTES = frozenset(("...", "…", "cut", "truncated", "continued", "more"))
_STOPS, _CLOSERS = frozenset(".!?。！？"), "\"'”’»)]"
_OPEN = frozenset(",;:-–—([{/$€£&+=<“‘«¿¡@")
_HINT = re.compile(r"peer closed|no bytes|timeout|reset|length|context window", re.I)
_PAIRS = {")": "(", "]": "[", '"': '"', "”": "“„", "’": "‘’", "'": "'", "»": "«", "}": "{"}
_LASTWORD = re.compile(r"[^\W\d_]+$")

_FIELDS = [
    ("kind", pa.string()), ("key", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("hash", pa.int64()),
    ("answer_id", pa.int64()), ("tag", pa.string()), ("last", pa.string()), ("keys", pa.list_(pa.string())),
    ("open", pa.bool_()), ("ellipsis", pa.bool_()), ("dot", pa.bool_()), ("flag", pa.int32()), ("err", pa.int32()),
    ("copied", pa.bool_()), ("votes", pa.string()),
]
_ARROW = pa.schema(_FIELDS)
PROFILE = (
    "kind string, key string, a long, b long, hash long, answer_id long, tag string, last string, keys array<string>, "
    "open boolean, ellipsis boolean, dot boolean, flag int, err int, copied boolean, votes string"
)
COUNTS, TAILS, VOTES = range(0, 5), (0, 4, *range(5, 15)), (0, 5, 6, 15)


def _batch(rows: list[tuple], at) -> pa.RecordBatch:
    """Rows that fill the fields at those positions; the others are null."""
    given = dict(zip(at, zip(*rows))) if rows else {}
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(given[i], t) if i in given else pa.nulls(n, t) for i, (_, t) in enumerate(_FIELDS)], schema=_ARROW)


class _Cache(dict):
    """fn(token), made once per token; emptied when it grows beyond a bound."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, token):
        if len(self) > 400_000:
            self.clear()
        self[token] = got = self.fn(token)
        return got


def _masked(token: str) -> str:
    """Numbers become #, addresses §, capitalised words @; function words are kept in lower case."""
    if token[-1].isdigit() and (token[0].isdigit() or token[2:3] == "-"):
        return "#"
    if token.startswith("http"):
        return "§"
    return token if not token[0].isupper() else low if (low := token.lower()) in ANY_STOP else "@"


def _worded(token: str) -> str:
    """The word in lower case, nothing for marks."""
    return token.lower() if token[0].isalnum() else ""


_MASK, _LOW = _Cache(_masked), _Cache(_worded)


def _sentences(masked: list[str]) -> list[str]:
    """Sentences and lines of masked tokens, joined by blanks."""
    joined = " ".join(masked).replace(" . ", " .\n").replace(" ? ", " ?\n").replace(" ! ", " !\n")
    return [p for p in map(str.strip, joined.split("\n")) if p]


def _tokens(text: str) -> list[str]:
    return (_TOK_ASCII if text.isascii() else _TOK).findall(text)


def _without_ellipsis(body: str) -> str:
    """body without the ellipses and bracketed notes of a cut at its end, however many."""
    while body:
        if body[-1] == "…":
            body = body[:-1]
        elif body.endswith("..."):
            body = body.rstrip(".")
        elif body[-1] in ")]" and (i := max(body.rfind("["), body.rfind("("))) >= 0 and body[i + 1 : -1].strip() in _CUT_NOTES:
            body = body[:i]
        else:
            break
        body = body.rstrip()
    return body


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _paired(body: str) -> bool:
    """The closing mark at the end has its opening mark in the last line, so a quotation or bracket is complete."""
    line = body[body.rfind("\n") + 1 : -1]
    return any(o in line for o in _PAIRS[body[-1]])


def _last_word(body: str) -> str:
    """The letters at the end, with inner hyphens and apostrophes as in the vocabulary."""
    i = len(body)
    while i and (body[i - 1].isalpha() or body[i - 1] in "'’-" and i < len(body) and i > 1 and body[i - 2].isalpha()):
        i -= 1
    return body[i:]


def _contexts(tokens: list[str]) -> list[str]:
    """Keys of the last 4, 2 and 1 tokens."""
    return ["4" + " ".join(tokens[-4:]), "2" + " ".join(tokens[-2:]), "1" + tokens[-1]]


def _bare_end(text: str) -> str:
    """Without blanks, symbols such as emoji and ignorable characters at the end."""
    text = text.rstrip()
    while text and unicodedata.category(text[-1]) in ("So", "Sk", "Cf", "Mn", "Zs", "Cc"):
        text = text[:-1].rstrip()
    return text


class _Queries:
    """What the votes need of each query, made once."""

    def __init__(self, known: dict[str, str] | None):
        self.known, self.made = known, {}

    def get(self, item, text=None):
        key = item if self.known is not None else text
        if key not in self.made:
            q = self.known.get(item) if self.known is not None else text
            w = list(filter(None, map(_LOW.__getitem__, _tokens(q)))) if q else []
            if len(self.made) > 100_000:
                self.made.clear()
            self.made[key] = (frozenset(w), language(w)[0] if w else None, script_language(q) if q else None) if w else None
        return self.made[key]


def _profile(batches, known, with_votes):
    """See the module text. known: {item: query}, or None if each row brings its query in the column q."""
    queries = _Queries(known)
    sentences, names, eot, patterns = Counter(), Counter(), defaultdict(set), Counter()
    n_eot = 0  # (context, text) pairs held

    def flush():
        total, stop, vocab = [Counter() for _ in range(3)], [Counter() for _ in range(3)], Counter()
        for s, n in sentences.items():
            t = ["^", *s.split(" ")]
            if t[-1] in ".!?":
                t.pop()
            if len(t) < 2:
                continue
            two = [x + " " + y for x, y in zip(t, t[1:])]
            four = two[:1] + [t[0] + " " + x for x in two[1:2]] + [x + " " + y for x, y in zip(two, two[2:])]
            if n == 1:
                for c, keys in zip(total, (four, two, t[1:])):
                    c.update(keys)
                vocab.update(t)
            else:
                for c, keys in zip(total, (four, two, t[1:])):
                    for k in keys:
                        c[k] += n
                for k in t:
                    vocab[k] += n
            for c, k in zip(stop, (four[-1], two[-1], t[-1])):
                c[k] += n
        rows = [("context", m + k, n, z[k], None) for m, c, z in zip("421", total, stop) for k, n in c.items()]
        rows += [("word", "w" + w.lower(), n, 0, None) for w, n in vocab.items() if w[0].isalpha()]
        rows += [("word", "w" + w.lower(), n, 0, None) for w, n in names.items()]
        rows += [("eot", k, 1, 1, h) for k, hs in eot.items() for h in hs]
        rows += [("pattern", p, n, 0, None) for p, n in patterns.items()]
        for c in (sentences, names, eot, patterns):
            c.clear()
        return _batch(rows, COUNTS)

    for batch in batches:
        out, voted = [], []
        cols = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        hinted = pc.match_substring_regex(batch.column("answer"), MAY_DECLINE).to_pylist() if with_votes else [False] * batch.num_rows
        qs = cols["q"] if known is None else [None] * batch.num_rows
        for aid, item, tag, text, gen, trunc, err, q, hint in zip(cols["answer_id"], cols["id"], cols["tag"], cols["answer"], cols["gen_tokens"], cols["truncated"], cols["error"], qs, hinted):
            empty = is_empty_answer(text)
            query = None if empty else queries.get(item, q)
            tokens = None
            if not empty:
                tokens = _tokens(text)
                masked = list(map(_MASK.__getitem__, tokens))
                body = _bare_end(text)
                ell = False
                if body and body[-1] in ".…])" and len(bare := _without_ellipsis(body)) < len(body):
                    ell, body = True, _bare_end(bare)
                closed = body.rstrip(_CLOSERS)[-1:] in _STOPS or bool(body) and body[-1] in _PAIRS and _paired(body)
                dot = closed and not ell and body[-1] == "." and body[-2:-1].isdigit()
                parts = _sentences([_MASK[t] for t in _tokens(body)] if ell else masked)
                caps = [t for t, m in zip(tokens, masked) if m == "@"]
                names.update(caps if closed and not ell else caps[:-1])
                if closed and not dot and not ell:
                    sentences.update(parts)
                elif parts:
                    if dot:
                        sentences.update(parts)
                        t = ["^", *parts[-1].split(" ")[:-1]]
                    else:
                        sentences.update(parts[:-1])
                        line = max(body.rfind("\n"), body.rfind(". "), body.rfind("! "), body.rfind("? ")) + 1
                        t = ["^", *(_MASK[x] for x in _tokens(body[line:]))]
                    if len(t) > 1:
                        h = _hash(text)
                        if not dot:
                            if len(t) > 2:
                                sentences[" ".join(t[1:-1]) + " ,"] += 1
                            for key in _contexts(t):
                                n_eot += h not in eot[key]
                                eot[key].add(h)
                        copied = False
                        if query:
                            ws = set(filter(None, map(_LOW.__getitem__, tokens)))
                            both = len(ws & query[0])
                            copied = both >= 0.7 * len(query[0]) and both >= 0.75 * len(ws)
                        last = _last_word(body)
                        keys = [*_contexts(t), f"l{len(text.rstrip())}"]
                        if gen is not None:
                            keys.append(f"g{int(gen)}")
                        if last:
                            keys += ["w" + last.lower(), "p" + last.lower()]
                        flag = -1 if trunc is None else int(trunc)
                        told = 1 if err and _HINT.search(err) else 0
                        out.append(("tail", h, aid, tag, last, keys, bool(body) and body[-1] in _OPEN, ell, dot, flag, told, copied))
            if with_votes:
                v = _votes(text, tokens, empty, gen, err, query, hint)
                patterns[v] += 1
                if "+" in v:
                    voted.append(("votes", aid, tag, v))
        if out:
            yield _batch(out, TAILS)
        if voted:
            yield _batch(voted, VOTES)
        if len(sentences) + len(names) + n_eot > FLUSH:
            yield flush()
            n_eot = 0
    yield flush()


def _votes(text, tokens, empty, gen, err, query, may_decline) -> str:
    """Votes of the text functions, a character each: + for, - against, 0 abstaining."""
    few = "0" if gen is None else "+" if gen <= 3 else "-"
    hint = "0" if not err else "+" if "empty" in err else "-"
    if empty:
        return "+" + few + hint + "-" * (N_TEXT - 3)
    w = list(filter(None, map(_LOW.__getitem__, tokens)))
    declines = nothing = False
    if may_decline:
        low = text.lower()
        cues = [c for c in CUES if c in low]
        if cues and (not CAN.issuperset(cues) or CANNOT.search(low)):
            declines, nothing = refusal_votes(low, cues)
    v = "-" + few + hint + ("+" if declines else "-") + ("+" if nothing else "-") + ("0" if len(w) <= 60 else "-")
    if not query:
        return v + "000000"
    ws = set(w)
    qw, qlang, qscript = query
    both = len(ws & qw)
    v += "+" if both >= 0.7 * len(qw) else "-"
    v += "+" if both >= 0.72 * (len(ws) + len(qw) - both) else "-"
    v += "+" if both >= 0.75 * len(ws) and len(w) >= 4 else "-"
    lang, share = language(w)
    if lang is None or qlang is None:
        v += "0"
    else:
        v += "+" if lang != qlang and share >= 0.6 else "-"
    script = script_language(text)
    v += "0" if script is None and qscript is None or script == "pt" or qscript == "pt" else "+" if script != qscript and (script or lang) != qlang else "-"
    if share == 1 and lang == qlang:
        return v + "-"  # each function word is one of the query's language too, so no sentence is in another one
    away = known = 0
    for s in _SENT.split(text.lower()):
        sl = language(t := s.split())[0]
        if sl:
            known += len(t)
            away += len(t) if sl != qlang else 0
    return v + ("0" if not known or qlang is None else "+" if away > 0.6 * known else "-")


def profile(answers: DataFrame, items: DataFrame, with_votes: bool) -> DataFrame:
    """The written result of the Arrow pass."""
    spark = answers.sparkSession
    cols = [F.col(c).cast(t).alias(c) for c, t in (("answer_id", "long"), ("id", "string"), ("tag", "string"), ("answer", "string"), ("gen_tokens", "double"), ("truncated", "boolean"), ("error", "string"))]
    src = answers.select(*cols).where("answer_id is not null")
    asked = items.select(F.col("id").cast("string").alias("id"), F.col("query").cast("string").alias("q")).where("id is not null and q is not null").dropDuplicates(["id"])
    if asked.count() <= MAX_ITEMS:
        held = spark.sparkContext.broadcast({r.id: r.q for r in asked.collect()})
        run = lambda batches: _profile(batches, held.value, with_votes)
    else:
        src = src.join(asked, "id", "left")
        run = lambda batches: _profile(batches, None, with_votes)
    return materialize(spread(src).mapInArrow(run, PROFILE))


#: Letters of the longest trie node; longer final tokens are compared with the longer words by their first so many letters.
NODE = 40


def _statistics(prof: DataFrame) -> DataFrame:
    """(key, total, stop): contexts, final contexts by distinct text, known words, trie nodes and length peaks."""
    ctx = prof.where("kind = 'context'").groupBy("key").agg(F.sum("a").alias("total"), F.sum("b").alias("stop"), F.sum("a").alias("inner"))
    # nodes of a trie in context: the words that follow the same one or three words, and their proper prefixes
    often = ctx.where("total >= 5 and key not like '1%'").select("key", F.length(F.substring_index("key", " ", -1)).alias("n")).where("n >= 2")
    longer = often.select(F.explode(F.expr(f"transform(sequence(1, least(n - 1, {NODE})), i -> concat('x', substr(key, 1, length(key) - n + i)))")).alias("key")).groupBy("key").agg(F.count("*").alias("total"))
    eot = prof.where("kind = 'eot'").select("key", "hash").distinct().groupBy("key").agg(F.count("*").alias("total"), F.count("*").alias("stop")).withColumn("inner", F.lit(0).cast("long"))
    known = prof.where("kind = 'word'").groupBy("key").agg(F.sum("a").alias("total")).where("total >= 2").withColumn("stop", F.lit(0).cast("long"))
    nodes = known.where(F.length("key") >= 3).select(F.explode(F.expr(f"transform(sequence(2, least(length(key) - 1, {NODE + 1})), k -> concat('p', substr(key, 2, k - 1)))")).alias("key"))
    nodes = nodes.groupBy("key").agg(F.count("*").alias("total")).withColumn("stop", F.lit(0).cast("long"))
    size = prof.where("kind = 'tail' and not dot").select(F.explode("keys").alias("key")).where("key like 'l%' or key like 'g%'").groupBy("key").agg(F.count("*").alias("total"))
    near = size.select(F.substring("key", 1, 1).alias("m"), F.expr("cast(substr(key, 2) as int)").alias("v"), "total")
    around = near.select("m", "total", F.explode(F.expr("filter(sequence(v - 6, v + 6), x -> x <> v)")).alias("v")).groupBy("m", "v").agg((F.sum("total") / 12).alias("mean"))
    peaks = near.join(around, ["m", "v"], "left").select(F.concat("m", F.col("v").cast("string")).alias("key"), "total", F.coalesce(F.col("mean"), F.lit(0.0)).cast("long").alias("stop"))
    both = ctx.unionByName(eot).groupBy("key").agg(F.sum("total").alias("total"), F.sum("stop").alias("stop"), F.sum("inner").alias("inner"))
    none = F.lit(0).cast("long")
    rest = known.unionByName(nodes).unionByName(peaks).unionByName(longer.withColumn("stop", none))
    return both.unionByName(rest.withColumn("inner", none))


def _long_nodes(prof: DataFrame, tails: DataFrame) -> DataFrame:
    """(answer_id, m, total): what the trie says of final tokens with more than NODE letters, which have no node of their
    own: their proper continuations are found among the words with the same first letters. m: p, x2, x4."""
    cut = F.expr(f"substr(key, 1, length(key) - length(w) + {NODE})")
    word = prof.where(f"kind in ('word', 'context') and length(key) > {NODE + 2}").groupBy("kind", "key").agg(F.sum("a").alias("n"))
    word = word.withColumn("w", F.when(F.col("kind") == "word", F.substring("key", 2, 1 << 20)).otherwise(F.substring_index("key", " ", -1)))
    word = word.where(f"length(w) > {NODE + 1} and key not like '1%' and n >= if(kind = 'word', 2, 5)").select(cut.alias("near"), F.col("key").alias("whole"))
    asked = tails.where(f"length(last) > {NODE} and not dot").select("answer_id", "last", F.explode(F.array(F.concat(F.lit("w"), F.lower("last")), F.get("keys", F.lit(0)), F.get("keys", F.lit(1)))).alias("key")).withColumn("w", F.col("last"))
    met = asked.withColumn("near", cut).join(word, "near").where("startswith(whole, key) and length(whole) > length(key)")
    m = F.when(F.col("key").startswith("w"), "p").otherwise(F.concat(F.lit("x"), F.substring("key", 1, 1)))
    return met.groupBy("answer_id", m.alias("m")).agg(F.count("*").alias("total"))


#: What a tail's evidence string holds, a character each, in order, and the values that each may have.
EVIDENCE = (
    ("cut_word", "01"), ("open", "01"), ("ends_here", "n012345"), ("length_peak", "01"), ("token_peak", "01"), ("flag", "n01"), ("error", "01"), ("ellipsis", "01"), ("number_stop", "01"),
)


def tail_evidence(prof: DataFrame) -> DataFrame:
    """(answer_id, tag, e): the evidence of each tail. ends_here is the share of sentence ends after the tail's last words:
    n unknown, 0 below 0.02, 1 below 0.1, 2 below 0.25, 3 below 0.5, 4 below 0.9, 5 above."""
    tails = prof.where("kind = 'tail' and not copied").select("answer_id", "tag", "last", "keys", "open", "ellipsis", "dot", "flag", "err")
    grown = F.when((F.col("last") != "") & ~F.col("dot"), F.transform(F.slice("keys", 1, 2), lambda k: F.concat(F.lit("x"), k))).otherwise(F.array().cast("array<string>"))
    asked = tails.select("answer_id", F.explode(F.concat("keys", grown)).alias("key"))
    m = F.when(F.col("key").startswith("x"), F.substring("key", 1, 2)).otherwise(F.substring("key", 1, 1))
    found = asked.join(_statistics(prof), "key").select("answer_id", m.alias("m"), "total", "stop", "inner")
    none = F.lit(0).cast("long")
    found = found.unionByName(_long_nodes(prof, tails).withColumn("stop", none).withColumn("inner", none))
    pick = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    ev = found.groupBy("answer_id").agg(*[pick(m, c).alias(f"{n}_{c}") for m, n in (("4", "c4"), ("2", "c2"), ("1", "c1"), ("w", "w"), ("p", "p"), ("l", "len"), ("g", "gen")) for c in ("total", "stop")], pick("4", "inner").alias("i4"), pick("2", "inner").alias("i2"), pick("x4", "total").alias("x4"), pick("x2", "total").alias("x2"))
    x = tails.join(ev, "answer_id", "left")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.lit(None).cast("double")
    for n in ("c1", "c2", "c4"):
        t, s = n0(f"{n}_total") - 1, n0(f"{n}_stop") - 1  # without the tail's own
        share = F.when(t >= 3, F.greatest(s, F.lit(0)) / t).otherwise(share)
    # a known word too is cut if it never stands after these words inside a text, but words that it begins often do
    inside = ((n0("i4") == 0) & (n0("x4") > 0)) | ((n0("i2") == 0) & (n0("x2") > 0))
    cut_word = (F.col("last") != "") & ~F.col("dot") & (((n0("w_total") == 0) & (n0("p_total") > 0)) | inside)
    level = F.when(share.isNull() | cut_word & (share >= 0.25), "n")  # sentence ends say nothing for an unfinished word
    for i, top in enumerate((0.02, 0.1, 0.25, 0.5, 0.9)):
        level = level.when(share < top, str(i))
    peak = lambda n: F.coalesce((F.col(f"{n}_total") >= 5) & (F.col(f"{n}_total") >= 4 * (F.col(f"{n}_stop") + 1)), F.lit(False))
    bit = lambda c: F.when(c, "1").otherwise("0")
    flag = F.when(F.col("flag") == 1, "1").when(F.col("flag") == 0, "0").otherwise("n")
    return x.select("answer_id", "tag", F.concat(bit(cut_word), bit(F.col("open")), level.otherwise("5"), bit(peak("len")), bit(peak("gen")), flag, bit(F.col("err") == 1), bit(F.col("ellipsis")), bit(F.col("dot"))).alias("e"))


#: Where the fit of the evidence starts: share of each value among cut answers and among whole ones.
START = {
    "cut_word": {"0": (0.45, 0.99), "1": (0.55, 0.01)}, "open": {"0": (0.95, 0.998), "1": (0.05, 0.002)},
    "ends_here": {"n": (0.3, 0.02), "0": (0.4, 0.003), "1": (0.1, 0.01), "2": (0.05, 0.02), "3": (0.05, 0.05), "4": (0.05, 0.1), "5": (0.05, 0.797)},
    "length_peak": {"0": (0.8, 0.98), "1": (0.2, 0.02)}, "token_peak": {"0": (0.85, 0.98), "1": (0.15, 0.02)},
    "flag": {"n": (0.05, 0.08), "0": (0.65, 0.9), "1": (0.3, 0.02)}, "error": {"0": (0.95, 0.995), "1": (0.05, 0.005)},
    "ellipsis": {"0": (0.9, 0.9998), "1": (0.1, 0.0002)}, "number_stop": {"0": (0.995, 0.7), "1": (0.005, 0.3)},
}


def fit_cut_model(counts: dict[str, int], rounds: int = 40, weight: float = 40.0) -> dict[str, float]:
    """{evidence: log odds that the answer was cut}. The weights of the evidence are fitted by expectation-maximization of
    two classes with independent evidence, over the counted evidence strings; tails with an ellipsis, which states a cut, are
    the labelled ones. START counts as ``weight`` tails of each class, so a few tails are judged by it and many by their own
    fit."""
    says = [name for name, _ in EVIDENCE].index("ellipsis")
    total = sum(counts.values())
    table = [{v: list(START[name][v]) for v in values} for name, values in EVIDENCE]
    prior, odds = 0.2, {}
    for _ in range(rounds if total else 0):
        for e in counts:
            odds[e] = math.log(prior / (1 - prior)) + sum(math.log(f[v][0] / f[v][1]) for f, v in zip(table, e))
        post = {e: 1.0 if e[says] == "1" else 1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for e, x in odds.items()}
        mass = sum(post[e] * n for e, n in counts.items())
        prior = (mass + 2) / (total + 10)
        for i, (f, (name, values)) in enumerate(zip(table, EVIDENCE)):
            for v in values:
                y = sum(post[e] * n for e, n in counts.items() if e[i] == v)
                z = sum((1 - post[e]) * n for e, n in counts.items() if e[i] == v)
                a, b = START[name][v]
                f[v] = [(y + weight * a) / (mass + weight), (z + weight * b) / (total - mass + weight)]
    return odds


def tail_scores(prof: DataFrame) -> DataFrame:
    """One row per tail: (answer_id, tag, e, log_odds, cut). There are at most 4,032 different evidence strings, whatever the
    number of tails; their counts are what the model is fitted on."""
    spark = prof.sparkSession
    tails = materialize(tail_evidence(prof))
    counts = {r.e: r.n for r in tails.groupBy("e").agg(F.count("*").alias("n")).collect()}
    odds = spark.createDataFrame(list(fit_cut_model(counts).items()), "e string, log_odds double")
    return tails.join(odds, "e").withColumn("cut", F.col("log_odds") > 0)  # at most 4,032 rows


def truncated_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(answer_id): answers cut off before their end."""
    return tail_scores(profile(answers, items, False)).where("cut").select("answer_id")


def truncation_rates(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(tag, n_answers, n_truncated, share) for each tag."""
    cut = tail_scores(profile(answers, items, False)).where("cut").groupBy("tag").agg(F.count("*").alias("n_truncated"))
    n = answers.groupBy("tag").agg(F.count("*").alias("n_answers"))
    got = n.join(cut, n.tag.eqNullSafe(cut.tag), "left").select(n.tag, "n_answers", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"))
    return got.withColumn("share", F.round(F.col("n_truncated") / F.col("n_answers"), 6))


#: Where the tables of the labelling functions start: (share among defective, among sound answers) of each vote that is cast.
USUAL = {"+": (0.88, 0.011), "-": (0.12, 0.989)}
ANCHOR = {"+": (0.98, 0.0005), "-": (0.02, 0.9995)}
HINT = {"+": (0.5, 0.06), "-": (0.5, 0.94)}
KINDS = {"no_own_words": ANCHOR, "nothing_else": ANCHOR, "model": ANCHOR, "few_tokens": HINT, "error_hint": HINT, "flag": HINT, "length": HINT, "short": HINT}


def fit_label_model(patterns: dict[str, int], functions: tuple[tuple[str, str], ...] = LFS, rounds: int = 25) -> dict[str, dict[str, float]]:
    """{defect: {votes of its functions: posterior}} by expectation-maximization over counted vote patterns; the number of
    patterns of a defect is bounded by 3 to the number of its functions, whatever the number of rows.

    An abstaining function says nothing about the class. All tables are fitted. Each starts from a prior that counts as so many rows: 0.02 of all for most functions, all of them
    and 2,000 more for the anchors, which state what the defect is: without that weight a lone strong function among hints drifts to what
    the hints share."""
    out = {}
    for d in DEFECTS:
        at = [i for i, (x, _) in enumerate(functions) if x == d]
        seen = Counter()
        for p, n in patterns.items():
            seen["".join(p[i] for i in at)] += n
        total = sum(seen.values())
        if not total:
            out[d] = {}
            continue
        base = [KINDS.get(functions[i][1], USUAL) for i in at]
        strength = [total + 2000 if b is ANCHOR else 0.02 * total + 5 for b in base]
        table = [{v: list(p) for v, p in b.items()} for b in base]
        prior = 0.03
        post = {}
        for _ in range(rounds):
            for p in seen:
                y, z = prior, 1 - prior
                for f, v in zip(table, p):
                    if v != "0":
                        y, z = y * f[v][0], z * f[v][1]
                post[p] = y / (y + z)
            mass = sum(post[p] * n for p, n in seen.items())
            prior = min(0.5, max(1e-4, (mass + 3) / (total + 100)))
            for j, f in enumerate(table):
                cast = {v: [sum(w * n for p, n in seen.items() if p[j] == v for w in ((post[p] if y else 1 - post[p]),)) for y in (1, 0)] for v in "+-"}
                for v in "+-":
                    f[v] = [(cast[v][y] + strength[j] * base[j][v][y]) / (cast["+"][y] + cast["-"][y] + strength[j]) for y in (0, 1)]
        out[d] = post
    return out


def best_cutoff(posteriors: list[tuple[float, bool]]) -> float:
    """The cutoff with the best F1 over labelled rows (posterior, has the defect): the middle between the two posteriors that
    it lies between, the widest such gap where several are as good. 0.5 without a labelled defect."""
    wanted = sum(y for _, y in posteriors)
    if not wanted:
        return 0.5
    ranked = sorted(posteriors, reverse=True)
    best, hit = (0.0, 0.0, 0.5), 0
    for k, (p, y) in enumerate(ranked, 1):
        hit += y
        below = ranked[k][0] if k < len(ranked) else 0.0
        if below < p:
            best = max(best, (2 * hit / (k + wanted), p - below, (p + below) / 2))
    return best[2]


def vote_patterns(answers: DataFrame, items: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(written rows (answer_id, v) of all answers with a vote for a defect or a tail, counts of all patterns by defect).
    Votes are counted by defect, so at most 3 to the number of its functions (27 to 243) patterns of each reach the driver."""
    prof = profile(answers, items, True)
    t = tail_scores(prof)
    e = lambda name: F.substring("e", [n for n, _ in EVIDENCE].index(name) + 1, 1)
    sign = lambda c: F.when(c, "+").otherwise("-")
    open_ = F.when(e("ends_here") == "n", "0").otherwise(sign(e("ends_here").isin("0", "1")))
    length = sign((e("length_peak") == "1") | (e("token_peak") == "1"))
    flag = F.when(e("flag") == "1", "+").when(e("flag") == "0", "-").otherwise("0")
    tv = F.concat(sign(F.col("cut")), sign(e("cut_word") == "1"), open_, length, flag)
    tails = t.select("answer_id", F.lit(None).cast("string").alias("v"), tv.alias("t"))
    text = prof.where("kind = 'votes'").select("answer_id", F.col("votes").alias("v"), F.lit(None).cast("string").alias("t"))
    none = F.concat(F.coalesce(F.max("v"), F.lit("-" * N_TEXT)), F.coalesce(F.max("t"), F.lit("-" * (len(LFS) - N_TEXT))))
    rows = materialize(tails.unionByName(text).groupBy("answer_id").agg(none.alias("v")))
    bare = F.lit("-" * (len(LFS) - N_TEXT))
    # the patterns of the texts count these rows with their text votes alone: taken back, and counted whole
    moved = rows.select(F.explode(F.array(F.struct("v", F.lit(1).cast("long").alias("n")), F.struct(F.concat(F.substring("v", 1, N_TEXT), bare).alias("v"), F.lit(-1).cast("long").alias("n")))).alias("x")).select("x.*")
    every = prof.where("kind = 'pattern'").select(F.concat("key", bare).alias("v"), F.col("a").alias("n")).unionByName(moved)
    counts = every.groupBy("v").agg(F.sum("n").alias("n")).select(F.explode(_by_defect()).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).where("n > 0")
    return rows, {r.p: r.n for r in counts.collect()}


def _by_defect() -> F.Column:
    """The votes v as one string a defect: its name, a colon, the votes of its functions."""
    at = {d: [i for i, (x, _) in enumerate(LFS) if x == d] for d in DEFECTS}
    return F.array(*[F.concat(F.lit(d + ":"), F.substring("v", i[0] + 1, len(i))) for d, i in at.items()])


def posteriors(counts: dict[str, int]) -> dict[str, float]:
    """{defect and votes: posterior} from the counts of vote_patterns()."""
    out = {}
    for d in DEFECTS:
        mine = {p.partition(":")[2]: n for p, n in counts.items() if p.startswith(d + ":")}
        model = fit_label_model(mine, tuple(f for f in LFS if f[0] == d))[d]
        out |= {f"{d}:{p}": float(x) for p, x in model.items()}
    return out


def answer_labels(answers: DataFrame, items: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(answer_id, defect, posterior): a row for each label whose posterior exceeds its cutoff; an answer may have several."""
    rows, counts = vote_patterns(answers, items)
    cut = CUTOFFS | (cutoffs or {})
    found = [(p, p.partition(":")[0], x) for p, x in posteriors(counts).items() if x > cut[p.partition(":")[0]]]
    labels = rows.sparkSession.createDataFrame(found, "p string, defect string, posterior double")  # at most 351 rows
    return rows.select("answer_id", F.explode(_by_defect()).alias("p")).join(labels, "p").select("answer_id", "defect", "posterior")


def answer_defects(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(answer_id, defect): one defect per defective answer, in the order of DEFECTS where several labels hold."""
    rank = F.expr("array_position(array(" + ",".join(f"'{d}'" for d in DEFECTS) + "), defect)")
    got = answer_labels(answers, items).withColumn("rank", rank)
    return got.groupBy("answer_id").agg(F.min_by("defect", "rank").alias("defect"))
