"""Template residue and error-page text (problem 2): positive-unlabelled naive Bayes by expectation-maximization.

Texts are cut into passages: each slot (a name between slot marks) with its neighbours, and each sentence or line of the
rest. Passages that hold unmistakable residue are *trusted*: they seed the positive class and decide nothing else; all others
are unlabelled. One pass over the texts writes the masked passages of each text and, counted inside each task, the distinct
ones of the corpus. The hashed features of the distinct passages (words, word pairs; names, words, styles and unmistakable
marks of slots) are written once; expectation-maximization re-weights the unlabelled passages until the posteriors settle.
The model is a vector of fixed size. It scores every passage, trusted or not, and a record is residue if one of its passages
has positive log odds.

Defined results: null and empty texts have no passages and are no case; a record is listed once, copies under other ids
too; no rows give no rows; extra columns are ignored; texts and slot names of any length and script are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, release, spread

BITS = 17
#: A slot name: a letter of any script first, then words; it ends at the next mark, so no length limit is needed.
_NAME = r"[^\W\d_][\w .\-'’/]*?"
#: (kind, pattern); kinds in capitals are unmistakable slots.
SLOTS = (
    ("BRACE2", rf"\{{\{{\s*({_NAME})\s*\}}\}}"), ("BRACKET2", rf"\[\[\s*({_NAME})\s*\]\]"), ("ANGLE2", rf"<<\s*({_NAME})\s*>>"),
    ("AT2", rf"@@\s*({_NAME})\s*@@"), ("UNDER2", r"__([A-Z][A-Z_ ]+?)__"), ("DOLLAR", rf"\$\{{\s*({_NAME})\s*\}}"),
    ("BLOCK", r"\{%-?\s*(?:if|elif|for|include|block|set|else|end\w*)?\s*([\w .\-]*?)\s*-?%\}"), ("PERCENT", r"%([A-Z][A-Z_]{2,})%"),
    ("INSERT", r"<\s*(?:insert|your|enter|add)\s+([\w .\-]{2,}?)(?:\s+here)?\s*/?>"), ("YOURS", r"\[\s*(?:your|insert|enter|add)\s+([\w .\-]{2,}?)(?:\s+here)?\s*\]"),
    ("TAG", r"<([A-Z][A-Z_]{2,})\s*/>"), ("HASH", r"#([A-Z][A-Z_]{2,})#"),
    ("brace", rf"\{{({_NAME})\}}"), ("bracket", rf"\[({_NAME})\]"), ("angle", rf"<({_NAME})>"),
)
_SLOT = re.compile("|".join(p for _, p in SLOTS), re.I)
_SLOT_EXACT = [(k, re.compile(p if k in ("UNDER2", "PERCENT", "TAG", "HASH") else "(?i:" + p + ")")) for k, p in SLOTS]
_MAYBE = r"[{\[<]|@@|__|%[A-Za-z]|#[A-Za-z]"

#: Unmistakable residue: what a whole passage says. Searched in the lower-cased passage.
TRUSTED = re.compile(
    r"\b(?:lorem|ipsum)\b.*|\bdolor sit amet\b.*|^\W*(?:please )?(?:enable|activate|turn on|allow|switch on)\b.{0,24}\b(?:javascript|scripts?|scripting)\b.{0,40}\b(?:to (?:view|use|see|continue|read)(?: (?:this|the) (?:page|site|content|article|app))?|reload|in your browser)\b"
    r"|^\W*you need to (?:allow|enable|activate|turn on) (?:java)?script(?:s|ing)?\b|\bscript blocker and (?:refresh|reload)\b|^\W*if nothing appears, javascript\b|^\W*javascript (?:is|must be) (?:disabled|required|enabled|off)\b|^\W*(?:your|this) browser does not support\b|^\W*this (?:site|page|app|application) (?:needs|requires) (?:java)?scripts?\b"
    r"|<noscript>.*?</noscript>|<html\b.*?</html>|\btraceback \(most recent call last\)(?::? ?\w*(?:error|exception)\b:? ?\S*)?|^\W*\{\"(?:status|error|code)\":.*?\}"
    r"|^\W*(?:error )?[45]\d\d:? (?:not found|forbidden|unauthori[sz]ed|bad gateway|bad request|service unavailable|gateway time-?out|internal server error|too many requests|request timeout)\b"
    r"|^\W*(?:upstream )?request timed out\b(?: after \d+ (?:seconds|s|ms))?|^\W*rate limit (?:reached|exceeded)\b|^\W*(?:your )?(?:text|content|copy|title|answer|reply|description|message) (?:goes )?here\W*$|^\W*(?:sample|dummy|placeholder|filler) (?:text|content|copy|response|answer|reply)\b.{0,30}(?:here|written|added|replaced|follow)\b"
    r"|^\W*insert (?:your )?(?:text|reply|answer|content|response|copy|message) here\b|^\W*content (?:is )?coming soon\W*$|^\W*(?:tbd|tba|todo|fixme)\W*$|^\W*(?:asdf|qwerty|blah|xxx+|foo|test)(?:\W+(?:asdf|qwerty|blah|xxx+|bar|foo|test|[a-z]{1,4}df))+\W*$|^\W*dummy (?:text|content|copy|response|answer|reply)\b(?:,? do not use)?|^\W*copy to follow\W*$"
    r"|^\W*something went wrong on (?:our|the server) (?:side|end)\b|^\W*(?:your )?session (?:has )?(?:expired|timed out)\W*$|^\W*access denied\W*$|^\W*(?:sorry,? )?(?:the|this) page (?:you are looking for|you requested) (?:does not exist|cannot be|could not be|has been|was not)|^\W*page not found\W*$|^\W*(?:an )?(?:unexpected|internal) (?:server )?error (?:has )?(?:occurred|happened)\b|^\W*connection (?:refused|reset|timed out)\b|^\W*unhandled exception\b|^\W*this service is temporarily (?:down|unavailable)\b|^\W*checking your browser before\b|^\W*loading(?:…|\.\.\.)? .{0,20}javascript\b"
)
#: TRUSTED without its anchors: a text without a match holds no trusted sentence. One automaton over a whole column.
MAY_TRUST = TRUSTED.pattern.replace(r"^\W*", "").replace(r"\W*$", "")
_PAGE = re.compile(r"<html\b|<noscript>|^\s*\{\"", re.I)
_SENT = re.compile(r"(?<=[.!?…])\s+|\n+")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\b[A-Z]{2}-\d+|\d[\d.,:]*")
_CAP = re.compile(r"(?<=[\w,;] )[A-ZÀ-ÖØ-ÞА-Я][^\W\d_]+")
_WORD = re.compile(r"[^\W_]+|#")
#: A new sentence on the same line.
_NEXT = re.compile(r"[\W\d]*(?:[A-Z]{2}-\d+\s+)?[A-ZÀ-ÖØ-ÞА-Я][^\W\d]*[ ,]")
_TAIL = re.compile(r"^\W*(?:incident|request id|ref|id|code|#)?\W*#?\W*$")


def _slot(m: re.Match) -> tuple[str, bool]:
    """(key, trusted) of a slot match."""
    whole = m[0]
    for kind, p in _SLOT_EXACT:
        if n := p.fullmatch(whole):
            name = n[1] or ""
            break
    else:
        kind, name = "angle", whole.strip("<>[]{}")
    style = "upper" if name.isupper() else "title" if name[:1].isupper() else "snake" if "_" in name else "lower"
    plain = " ".join(re.split(r"[\s_.\-]+", name.lower())).strip()
    return f"slot\t{kind}\t{plain}\t{style}", kind.isupper()


def passages(text: str, slots: bool = True, seeds: bool = True) -> list[tuple[str, bool]]:
    """(masked passage, trusted) of a whole text. slots, seeds: whether a slot mark, a trusted sentence may be in it."""
    out = []
    if slots and not _PAGE.search(text):
        def take(m):
            out.append(_slot(m))
            return " "

        text = _SLOT.sub(take, text)
    parts = [p for p in _SENT.split(text.strip()) if p]
    only = "only\t" if len(parts) <= 2 else "part\t"
    for p in parts:
        m = TRUSTED.search(p.lower()) if seeds else None
        if m and _NEXT.match(p, m.end()):
            parts.append(p[m.end() :])  # what follows on the same line is judged on its own
            p = p[: m.end()]
        masked, caps = _CAP.subn("@", _HEX.sub("#", p))
        if 2 * caps > p.count(" "):
            masked = _HEX.sub("#", p)  # headline style: capitals say nothing
        masked = masked.lower()
        if not _TAIL.match(masked):
            out.append((only + masked, bool(m)))
    return out


HALF = 1 << (BITS - 1)


def features(passage: str) -> list[int]:
    """Hashed features of a masked passage; those of slots lie in the upper half. Only unmistakable marks are features: they
    decide which slots are trusted, so the others would count as evidence against."""
    kind, _, rest = passage.partition("\t")
    if kind == "slot":
        mark, name, style = rest.split("\t")
        f = ["n=" + name, "s=" + style, *("w=" + x for x in name.split(" "))]
        if mark.isupper():
            f.append("m=" + mark)
        return [HALF + (zlib.crc32(x.encode("utf-8", "surrogatepass")) & (HALF - 1)) for x in f]
    w = _WORD.findall(rest)
    f = w + [x + " " + y for x, y in zip(w, w[1:])] + ["len=" + str(min(len(w), 20) // 4), "where=" + kind]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (HALF - 1) for x in f]


_FIELDS = [("id", pa.string()), ("field", pa.string()), ("passages", pa.list_(pa.string())), ("passage", pa.string()), ("n", pa.int64()), ("trusted", pa.bool_())]
_RAW = "id string, field string, passages array<string>, passage string, n long, trusted boolean"
_SUMS = pa.schema([("f", pa.int32()), ("w", pa.float64())])


def _cut(batches, names):
    """Rows (id, field, passages) of the texts, and (passage, n, trusted) counted in the task. Columns: id, then the fields."""
    seen: Counter = Counter()
    sure: set = set()

    def flush():
        keys = list(seen)
        cols = [pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([k in sure for k in keys], pa.bool_())]
        got = pa.RecordBatch.from_arrays([pa.nulls(len(keys), t) for _, t in _FIELDS[:3]] + cols, schema=pa.schema(_FIELDS))
        seen.clear()
        sure.clear()
        return got

    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for k, name in enumerate(names, 1):
            texts = batch.column(k)
            slots = pc.match_substring_regex(texts, _MAYBE).to_pylist()
            seeds = pc.match_substring_regex(texts, MAY_TRUST, ignore_case=True).to_pylist()
            for i, t, s, x in zip(ids, texts.to_pylist(), slots, seeds):
                if t:
                    got = passages(t, s, x)
                    mine = [p for p, _ in got]
                    seen.update(mine)
                    sure.update(p for p, trusted in got if trusted)
                    if mine and i is not None:
                        out.append((i, name, mine))
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)] + [pa.nulls(len(out), t) for _, t in _FIELDS[3:]], schema=pa.schema(_FIELDS))
        if len(seen) > 200_000:
            yield flush()
    yield flush()


def _featured(batches):
    """(n, trusted, f, key): the features of distinct passages."""
    for b in batches:
        texts = b.column(0).to_pylist()
        f = pa.array([features(p) for p in texts], pa.list_(pa.int32()))
        key = pa.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), f, key], names=["n", "trusted", "f", "key"])


def _log_odds(model, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log odds of passages; flat: their features one after another, count: how many each has. A passage without features,
    or with features the corpus never had, has the odds of its kind."""
    bias, weight = model
    start = np.cumsum(count) - count
    first = flat[np.minimum(start, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(count), np.int64)
    at = np.repeat(np.arange(len(count)), count)
    return np.where((count > 0) & (first >= HALF), bias[1], bias[0]) + np.bincount(at, weight[flat], len(count))


def fit(shapes: DataFrame, rounds: int = 6, held: float = 0.0) -> tuple[tuple[float, float], np.ndarray]:
    """((bias of sentences, of slots), weight vector) of the naive Bayes model. shapes: written (n, trusted, f, key).
    Class counts are smoothed towards the corpus, so a feature that no positive has counts against it. ``held`` is the share
    of the trusted passages, by their key, that are treated as unlabelled: for measuring."""
    spark = shapes.sparkSession
    size = 1 << BITS
    hidden = int(held * 1000)

    def sums(model, what):
        """Per hashed feature the sum of n ("all") or of n x posterior; the last two hold the passages themselves."""
        sent = spark.sparkContext.broadcast(model) if model is not None else None  # a vector of fixed size

        def run(batches):
            acc = np.zeros(size + 2)
            for b in batches:
                n = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                key = b.column(3).to_numpy(zero_copy_only=False)
                sure = b.column(1).to_numpy(zero_copy_only=False).astype(bool) & (key % 1000 >= hidden)
                lists = b.column(2)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                if what == "all":
                    w = n
                elif sent is None:
                    w = n * sure
                else:
                    w = n * np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(_log_odds(sent.value, flat, count), -40, 40))))
                if len(flat):
                    acc[:size] += np.bincount(flat, np.repeat(w, count), size)
                    slot = (count > 0) & (flat[np.minimum(np.cumsum(count) - count, len(flat) - 1)] >= HALF)
                    acc[size] += w[~slot].sum()
                    acc[size + 1] += w[slot].sum()
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(acc[at])], schema=_SUMS)

        total = np.zeros(size + 2)
        for r in shapes.mapInArrow(run, "f int, w double").groupBy("f").agg(F.sum("w").alias("w")).toLocalIterator():
            total[r.f] = r.w
        return total

    every, pos, model = sums(None, "all"), sums(None, "pos"), None
    for _ in range(rounds):
        neg = np.maximum(every - pos, 0)
        weight, bias = np.zeros(size), []
        for part, count in ((slice(0, HALF), size), (slice(HALF, size), size + 1)):
            a, p, q = every[part] + 1e-9, pos[part], neg[part]
            back = a / a.sum()
            s, t = 0.01 * p.sum() + 2, 0.01 * q.sum() + 2
            weight[part] = np.log((p + s * back) / (p.sum() + s)) - np.log((q + t * back) / (q.sum() + t))
            bias.append(math.log((pos[count] + 1) / (neg[count] + 1)))
        new = (tuple(bias), np.clip(weight, -6, 6))
        moved = None if model is None else float(np.abs(new[1] - model[1]).max())
        model = new
        if moved is not None and moved < 0.05:
            break
        pos = sums(model, "pos")
    return model


def _prepared(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(written passages of the texts and of the corpus, written features of the distinct passages)."""
    names = list(fields)
    src = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(fields)])
    raw = materialize(spread(src).mapInArrow(lambda batches: _cut(batches, names), _RAW))
    distinct = raw.where("passage is not null").groupBy("passage").agg(F.sum("n").alias("n"), F.max("trusted").alias("trusted"))
    return raw, materialize(distinct.mapInArrow(_featured, "n long, trusted boolean, f array<int>, key long"))


def scored(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("instruction", "response")) -> DataFrame:
    """(id, field, log_odds, passage) of the strongest passage of each text that has one."""
    raw, shapes = _prepared(df, id_col, fields)
    model = fit(shapes)
    release(shapes)
    held = df.sparkSession.sparkContext.broadcast(model)  # a vector of fixed size

    def run(batches):
        known: dict[str, float] = {}
        for b in batches:
            lists = b.column(2).to_pylist()
            new = list({p for ps in lists for p in ps if p not in known})
            if new:
                f = [features(p) for p in new]
                odds = _log_odds(held.value, np.concatenate([np.asarray(x, np.int64) for x in f]), np.array([len(x) for x in f]))
                known.update(zip(new, odds.tolist()))
            best = [max(ps, key=known.__getitem__) for ps in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([known[p] for p in best], pa.float64()), pa.array(best, pa.string())], names=["id", "field", "log_odds", "passage"])
            if len(known) > 300_000:
                known.clear()

    return raw.where("id is not null").select("id", "field", "passages").mapInArrow(run, "id string, field string, log_odds double, passage string")


def residue(df: DataFrame, cutoff: float = 0.0, **kw) -> DataFrame:
    """(id): records with a passage whose log odds exceed the cutoff."""
    return scored(df, **kw).where(F.col("log_odds") > cutoff).select("id").distinct()


def held_out_recall(df: DataFrame, held: float = 0.3, id_col: str = "id", fields: tuple[str, ...] = ("instruction", "response")) -> tuple[int, int]:
    """(hidden trusted passages that the model finds, hidden trusted passages): distinct ones, fitted without their labels."""
    raw, shapes = _prepared(df, id_col, fields)
    model = fit(shapes, held=held)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lists = b.column(0)
            count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            odds = _log_odds(sent.value, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
            yield pa.RecordBatch.from_arrays([pa.array([int((odds > 0).sum())], pa.int64()), pa.array([len(odds)], pa.int64())], names=["found", "n"])

    got = shapes.where(f"trusted and key % 1000 < {int(held * 1000)}").select("f").mapInArrow(run, "found long, n long")
    r = got.agg(F.coalesce(F.sum("found"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return r[0], r[1]
