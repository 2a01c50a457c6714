"""Text normalisers, n-grams and small text functions as Column expressions.

The normalisers differ on purpose and are not interchangeable; each states its rule. Only Unicode compatibility
composition has no built-in expression and runs in an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = r"\{\{([^{}]+)\}\}"


def fold(c: Column) -> Column:
    """Lower case with the one full case folding that European text needs."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_ascii(c: Column) -> Column:
    """TX1: folded; placeholders become ph; n't becomes not; everything but a-z, 0-9 becomes a blank; blanks collapse."""
    x = F.regexp_replace(fold(c), PLACEHOLDER, " ph ")
    x = F.replace(x, F.lit("n't"), F.lit(" not "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", " "), r"\s+", " "))


def response_template(c: Column) -> Column:
    """TX2: every placeholder is the same slot, then TX1."""
    return normalize_ascii(F.regexp_replace(c, PLACEHOLDER, "{{SLOT}}"))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    codes, uniques = pd.factorize(text)
    made = [unicodedata.normalize("NFKC", u) for u in uniques]
    return pd.Series([None if i < 0 else made[i] for i in codes], dtype=object)


def normalize_unicode(c: Column) -> Column:
    """TX3: compatibility composition, folding, straight apostrophes, placeholders to a word, Unicode words joined."""
    x = F.regexp_replace(F.replace(fold(nfkc(c)), F.lit("’"), F.lit("'")), PLACEHOLDER, " placeholder ")
    return F.array_join(F.regexp_extract_all(x, F.lit(r"(?U)[\w]+(?:'[\w]+)*"), F.lit(0)), " ")


def tokens(c: Column) -> Column:
    """TX4: ASCII words with an inner apostrophe."""
    return F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def closing_form(c: Column) -> Column:
    """TX5: compatibility composition, then lower-case words joined."""
    return F.array_join(F.regexp_extract_all(F.lower(nfkc(c)), F.lit(r"[a-z][a-z'-]*"), F.lit(0)), " ")


def word_count(c: Column) -> Column:
    """TX6."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z'’-]*"), F.lit(0)))


def ngrams(words: Column, n: int = 6, short: bool = False) -> Column:
    """NG1/NG2: distinct n-grams of an array of words, joined by blanks; none for shorter texts, or with ``short`` (NG3)
    one gram of all words. The guard is needed: sequence(1, 0) counts down."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))
    few = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")) if short else F.array().cast("array<string>")
    return F.when(F.size(words) >= n, grams).otherwise(few)


def first_words(c: Column, n: int = 8) -> Column:
    """NG4: the first n blank-separated words."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), 1, n), " ")


def collapse_space(c: Column) -> Column:
    """PRJ8."""
    x = F.regexp_replace(c, r"[ \t]+\n", "\n")
    x = F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return strip(x)


def slug(prefix: str, c: Column) -> Column:
    """PRJ9: rule id of a name."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def safe_cell(c: Column) -> Column:
    """SNK7: a leading quote where a spreadsheet would see a formula."""
    risky = F.regexp_replace(c, r"^\s+", "").rlike(r"^[=+\-@]") | c.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def html_json(c: Column) -> Column:
    """SNK8: JSON that may stand inside HTML."""
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))


def straight_apostrophes(c: Column) -> Column:
    return F.translate(c, "‘’‛′", "''''")


def parse_bool(c: Column, strict: bool) -> Column:
    """PRJ33: true or false, null for anything else. Strict takes only these words as they are."""
    if strict:
        return F.when(c == "true", True).when(c == "false", False)
    x = F.lower(strip(c))
    return F.when(x.isin("true", "1", "yes", "y"), True).when(x.isin("false", "0", "no", "n"), False)


def hash_order(seed: str, *cols: Column) -> Column:
    """A total pseudo-random order that every engine computes alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]))


def dot(a: Column, b: Column) -> Column:
    """BS5: sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows (Hyyrö 2004)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(made: pd.Series, wanted: pd.Series) -> pd.Series:
    """BS4: F1 of the longest common subsequence of lower-case ASCII words; 1 for equal texts, 0 if one is blank."""
    import re

    out = []
    for a, b in zip(made, wanted):
        a, b = a or "", b or ""
        if a == b:
            out.append(1.0)
            continue
        x, y = re.findall(r"[a-z0-9]+", a.lower()), re.findall(r"[a-z0-9]+", b.lower())
        n = _lcs(x, y)
        out.append(0.0 if not n else 2 * n / (len(x) + len(y)))
    return pd.Series(out)
