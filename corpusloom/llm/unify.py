"""One form for texts that look the same (problem 9).

``unified(text)`` composes compatibility forms, maps blanks, removes default-ignorable characters and writes letters of
identical shape in one alphabet. ``look_key`` is the equality key; ``search_key`` adds the full compatibility form and
full case folding.

Defined results: null text has null keys and matches nothing; empty texts are equal to each other and, as they don't
differ in a character, form no pair; texts of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.joins import salted_join
from corpusloom.session import materialize, spread

# Letters of Cyrillic and Greek whose usual shape is that of a Latin letter, and that letter.
ALIKE_FROM = "АВЕЅІЈКМНОРСТХУҮԌԚԜ" + "аеорсухѕіјһԁԛԝӏү" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" + "ονρϲϳ"
ALIKE_TO = "ABESIJKMHOPCTXYYGQW" + "aeopcyxsijhdqwly" + "ABEZHIKMNOPTYXCJ" + "ovpcj"

# Default-ignorable code points (first, last) of the Unicode standard.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

_WORD = re.compile(r"[^\W_]+")
#: ASCII characters that have another form.
_BLANKS = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f]")


@functools.cache
def _tables() -> tuple[dict, dict]:
    """Translation before decomposition (ignorables, blanks, width, joined letters) and after it (alphabets)."""
    first: dict[int, str | None] = {}
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if ch.isspace():
            first[cp] = "\n" if cp in (0x85, 0x2028, 0x2029) else " "
            continue
        tag = unicodedata.decomposition(ch)
        if tag.startswith(("<wide>", "<narrow>", "<noBreak>")) or tag.startswith("<compat>") and ch.isalpha():
            first[cp] = unicodedata.normalize("NFKC", ch)
    first |= dict.fromkeys((0x09, 0x1C, 0x1D, 0x1E, 0x1F), " ")
    first |= dict.fromkeys((0x0B, 0x0C, 0x0D), "\n")
    for low, high in IGNORABLE:
        first.update(dict.fromkeys(range(low, high + 1)))
    return first, str.maketrans(ALIKE_FROM, ALIKE_TO)


def unified(text: str) -> str:
    """The form in which texts that look the same are equal; case, digits, punctuation and accents stay."""
    if text.isascii() and not _BLANKS.search(text):
        return text
    first, alike = _tables()
    text = text.replace("\r\n", "\n").translate(first)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(alike))


def search_form(text: str) -> str:
    """NFKC with full case folding on top of unified(): for comparisons that ignore case as well."""
    return unicodedata.normalize("NFKC", unified(text)).casefold()


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the unified text, lower-cased."""
    return _WORD.findall(unified(text).lower())


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def per_distinct(values: pd.Series, fn) -> list:
    """fn over each distinct value of a batch once; null stays null."""
    codes, uniques = pd.factorize(values)
    got = [fn(u) for u in uniques]
    return [None if c < 0 else got[c] for c in codes]


@F.pandas_udf(T.StringType())
def unified_udf(text: pd.Series) -> pd.Series:
    return pd.Series(per_distinct(text, unified), dtype=object)


@F.pandas_udf(T.StringType())
def search_form_udf(text: pd.Series) -> pd.Series:
    return pd.Series(per_distinct(text, search_form), dtype=object)


@F.pandas_udf(T.StructType([T.StructField("look", T.BinaryType()), T.StructField("own", T.BinaryType())]))
def _keys_udf(text: pd.Series) -> pd.DataFrame:
    got = per_distinct(text, lambda s: (_digest(unified(s)), _digest(s)))
    return pd.DataFrame({"look": [g and g[0] for g in got], "own": [g and g[1] for g in got]})


def look_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look, own): 128-bit digests of the unified text and of the text itself; rows with null text are left out."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return spread(src).select("id", _keys_udf("t").alias("k")).select("id", "k.look", "k.own")


def look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, class_id, n_docs, n_variants). class_id is the smallest id that looks the same.
    Counts are combined before the shuffle, so a class with a third of all rows costs no more than another."""
    keys = materialize(look_keys(df, id_col, text_col))
    per_text = keys.groupBy("look", "own").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    per_look = per_text.groupBy("look").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_variants")
    )
    return keys.join(per_look, "look").select(F.col("id").alias(id_col), "class_id", "n_docs", "n_variants")


def look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b): all pairs that look the same and differ in at least one character, doc_a < doc_b.

    Pairs are formed between distinct texts of a class; members are joined to them afterwards. Exact copies are never
    paired with one another, so a text with a third of all rows gives rows only with its look-alikes."""
    keys = materialize(look_keys(df, id_col, text_col))
    mixed = (
        keys.groupBy("look").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("look")
    )
    members = materialize(keys.join(mixed, "look", "left_semi"))
    texts = members.select("look", "own").distinct()
    pairs = materialize(salted_join(texts, texts.withColumnRenamed("own", "other"), ["look"], "own", "other").where("own < other"))
    left = materialize(salted_join(pairs, members, ["look", "own"], "other", "id")).select("look", F.col("other").alias("own"), F.col("id").alias("i"))
    both = salted_join(left, members, ["look", "own"], "i", "id")
    return both.select(F.least("i", "id").alias("doc_a"), F.greatest("i", "id").alias("doc_b"))
