"""Passages of evaluation items inside a corpus (problem 7): BM25 index with block-max WAND, then exact verification.

The test items are the indexed texts (one per item and field), the corpus passages are the queries. An item's score for
a passage is the sum of its BM25 term weights over the distinct words of the passage. Each item's weights are divided
by its *threshold*: the least sum of distinct-word weights over the item's own runs of ``run`` words. A passage that
holds such a run scores at least 1, so "all above threshold" provably holds every true case; verification then compares
runs of words.

The passages of a text are its stretches of at least ``run`` words that the index knows: an unknown word adds nothing to a
score and stands in no run. Item ids are cut into blocks of neighbouring ids, and each (word, block) that occurs keeps its
largest weight. A passage whose words' largest weights stay below 1 together is left at once; then the block bounds are
summed, blocks whose bound stays below 1 are never scored (the id-range form of block-max WAND), and of the others only the
postings in live blocks are read. Bounds are stored like postings, so the index grows with its postings alone.

Defined results: null or empty text, or a text under ``run`` words, matches nothing; an item field under ``run`` words
or null is not indexed; repeated rows each give their rows; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.unify import words
from corpusloom.session import spread

K1, B = 1.2, 0.75


class ItemIndex:
    """BM25 postings of item texts with per-block maxima. entries: (item id, field, text)."""

    def __init__(self, entries, run: int = 12, block: int = 16):
        self.run, self.block = run, block
        self.items, self.grams, docs = [], [], []
        for item, field, text in entries:
            w = words(text) if text else []
            if item is not None and len(w) >= run:
                self.items.append((item, field))
                docs.append(w)
                self.grams.append({" ".join(w[i : i + run]) for i in range(len(w) - run + 1)})
        n = len(docs)
        df = Counter(t for w in docs for t in set(w))
        self.vocab = {t: i for i, t in enumerate(df)}
        mean = sum(map(len, docs)) / n if n else 1.0
        rows, cols, vals = [], [], []
        for d, w in enumerate(docs):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            least = min(sum(weight[t] for t in set(w[i : i + run])) for i in range(len(w) - run + 1))
            for t, x in weight.items():
                rows.append(self.vocab[t])
                cols.append(d)
                vals.append(x / least)
        order = np.lexsort((cols, rows)) if rows else []
        self.doc = np.asarray(cols, np.int32)[order] if rows else np.zeros(0, np.int32)
        self.val = np.asarray(vals, np.float64)[order] if rows else np.zeros(0)
        self.ptr = np.searchsorted(np.asarray(rows)[order], np.arange(len(self.vocab) + 1)) if rows else np.zeros(1, int)
        self.n_blocks = -(-n // block) if n else 0
        # postings lie by word and entry, so a word's block is a run of them; bounds are the largest weight of each run
        word = np.asarray(rows)[order] if rows else np.zeros(0, int)
        new = np.flatnonzero(np.r_[True, (np.diff(word) != 0) | (np.diff(self.doc // block) != 0)]) if rows else np.zeros(0, int)
        self.block_of, self.block_max = self.doc[new] // block, np.maximum.reduceat(self.val, new) if rows else np.zeros(0)
        self.block_ptr = np.searchsorted(word[new], np.arange(len(self.vocab) + 1))
        self.top = np.maximum.reduceat(self.val, self.ptr[:-1]).tolist() if rows else []

    def above(self, tokens) -> list[tuple[int, float]]:
        """(entry, score) of every indexed entry with a score of at least 1 for a passage, given as words or word numbers."""
        ids = [i for i in {self.vocab.get(x) if isinstance(x, str) else x for x in tokens} if i is not None]
        if not ids or sum(map(self.top.__getitem__, ids)) < 1 - 1e-9:
            return []
        at = [slice(self.block_ptr[t], self.block_ptr[t + 1]) for t in ids]
        live = np.bincount(np.concatenate([self.block_of[x] for x in at]), np.concatenate([self.block_max[x] for x in at]), self.n_blocks) >= 1 - 1e-9
        if not live.any():
            return []
        doc = np.concatenate([self.doc[self.ptr[t] : self.ptr[t + 1]] for t in ids])
        val = np.concatenate([self.val[self.ptr[t] : self.ptr[t + 1]] for t in ids])
        if not live.all():
            keep = live[doc // self.block]
            doc, val = doc[keep], val[keep]
        score = np.bincount(doc, val, len(self.items))
        return [(int(d), float(score[d])) for d in np.flatnonzero(score >= 1 - 1e-9)]

    def search(self, text: str, window: int):
        """{entry: (best score, runs shared)} of the verified entries of a whole text."""
        w = words(text)
        run, got = self.run, {}
        known = list(map(self.vocab.get, w))
        ends = [i for i, x in enumerate(known) if x is None] + [len(w)]
        start = 0
        for end in ends:
            for at in range(start, end - run + 1, window - run + 1):
                last = min(at + window, end)
                cand = self.above(known[at:last])
                if cand:
                    part = w[at:last]
                    grams = {" ".join(part[i : i + run]) for i in range(len(part) - run + 1)}
                    for d, s in cand:
                        if hits := grams & self.grams[d]:
                            best, seen = got.get(d, (0.0, frozenset()))
                            got[d] = (max(best, s), seen | hits)
            start = end + 1
        return got


_BUILT: dict = {}


def _index(token: str, held, run: int) -> ItemIndex:
    """The index of a shard, built once in a worker. token names the shard of one call; an address may come again."""
    if (token, run) not in _BUILT:
        _BUILT.clear()
        _BUILT[token, run] = ItemIndex(held.value, run)
    return _BUILT[token, run]


def leaks(
    corpus: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "id",
    fields: tuple[str, ...] = ("query", "facts"),
    run: int = 12,
    window: int = 64,
    items_per_index: int = 20_000,
) -> DataFrame:
    """(id, item, field, score, n_runs): corpus rows that hold at least ``run`` consecutive words of an item's field.

    One index holds at most ``items_per_index`` items (its size bound for the broadcast: about 0.1 GB a worker with two fields
    of 50 words); more items are cut into several indexes, and each reads the corpus once. The result is the same."""
    spark = corpus.sparkSession
    entries = items.select(F.col(item_col).alias("item"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t")) for f in fields])).alias("e")).select("item", "e.field", "e.t").where("item is not null and t is not null")
    n = items.count()
    shards = max(1, -(-n // items_per_index))
    src = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    src = spread(src)
    item_type = dict(entries.dtypes)["item"]
    out = None
    for k in range(shards):
        part = entries.where(F.expr(f"pmod(xxhash64(item), {shards}) = {k}")) if shards > 1 else entries
        held = spark.sparkContext.broadcast(sorted((r.item, r.field, r.t) for r in part.collect()))

        def run_part(batches, held=held, run=run, window=window, token=uuid.uuid4().hex):
            index = _index(token, held, run)
            for pdf in batches:
                found = {}
                rows = []
                for i, t in zip(pdf["id"], pdf["t"]):
                    if t not in found:
                        found[t] = index.search(t, window)
                    rows += [(i, *index.items[d], s, len(g)) for d, (s, g) in found[t].items()]
                yield pd.DataFrame(rows, columns=["id", "item", "field", "score", "n_runs"])

        got = src.mapInPandas(run_part, f"id {dict(src.dtypes)['id']}, item {item_type}, field string, score double, n_runs int")
        out = got if out is None else out.unionByName(got)
    return out


def leaked_pairs(corpus: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(doc_id, id), distinct over the fields of an item and over repeated ids."""
    return leaks(corpus, items, **kw).select(F.col("id").alias("doc_id"), F.col("item").alias("id")).distinct()
