"""Mixing sources to target weights (problem 8): Pfair scheduling of source blocks, earliest deadline first.

Tokens are counted with a public tokenizer (its vocabulary file is a parameter). A document is a row with its id; a
repeated id counts as one document, with the smallest source and token count.

The total is the largest at which every source with a share, documents and allowed repeats can supply its share within its
repeats (or a smaller total that is asked for); shares of sources that can't supply anything are spread over the others in
proportion. Each source lays its documents end to end, in hashed order, pass after pass up to its repeats; a document is
taken if it starts before the source's budget ends and, at the end, if taking it comes nearer to the budget than leaving it.
The lines are cut into blocks of equal tokens. Block i of a source with weight w is released at floor(i / w) and due at
ceil((i + 1) / w); in each slot the released block with the earliest deadline goes first, which keeps every source within
one block of its ideal share at all times. There are at most ``max_blocks`` blocks, whatever the size of the data, so the
schedule is made on the driver.

Defined results: null or empty texts and texts without tokens are left out; a null source, or one without a row in the
targets, gets no share; zero shares and zero repeats give nothing; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import materialize, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Targets are read by the driver, which schedules them; more are an error.
MOST_TARGETS = 10_000


def source_name(c) -> F.Column:
    """One spelling of a source: lower case, one underscore between its parts."""
    return F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"^[\s_\-]+|[\s_\-]+$", ""), r"[\s_\-]+", "_")


def _tokenizer(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_HELD: dict = {}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens): tokens of each whole text. The vocabulary file is read once, where this is called, and sent to the
    workers; its size does not depend on the data, and more than 64 MB are refused."""
    with open(vocabulary, "rb") as f:
        held = f.read((1 << 26) + 1)
    if len(held) > 1 << 26:
        raise ValueError(f"{vocabulary} is too large for a vocabulary")
    sent = df.sparkSession.sparkContext.broadcast(held)
    token = hashlib.sha256(held).hexdigest()
    src = df.select(F.col(id_col).alias("id"), source_name(F.col("source")).alias("source"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null and t <> ''")

    def run(batches):
        if token not in _HELD:
            _HELD[token] = _tokenizer(sent.value)
        encode = _HELD[token].encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    kind = dict(src.dtypes)["id"]
    return spread(src).mapInArrow(run, f"id {kind}, source string, tokens long")


def budgets(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens to take from each source. supply: tokens by source; targets: (share, repeats)."""
    able = {s: w for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and supply.get(s, 0) > 0}
    if not able:
        return {}
    weight = sum(able.values())
    most = min(supply[s] * targets[s][1] / (w / weight) for s, w in able.items())
    size = most if total is None else min(most, total)
    return {s: size * w / weight for s, w in able.items()}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[tuple[str, int], int]:
    """Slot of each (source, block): Pfair windows, earliest deadline first."""
    total = sum(weights.values())
    w = {s: weights[s] / total for s in blocks if blocks[s]}
    waiting = [(0, s, 0) for s in sorted(w)]
    heapq.heapify(waiting)
    ready, slot, out = [], 0, {}
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((i + 1) / w[s] - 1e-9), s, i))
        if not ready:
            slot = waiting[0][0]
            continue
        _, s, i = heapq.heappop(ready)
        out[s, i] = slot
        slot += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (math.floor((i + 1) / w[s] + 1e-9), s, i + 1))
    return out


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, max_blocks: int = 20_000, least_block: int = 2_000, per_bucket: int = 50_000, vocabulary: str = VOCABULARY, seed: str = "mix") -> DataFrame:
    """(doc_id, source, use, tokens, slot, place): the selection in its order; use counts the uses of a document from 1,
    slot is the scheduled block, place the token offset inside the source."""
    spark = documents.sparkSession
    counted = token_counts(documents, vocabulary=vocabulary).where("tokens > 0 and source is not null")
    unique = materialize(counted.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("id", "x.source", "x.tokens"))
    want = {}
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    for r in targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r")).where("s is not null").collect():
        want.setdefault(r.s, (r.w or 0.0, r.r or 0))
    stock = unique.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"))
    named = spark.createDataFrame([(s,) for s in want] or [("",)], "source string")
    supply = {r.source: r for r in stock.join(named, "source", "left_semi").collect()}  # at most one row a target
    give = budgets({s: r.n for s, r in supply.items()}, want, total)
    if not give:
        empty = "doc_id long, source string, use int, tokens long, slot long, place long"
        return spark.createDataFrame([], empty)
    size = sum(give.values())
    block = max(least_block, math.ceil(size / max_blocks))
    n_blocks = {s: max(1, math.ceil(x / block)) for s, x in give.items()}
    slots = schedule(n_blocks, give)
    plan = spark.createDataFrame([(s, float(x), int(supply[s].n), min(want[s][1], math.ceil(x / supply[s].n)), max(1, math.ceil(supply[s].docs / per_bucket))) for s, x in give.items()], "source string, budget double, stock long, passes int, buckets int")
    order = unique.join(plan, "source").withColumn("o", F.xxhash64(F.lit(seed), "id")).withColumn("b", F.expr("pmod(shiftright(o, 20), buckets)"))
    before = order.groupBy("source", "b").agg(F.sum("tokens").alias("n"))
    before = before.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source", "b", "base")
    line = order.withColumn("run", F.sum("tokens").over(W.partitionBy("source", "b").orderBy("o", "id").rowsBetween(W.unboundedPreceding, 0))).join(before, ["source", "b"])
    line = line.withColumn("start", F.col("base") + F.col("run") - F.col("tokens"))
    uses = line.withColumn("use", F.explode(F.sequence(F.lit(1), "passes"))).withColumn("place", F.col("start") + (F.col("use") - 1) * F.col("stock"))
    taken = uses.where(F.col("place") + F.col("tokens") / 2.0 <= F.col("budget"))
    where = spark.createDataFrame([(s, i, k) for (s, i), k in slots.items()], "source string, i int, slot long")
    taken = taken.withColumn("i", F.least(F.floor(F.col("place") / block).cast("int"), F.ceil(F.col("budget") / block).cast("int") - 1))
    return taken.join(where, ["source", "i"]).select(F.col("id").alias("doc_id"), "source", F.col("use").cast("int").alias("use"), "tokens", "slot", "place")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, n_uses, n_docs, most_uses, actual_share) for each source of the targets."""
    per = selection.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_uses"), F.count_distinct("doc_id").alias("n_docs"), F.max("use").alias("most_uses"))
    want = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share")).where("source is not null")
    got = want.join(per, "source", "left").na.fill(0, ["tokens", "n_uses", "n_docs", "most_uses"])
    total = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # a row per target, not per document
    return got.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))
