"""Pairs of records with a given word overlap: across splits (problem 4) and in one collection (problem 6).

Both work on distinct word sets: records with the same words form one class, classes are compared, members are joined to
the verified class pairs at the end. One pass over the texts writes both, members and classes; copies are dropped inside each
task before anything is shuffled. Word sets are arrays of 64-bit word hashes, classes carry a 128-bit digest, blocks its
first 64 bits (classes that share them are candidates more, as candidates meet every class with that number).

Blocks are shuffled once, by code, and read in runs of one code; runs of more than 1,000 rows are left to a join in cells of
bounded size. Pairs are thinned where they meet by the few numbers that blocks carry, and only the words of the classes that
are left are moved and compared.

Problem 4, segmented code blocks of a similarity hash. The fingerprint of a class has a bit per bucket, the parity of the
words hashed into it, so each differing word flips at most one bit and the Hamming distance never exceeds the number of
differing words (the sign-projection kind has no such bound). An overlap of at least t between sets of a and b words
leaves at most (1-t)/(1+t) (a+b) differing words. Classes meet by *levels* of set size; a level that allows d differing
words cuts the words into d+2 segments, of which two must agree. Blocks are pairs of segments, joined across splits;
fingerprints within the Hamming radius are verified by their words. No pair is lost. As the pairs of segments grow with the
square of d, levels with more than SEGMENTS of them use LONG_BANDS bands of LONG_ROWS minimum hashes instead (at overlap
0.85 a pair is missed with probability 4e-6), so a text of any length has a bounded number of codes.

Problem 6, pivot distance tables. Blocks come from bands of minimum hashes. Each class carries the Hamming distances of its
parity fingerprint to 16 reference fingerprints; as distances to a reference differ by at most the Hamming distance, pairs
with a larger coordinate difference than their allowed number of differing words are discarded, then those whose 128-bit
fingerprints lie further apart than that, and survivors are verified by their words.
The reference distances alone can't replace the blocks: between short random sets they hardly differ.

Defined results: null or wordless texts, null groups and null ids match nothing; repeated rows pair with one another like
other rows; no rows give no rows; extra columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import components
from corpusloom.operators.joins import salted_join
from corpusloom.session import materialize, spread

_WORD = re.compile(r"[^\W_]+")
EPS = 1e-9


class _Hash(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def word_sets(df: DataFrame, side: str | None = None) -> tuple[DataFrame, DataFrame]:
    """df(id, t, ...) -> (members (id, ..., k), classes (k, r, n, h[, side])): the class digest of each record, and of the
    classes their digest, its number r, the number of distinct words and their hashes. A class has a row per task and side
    that has it. The k of a wordless row is null. ``side`` names a boolean column of df."""
    keep = [c for c in df.columns if c != "t"]
    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes if c != "t")
    at, at_side = df.columns.index("t"), df.columns.index(side) if side else None
    names = [*keep, "k", "r", "n", "h"]

    def run(batches):
        hashed, seen = _Hash(), set()
        for b in batches:
            sides = b.column(at_side).to_pylist() if side else [None] * b.num_rows
            k, ck, cn, ch, cs = [], [], [], [], []
            for t, s in zip(b.column(at).to_pylist(), sides):
                k.append(None)
                if t and (w := set(_WORD.findall(t.lower()))):
                    x = np.sort(np.fromiter((hashed[y] for y in w), np.uint64, len(w)))
                    digest = xxhash.xxh3_128_digest(x.tobytes())
                    k[-1] = digest
                    if (digest, s) not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add((digest, s))
                        ck.append(digest)
                        cn.append(len(x))
                        ch.append(x)
                        cs.append(s)
            none = lambda t: pa.nulls(len(k), t)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(k, pa.binary()), none(pa.int64()), none(pa.int32()), none(pa.list_(pa.int64()))], names=names)
            flat = np.concatenate(ch).view(np.int64) if ch else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cn)]).astype(np.int32)), pa.array(flat))
            head = [pa.array(cs, pa.bool_()) if c == side else pa.nulls(len(ck), b.schema.field(c).type) for c in keep]
            short = np.frombuffer(b"".join(x[:8] for x in ck), np.int64)
            yield pa.RecordBatch.from_arrays([*head, pa.array(ck, pa.binary()), pa.array(short), pa.array(cn, pa.int32()), lists], names=names)

    got = materialize(spread(df).mapInArrow(run, f"{kinds}, k binary, r long, n int, h array<bigint>"))
    return got.where("r is null").select(*keep, "k"), got.where("r is not null").select("k", "r", "n", "h", *([side] if side else []))


@functools.cache
def levels(t: float, largest: int) -> tuple[tuple[int, int, int], ...]:
    """(lo, hi, d): the smaller of two sets has lo..hi words, which then differ in at most d words."""
    out, lo = [], 1
    while lo <= largest:
        d = math.floor(lo * (1 - t) / t + EPS)
        hi = lo
        # widen while the number of differing words stays, then once more by a tenth for long texts
        while math.floor((hi + 1) * (1 - t) / t + EPS) == d or hi + 1 < lo * 1.1:
            hi += 1
        out.append((lo, hi, math.floor(hi * (1 - t) / t + EPS)))
        lo = hi + 1
    return tuple(out)


_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    return x ^ (x >> np.uint64(29))


@functools.cache
def _two_of(m: int):
    return np.triu_indices(m, 1)


def parity_sketch(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit per bucket: parity of the hashes in it, as uint8 0/1."""
    return (np.bincount((_mix(h * _C[1]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


#: Most segments of a level; bands and rows of the levels beyond it.
SEGMENTS, LONG_BANDS, LONG_ROWS = 32, 60, 10


def block_codes(h: np.ndarray, t: float) -> np.ndarray:
    """Codes of all blocks of a set of word hashes (uint64)."""
    n, out, long = len(h), [], False
    least = math.ceil(t * n - EPS)
    for lo, hi, d in levels(t, 1 << max(4, n.bit_length())):
        if hi < least or d == 0:
            continue
        if lo > n:
            break
        m = d + 2
        if m > SEGMENTS:
            long = True
            continue
        seg = np.zeros(m, np.uint64)
        np.bitwise_xor.at(seg, (_mix(h + np.uint64(lo * int(_C[0]) & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64), h)
        i, j = _two_of(m)
        out.append(_mix(_mix(seg[i] * _C[0] + i.astype(np.uint64) * _C[1]) + seg[j] * _C[2] + j.astype(np.uint64) * _C[3] + np.uint64(lo)))
    if long:
        out.append(_mix(band_codes(h, LONG_BANDS, LONG_ROWS)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _arrays(b: pa.RecordBatch) -> list[np.ndarray]:
    """The word hashes of each row of a batch with the column h."""
    hs = b.column("h")
    flat, off = hs.flatten().to_numpy().view(np.uint64), hs.offsets.to_numpy() - hs.offsets[0].as_py()
    return [flat[x:y] for x, y in zip(off, off[1:])]


def _blocks(classes: DataFrame, codes, small, width: int, side: str | None = None, most: int = 2_000_000) -> DataFrame:
    """(code, r, x0, x1, ...[, side]) of classes. codes: word hashes to codes, small: word hashes to ``width`` numbers by which
    pairs are thinned. Batches are cut at ``most`` codes."""
    names = ["code", "r", *(f"x{i}" for i in range(width)), *([side] if side else [])]

    def run(batches):
        for b in batches:
            made, kept, n, first = [], [], 0, 0
            for i, h in enumerate(_arrays(b)):
                made.append(codes(h))
                kept.append(small(h))
                n += len(made[-1])
                if n > most or i == b.num_rows - 1:
                    at = np.repeat(np.arange(i + 1 - first), [len(c) for c in made])
                    cols = [pa.array(np.concatenate(made).view(np.int64)), b.column("r").take(pa.array(at + first))]
                    x = np.array(kept, np.int64)[at]
                    cols += [pa.array(np.ascontiguousarray(x[:, j])) for j in range(width)]
                    yield pa.RecordBatch.from_arrays(cols + ([b.column(side).take(pa.array(at + first))] if side else []), names=names)
                    made, kept, n, first = [], [], 0, i + 1

    return classes.select("r", "h", *([side] if side else [])).mapInArrow(run, ", ".join(f"{c} {'boolean' if c == side else 'long'}" for c in names))


_EMITTED = pa.schema([("code", pa.int64()), ("ra", pa.int64()), ("rb", pa.int64()), ("x", pa.list_(pa.int64())), ("side", pa.bool_())])


def _runs(batches, near, width: int, sided: bool, longest: int):
    """From rows (code, r, x0, ...[, side]) in the order of code and r: the pairs (ra, rb) of each run of one code that are near
    by their numbers, and, with the code, the rows of runs with more than ``longest`` rows, which are joined elsewhere. A run
    may lie in several batches."""
    held = None
    hot = None  # the code whose rows are passed on, as its run is too long

    def passed(code, r, x, side):
        n = len(code)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(r), pa.nulls(n, pa.int64()), lists, pa.array(side)], schema=_EMITTED)

    def pairs(ra, rb):
        n = len(ra)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(ra), pa.array(rb), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.bool_())], schema=_EMITTED)

    def work(code, r, x, side):
        new = np.r_[True, (code[1:] != code[:-1]) | (r[1:] != r[:-1]) | (side[1:] != side[:-1])]
        code, r, x, side = code[new], r[new], x[new], side[new]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[start, len(code)])
        keep = size > 1
        if sided:
            n = np.add.reduceat(side.astype(np.int64), start)
            keep &= (n > 0) & (n < size)
        keep, wide = np.repeat(keep, size), np.repeat(size > longest, size)
        if (wide & keep).any():
            yield passed(*[c[wide & keep] for c in (code, r, x, side)])
        code, r, x, side = (c[keep & ~wide] for c in (code, r, x, side))
        at, step = np.arange(len(code)), 1
        while len(at := at[at + step < len(code)]) and len(at := at[code[at] == code[at + step]]):
            i, j = at, at + step
            if sided:
                cross = side[i] != side[j]
                i, j = np.where(side[i], i, j)[cross], np.where(side[i], j, i)[cross]
            ok = (r[i] != r[j]) & near(x[i], x[j])
            if ok.any():
                yield pairs(r[i[ok]], r[j[ok]])
            step += 1

    for b in batches:
        x = np.stack([b.column(2 + k).to_numpy() for k in range(width)], 1) if width else np.zeros((b.num_rows, 0), np.int64)
        side = b.column(2 + width).to_numpy(zero_copy_only=False).astype(bool) if sided else np.zeros(b.num_rows, bool)
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), x, side]
        if hot is not None:
            other = cols[0] != hot
            n = int(other.argmax()) if other.any() else b.num_rows
            if n:
                yield passed(*[c[:n] for c in cols])
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            hot = None
        held = cols if held is None else [np.concatenate([p, q]) for p, q in zip(held, cols)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
        if cut:
            yield from work(*[c[:cut] for c in held])
            held = [c[cut:] for c in held]
        if len(held[0]) > longest:
            hot = int(held[0][0])
            yield passed(*held)
            held = None
    if held is not None and len(held[0]):
        yield from work(*held)


def _met(blocks: DataFrame, near, width: int, side: str | None = None, longest: int = 1000, per_task: int = 1_000_000) -> DataFrame:
    """Written distinct pairs (ra, rb) of numbers that share a code and are near by their numbers: ra < rb, or with ``side`` ra
    of true and rb of false rows. Blocks are shuffled once, by their code, and each code's rows are read in one run; the rows
    of codes with more than ``longest`` rows are joined in cells of bounded size."""
    x = blocks.repartition("code").sortWithinPartitions("code", "r")
    run = lambda batches: _runs(batches, near, width, side is not None, longest)
    got = materialize(x.mapInArrow(run, "code long, ra long, rb long, x array<bigint>, side boolean").distinct())
    hot = got.where("rb is null")
    one, two = hot.where("side") if side else hot, hot.where("not side") if side else hot
    one, two = one.select("code", "ra", F.col("x").alias("xa")), two.select("code", F.col("ra").alias("rb"), F.col("x").alias("xb"))
    many = salted_join(one, two, ["code"], "ra", "rb", per_task).where("ra <> rb" if side else "ra < rb").select("ra", "rb", "xa", "xb")

    def thin(batches):
        for b in batches:
            a, c = (b.column(k).flatten().to_numpy().reshape(-1, width) for k in (2, 3))
            ok = pa.array(near(a, c)) if b.num_rows else pa.array([], pa.bool_())
            yield b.select(["ra", "rb"]).filter(ok)

    return materialize(got.where("rb is not null").select("ra", "rb").unionByName(many.mapInArrow(thin, "ra long, rb long")).distinct())


def _verified(met: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """Distinct class pairs (a, b) of candidates (ra, rb) whose word sets have an overlap of at least t. Only the words of
    classes among the candidates are moved."""
    ids = met.select(F.explode(F.array("ra", "rb")).alias("r")).distinct()
    needed = materialize(classes.select("k", "r", "h").join(ids, "r", "left_semi").dropDuplicates(["k"]))
    x = met.join(needed.select(F.col("r").alias("ra"), F.col("k").alias("a"), F.col("h").alias("ha")), "ra")
    x = x.join(needed.select(F.col("r").alias("rb"), F.col("k").alias("b"), F.col("h").alias("hb")), "rb").where("a <> b")
    both = F.size(F.array_intersect("ha", "hb"))
    x = x.select("a", "b", both.alias("i"), (F.size("ha") + F.size("hb") - both).alias("u"))
    return x.where(F.col("i") >= t * F.col("u") - EPS).select("a", "b").distinct()


def _allowed(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """How many words sets of na and nb words may differ in."""
    return np.floor((na + nb) * ((1 - t) / (1 + t)) + EPS)


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; counted of unsigned numbers, as of signed ones those of the absolute value are."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _near_prints(t: float):
    """Numbers (size, 64-bit fingerprint) within the Hamming radius."""
    return lambda x, y: _differing(x[:, 1], y[:, 1]) <= _allowed(x[:, 0], y[:, 0], t)


def group_number(c) -> F.Column:
    """The number in a group label, however it is written; null without one."""
    digits = F.regexp_replace(F.translate(c.cast("string"), "０１２３４５６７８９", "0123456789"), "[^0-9]", "")
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))


def split_name(c) -> F.Column:
    """train, val or test in one spelling; null for anything else."""
    low = F.regexp_replace(F.lower(c.cast("string")), r"[^a-z]", "")
    return F.when(low.isin("train", "training", "trn"), "train").when(low.isin("val", "valid", "validation", "dev"), "val").when(low.isin("test", "testing", "tst"), "test")


def _ordered(x: DataFrame, a: str = "ia", b: str = "ib") -> DataFrame:
    return x.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))


def _print(h: np.ndarray, bits: int = 64) -> list[int]:
    """The parity fingerprint as numbers of 64 bits."""
    return np.packbits(parity_sketch(h, bits)).view(np.int64).tolist()


def _across(df: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(records (id, g, train, k), written class pairs (a, b): a has train rows, b held-out rows, their words overlap). A class
    with rows on both sides pairs with itself; k is null without words."""
    src = df.select(F.col("id").cast("string").alias("id"), group_number(F.col("group_id")).alias("g"), split_name(F.col("split")).alias("s"), F.col("instruction").cast("string").alias("t"))
    src = src.where("id is not null and s is not null").select("id", "g", (F.col("s") == "train").alias("train"), "t")
    members, classes = word_sets(src, "train")
    blocks = _blocks(classes, lambda h: block_codes(h, t), lambda h: [len(h), *_print(h)], 2, "train")
    alike = _verified(_met(blocks, _near_prints(t), 2, "train"), classes, t)
    sides = members.where("k is not null").groupBy("k").agg(F.max("train").alias("tr"), F.max(~F.col("train")).alias("he"))
    return members, materialize(alike.unionByName(sides.where("tr and he").select(F.col("k").alias("a"), F.col("k").alias("b"))))


def split_overlaps(df: DataFrame, t: float = 0.85, per_task: int = 1_000_000) -> DataFrame:
    """(id_a, id_b): one record in train, one in val or test, of one group or with instructions of overlap at least t. The
    pairs are the result asked for; overlap_links() has the bounded form."""
    members, classes = _across(df, t)
    worded, grouped = members.where("k is not null"), members.where("g is not null")
    tr = worded.where("train").select(F.col("k").alias("a"), F.col("id").alias("ia"), F.col("g").alias("ga"))
    he = worded.where("not train").select(F.col("k").alias("b"), F.col("id").alias("ib"), F.col("g").alias("gb"))
    alike = salted_join(materialize(salted_join(classes, tr, ["a"], "b", "ia", per_task)), he, ["b"], "ia", "ib", per_task).where("ga is null or gb is null or ga <> gb")
    same = salted_join(grouped.where("train").select("g", F.col("id").alias("ia")), grouped.where("not train").select("g", F.col("id").alias("ib")), ["g"], "ia", "ib", per_task)
    return _ordered(alike).unionByName(_ordered(same))


def overlap_links(df: DataFrame, t: float = 0.85) -> DataFrame:
    """(id, train, class_id, n_links): one row per record with a group or words; class_id is the smallest id with the same
    words, n_links the number of records on the other side in its group or with an overlapping instruction. Counted by class
    and group, so no pair of records is formed: those of the group, and of the classes alike, less those that are both."""
    members, classes = _across(df, t)
    worded = members.where("k is not null")
    least = worded.groupBy("k").agg(F.min("id").alias("class_id"))
    by_class = worded.groupBy("k", "train").agg(F.count("*").alias("n"))
    by_both = worded.where("g is not null").groupBy("k", "g", "train").agg(F.count("*").alias("n"))
    by_group = members.where("g is not null").groupBy("g", "train").agg(F.count("*").alias("n"))
    both = classes.select(F.col("a").alias("k"), F.col("b").alias("o"), F.lit(True).alias("train")).unionByName(classes.select(F.col("b").alias("k"), F.col("a").alias("o"), F.lit(False).alias("train")))
    other = lambda x: x.withColumn("train", ~F.col("train"))
    alike = both.join(other(by_class).withColumnRenamed("k", "o"), ["o", "train"]).groupBy("k", "train").agg(F.sum("n").alias("n1"))
    twice = both.join(other(by_both).withColumnRenamed("k", "o"), ["o", "train"]).groupBy("k", "g", "train").agg(F.sum("n").alias("n2"))
    x = members.where("g is not null or k is not null").join(least, "k", "left")
    x = x.join(alike, ["k", "train"], "left").join(twice, ["k", "g", "train"], "left").join(other(by_group).withColumnRenamed("n", "n3"), ["g", "train"], "left")
    n = F.coalesce("n1", F.lit(0)) - F.coalesce("n2", F.lit(0)) + F.coalesce("n3", F.lit(0))
    return x.select("id", "train", F.coalesce("class_id", "id").alias("class_id"), n.cast("long").alias("n_links"))


def overlap_report(df: DataFrame, links: DataFrame) -> DataFrame:
    """(split, target_source, n_records, n_pairs): held-out records that overlap with train, and their pairs."""
    meta = df.select(F.col("id").cast("string").alias("id"), split_name(F.col("split")).alias("split"), "target_source").where("split in ('val', 'test')").dropDuplicates(["id"])
    held = links.where("not train and n_links > 0").groupBy("id").agg(F.sum("n_links").alias("n"))
    return held.join(meta, "id").groupBy("split", "target_source").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_pairs"))


# --- problem 6 -----------------------------------------------------------------------------------------------------

BANDS, ROWS, PIVOTS, SKETCH = 80, 8, 16, 1024


@functools.cache
def _permutations(n: int):
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def band_codes(h: np.ndarray, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    """A code per band of minimum hashes."""
    a, b = _permutations(bands * per)
    x = (_mix(h) >> np.uint64(32)).astype(np.uint32)
    low = (x[:, None] * a + b).min(0) if len(x) <= 4096 else np.min([(part[:, None] * a + b).min(0) for part in np.array_split(x, len(x) // 4096 + 1)], axis=0)
    rows = low.reshape(bands, per).astype(np.uint64)
    code = np.arange(bands, dtype=np.uint64) * _C[1]
    for j in range(per):
        code = _mix(code * _C[0] + rows[:, j])
    return code


WIDTH = 1 + PIVOTS // 4 + 2


def _measures(pivots: np.ndarray):
    """Word hashes to WIDTH numbers: the size, the distances to the reference fingerprints, four to a number, and a 128-bit
    fingerprint folded from the same bits."""

    def of(h):
        s = parity_sketch(h, SKETCH)
        small = np.bitwise_xor.reduce(s.reshape(-1, 128), 0)  # parities of joined buckets are those of their words
        return [len(h), *(s ^ pivots).sum(1, dtype=np.int16).view(np.int64).tolist(), *np.packbits(small).view(np.int64).tolist()]

    return of


def _near_pivots(t: float):
    """Pairs whose reference distances nowhere differ by more than the allowed words; of those, the ones whose fingerprints
    are within that Hamming distance. No true pair is discarded by either."""

    def near(x, y):
        most = _allowed(x[:, 0], y[:, 0], t)
        tables = [np.ascontiguousarray(z[:, 1 : 1 + PIVOTS // 4]).view(np.int16).astype(np.int32) for z in (x, y)]
        ok = np.abs(tables[0] - tables[1]).max(1, initial=0) <= most
        return ok & (_differing(x[:, -2:], y[:, -2:]).sum(1) <= most)

    return near


def _reference_fingerprints(classes: DataFrame) -> np.ndarray:
    """Sketches of PIVOTS classes with the smallest digests: a bounded choice that depends on no order of rows."""
    least = classes.select("k").distinct().orderBy("k").limit(PIVOTS).collect()
    rows = classes.where(F.col("k").isin([bytes(r.k) for r in least])).dropDuplicates(["k"]).select("k", "h").collect() if least else []
    got = [parity_sketch(np.array(r.h, np.int64).view(np.uint64), SKETCH) for r in sorted(rows, key=lambda r: bytes(r.k))]
    got += [np.zeros(SKETCH, np.uint8)] * (PIVOTS - len(got))
    return np.array(got)


def near_classes(df: DataFrame, id_col: str, text, t: float) -> tuple[DataFrame, DataFrame]:
    """(records (id, k), verified pairs (a, b) of different classes)."""
    src = df.select(F.col(id_col).cast("string").alias("id"), text.alias("t")).where("id is not null")
    members, classes = word_sets(src)
    members = members.where("k is not null")
    blocks = _blocks(classes, band_codes, _measures(_reference_fingerprints(classes)), WIDTH)
    return members, materialize(_verified(_met(blocks, _near_pivots(t), WIDTH), classes, t))


def both_texts() -> F.Column:
    """instruction and response as one text; null counts as empty."""
    return F.concat_ws("\n", F.col("instruction").cast("string"), F.col("response").cast("string"))


def near_duplicate_pairs(df: DataFrame, t: float = 0.75) -> DataFrame:
    """(id_a, id_b): all pairs of records whose instruction and response together have an overlap of at least t."""
    recs, pairs = near_classes(df, "id", both_texts(), t)
    a, b = recs.select(F.col("k").alias("a"), F.col("id").alias("ia")), recs.select(F.col("k").alias("b"), F.col("id").alias("ib"))
    across = salted_join(materialize(salted_join(pairs, a, ["a"], "b", "ia")), b, ["b"], "ia", "ib")
    inside = salted_join(a.withColumnRenamed("a", "k"), b.withColumnRenamed("b", "k"), ["k"], "ia", "ib").where("ia < ib")
    return _ordered(across).unionByName(_ordered(inside))


def near_duplicate_groups(df: DataFrame, t: float = 0.75) -> DataFrame:
    """(id, group_id, n_links): one row per record with words; group_id is the smallest id linked directly or through
    others, n_links the number of records linked directly. Copies are counted, not expanded."""
    recs, pairs = near_classes(df, "id", both_texts(), t)
    roots = components(pairs)
    size = recs.groupBy("k").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    both = pairs.select(F.col("a").alias("k"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("k"), F.col("a").alias("o")))
    links = both.join(size.select(F.col("k").alias("o"), "m"), "o").groupBy("k").agg(F.sum("m").alias("links"))
    per = size.join(roots.withColumnsRenamed({"node": "k"}), "k", "left").join(links, "k", "left")
    per = per.select("k", "m", "least", F.coalesce("root", "k").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    named = per.groupBy("root").agg(F.min("least").alias("group_id"))
    return recs.join(per.join(named, "root").select("k", "group_id", "n_links"), "k").select("id", "group_id", "n_links")
