"""Mixing sources to target weights: packed blocks, shard counts, permuted slots, a join by index."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varilume.llm.common import WORD, cut, table

SEED = 20_240_501
#: Words of a block, slots of an output shard, documents of a bucket of the running sums.
BLOCK, SHARD_SLOTS, BUCKET_DOCS = 128, 4096, 4096
WEIGHTS, EPOCHS, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: One row for each source reaches the driver; more sources than this raise an error.
MAX_SOURCES = 1_000_000
#: numpy draws hypergeometric counts of populations below this; larger ones are drawn by the ratio of uniforms, from the same law.
NUMPY_BELOW = 1_000_000_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> list[float]:
    """Words to take from each source: shares by repeating weight, stopped at most times the size, the excess reshared."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    cap = most * np.array(sizes, float)
    out, open_ = np.zeros(len(sizes)), cap > 0
    left = min(epochs * float(sum(sizes)), float(cap.sum()))
    while open_.any():
        share = left * w / w[open_].sum()
        over = open_ & (share > cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return out.tolist()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse: a Feistel network that walks cycles back into range."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix64(np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in keys[::-1] if back else keys:
            a, b = (b ^ (_mix64(a + k) & mask), a) if back else (b, a ^ (_mix64(b + k) & mask))
        return (a << shift) | b

    x = once(np.asarray(index).astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """What each task knows of a source: its words, its blocks and the slots it fills."""

    key: int
    words: int
    take: int
    block: int

    @property
    def blocks(self) -> int:
        return -(-self.words // self.block)

    @property
    def passes(self) -> int:
        return self.take // self.words if self.words else 0

    def length(self, block: np.ndarray) -> np.ndarray:
        return np.minimum(self.block, self.words - block * self.block)

    @property
    def rest(self) -> tuple[int, int]:
        """Slots of the last, partial pass, and the words by which its last slot is cut."""
        need = self.take - self.passes * self.words
        if not need:
            return 0, 0
        short = self.blocks * self.block - self.words
        at = int(permute(np.array([self.blocks - 1]), self.blocks, self.key + self.passes, back=True)[0])
        n = -(-need // self.block)
        if n > at:
            n = -(-(need + short) // self.block)
        return n, n * self.block - (short if n > at else 0) - need

    @property
    def slots(self) -> int:
        return self.passes * self.blocks + self.rest[0]

    def fill(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each slot and the words taken from it."""
        lap, at = j // self.blocks, j % self.blocks
        out = np.empty(len(j), np.int64)
        for p in np.unique(lap):
            out[lap == p] = permute(at[lap == p], self.blocks, self.key + int(p))
        n = self.length(out)
        last, less = self.slots - 1, self.rest[1]
        return out, np.where(j == last, n - less, n)


def _grown(x: float, d: float) -> float:
    """log Gamma(x + d) - log Gamma(x) by Stirling's series, without the loss of taking two large numbers apart."""
    if min(x, x + d) < 1e4:
        return math.lgamma(x + d) - math.lgamma(x)
    return (x + d - 0.5) * math.log1p(d / x) + d * (math.log(x) - 1) + (1 / (x + d) - 1 / x) / 12


def ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, m: int) -> int:
    """A hypergeometric count of any size: how many of m drawn without return from good + bad are good.

    Points are thrown at a box around the law's mode and kept under the law's own curve, so no approximation enters but
    the rounding of logarithms.
    """
    total = good + bad
    low, high = max(0, m - bad), min(m, good)
    if low == high:
        return low
    p = good / total
    mean, var = m * p, m * p * (1 - p) * (total - m) / max(1, total - 1)
    mode = min(high, max(low, (m + 1) * (good + 1) // (total + 2)))
    centre, width = mean + 0.5, math.sqrt(8 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(centre + width * (v - 0.5) / u)
        if not low <= k <= high:
            continue
        d = float(k - mode)
        # log of the law at k less that at the mode: factorials of k, good - k, m - k and bad - m + k
        fall = _grown(mode + 1, d) + _grown(good - mode + 1, -d) + _grown(m - mode + 1, -d) + _grown(bad - m + mode + 1, d)
        if 2 * math.log(u) <= -fall:
            return k


def draw(counts: np.ndarray, m: int, key: tuple[int, ...]) -> np.ndarray:
    """How many of m slots fall to each source: multinomial, given that counts are left in all. Exact at any size."""
    rng, total = np.random.default_rng([SEED, *key]), int(counts.sum())
    if total < NUMPY_BELOW:
        return rng.multivariate_hypergeometric(counts, m, method="marginals")
    got = np.zeros(len(counts), np.int64)
    for i, c in enumerate(counts.tolist()):
        total -= c
        got[i] = ratio_of_uniforms(rng, c, total, m) if m and c else 0
        m -= int(got[i])
    return got


def shard_counts(counts: np.ndarray, first: int, last: int, per: int):
    """(shard, counts, offsets) for shards first..last-1, by halving: no task sees the shards before its own."""
    slots = int(counts.sum())
    stack = [(0, -(-slots // per), counts, np.zeros_like(counts))]
    while stack:
        lo, hi, c, off = stack.pop()
        if hi <= first or lo >= last or lo == hi:
            continue
        if hi - lo == 1:
            yield lo, c, off
            continue
        mid = (lo + hi) // 2
        left = draw(c, (mid - lo) * per, (lo, hi))
        stack += [(mid, hi, c - left, off + left), (lo, mid, left, off)]


def slots(spark: SparkSession, sources: list[Source], per: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, source_no, block, words): the block that each slot of each output shard takes."""
    counts = np.array([s.slots for s in sources], np.int64)
    k = -(-int(counts.sum()) // per) if len(sources) else 0

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, c, off in shard_counts(counts, int(ids.min()), int(ids.max()) + 1, per):
                no = np.repeat(np.arange(len(c)), c)
                block, words = np.empty(len(no), np.int64), np.empty(len(no), np.int64)
                for i in np.nonzero(c)[0]:
                    block[no == i], words[no == i] = sources[i].fill(np.arange(off[i], off[i] + c[i]))
                order = np.random.default_rng([SEED, 1, shard]).permutation(len(no))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), shard)), pa.array(np.arange(len(no))), pa.array(no[order].astype(np.int64)), pa.array(block[order]), pa.array(words[order])], ["shard", "slot", "source_no", "block", "words"])

    # Spark takes these rows for as few as the shards; the hint keeps it from broadcasting them
    return spark.range(0, k, 1, max(1, min(k, 2 * spark.sparkContext.defaultParallelism, -(-k // 4)))).mapInArrow(run, "shard long, slot long, source_no long, block long, words long").hint("merge")


@dataclass(frozen=True)
class Mix:
    pieces: DataFrame
    slots: DataFrame


def plan(docs: DataFrame, block: int, with_text: bool) -> Mix:
    """Place every document in its source's sequence of words and draw the slots.

    pieces: (doc_id, size, source, source_size, target, source_no, start, block, lo, hi[, piece]), one row for each block
    that a document touches (block null where it has no word).
    """
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    base = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    sized = base.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    sized = cut(sized.withColumn("bucket", bucket))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    rows = by_bucket.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["words"] for r in rows])
    sources = [Source(key=int(_mix64(np.array([SEED + 1000 * i], np.uint64))[0] >> np.uint64(1)), words=r["words"], take=min(round(g), int(MOST * r["words"])), block=block) for i, (r, g) in enumerate(zip(rows, goal, strict=True))]
    known = F.broadcast(spark.createDataFrame([(r["source"], i, r["words"], g) for i, (r, g) in enumerate(zip(rows, goal, strict=True))], "name string, source_no long, source_size long, target double"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0))).select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), "before")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"start": F.coalesce(F.sum("size").over(inside), F.lit(0)), "place": F.row_number().over(Window.partitionBy("source", "bucket").orderBy("doc_id", "tie"))})
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["src"]) & (placed["bucket"] == offsets["bkt"])).withColumn("start", F.col("start") + F.col("before"))
    placed = placed.join(known, placed["source"].eqNullSafe(known["name"]))
    if with_text:
        # the n-th of equal rows gets the n-th place, so that repeated rows keep apart
        nth = Window.partitionBy("doc_id", "source", "tie")
        placed = placed.withColumn("nth", F.row_number().over(nth.orderBy("start")))
        text = base.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "text", F.xxhash64("text").alias("t"))
        text = text.withColumn("n", F.row_number().over(Window.partitionBy("id", "of", "t").orderBy("t")))
        placed = placed.join(text, placed["doc_id"].eqNullSafe(text["id"]) & placed["source"].eqNullSafe(text["of"]) & (placed["tie"] == text["t"]) & (placed["nth"] == text["n"])).withColumn("words_", words)
    first, last = F.col("start"), F.col("start") + F.col("size")
    keep = ["doc_id", "size", "source", "source_size", "target", "source_no", "start", "bucket", "place"]
    b = F.expr(f"explode_outer(if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), null))")
    pieces = placed.select(*keep, *(["words_"] if with_text else []), b.alias("block"))
    pieces = pieces.withColumns({"lo": F.greatest(first, F.col("block") * block), "hi": F.least(last, (F.col("block") + 1) * block)})
    if with_text:
        pieces = pieces.select(*keep, "block", "lo", "hi", F.expr("array_join(slice(words_, cast(lo - start + 1 as int), cast(hi - lo as int)), ' ')").alias("piece"))
    return Mix(pieces, slots(spark, sources))


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken), the words that the mix takes of it.

    Null and empty texts have size 0 and give nothing; a null source is a source of its own, the last; repeated rows
    each have their place; no documents give no rows. Each source's sum of taken is its target, rounded, as the last slot
    of a source is cut; a block is taken twice at most, so no document exceeds 2 times its size.
    """
    mix = plan(docs, block, with_text=False)
    got = mix.pieces.join(mix.slots.select(F.col("source_no").alias("s"), F.col("block").alias("b"), "words"), (F.col("source_no") == F.col("s")) & (F.col("block") == F.col("b")), "left")
    # least() passes over nulls, so a block without a slot needs saying
    n = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), F.least("hi", F.col("block") * block + F.col("words")) - F.col("lo")))
    return got.groupBy("doc_id", "source", "bucket", "place", "start", "size", "source_size", "target").agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, slot, source, block, doc_ids, n_words, text): the blocks of the mix, in the order of the slots.

    Each source's words stand in the order of its documents (by bucket of the id's hash, then id); rules for nulls,
    empties and repeats as in taken().
    """
    mix = plan(docs, block, with_text=True)
    p = mix.pieces.filter("block is not null").select("source_no", "block", "source", "doc_id", "lo", "hi", "piece")
    s = mix.slots.select(F.col("source_no").alias("s"), F.col("block").alias("b"), "shard", "slot", "words")
    got = p.join(s, (p["source_no"] == s["s"]) & (p["block"] == s["b"]))
    n = F.least(F.col("hi"), F.col("block") * block + F.col("words")) - F.col("lo")
    got = got.withColumn("n", n).filter("n > 0").withColumn("piece", F.expr("if(n = hi - lo, piece, substring_index(piece, ' ', cast(n as int)))"))
    # clustered by (source_no, block) already: no further shuffle
    out = got.groupBy("source_no", "block", "shard", "slot").agg(F.first("source").alias("source"), F.sum("n").alias("n_words"), F.array_sort(F.collect_list(F.struct("lo", "doc_id", "piece"))).alias("parts"))
    return out.select("shard", "slot", "source", "block", F.expr("transform(parts, x -> x.doc_id)").alias("doc_ids"), "n_words", F.expr("array_join(transform(parts, x -> x.piece), ' ')").alias("text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
