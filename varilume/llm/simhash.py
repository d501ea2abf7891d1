"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm import alike
from varilume.llm.common import cut, documents, map_batches, raw, table
from varilume.llm.components import components

SEED = 42
#: Odd multipliers that turn a shingle's hash into those of the further lanes.
LANE_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Hashes whose bits are unpacked at once; bounds the memory a very long text needs.
CHUNK = 1 << 15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words, repeats included; the whole sequence where it is shorter."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - words + 1)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) <= words:
        return np.array([h(join(w), SEED)], np.uint64)
    return np.fromiter((h(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, n)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return h
    h = h * np.uint64(LANE_MIX[lane - 1])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def majority(h: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = np.ascontiguousarray(h[at : at + CHUNK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """(doc_id, f0..): one 64-bit SimHash for each lane, over whole texts."""
    names = [f"f{i}" for i in range(lanes)]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[int]] = [[] for _ in names]
        for text in raw(batch.column("text")):
            h = shingle_hashes(text, words)
            for i, col in enumerate(out):
                col.append(majority(_lane(h, i)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", *names])

    return map_batches(documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _segments(lanes: int, width: int) -> list[tuple[int, int]]:
    return [(lane, at * width) for lane in range(lanes) for at in range(64 // width)]


def _table(points: DataFrame, lanes: int, width: int, *more: str) -> DataFrame:
    """points under each segment's value: s, v, key (both in one number), rep, f0.. and more."""
    names = [f"f{i}" for i in range(lanes)]
    parts = F.array(*(F.struct(F.lit(i).alias("s"), _value("", lane, at, width).alias("v")) for i, (lane, at) in enumerate(_segments(lanes, width))))
    own = points.select("rep", *more, *names, F.explode(parts).alias("x")).select("rep", *more, *names, "x.s", "x.v")
    return own.withColumn("key", F.expr(f"v | shiftleft(cast(s as bigint), {width})"))


def stars(points: DataFrame, lanes: int, width: int, radius: int) -> DataFrame:
    """(a, b): links of the points that share a segment's value to two of them, those of the least and the largest rep.

    Two rows at most for each point and segment, however large a group; enough to join most of a group of near copies.
    """
    names = [f"f{i}" for i in range(lanes)]
    own = _table(points, lanes, width)
    one = F.struct("rep", *names)
    ends = own.groupBy("key").agg(F.min(one).alias("x"), F.max(one).alias("y")).filter("x.rep != y.rep").select("key", F.explode(F.array("x", "y")).alias("c"))
    far = own.select("key", F.col("rep").alias("b"), *(F.col(n).alias(f"b{n}") for n in names))
    centre = ends.select("key", F.col("c.rep").alias("a"), *(F.col(f"c.{n}").alias(f"a{n}") for n in names))
    return far.join(centre, "key").filter((F.col("a") != F.col("b")) & (_away(names) <= radius)).select("a", "b")


def links(points: DataFrame, lanes: int, width: int, radius: int, ends: tuple[str, str] = ("la", "lb")) -> DataFrame:
    """(a, b), labels of points (rep, label, f0..) of different labels whose fingerprints differ by radius bits at most; ends a, b: the points.

    Each fingerprint is cut into segments of width bits. A point enters the table under each segment's
    value and probes it with the Hamming ball of radius 1 around that value; a flip from 0 to 1 suffices,
    as the other point of a pair makes the opposite one. With at least radius / 2 segments, rounded up,
    (radius // segments <= 1) no pair is missed; with fewer, the pairs missed are those with two
    or more differing bits in every segment. A pair is kept at its first segment within the ball only.
    Probes of a value under which nothing but their own label stands are left out before points meet, so that a group
    that has one label already costs no pairs.
    """
    segments, names = _segments(lanes, width), [f"f{i}" for i in range(lanes)]
    own = _table(points, lanes, width, "label")
    labels = own.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"))
    flips = F.expr(f"filter(transform(sequence(0, {width - 1}), i -> v | shiftleft(1L, i)), x -> x != v)")
    probe = own.select("s", "v", F.explode(F.concat(F.array("v"), flips)).alias("p"), F.col("rep").alias("a"), F.col("label").alias("la"), *(F.col(n).alias(f"a{n}") for n in names))
    probe = probe.select(F.expr(f"p | shiftleft(cast(s as bigint), {width})").alias("key"), (F.col("p") == F.col("v")).alias("exact"), "a", "la", *(f"a{n}" for n in names))
    probe = probe.hint("merge").join(labels, "key").filter("not (l1 = la and l2 = la)").drop("l1", "l2")
    tab = own.select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), *(F.col(n).alias(f"b{n}") for n in names))

    def nearby(lane: int, at: int) -> Column:
        return F.bit_count(_value("a", lane, at, width).bitwiseXOR(_value("b", lane, at, width))) <= 1

    first = reduce(lambda rest, i: F.when(nearby(*segments[i]), F.lit(i)).otherwise(rest), reversed(range(len(segments))), F.lit(-1))
    on = (probe["key"] == tab["key"]) & (~F.col("exact") | (F.col("a") < F.col("b"))) & (F.col("la") != F.col("lb")) & (_away(names) <= radius) & (first == F.shiftright(tab["key"], width))
    return probe.join(tab.hint("merge"), on).select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b")).distinct()


def candidates(points: DataFrame, lanes: int, width: int, radius: int) -> DataFrame:
    """(a, b): pairs of points (rep, f0..) for an exact check, found by multi-index hashing: the stars, and the links between
    points that no star joins. A pair that stars join without a link of its own is not given."""
    star = cut(stars(points, lanes, width, radius))
    early = components(star, "a", "b")
    points = cut(points.join(early, points["rep"] == early["node"], "left").select("rep", *(f"f{i}" for i in range(lanes)), F.coalesce("component", "rep").alias("label")))
    return star.unionByName(links(points, lanes, width, radius, ("a", "b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _value(prefix: str, lane: int, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(f"{prefix}f{lane}"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _away(names: list[str]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a{n}").bitwiseXOR(F.col(f"b{n}"))) for n in names))


def near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 3, width: int = 16, radius: int = 27) -> DataFrame:
    """One row per document: (doc_id, f0.., component_id), the smallest doc_id reachable by links.

    The default takes 5-word shingles and 192 bits; 27 differing bits stand for a Jaccard likeness of
    about 0.82, with the sketch's error, and its 12 segments miss some pairs beyond 23 bits. Equal fingerprints meet in one
    point, so copies cost no pairs. A large group of near copies is first joined by stars within each segment's values; the
    search over all segments then leaves out pairs that are joined already, which changes no component.
    Null and empty texts have fingerprint 0 and are linked like any other; of repeated doc_ids each row is
    returned; no documents give no rows.
    """
    names = [f"f{i}" for i in range(lanes)]
    marks = cut(fingerprints(docs, words, lanes))
    points = cut(marks.groupBy(*names).agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    early = components(stars(points, lanes, width, radius), "a", "b")
    points = cut(points.join(early, points["rep"] == early["node"], "left").select("rep", *names, F.coalesce("component", "rep").alias("label")))
    comp = components(links(points, lanes, width, radius), "a", "b")
    named = points.join(comp, points["label"] == comp["node"], "left").select(*names, F.coalesce("component", "label").alias("component_id"))
    return marks.join(named, names, "left").select("doc_id", *names, "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without all but the document of the smallest doc_id of each component of shingle sets of Jaccard likeness 0.8 or more.

    Pairs come from SimHash by multi-index hashing, and each is kept on its whole sets alone. No workable radius finds all
    such pairs (about 29 of 192 bits differ at 0.8, give or take 5), so the exact join of ``alike`` adds those that
    SimHash misses; repeated doc_ids stay together.
    """
    gone = alike.near_duplicates(docs, words).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, 64 bits, linked at 3 differing bits; two 32-bit segments with radius-1 balls miss none."""
    got = near_duplicates(table(spark, sf_dir, "documents"), words=3, lanes=1, width=32, radius=3)
    return got.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
