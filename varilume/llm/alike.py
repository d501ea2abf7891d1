"""Documents of like shingle sets: pairs by SimHash and multi-index hashing, an exact Jaccard join for the rest, and components.

SimHash gives pairs of near fingerprints first; they are kept on their whole sets. It misses some pairs near LEAST, which
a join by prefix, length and positional filters adds.

Each set is put into one order for all, common shingles last. Sets of a Jaccard likeness of LEAST or more share one of the
first n - ceil(LEAST n) + 1 at least, so no pair is missed, and each candidate is kept on its whole sets alone. Before
texts are fetched for that, a bound on the sets' difference lets most others go: each set has a mask of the parities
of its shingles, and masks that differ in more bits than the difference of sets may count belong to no pair. A large set
has a wide mask too, with at least DENSE bits for ten shingles, so that the bound tells sets of any size apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varilume.llm.common import cut, documents, map_batches, raw, release
from varilume.llm.components import components

#: Least likeness, as a fraction, so that the bound is exact.
LEAST = (4, 5)
#: Shingles of MANY sets or more are first linked by stars.
MANY = 17
#: Documents looked at for common shingles, how many hold one, and how many are kept. They set the order, not the result.
SAMPLE, OFTEN, COMMON = 8_000, 3, 50_000
#: Bytes of text that one bucket of prefixes stands for.
BUCKET_BYTES = 8 << 20
#: Words of 64 bits of a set's parity mask, and bits for ten shingles that a wide mask has at least.
MASK, DENSE = 16, 7
#: SimHash of sets: segments' width, and bits that a candidate pair may differ in; 16 of 64 are some 2 deviations beyond the mean at LEAST.
WIDTH, RADIUS = 32, 16
ENTRY = np.dtype([("key", "<i8"), ("point", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _set(text: bytes, words: int) -> np.ndarray:
    from varilume.llm.simhash import shingle_hashes

    return np.unique(shingle_hashes(text, words))


def _point(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Of a sorted set, those shingles of which a set that is alike enough has one; common: sorted."""
    n = len(h)
    if len(common) and n:
        late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate((h[~late], h[late]))
    return h[: n - -(-LEAST[0] * n // LEAST[1]) + 1] if n else h


def fits(na, nb, pa_, pb):
    """Whether sets that share what stands at these places, and nothing before, can be alike enough."""
    p, q = LEAST
    rest = np.minimum(na - pa_, nb - pb)
    return (q * np.minimum(na, nb) >= p * np.maximum(na, nb)) & ((p + q) * rest >= p * (na + nb))


def _common(base: DataFrame, words: int) -> np.ndarray:
    rate = max(1, base.count() // SAMPLE)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([_set(t, words) for t in raw(batch.column("text"))]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    got = map_batches(base.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rate)) == 0).select("text"), f, "h long, n long")
    rows = got.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def parities(h: np.ndarray, size: int = MASK) -> np.ndarray:
    """For each of 64 size places whether an odd number of the set's shingles fall on it: the masks of two sets differ in as many
    bits as the sets differ in shingles, or in fewer."""
    at = ((h >> np.uint64(20)) % np.uint64(64 * size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * size) & 1).astype(np.uint8)).view("<i8")


def wide(h: np.ndarray) -> np.ndarray:
    """Parities in a mask that grows with the set, by doubling, as MASK words can't tell large sets apart; none where those do.

    Its halves, one xor the other, are the mask of half the size, so that masks of two sizes can be held together.
    """
    size = MASK
    while 640 * size < DENSE * len(h):
        size *= 2
    return parities(h, size) if size > MASK else np.zeros(0, "<i8")


def _marks(base: DataFrame, words: int) -> DataFrame:
    """(doc_id, t, point, n, f0, mask, wide): hashes of the text and of its set, the set's size, SimHash and parities."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        from varilume.llm.simhash import majority

        sets = [_set(t, words) for t in raw(batch.column("text"))]
        masks = [pa.array([g(h) for h in sets], pa.list_(pa.int64())) for g in (parities, wide)]
        cols = [batch.column("doc_id"), batch.column("t"), pa.array([_point(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([majority(h) for h in sets], pa.int64()), *masks]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "point", "n", "f0", "mask", "wide"])

    return map_batches(base.select("doc_id", F.xxhash64("text").alias("t"), "text"), f, "doc_id long, t long, point long, n long, f0 long, mask array<long>, wide array<long>")


def _possible(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs without those whose masks differ too much for the likeness: |A - B| + |B - A| <= (q - p) / (q + p) (|A| + |B|)."""
    side = lambda s: points.select(F.col("point").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"wide_{s}"), *(F.get("mask", F.lit(i)).alias(f"{s}{i}") for i in range(MASK)))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_near()).select("a", "b")


def _near():
    """Whether the masks, and then the wide ones of large sets, leave room for the likeness. Of sets that can be alike one wide
    mask is at most twice as long as the other; what is said of further sets is void, as their sizes rule them out."""
    p, q = LEAST
    bound = (q - p) * (F.col("n_a") + F.col("n_b"))
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(MASK)), F.lit(0))
    size = "least(size(wide_a), size(wide_b))"
    half = lambda w: f"get({w}, i) ^ if(size({w}) > {size}, get({w}, i + {size}), 0L)"
    large = F.expr(f"if({size} = 0, 0, aggregate(sequence(0, greatest(0, {size} - 1)), 0, (n, i) -> n + bit_count(({half('wide_a')}) ^ ({half('wide_b')}))))")
    return ((p + q) * differ <= bound) & ((p + q) * large <= bound)


def _deal(base: DataFrame, words: int, common: np.ndarray, buckets: int) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [np.zeros(0, ENTRY)]
        for t in raw(batch.column("text")):
            h = _set(t, words)
            key = prefix(h, common)
            e = np.zeros(len(key), ENTRY)
            e["key"], e["point"], e["n"], e["pos"] = key.view(np.int64), _point(h), len(h), np.arange(len(key))
            parts.append(e)
        e = np.concatenate(parts)
        bucket = (e["key"].astype(np.uint64) >> np.uint64(24)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        e, bucket = e[order], bucket[order]
        full, begin = np.unique(bucket, return_index=True)
        blobs = [x.tobytes() for x in np.split(e, begin[1:])] if len(full) else []
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return map_batches(base.select("text"), f, "bucket long, blob binary")


def _candidates(dealt: DataFrame) -> DataFrame:
    """kind 0: pairs (a, b) of points that share a rare key; kind 1: what stands under keys of MANY points or more."""

    def f(key, group):
        e = np.concatenate([np.frombuffer(b, ENTRY) for b in group.column("blob").to_pylist()])
        e = e[np.lexsort((e["point"], e["key"]))]
        # copies of a text have one point
        new = np.ones(len(e), bool)
        new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["point"][1:] != e["point"][:-1])
        e = e[new]
        k = e["key"]
        _, which, count = np.unique(k, return_inverse=True, return_counts=True)
        size = count[which]
        big, e = e[size >= MANY], e[(size > 1) & (size < MANY)]
        n, pos, k = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["key"]
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, MANY):
            at = np.flatnonzero(k[d:] == k[:-d])
            at = at[fits(n[at], n[at + d], pos[at], pos[at + d])]
            found.append(np.stack((e["point"][at], e["point"][at + d]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        m, z = len(pairs), np.zeros(len(pairs), np.int64)
        cols = {"kind": (z, np.ones(len(big), np.int64)), "key": (z, big["key"]), "a": (pairs[:, 0], big["point"]), "b": (pairs[:, 1], big["point"]), "n": (z, big["n"].astype(np.int64)), "pos": (z, big["pos"].astype(np.int64))}
        return pa.table({c: pa.array(np.concatenate(v), pa.int64()) for c, v in cols.items()})

    return dealt.groupBy("bucket").applyInArrow(f, "kind long, key long, a long, b long, n long, pos long")


def _alike(base: DataFrame, points: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(a, b), the doc_ids that stand for the points of those pairs whose whole sets are alike enough."""

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array([z(t) for t in raw(batch.column("text"))], pa.binary())], ["doc_id", "t", "z"])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        expand = zstandard.ZstdDecompressor().decompress
        keep, sets, last = [], {}, None
        for a, za, zb in zip(batch.column("a").to_pylist(), batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
            if a != last:
                last, sets = a, _set(expand(za), words)
            other = _set(expand(zb), words)
            both = len(np.intersect1d(sets, other, assume_unique=True))
            keep.append(sum(LEAST) * both >= LEAST[0] * (len(sets) + len(other)))
        return pa.RecordBatch.from_arrays([batch.column("ra"), batch.column("rb")], ["ra", "rb"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(_possible(points, pairs))
    ids = pairs.select(F.col("a").alias("point")).unionByName(pairs.select(F.col("b").alias("point"))).distinct()
    want = points.join(ids, "point").select("point", F.col("rep").alias("r"), F.col("t").alias("rt"))
    z = map_batches(base.select("doc_id", F.xxhash64("text").alias("t"), "text"), squeeze, "doc_id long, t long, z binary")
    texts = cut(z.join(want, (z["doc_id"] == want["r"]) & (z["t"] == want["rt"])).select("point", "r", "z"))
    one = texts.select(F.col("point").alias("a"), F.col("r").alias("ra"), F.col("z").alias("za"))
    two = texts.select(F.col("point").alias("b"), F.col("r").alias("rb"), F.col("z").alias("zb"))
    got = cut(map_batches(pairs.join(two, "b").join(one, "a").select("a", "ra", "za", "rb", "zb"), f, "a long, b long"))
    release(base.sparkSession)
    return got


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per document: (doc_id, component_id), the smallest doc_id reachable over pairs of likeness LEAST or more.

    Sets are of 64-bit shingle hashes; equal sets meet in one point, so copies cost no pairs. Keys of MANY points or more are
    first linked by stars, each point to the one of the smallest doc_id; all their pairs follow, without those that
    are joined already, which changes no component. SimHash's candidates go through the same exact check as the join's. Texts without words are alike; of repeated doc_ids each row is returned.
    """
    from varilume.llm import simhash

    base = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    marks = cut(_marks(base, words))
    named = marks.filter("doc_id is not null").groupBy("point").agg(F.min(F.struct("doc_id", "t", "n", "f0", "mask", "wide")).alias("x"))
    points = cut(named.select("point", F.col("x.doc_id").alias("rep"), F.col("x.t").alias("t"), F.col("x.n").alias("n"), F.col("x.f0").alias("f0"), F.col("x.mask").alias("mask"), F.col("x.wide").alias("wide")))
    marks = marks.select("doc_id", "point")
    some = base.filter("doc_id is not null")
    near = cut(simhash.candidates(points.select(F.col("point").alias("rep"), "f0"), 1, WIDTH, RADIUS))
    release(docs.sparkSession)
    found = cut(_candidates(_deal(some, words, _common(some, words), max(4, -(-total // BUCKET_BYTES)))))
    release(docs.sparkSession)
    big = cut(found.filter("kind = 1").select("key", F.col("a").alias("point"), "n", "pos").join(points.select("point", "rep"), "point"))
    centre = big.groupBy("key").agg(F.min(F.struct("rep", "point")).alias("c")).select("key", F.col("c.point").alias("a"))
    stars = big.select("key", F.col("point").alias("b")).join(centre, "key").filter("a != b").select("a", "b").distinct()
    early = _alike(some, points, cut(near.unionByName(found.filter("kind = 0").select("a", "b")).unionByName(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()), words)
    comp = components(early, "a", "b")
    label = big.join(comp, big["rep"] == comp["node"], "left").select("key", "point", "n", "pos", F.coalesce("component", "rep").alias("label"))
    # keys under which all has one label have no link to add
    mixed = label.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 != l2").select("key")
    label = cut(label.join(mixed, "key", "left_semi"))
    masked = label.join(points.select("point", "mask", "wide"), "point")
    side = lambda s: masked.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("point", "n", "pos", "label", "wide")), *(F.get("mask", F.lit(i)).alias(f"{s}{i}") for i in range(MASK)))
    p, q = LEAST
    able = F.expr(f"point_a < point_b and label_a != label_b and {q} * least(n_a, n_b) >= {p} * greatest(n_a, n_b) and {p + q} * least(n_a - pos_a, n_b - pos_b) >= {p} * (n_a + n_b)")
    a, b = side("a"), side("b")
    rest = cut(a.join(b, (a["key"] == b["key"]) & able & _near()).select(F.col("point_a").alias("a"), F.col("point_b").alias("b")).distinct())
    links = early if rest.isEmpty() else early.unionByName(_alike(some, points, rest, words))
    comp = components(links, "a", "b")
    joined = points.join(comp, points["rep"] == comp["node"], "left").select("point", F.coalesce("component", "rep").alias("component_id"))
    return marks.join(joined, "point", "left").select("doc_id", "component_id")
