"""Exact removal of repeated 50-byte strings: texts are dealt into shards, and each shard is suffix-sorted.

A window of 50 bytes belongs to the shard of the least hash among its 16-byte strings, so equal windows meet whatever text
surrounds them. Consecutive windows of one hash form a run and travel as one. A run that stands elsewhere
as a whole needs no bytes; runs that share a hash but differ go to the suffix sort of ``induced``, which finds their windows
in common. Runs are equal if 64 bits of hash and the length are. What is shuffled besides the texts is some 20 bytes for each run, and a run has some 17 windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm import induced
from varilume.llm.common import cut, documents, map_batches, raw, release, table

LENGTH, GRAM = 50, 16
#: Bytes of text that one shard stands for, and bytes hashed at once.
SHARD_BYTES, CHUNK = 3 << 20, 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) ^ np.random.default_rng(51).integers(0, 2**63, 256, dtype=np.uint64)
RUN = np.dtype([("high", "<u4"), ("low", "<u2"), ("whole", "<u8"), ("doc", "<u2"), ("start", "<u4"), ("n", "<u4")])
SPAN = np.dtype([("key", "<i8"), ("start", "<u4"), ("n", "<u4")])
ASK = np.dtype([("key", "<i8"), ("doc_id", "<i8"), ("value", "<u8"), ("start", "<u4"), ("n", "<u4"), ("shard", "<u4")])
ALIAS = np.dtype([("key", "<i8"), ("first", "<u4"), ("start", "<u4"), ("n", "<u4")])
#: Bytes of runs sorted at once; runs of one hash stay together.
SORT_BYTES = 1 << 20


def _squeezed(keyed: DataFrame, buckets: int) -> DataFrame:
    """(key, bucket, doc_id, z): texts compressed one by one before they are dealt, as they go over the wire twice."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("bucket"), batch.column("doc_id"), pa.array([squeeze(t) for t in raw(batch.column("text"))], pa.binary())], ["key", "bucket", "doc_id", "z"])

    return map_batches(keyed.select("key", (F.col("key") % buckets).alias("bucket"), "doc_id", "text"), f, "key long, bucket long, doc_id long, z binary")


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z) for z in column.to_pylist()]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 1 << 64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of the width, by windows of doubled size."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, hash, hash of the whole run) of all runs of texts of LENGTH bytes or more, in order."""
    use = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    if not use:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sizes = np.array([len(texts[i]) for i in use])
    begin = np.cumsum(sizes) - sizes
    x = _TABLE[np.frombuffer(b"".join(texts[i] for i in use), np.uint8)]
    n = len(x)
    h, size = x, 1
    while size < GRAM:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
    least = _least(_mix(h), LENGTH - GRAM + 1)
    valid = np.ones(n - LENGTH + 1, bool)
    for e in (begin + sizes)[:-1]:
        valid[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(valid)
    value = least[at]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)))
    # windows of neighbouring texts are never adjacent: the last 49 places of each text are invalid
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, value = at[first], value[first]
    # polynomial hash of the run's bytes: prefix sums of weighted values, brought to a common power by the inverse
    weight = np.full(n, _M, np.uint64)
    weight[0] = 1
    weight = np.cumprod(weight)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * weight)))
    inverse = np.full(n, np.uint64(pow(int(_M), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    whole = _mix((total[start + count + LENGTH - 1] - total[start]) * inverse[start] + count.astype(np.uint64))
    owner = np.searchsorted(begin, start, side="right") - 1
    return np.array(use)[owner], start - begin[owner], count, value, whole


def _pieces(texts: list[bytes]):
    """(indices, offsets, parts): groups of about CHUNK bytes; longer texts go in parts that share 49 bytes."""
    group, held = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            part = t[a : a + CHUNK + LENGTH - 1]
            if held and held + len(part) > CHUNK:
                yield group
                group, held = [], 0
            group.append((i, a, part))
            held += len(part)
    if group:
        yield group


def _planes(column: np.ndarray) -> bytes:
    """Bytes of a column by their place in a number: the high ones are mostly zero and compress to nothing on the wire."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, column.dtype.itemsize).T.tobytes()


def _from_planes(blob: bytes, kind: np.dtype, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _deal(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, docs, runs, spans): runs of each batch by shard. Of equal runs of a batch only those of the least doc_id
    go on to be compared; the others are repeats already and go as bare spans."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("key", "doc_id"))
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for group in _pieces(raw(batch.column("text"))):
            owner, start, n, value, whole = runs([p for _, _, p in group])
            index, offset = (np.array([g[k] for g in group], np.int64) for k in (0, 1))
            for col, v in zip(found, (index[owner], start + offset[owner], n, value, whole), strict=True):
                col.append(v)
        doc, start, n, value, whole = (np.concatenate(c) for c in found)
        order = np.lexsort((ids[doc], n, whole, value))
        doc, start, n, value, whole = (v[order] for v in (doc, start, n, value, whole))
        lead = np.ones(len(doc), bool)
        lead[1:] = (value[1:] != value[:-1]) | (whole[1:] != whole[:-1]) | (n[1:] != n[:-1])
        least = ids[doc][lead][np.cumsum(lead) - 1] if len(doc) else np.zeros(0, np.int64)
        again = ids[doc] > least
        shard = ((value >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)
        rows = ([], [], [], [])
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[s], cuts[s + 1])
            go, bare = ~again[part], again[part]
            used, local = np.unique(doc[part], return_inverse=True)
            out = np.zeros(int(go.sum()), RUN)
            # 48 bits of the hash besides the shard, all 64 of the whole run's
            out["high"], out["low"] = (value[part][go] >> np.uint64(16)) & np.uint64(0xFFFFFFFF), value[part][go] & np.uint64(0xFFFF)
            out["whole"], out["doc"] = whole[part][go], local[go]
            out["start"], out["n"] = start[part][go], n[part][go]
            more = np.zeros(int(bare.sum()), SPAN)
            more["key"], more["start"], more["n"] = keys[doc[part][bare]], start[part][bare], n[part][bare]
            for col, v in zip(rows, (int(s), np.stack((keys[used], ids[used])).tobytes(), b"".join(_planes(out[c]) for c in RUN.names), more.tobytes()), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["shard", "docs", "runs", "spans"])

    return map_batches(docs, f, "shard long, docs binary, runs binary, spans binary")


def _by_bucket(records: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    bucket = records["key"] % buckets
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    return [int(b) for b in full], [records[cuts[b] : cuts[b + 1]].tobytes() for b in full]


def _compare(dealt: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, blob): kind 0 are spans of windows that repeat, kind 1 asks for the bytes of runs that differ from
    others of their hash, once for each distinct run of the least doc_id, kind 2 says where a text repeats such a run."""

    def f(key, group):
        cols = {c: [] for c in ("value", "whole", "key", "doc_id", "start", "n")}
        spans = [np.frombuffer(b, SPAN) for b in group.column("spans").to_pylist()]
        for docs, blob in zip(group.column("docs").to_pylist(), group.column("runs").to_pylist(), strict=True):
            keys, ids = np.frombuffer(docs, np.int64).reshape(2, -1)
            m, pos, r = len(blob) // RUN.itemsize, 0, {}
            for c in RUN.names:
                r[c] = _from_planes(blob, RUN[c], m, pos)
                pos += m * RUN[c].itemsize
            cols["value"].append((r["high"].astype(np.uint64) << np.uint64(16)) | r["low"])
            cols["whole"].append(r["whole"])
            cols["key"].append(keys[r["doc"]])
            cols["doc_id"].append(ids[r["doc"]])
            cols["start"].append(r["start"])
            cols["n"].append(r["n"])
        r = {c: np.concatenate(cols.pop(c)) for c in list(cols)}
        order = np.lexsort((r["start"], r["key"], r["doc_id"], r["n"], r["whole"], r["value"]))
        r = {c: v[order] for c, v in r.items()}
        top = np.ones(len(order), bool)
        top[1:] = r["value"][1:] != r["value"][:-1]
        lead = top.copy()
        lead[1:] |= (r["whole"][1:] != r["whole"][:-1]) | (r["n"][1:] != r["n"][:-1])
        at = np.flatnonzero(lead)
        least = r["doc_id"][at][np.cumsum(lead) - 1]
        again = r["doc_id"] > least
        out = np.zeros(int(again.sum()), SPAN)
        for c in SPAN.names:
            out[c] = r[c][again]
        # distinct runs of a hash, where there are several, and not all of one document
        which = np.cumsum(top) - 1
        several = np.bincount(which[at])[which] > 1
        lo, hi = np.minimum.reduceat(r["doc_id"], np.flatnonzero(top)), np.maximum.reduceat(r["doc_id"], np.flatnonzero(top))
        open_ = ~again & several & (lo < hi)[which]
        own = lead.copy()
        own[1:] |= r["key"][1:] != r["key"][:-1]
        asks = np.zeros(int((open_ & own).sum()), ASK)
        for c in ("key", "doc_id", "value", "start", "n"):
            asks[c] = r[c][open_ & own]
        asks["shard"] = key[0].as_py()
        aliases = np.zeros(int((open_ & ~own).sum()), ALIAS)
        for c in ("key", "start", "n"):
            aliases[c] = r[c][open_ & ~own]
        aliases["first"] = r["start"][np.flatnonzero(own)][np.cumsum(own) - 1][open_ & ~own]
        b0, v0 = _by_bucket(np.concatenate([*spans, out]), buckets)
        b1, v1 = _by_bucket(asks, buckets)
        b2, v2 = _by_bucket(aliases, buckets)
        return pa.table({"bucket": pa.array(b0 + b1 + b2, pa.int64()), "kind": pa.array([0] * len(b0) + [1] * len(b1) + [2] * len(b2), pa.int32()), "blob": pa.array(v0 + v1 + v2, pa.binary())})

    return dealt.groupBy("shard").applyInArrow(f, "bucket long, kind int, blob binary")


def _fetch(texts: DataFrame, asks: DataFrame) -> DataFrame:
    """(shard, asks, bytes): the bytes of the runs asked for, dealt by shard."""

    def f(key, left, right):
        asks = [np.frombuffer(b, ASK) for b in right.column("blob").to_pylist()]
        rows = ([], [], [])
        if asks and left.num_rows:
            asks = np.concatenate(asks)
            wanted = np.isin(left.column("key").to_numpy(), asks["key"])
            text = dict(zip(left.column("key").to_numpy()[wanted].tolist(), _texts(left.column("z").filter(pa.array(wanted))), strict=True))
            asks = asks[np.argsort(asks["shard"], kind="stable")]
            full, begin = np.unique(asks["shard"], return_index=True)
            for s, part in zip(full, np.split(asks, begin[1:]), strict=True):
                got = b"".join(text[k][a : a + n + LENGTH - 1] for k, a, n in zip(part["key"].tolist(), part["start"].tolist(), part["n"].tolist(), strict=True))
                for col, v in zip(rows, (int(s), part.tobytes(), got), strict=True):
                    col.append(v)
        return pa.table({"shard": pa.array(rows[0], pa.int64()), "asks": pa.array(rows[1], pa.binary()), "bytes": pa.array(rows[2], pa.large_binary()).cast(pa.binary())})

    return texts.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(f, "shard long, asks binary, bytes binary")


def _windows(strings: list[bytes]) -> np.ndarray:
    """Hashes of all windows of the strings, one string after the other."""
    x = _TABLE[np.frombuffer(b"".join(strings), np.uint8)]
    h, size = x, 1
    for bit in bin(LENGTH)[3:]:
        h, size = h[:-size] * _power(size) + h[size:], 2 * size
        if bit == "1":
            h, size = h[:-1] * _M + x[size:], size + 1
    inside = np.ones(len(h), bool)
    for e in np.cumsum([len(s) for s in strings])[:-1]:
        inside[e - LENGTH + 1 : e] = False
    return _mix(h[inside])


def _shared(asks: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The stretches of the strings that hold windows which may stand in a string of another doc_id, as asks and strings of their own.

    Windows are told apart by a 64-bit hash. Equal windows have one hash, so none that repeats is left out; the sort
    decides on bytes. It sees what is shared, however many distinct surroundings one passage has.
    """
    count = np.array([len(s) for s in strings], np.int64) - LENGTH + 1
    first = np.cumsum(count) - count
    total = int(count.sum())
    h, held = np.empty(total, np.uint64), 0
    for part in np.split(np.arange(len(strings)), np.searchsorted(first, np.arange(SORT_BYTES, total, SORT_BYTES))):
        if len(part):
            got = _windows([strings[i] for i in part])
            h[held : held + len(got)] = got
            held += len(got)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), count)
    keep = np.zeros(total, bool)
    # a share of the hashes at a time, so that large groups need little more than 13 bytes a window
    shares = np.uint64(-(-total // (4 * SORT_BYTES)))
    for k in range(int(shares)):
        use = np.flatnonzero(h % shares == k) if shares > 1 else np.arange(total)
        if len(use):
            use = use[np.argsort(h[use])]
            new = np.flatnonzero(np.concatenate(([True], h[use[1:]] != h[use[:-1]])))
            ids = asks["doc_id"][owner[use]]
            several = np.minimum.reduceat(ids, new) < np.maximum.reduceat(ids, new)
            keep[use] = np.repeat(several, np.diff(np.append(new, len(use))))
    del h
    kept = np.flatnonzero(keep)
    if not len(kept):
        return asks[:0], []
    edge = np.flatnonzero(np.concatenate(([True], (np.diff(kept) != 1) | (owner[kept][1:] != owner[kept][:-1]))))
    start, n = kept[edge], np.diff(np.append(edge, len(kept)))
    out = asks[owner[start]].copy()
    offset = start - first[owner[start]]
    out["start"] = asks["start"][owner[start]] + offset
    out["n"] = n
    return out, [strings[o][a : a + m + LENGTH - 1] for o, a, m in zip(owner[start].tolist(), offset.tolist(), n.tolist(), strict=True)]


def _gone(asks: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Spans of the strings' windows that one of a smaller doc_id holds too."""
    asks, strings = _shared(asks, strings)
    if not strings:
        return np.zeros(0, SPAN)
    string, start, which = induced.repeats(strings, LENGTH)
    if not len(string):
        return np.zeros(0, SPAN)
    ids = asks["doc_id"][string]
    _, which = np.unique(which, return_inverse=True)
    least = np.full(which.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    gone = ids > least[which]
    string, start = string[gone], start[gone]
    order = np.lexsort((start, string))
    string, start = string[order], start[order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), SPAN)
    out["key"], out["start"] = asks["key"][string[first]], asks["start"][string[first]] + start[first]
    out["n"] = np.diff(np.append(first, len(string)))
    return out


def _sort(fetched: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): windows that a smaller doc_id of the shard holds too, by the shard's suffix array."""

    def f(key, group):
        asks = np.concatenate([np.frombuffer(b, ASK) for b in group.column("asks").to_pylist()])
        size = asks["n"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        joined = b"".join(group.column("bytes").to_pylist())
        order = np.argsort(asks["value"], kind="stable")
        value, reach = asks["value"][order], np.cumsum(size[order])
        parts, done = [], 0
        while done < len(order):
            # as many hashes as fit, one at least
            top = np.searchsorted(reach, (reach[done - 1] if done else 0) + SORT_BYTES, side="right")
            stop = np.searchsorted(value, value[min(top, len(order) - 1)]) if top < len(order) else len(order)
            if stop <= done:
                stop = np.searchsorted(value, value[done], side="right")
            use = order[done:stop]
            parts.append(_gone(asks[use], [joined[a:b] for a, b in zip(begin[use].tolist(), (begin[use] + size[use]).tolist(), strict=True)]))
            done = stop
        out = np.concatenate([np.zeros(0, SPAN), *parts])
        b, v = _by_bucket(out, buckets)
        return pa.table({"bucket": pa.array(b, pa.int64()), "blob": pa.array(v, pa.binary())})

    return fetched.groupBy("shard").applyInArrow(f, "bucket long, blob binary")


def _repeated(spans: np.ndarray, aliases: np.ndarray) -> np.ndarray:
    """spans, and those within a run once more wherever its text repeats the run."""
    if not len(aliases) or not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["key"]))]
    # one sorted line of places: texts are numbered, each with room for its largest offset
    keys, number = np.unique(np.concatenate((spans["key"], aliases["key"])), return_inverse=True)
    room = np.int64(1) << 33
    at = number[: len(spans)] * room + spans["start"]
    begin = number[len(spans) :] * room + aliases["first"]
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, begin + aliases["n"])
    which = np.repeat(np.arange(len(aliases)), hi - lo)
    took = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    more = spans[took].copy()
    more["start"] = spans["start"][took].astype(np.int64) - aliases["first"][which] + aliases["start"][which]
    return np.concatenate((spans, more))


def _result(texts: DataFrame, spans: DataFrame) -> DataFrame:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def f(key, left, right):
        blobs = list(zip(right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True))
        spans = np.concatenate([np.zeros(0, SPAN), *(np.frombuffer(b, SPAN) for k, b in blobs if k == 0)])
        spans = _repeated(spans, np.concatenate([np.zeros(0, ALIAS), *(np.frombuffer(b, ALIAS) for k, b in blobs if k == 2)]))
        spans = spans[np.lexsort((spans["start"], spans["key"]))]
        keys, begin = np.unique(spans["key"], return_index=True)
        found = dict(zip(keys.tolist(), np.split(spans, begin[1:]) if len(keys) else [], strict=True))
        cols: list[list] = [[] for _ in names]
        for k, i, t in zip(left.column("key").to_pylist(), left.column("doc_id").to_pylist(), _texts(left.column("z")), strict=True):
            kept, removed, count = t, 0, 0
            if (s := found.get(k)) is not None:
                a, e = s["start"].astype(np.int64), s["start"].astype(np.int64) + s["n"] + LENGTH - 1
                reach = np.maximum.accumulate(e)
                first = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
                lo, hi = a[first], reach[np.append(first[1:], len(a)) - 1]
                kept = b"".join(t[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(t)], strict=True))
                removed, count = int((hi - lo).sum()), len(lo)
            for col, v in zip(cols, (i, len(t), removed, count, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                col.append(v)
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, cols, kinds, strict=True)})

    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(f, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), kept as bytes.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller doc_id; strings are judged on the
    input. Null texts count as empty; rows of one doc_id never remove from each other; a null doc_id counts
    as larger than all. Equal rows give equal results.
    """
    base = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    keyed = base.select(key.alias("key"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "text")
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(4, -(-total // SHARD_BYTES))
    compared = cut(_compare(_deal(keyed, parts), parts))
    release(docs.sparkSession)
    texts = _squeezed(base.select(key.alias("key"), "doc_id", "text"), parts)
    asks = compared.filter("kind = 1").select("bucket", "blob")
    sorted_ = cut(_sort(_fetch(texts.drop("doc_id"), asks), parts))
    release(docs.sparkSession)
    return _result(texts, compared.filter("kind != 1").unionByName(sorted_.withColumn("kind", F.lit(0))))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
