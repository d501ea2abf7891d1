"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm.common import documents, map_batches, raw, table
from varilume.llm.licenses import words

#: Tokens of the shortest tile, and the share of a test item that tiles must cover.
LEAST_TILE, THRESHOLD = 5, 0.8
#: Test items are taken in blocks of so many bytes at most, each in one pass over the documents.
BLOCK_BYTES = 16_000_000
#: Pairs of a seed's place in a text and in an item that are looked at together.
SEEDS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each window of n ids."""
    count = len(ids) - n + 1
    out = np.zeros(max(0, count), np.uint64)
    for j in range(n):
        out = out * _BASE + ids[j : j + count]
    return out


class Items:
    """Test items by the hashes of their token windows."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = LEAST_TILE):
        self.least = least
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.tokens = [], []
        seeds, owner, place = [], [], []
        for item, text in items:
            t = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.uint64)
            if not len(t):
                continue
            k = len(self.tokens)
            self.ids.append(item)
            self.tokens.append(t)
            h = _rolling(t, min(least, len(t)))
            if len(t) >= least:
                seeds.append(h)
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        h = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if seeds else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if seeds else np.zeros(0, np.int64)

    def coverage(self, text: bytes) -> dict[int, float]:
        """Share of each test item's tokens that tiles in the text cover; items without a tile are left out."""
        n = self.least
        if not len(self.hashes):
            return {}
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.uint64)
        if len(ids) < n:
            return {}
        known = np.cumsum(np.concatenate(([0], ids != 0)))
        at = np.nonzero(known[n:] - known[:-n] == n)[0]
        if not len(at):
            return {}
        h = _rolling(ids, n)[at]
        lo = np.searchsorted(self.hashes, h)
        hit = lo < len(self.hashes)
        hit[hit] = self.hashes[lo[hit]] == h[hit]
        at, h, lo = at[hit], h[hit], lo[hit]
        if not len(at):
            return {}
        matches = self._matches(ids, at, lo, np.searchsorted(self.hashes, h, side="right") - lo)
        out: dict[int, float] = {}
        owner = matches["owner"]
        for k in np.unique(owner):
            s = slice(np.searchsorted(owner, k), np.searchsorted(owner, k, side="right"))
            covered = tile(self.sizes[k], len(ids), matches["place"][s], matches["at"][s], matches["length"][s], n)
            if covered:
                # of items of one id the best counts
                out[self.ids[k]] = max(out.get(self.ids[k], 0.0), covered / int(self.sizes[k]))
        return out

    def _matches(self, ids: np.ndarray, at: np.ndarray, lo: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
        """Matches that can't be made longer, by item: where a seed has no equal tokens before it, and how far it goes.

        Seeds are met with their places SEEDS at a time and all but the first of each diagonal run are let go, so a text
        that repeats a token against an item that does so needs room for its edges alone.
        """
        kept: list[tuple] = []
        reach = np.cumsum(times)
        done = 0
        while done < len(at):
            stop = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + SEEDS, side="right")))
            t, m = times[done:stop], at[done:stop]
            which = np.repeat(lo[done:stop], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            m = np.repeat(m, t)
            owner, place = self.owner[which], self.place[which]
            spot = self.begin[owner] + place
            head = (place == 0) | (m == 0)
            head[~head] = self.flat[spot[~head] - 1] != ids[m[~head] - 1]
            kept.append((owner[head], place[head], m[head]))
            done = stop
        owner, place, at = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((at, at - place, owner))
        owner, place, at = owner[order], place[order], at[order]
        length, live = np.zeros(len(at), np.int64), np.arange(len(at))
        spot, room = self.begin[owner] + place, np.minimum(self.sizes[owner] - place, len(ids) - at)
        while len(live):
            live = live[length[live] < room[live]]
            live = live[self.flat[spot[live] + length[live]] == ids[at[live] + length[live]]]
            length[live] += 1
        real = length >= self.least  # Karp-Rabin hashes may collide
        return {"owner": owner[real], "place": place[real], "at": at[real], "length": length[real]}


def tile(size: int, text_size: int, place: np.ndarray, at: np.ndarray, length: np.ndarray, least: int) -> int:
    """Tokens of an item under greedy tiles: again and again the longest match of unmarked tokens on both sides.

    place, at, length: matches in the item and the text, sorted by diagonal and then by at; of equal lengths the first in the
    item, then in the text, goes first.
    """
    heap = [(-n, p, t) for n, p, t in zip(length.tolist(), place.tolist(), at.tolist(), strict=True)]
    heapq.heapify(heap)
    in_item, in_text = np.zeros(size, bool), np.zeros(text_size, bool)
    free = size
    while heap and free >= least:
        n, p, t = heapq.heappop(heap)
        n = -n
        taken = in_item[p : p + n] | in_text[t : t + n]
        if not taken.any():
            in_item[p : p + n] = True
            in_text[t : t + n] = True
            free -= n
            continue
        # what is left of it unmarked goes back to wait its turn
        edges = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(np.int8), [1]))))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), p + int(a), t + int(a)))
    return size - free


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, bytes]]]:
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).collect()
        yield sorted((r["item_id"], r["text"].encode()) for r in rows)


def overlaps(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, n_items, coverage, items).

    coverage: the highest of any test item; items: ids of those at the threshold or above, ascending. Null and empty texts
    have coverage 0; test items with a null id or text, or under 5 tokens, never match; repeated rows each give a row.
    """
    # each block adds to what the ones before found, row by row
    out = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0.0).alias("coverage"), F.expr("cast(array() as array<bigint>)").alias("items"))
    for block in _blocks(benchmark):
        found = Items(block)

        def f(batch: pa.RecordBatch, found: Items = found) -> pa.RecordBatch:
            got = [found.coverage(t) for t in raw(batch.column("text"))]
            hits = [sorted({*had, *(k for k, v in g.items() if v >= threshold)}) for had, g in zip(batch.column("items").to_pylist(), got, strict=True)]
            best = [max(had, *g.values()) if g else had for had, g in zip(batch.column("coverage").to_pylist(), got, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(best, pa.float64()), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "coverage", "items"])

        out = map_batches(out, f, "doc_id long, text string, coverage double, items array<long>")
    return out.select("doc_id", F.size("items").cast("long").alias("n_items"), "coverage", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold a test item to the threshold; all columns stay."""
    schema = docs.schema
    for block in _blocks(benchmark):
        found = Items(block)

        def f(batch: pa.RecordBatch, found: Items = found) -> pa.RecordBatch:
            keep = [max(found.coverage(t or b"").values(), default=0.0) < threshold for t in raw(batch.column("text"))]
            return batch.filter(pa.array(keep, pa.bool_()))

        docs = map_batches(docs, f, schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each document's best test item and the items found, in one row per document."""
    got = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_items", "coverage", "items")
