"""License scan: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm.common import documents, map_batches, raw, table

PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
#: Notices by which texts name or carry a license.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Blocks are windows over the words of the whole text that overlap by half, and those of each line.
BLOCK_WORDS = 64
#: Bytes that part words: all ASCII but digits and small letters. 0x0A is kept apart, as lines end there.
_SPLIT = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters and anything that isn't ASCII."""
    return text.lower().translate(_SPLIT).split()


class Index:
    """Templates by the rarest words of each: prefix, length and positional filters of the join."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.labels = [label for label, _ in templates]
        vocabulary = {w for _, t in templates for w in t.encode().split()}
        # rarest first over all documents, ties by the word itself
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets = [sorted({self.rank[w] for w in t.encode().split()}) for _, t in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for at, r in enumerate(s[: len(s) - need + 1]):
                self.prefix.setdefault(r, []).append((k, at))
        self.seeds = {w for w, r in self.rank.items() if r in self.prefix}

    def match(self, block: list[bytes]) -> dict[int, float]:
        """Containment of each template that the block holds to the threshold."""
        ranks = sorted({self.rank[w] for w in block if w in self.rank})
        out: dict[int, float] = {}
        tried: set[int] = set()
        for j, r in enumerate(ranks):
            for k, at in self.prefix.get(r, ()):
                if k in tried or len(ranks) < self.need[k]:
                    continue
                # the first word in common stands here, so at most the rest of both can follow
                tried.add(k)
                if 1 + min(len(self.sets[k]) - at - 1, len(ranks) - j - 1) < self.need[k]:
                    continue
                both = len(set(self.sets[k]).intersection(ranks))
                if both >= self.need[k]:
                    out[k] = both / len(self.sets[k])
        return out

    def blocks(self, text: bytes):
        # the whole text comes first, as templates may be wrapped over lines
        for part in (text, *(text.split(b"\n") if b"\n" in text else ())):
            w = words(part)
            if not self.seeds.isdisjoint(w):
                for a in range(0, max(1, len(w) - BLOCK_WORDS // 2), BLOCK_WORDS // 2):
                    yield w[a : a + BLOCK_WORDS]

    def labelled(self, text: bytes) -> tuple[set[str], float]:
        labels, score = set(), 0.0
        for block in self.blocks(text):
            for k, c in self.match(block).items():
                labels.add(self.labels[k])
                score = max(score, c)
        return labels, score


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each word of the templates; counts are summed in the tasks first, so few rows move."""
    vocabulary = {w for _, t in templates for w in t.encode().split()}

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = dict.fromkeys(vocabulary, 0)
        for text in raw(batch.column("text")):
            for w in vocabulary.intersection(words(text)):
                n[w] += 1
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n]), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    got = map_batches(documents(docs).select("text"), f, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in got.collect()}


def base(w: list[bytes]) -> list[tuple[int, str]]:
    """(start, label): places where a phrase's words stand consecutively, words from 0."""
    out = []
    pos = -1
    while True:
        try:
            pos = w.index(b"license", pos + 1)
        except ValueError:
            return sorted(out)
        for phrase, label in PHRASES:
            a = pos - len(phrase) + 1
            if a >= 0 and [x.decode() for x in w[a : pos + 1]] == list(phrase):
                out.append((a, label))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    labels are those of the phrases and of every template that a block of the text holds to the threshold; score is the
    highest containment found, 1 where a phrase stands, else 0. Null texts count as empty: no words, no labels,
    score 0. Repeated rows each give a row.
    """
    index = Index(templates, frequencies(docs, templates), threshold)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
            text = text.lower()
            w = words(text)
            places = base(w)
            own = {x for _, x in places}
            more, score = index.labelled(text)
            rows.append((doc, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if places else score))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(),) * 5 + (pa.string(),) * 2 + (pa.float64(),)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_batches(documents(docs), f, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
