"""Toxicity: non-negative positive-unlabelled learning of a linear classifier, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm.common import documents, map_batches, raw, table

#: The classifier is fitted on so many confirmed and unlabelled documents at most, those of the least id hash.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12_000
#: A feature is held by so many sampled documents at least, and its rates in the two samples lie so many standard errors apart.
LEAST_DOCS, LEAST_Z = 4, 4.0
STEPS, RATE, DECAY, SEED = 300, 0.05, 1e-4, 11
REJECT = 0.3
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&@-_"


def word_hashes(text: bytes) -> np.ndarray:
    """Distinct lower-cased (A-Z) words without punctuation at their ends, and their first 4 and 5 bytes, hashed to 32 bits."""
    h = xxhash.xxh32_intdigest
    words = {w.strip(_EDGES) for w in set(text.lower().split())}
    out = {h(x) for x in words if x}
    for k in (4, 5):
        out.update(h(x, k) for x in {w[:k] for w in words if len(w) > k})
    return np.array(sorted(out), np.uint32)


@dataclass(frozen=True)
class Model:
    """Features (sorted word hashes), their weights, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        h = word_hashes(text)
        total = self.bias
        if len(self.features) and len(h):
            at = np.searchsorted(self.features, h)
            at[at == len(self.features)] = 0
            total += float(self.weights[at[self.features[at] == h]].sum())
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimise the non-negative risk  prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)])  with logistic loss l.

    Where a batch's bracket is negative, the step goes up its gradient instead, as it shows overfitting. Weights have an
    L1 pull, so that words that tell nothing stay at zero and long texts don't add up noise.
    No positive documents or none unlabelled: a model without features that always returns the prior.
    """
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.empty(0, np.uint32), np.empty(0), bias)
    every, n = np.unique(np.concatenate(positive + unlabelled), return_counts=True)
    own, c = np.unique(np.concatenate(positive), return_counts=True)
    in_p = np.zeros(len(every))
    in_p[np.searchsorted(every, own)] = c
    p, q, mean = in_p / len(positive), (n - in_p) / len(unlabelled), n / (len(positive) + len(unlabelled))
    z = np.abs(p - q) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
    words = every[(n >= LEAST_DOCS) & (z >= LEAST_Z)]
    k = len(words)
    if not k:
        return Model(np.empty(0, np.uint32), np.empty(0), bias)

    def csr(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [], []
        for i, h in enumerate(docs):
            at = np.searchsorted(words, h)
            ok = at < k
            at = at[ok][words[at[ok]] == h[ok]]
            rows.append(np.full(len(at), i))
            cols.append(at)
        return np.concatenate(rows), np.concatenate(cols)

    (pr, pc), (ur, uc) = csr(positive), csr(unlabelled)
    w, np_, nu = np.zeros(k), len(positive), len(unlabelled)
    pull = DECAY + 2 * prior / np_
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, STEPS + 1):
        gp = np.bincount(pr, w[pc], np_) + bias
        gu = np.bincount(ur, w[uc], nu) + bias
        sp, su = sig(gp), sig(gu)
        negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
        dp, du = -prior * (1 - sp) / np_, su / nu
        dn = -prior * sp / np_
        if negative >= 0:
            a, b = dp + dn, du
        else:
            a, b = -dn, -du
        g = np.bincount(pc, a[pr], k) + np.bincount(uc, b[ur], k)
        gb = a.sum() + b.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        move = RATE / (np.sqrt(v / c2) + 1e-8)
        w = w - move * (m / c1)
        w = np.sign(w) * np.maximum(0, np.abs(w) - move * pull)
        bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    used = w != 0
    return Model(words[used], w[used], float(bias))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels that aren't held out; what it gathers is bounded by MAX_POSITIVE and MAX_UNLABELLED documents.

    The class prior is the share of toxic rows among all labelled rows that aren't held out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    confirmed = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(MAX_POSITIVE).withColumn("p", F.lit(1))
    others = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out()).orderBy(order, "doc_id").limit(MAX_UNLABELLED).withColumn("p", F.lit(0))
    chosen = F.broadcast(confirmed.unionByName(others).groupBy("doc_id").agg(F.collect_set("p").alias("roles")))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = [word_hashes(t).tobytes() for t in raw(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("roles"), pa.array(h, pa.binary())], ["roles", "h"])

    found = map_batches(documents(docs).join(chosen, "doc_id").select("roles", "text"), f, "roles array<int>, h binary").collect()
    sets = {k: sorted((bytes(r["h"]) for r in found if k in r["roles"])) for k in (0, 1)}
    arrays = {k: [np.frombuffer(b, np.uint32) for b in v] for k, v in sets.items()}
    return fit(arrays[1][: 2 * MAX_POSITIVE], arrays[0], toxic / n if n else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: (doc_id, score), from the whole text alone. Null and empty texts get the bias; repeated rows each give a row."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([model.score(t) for t in raw(batch.column("text"))], pa.float64())], ["doc_id", "score"])

    return map_batches(documents(docs), f, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, least: float = REJECT) -> DataFrame:
    """docs without those that score at least so much; all columns stay."""
    schema = docs.schema

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [model.score(t or b"") < least for t in raw(batch.column("text"))]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, f, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
