"""Secret scan: known shapes, and windows of high entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm.common import documents, map_batches, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least entropy, in bits a character, of a window of so many characters, for each character class.
WINDOW = 20
LEAST = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))
#: Candidates that are no secrets: identifiers, numbers, words, file paths, alphabets.
ALLOW = tuple(re.compile(x) for x in (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[0-9_+/=-]+", r"[A-Za-z]?[a-z]+", r"[A-Z]+", r"[/_=-]*+(?:[A-Za-z][a-z]*+[/_=-]++)*+(?:[A-Za-z][a-z]*+)?"))
_IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9]){ALLOW[0].pattern}(?![A-Za-z0-9])")
#: Places of digits and letters in alphabet order, which goes round; 255: other characters.
_ORDER = bytes(int(chr(c), 36) if c < 128 and chr(c).isalnum() else 255 for c in range(256))
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropy_runs(s: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans covered by windows of at least that Shannon entropy; counts are moved along, never rebuilt."""
    if len(s) < window:
        return []
    # entropy = log2(w) - sum(c log2 c) / w, so a bound on the sum will do
    most = (math.log2(window) - least) * window + 1e-9
    counts: dict[str, int] = {}
    total, runs = 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOG[c + 1] - _CLOG[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += _CLOG[c - 1] - _CLOG[c]
        if i >= window - 1 and total <= most:
            a = i - window + 1
            if runs and a <= runs[-1][1]:
                runs[-1][1] = i + 1
            else:
                runs.append([a, i + 1])
    return [(a, b) for a, b in runs]


def allowed(s: str) -> bool:
    return any(p.fullmatch(s) for p in ALLOW)


def pieces(s: str) -> list[tuple[int, int]]:
    """Parts of a candidate besides identifiers and stretches of alphabet order in it."""
    skip = [m.span() for m in _IDENTIFIER.finditer(s)]
    code = np.frombuffer(s.encode().translate(_ORDER), np.uint8).astype(np.int16)
    step = (code[:-1] < 36) & (code[1:] < 36) & ((code[1:] - code[:-1]) % 36 == 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], step.astype(np.int8), [0]))))
    skip += [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a + 1 >= 12]
    out, pos = [], 0
    for a, b in sorted(skip):
        out.append((pos, a))
        pos = max(pos, b)
    return [(a, b) for a, b in [*out, (pos, len(s))] if b - a >= WINDOW]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of each kind that meet its length."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        # a run that is too short has no longer run within it, so the length can stand in the pattern
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Each window is held against the bound of the narrowest class that its characters are of."""
    out = []
    for m in CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        for a, b in pieces(m[0]):
            found = []
            for kind, p in _CLASSES:
                for run in p.finditer(m[0], a, b):
                    if len(run[0]) >= WINDOW and not allowed(run[0]):
                        found += [(run.start() + x, run.start() + y) for x, y in entropy_runs(run[0], LEAST[kind])]
            end = -1
            for x, y in sorted(found):
                if x > end:
                    out.append((m.start() + x, m.start() + y, "entropy"))
                elif y > end:
                    out[-1] = (out[-1][0], m.start() + y, "entropy")
                end = max(end, y)
    return out


def joined(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[2]))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value): one row per span, in code points.

    Whole texts; null and empty texts and texts without secrets give no rows; repeated rows each give theirs.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, k, a, b, t[a:b]) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for a, b, k in sorted(base_spans(t) + entropy_spans(t))]
        return pa.RecordBatch.from_pylist([dict(zip(("doc_id", "kind", "start", "end", "value"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    return map_batches(documents(docs).withColumn("doc_id", F.col("doc_id").cast("long")), f, "doc_id long, kind string, start long, end long, value string")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, SHA-256 of the base spans, all spans.

    Null texts count as empty: no spans, the hash of the empty string. Repeated rows each give a row.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names[1:]]
        for t in batch.column("text").to_pylist():
            base = base_spans(t)
            for c, k in zip(cols, KINDS[:3], strict=False):
                c.append(sum(x[2] == k for x in base))
            cols[3].append(hashlib.sha256(joined(base, KINDS).encode()).hexdigest())
            cols[4].append(joined(base + entropy_spans(t), KINDS))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names)

    return map_batches(documents(docs), f, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
