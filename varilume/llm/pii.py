"""Personal data: known shapes, and a semi-Markov conditional random field over spans."""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.llm.common import documents, map_batches, table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts where a run of digits does: if it fails there, it fails at every later digit of the run
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)")
# chains of under 14 digits are dropped, and no chain within them is longer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = digits[::-1]
    return (sum(map(int, odd[::2])) + sum(sum(divmod(2 * int(c), 10)) for c in odd[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of each kind that meet its conditions."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end, "email"))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p.lstrip("0")[3:] for p in m[0].split(".")) and all(int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


#: Types of segments; the first is for single tokens outside of any entity.
TYPES = ("other", *KINDS)
#: Tokens that an entity spans at most: bounds the dynamic programme. STEP: tokens whose segments are scored at once.
MOST_TOKENS, STEP = 16, 256
#: What may stand between the chunks of one entity: a blank before a digit or a bracket.
_BRIDGE = re.compile(r" (?=[0-9(])")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_TRIGGER, _BLANK = re.compile(r"[0-9@]"), re.compile(r"\s")
_PHONE_SET, _N_FEATURES = re.compile(r"\+?[0-9 ().-]+"), 20


def zones(text: str):
    """(start, end) of chunks with a digit or @, with the neighbours that a bridge joins to them.

    The field looks for entities within zones alone: a wider gap than a bridge ends one.
    """
    pos = 0
    while m := _TRIGGER.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        if start >= 2 and start - 2 >= pos and text[start - 1] == " " and text[start - 2] in "+(":
            start -= 2
        end = m.end()
        while True:
            b = _BLANK.search(text, end)
            end = b.start() if b else len(text)
            if b and (m2 := _BRIDGE.match(text, end)):
                nxt = _BLANK.search(text, m2.end())
                end = nxt.start() if nxt else len(text)
                continue
            break
        yield start, end
        pos = max(end, m.end())


def features(s: str, left: str, right: str) -> np.ndarray:
    """Of a whole span and the characters beside it; of no single token."""
    d, n_at = _digits(s), s.count("@")
    local, _, domain = s.partition("@")
    parts = s.split(".")
    alone = not (left.isalnum() or left in "@.-_%+") and not (right.isalnum() or right in "@-_%")
    plain = _PHONE_SET.fullmatch(s) is not None
    edges = s[:1].isalnum() and s[-1:].isalnum()
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)
    digits_only = bool(d) and all(c.isdigit() or c in " -" for c in s)
    x = (1.0, n_at == 1 and bool(local) and "." in domain.strip(".") and edges, n_at == 1, n_at == 1 and bool(local) and set(local) <= _LOCAL and all(c.isalnum() or c in ".-" for c in domain), four, four and all(int(p) <= 255 for p in parts), digits_only and edges, digits_only and 14 <= len(d) <= 19, digits_only and 14 <= len(d) <= 19 and luhn(d), digits_only and len(d) == 16, plain and 10 <= len(d) <= 13, plain and 7 <= len(d) <= 9, s[:1] == "+" and plain, s[:1] == "(" and plain, plain and any(c in " ()-" for c in s), alone, not edges and s[:1] not in "+(", any(c.isspace() for c in s), min(len(s), 40) / 20, sum(c.isalpha() for c in s) / max(1, len(s)))
    return np.array(x, float)


def entity_like(s: str) -> bool:
    """An entity starts with a digit, a letter, + or ( and ends with a digit or a letter, and needs six characters."""
    return len(s) >= 6 and s[-1].isalnum() and (s[0].isalnum() or s[0] in "+(") and any(c.isdigit() or c == "@" for c in s)


def decode(text: str, start: int, end: int, w: np.ndarray) -> list[tuple[int, int, str]]:
    """The highest-scoring segmentation of text[start:end], boundaries and types together: what Lattice(..).best gives.

    Segments are scored for STEP tokens at a time, so that a chunk without blanks, however long, needs two numbers a token.
    """
    cuts = [start + m.start() for m in _TOKEN.finditer(text, start, end)] + [end]
    n = len(cuts) - 1
    score, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
    for first in range(1, n + 1, STEP):
        rows, segments = [], []
        for j in range(first, min(n, first + STEP - 1) + 1):
            b = cuts[j]
            for i in range(max(0, j - MOST_TOKENS), j):
                a = cuts[i]
                s = text[a:b]
                entity = entity_like(s)
                if j == i + 1 or entity:
                    segments.append((i, j, entity))
                    rows.append(features(s, text[a - 1 : a], text[b : b + 1]))
        x = np.array(rows) @ w.T
        long_, plain = np.array([j > i + 1 for i, j, _ in segments]), np.array([not e for *_, e in segments])
        x[long_, 0] = -np.inf
        x[plain, 1:] = -np.inf
        last = 0
        for (i, j, _), top, kind in zip(segments, x.max(1).tolist(), x.argmax(1).tolist(), strict=True):
            if j != last:
                score[j], last = -np.inf, j
            if score[i] + top > score[j]:
                score[j], back[j] = score[i] + top, (i, kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind:
            out.append((cuts[i], cuts[j], TYPES[kind]))
        j = i
    return out[::-1]


class Lattice:
    """Candidate segments of a zone and their features; single tokens may be outside of entities."""

    def __init__(self, text: str, start: int = 0, end: int | None = None):
        end = len(text) if end is None else end
        self.cuts = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
        self.n = len(self.cuts) - 1
        self.by_end: list[list[tuple[int, int]]] = [[] for _ in range(self.n + 1)]
        rows, self.segments = [], []
        for i in range(self.n):
            a = self.cuts[i]
            for j in range(i + 1, min(self.n, i + MOST_TOKENS) + 1):
                b = self.cuts[j]
                s = text[a:b]
                entity = entity_like(s)
                if j == i + 1 or entity:
                    self.by_end[j].append((i, len(rows)))
                    self.segments.append((i, j, entity))
                    rows.append(features(s, text[a - 1 : a], text[b : b + 1]))
        self.x = np.array(rows) if rows else np.zeros((0, _N_FEATURES))

    def scores(self, w: np.ndarray) -> np.ndarray:
        s = self.x @ w.T
        for k, (i, j, entity) in enumerate(self.segments):
            if j > i + 1:
                s[k, 0] = -np.inf
            if not entity:
                s[k, 1:] = -np.inf
        return s

    def best(self, w: np.ndarray) -> list[tuple[int, int, str]]:
        """The highest-scoring segmentation: boundaries and types together."""
        s = self.scores(w)
        top, kind = s.max(1), s.argmax(1)
        score, back = [0.0] + [-np.inf] * self.n, [(0, 0)] * (self.n + 1)
        for j in range(1, self.n + 1):
            for i, k in self.by_end[j]:
                if score[i] + top[k] > score[j]:
                    score[j], back[j] = score[i] + top[k], (i, k)
        out, j = [], self.n
        while j:
            i, k = back[j]
            if kind[k]:
                out.append((self.cuts[i], self.cuts[j], TYPES[kind[k]]))
            j = i
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: list[tuple[int, int, str]]) -> np.ndarray:
        """Of the log-likelihood of the gold segmentation: its features minus the expected ones."""
        s = self.scores(w)
        seg = np.logaddexp.reduce(s, axis=1)
        alpha, beta = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        alpha[0] = beta[self.n] = 0
        for j in range(1, self.n + 1):
            for i, k in self.by_end[j]:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + seg[k])
        for j in range(self.n, 0, -1):
            for i, k in self.by_end[j]:
                beta[i] = np.logaddexp(beta[i], beta[j] + seg[k])
        i, j = np.array([x[:2] for x in self.segments]).T
        p = np.exp(s + (alpha[i] + beta[j] - alpha[-1])[:, None])
        at = {(a, b): k for k, (a, b, _) in enumerate(self.segments)}
        pos, truth = 0, np.zeros_like(p)
        where = {c: n for n, c in enumerate(self.cuts)}
        for a, b, kind in sorted(gold):
            for t in range(pos, where[a]):
                truth[at[t, t + 1], 0] = 1
            truth[at[where[a], where[b]], TYPES.index(kind)] = 1
            pos = where[b]
        for t in range(pos, self.n):
            truth[at[t, t + 1], 0] = 1
        return (truth - p).T @ self.x


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up strings with their entities; a half holds none: numbers, versions, dates, hashes, times."""
    r, out = random.Random(seed), []
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwyz") for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = num(r.choice((14, 15, 15, 16, 16, 16, 16, 18, 19)) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.6 or len(d) != 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}"))

    def no() -> str:
        h = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 16, 32, 40))))
        bad = num(16)
        while luhn(bad):
            bad = num(16)
        return r.choice((num(r.randint(1, 7)), f"{r.randint(0, 9)}.{r.randint(0, 20)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", h, bad, num(r.randint(20, 30)), f"{num(3)}.{num(3)}", f"@{word()}", f"{r.randint(256, 999)}.{num(3)}.{r.randint(300, 999)}.{num(3)}", num(10), f"{num(4)} {num(4)}", f"{num(2)}/{num(2)}/{num(4)}"))

    for _ in range(n):
        kind = r.choice((*KINDS, "", "", "", ""))
        s = {"email": lambda: f"{r.choice((word() + '.' + word(), word(), num(2), word() + num(2)))}@{word()}{r.choice(('', num(1)))}.{r.choice(('com', 'org', 'net', 'example.com'))}", "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone, "": no}[kind]()
        pre = r.choice(("", "", "(", '"', "x=", "<", word() + ":"))
        post = r.choice(("", "", ".", ",", ")", "###", '"', "$$$"))
        text = pre + s + post
        out.append((text, [(len(pre), len(pre) + len(s), kind)] if kind else []))
    return out


@functools.cache
def weights(examples: int = 400, epochs: int = 12, seed: int = 7) -> tuple:
    """The field's weights, one row for each type: likelihood ascent over made-up examples (a bounded, fixed number)."""
    rng, w = np.random.default_rng(seed), np.zeros((len(TYPES), _N_FEATURES))
    data = []
    for text, gold in _examples(examples, seed):
        lat = Lattice(text)
        at = {(lat.cuts[a], lat.cuts[b]) for a, b, e in lat.segments if e}
        if all((a, b) in at for a, b, _ in gold):
            data.append((lat, gold))
    g2 = np.full_like(w, 1e-3)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            g = data[k][0].gradient(w, data[k][1]) - 1e-3 * w
            g2 += g * g
            w = w + 0.5 * g / np.sqrt(g2)
    return tuple(map(tuple, w))


def field_spans(text: str, w: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    for a, b in zones(text):
        if b - a >= 6:
            out += decode(text, a, b, w)
    return out


def all_spans(text: str, w: np.ndarray) -> tuple[list, list]:
    """Base spans, and those with the field's; one that both find counts once."""
    base = base_spans(text)
    held = set(base)
    return base, base + [x for x in field_spans(text, w) if x not in held]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span, or overlapping spans as one, in favour of its kind in brackets."""
    out, pos = [], 0
    for a, b, k in sorted(spans):
        if a >= pos:
            out += [text[pos:a], f"[{k.upper()}]"]
        pos = max(pos, b)
    return "".join(out) + text[pos:]


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, SHA-256 of the base spans, all spans in code points.

    Null texts count as empty: no spans, the hash of the empty string. Repeated rows each give a row.
    """
    w = np.array(weights())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in names[1:]]
        for t in batch.column("text").to_pylist():
            base, every = all_spans(t, w)
            for c, k in zip(cols, KINDS, strict=False):
                c.append(sum(x[2] == k for x in base))
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined(every))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    return map_batches(documents(docs), f, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with every span of its text masked; null texts stay null, other columns and their order stay."""
    w, schema = np.array(weights()), docs.schema

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(column)
        texts = [t if t is None else masked(t, all_spans(t, w)[1]) for t in batch.column(i).to_pylist()]
        return batch.set_column(i, column, pa.array(texts, pa.string()))

    return map_batches(docs, f, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
