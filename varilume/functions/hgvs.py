"""HGVS descriptions of edits on transcripts (c., n.) and on their proteins (p.)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from varilume.functions.vocab import GENETIC_CODES, RESIDUES

COLUMNS = ("transcript_hgvs", "protein_hgvs", "hgvs_shift", "transcript_hgvs_status", "transcript_hgvs_reason", "protein_hgvs_status", "protein_hgvs_reason")
#: Bases on either side of an edit within which it is moved to the 3' end of a repeat.
REACH = 1000
_SWAP = str.maketrans("ACGTUNRYKMBDHVSW", "TGCAANYRMKVHDBSW")
_CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
_TABLES = {k: dict(zip(_CODONS, v, strict=True)) for k, v in GENETIC_CODES.items()}


def shifted(window: str, at: int, low: int, high: int, ref: str, alt: str, forward: bool) -> int:
    """How far an insertion or deletion moves in transcript direction without changing the sequence.

    window: reference from place at; low, high: the deleted span, or the two bases beside the insertion.
    """
    pattern = alt or ref
    k, i = len(pattern), 0
    if forward:
        start, limit = (high if alt else high + 1) - at, REACH - k + 1
        while i < limit and 0 <= start + i < len(window) and window[start + i] == pattern[i % k]:
            i += 1
    else:
        start, limit = (low if alt else low - 1) - at, REACH - k + 1
        while i < limit and 0 <= start - i < len(window) and window[start - i] == pattern[k - 1 - i % k]:
            i += 1
    return i


def place(anchor: int, offset: int, coding: bool, start: int, end: int) -> str | None:
    """Text of a coordinate: anchor is a place in the spliced transcript, offset the distance from it into an intron."""
    if anchor < 1:
        return None
    if not coding:
        text = str(anchor)
    elif anchor > end:
        text = f"*{anchor - end}"
    elif anchor == end and offset:
        return f"*{offset}"
    else:
        text = str(anchor - start + 1 if anchor >= start else anchor - start)
    return f"{text}{offset:+d}" if offset else text


def three(residues: str) -> str:
    return "".join([RESIDUES.get(x, "Xaa") for x in residues])


def protein(ref: str, alt: str, first: int, rp: str, ap: str, frameshift: bool, start_lost: bool, stop_lost: bool) -> str | None:
    """Text of a protein change. ref, alt: whole proteins, alt on past the old stop; first: the window's first residue; rp, ap: the windows."""
    if start_lost:
        return f"p.{three(rp[:1] or ref[:1])}{first}?"
    if rp == ap and not frameshift:
        return f"p.{three(rp[0])}{first}=" if rp else None
    if frameshift:
        i = first - 1
        while i < len(ref) and i < len(alt) and ref[i] == alt[i] and ref[i] != "*":
            i += 1
        if i >= len(alt):
            return f"p.{three(ref[first - 1])}{first}del" if first <= len(ref) and first > len(alt) else f"p.{three(ref[i - 1] * 2)[:3]}{i + 1}{three(ref[i - 1])}fsTer?" if i else None
        a, b = ref[i] if i < len(ref) else "*", alt[i]
        if a == b == "*":
            return f"p.Ter{i + 1}="
        if b == "*":
            return f"p.{three(a)}{i + 1}Ter"
        stop = alt.find("*", i)
        return f"p.{three(a)}{i + 1}{three(b)}fsTer{stop - i + 1 if stop >= 0 and i else '?'}"
    if stop_lost and "*" in rp:
        i = first - 1 + rp.find("*")
        if i < len(alt):
            stop = alt.find("*", i)
            return f"p.Ter{i + 1}{three(alt[i])}extTer{stop - i if stop >= 0 else '?'}"
    a, b, at = rp, ap, first
    while a and b and a[0] == b[0] and a[0] != "*":
        a, b, at = a[1:], b[1:], at + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) == len(b) == 1:
        return f"p.{three(a)}{at}{three(b)}"
    if a and not b:
        i, k = at - 1, len(a)
        while i + k < len(ref) and ref[i] == ref[i + k] != "*":
            i += 1
        return f"p.{three(ref[i])}{i + 1}del" if k == 1 else f"p.{three(ref[i])}{i + 1}_{three(ref[i + k - 1])}{i + k}del"
    if b and not a:
        i, k = at - 1, len(b)
        while i < len(ref) and ref[i] == b[0] != "*":
            b, i = b[1:] + b[0], i + 1
        if i >= k and ref[i - k : i] == b:
            return f"p.{three(b[0])}{i - k + 1}dup" if k == 1 else f"p.{three(b[0])}{i - k + 1}_{three(b[-1])}{i}dup"
        if 0 < i < len(ref):
            return f"p.{three(ref[i - 1])}{i}_{three(ref[i])}{i + 1}ins{three(b)}"
        return None
    if not a:
        return None
    span = f"{three(a[0])}{at}" + (f"_{three(a[-1])}{at + len(a) - 1}" if len(a) > 1 else "")
    return f"p.{span}delins{three(b)}"


def _translated(s: str, table: int) -> str:
    code = _TABLES.get(table, {})
    return "".join([code.get(s[i : i + 3], "X") for i in range(0, len(s) - len(s) % 3, 3)])


def describe_pairs(p, r: dict, d: dict, at: dict) -> dict:
    """COLUMNS of a batch of pairs with small variants.

    With a window of the reference (window, window_start) all edits within the transcript are described, after a move to the
    3' end of a repeat; without one, substitutions in the CDS alone, and others say missing_reference.
    """
    n, none = p.n, [None] * p.n
    dna, prot, dr, pr = list(none), list(none), list(none), list(none)
    shift = np.zeros(n, np.int64)
    windowed = "window" in p.batch.schema.names
    rows = np.flatnonzero(r["within"])
    ref, alt = p.texts("reference_difference", rows), p.texts("alternate_difference", rows)
    low, high = p.ints("edit_start0") + 1, p.ints("edit_end0")
    insertion = high < low
    low, high = np.where(insertion, low - 1, low), np.where(insertion, high + 1, high)
    kinds = np.zeros(n, np.int64)  # 0 nothing to say, 1 sub, 2 del, 3 ins, 4 dup, 5 delins, 6 inv
    snv_only = not windowed
    whole_ref = p.texts("reference", rows) if snv_only else None
    windows, starts = (p.texts("window", rows), p.ints("window_start")[rows].tolist()) if windowed else (none, none)
    lo, hi = low.copy(), high.copy()
    fwd = p.fwd[rows].tolist()
    for j, (i, a, b, f) in enumerate(zip(rows.tolist(), ref, alt, fwd, strict=True)):
        if snv_only:
            if d["delta"][i] and len(a) == len(b) == 1 and len(whole_ref[j]) == 1:
                kinds[i] = 1
            else:
                dr[i] = "missing_reference"
            continue
        w, ws = windows[j], starts[j]
        if w is None:
            dr[i] = "missing_reference"
            continue
        if a and w[lo[i] - ws : hi[i] - ws + 1] != a:
            dr[i] = "reference_mismatch"
            continue
        if len(a) == len(b) == 1:
            kinds[i] = 1
        elif a and b:
            kinds[i] = 6 if len(a) == len(b) and b == a.translate(_SWAP)[::-1] else 5
        else:
            k = shifted(w, ws, int(lo[i]), int(hi[i]), a, b, f)
            shift[i] = k
            k = k if f else -k
            lo[i] += k
            hi[i] += k
            kinds[i] = 2 if a else 3
            if b:
                m = len(b)
                turned = b[abs(k) % m :] + b[: abs(k) % m] if f else b[m - abs(k) % m :] + b[: m - abs(k) % m]
                alt[j] = turned
                up, down = (int(hi[i]), int(hi[i]) + m - 1), (int(lo[i]) - m + 1, int(lo[i]))
                for x, y in (up, down) if f else (down, up):
                    if x >= ws and w[x - ws : y - ws + 1] == turned:
                        kinds[i], lo[i], hi[i] = 4, x, y
                        break
    begin, finish = p.anchors(np.where(p.fwd, lo, hi)), p.anchors(np.where(p.fwd, hi, lo))
    start, end = p.cdna(np.where(p.fwd, p.cs, p.ce)), p.cdna(np.where(p.fwd, p.ce, p.cs))
    outside = (np.minimum(lo, hi) < p.ts) | (np.maximum(lo, hi) > p.te)
    cols = [x[rows].tolist() for x in (kinds, *begin, *finish, p.coding, start, end, outside)]
    for i, a, b, f, kind, c1, o1, c2, o2, cod, st, en, out in zip(rows.tolist(), ref, alt, fwd, *cols, strict=True):
        if not kind:
            continue
        x, y = place(c1, o1, cod, st, en), place(c2, o2, cod, st, en)
        if x is None or y is None or out or (cod and (st < 1 or en < 1)):
            dr[i] = "invalid_projection"
            continue
        if not f:
            a, b = a.translate(_SWAP)[::-1], b.translate(_SWAP)[::-1]
        span = x if x == y else f"{x}_{y}"
        dna[i] = ("c." if cod else "n.") + (f"{x}{a}>{b}" if kind == 1 else f"{span}del" if kind == 2 else f"{span}ins{b}" if kind == 3 else f"{span}dup" if kind == 4 else f"{span}delins{b}" if kind == 5 else f"{span}inv")
    whole = d["_whole"]
    first = at["protein_start"]
    for i in rows.tolist():
        if not d["delta"][i]:
            continue
        if not windowed and not kinds[i]:
            pr[i] = "missing_reference"
            continue
        rp, ap = d["ref_peptide"][i], d["alt_peptide"][i]
        if len(rp) == len(ap) == 1 and not d["frameshift"][i]:
            fs = int(first[i])
            prot[i] = f"p.{three(rp)}{fs}?" if d["start_lost"][i] else f"p.{three(rp)}{fs}=" if rp == ap else f"p.{three(rp)}{fs}{three(ap)}" if rp != "*" else None
            if prot[i] or not windowed:
                continue
        cds, new, table = whole[i]
        prot[i] = protein(_translated(cds, table), _translated(new, table), int(first[i]), rp, ap, bool(d["frameshift"][i]), bool(d["start_lost"][i]), bool(d["stop_lost"][i]))
        if prot[i] is None:
            pr[i] = "unsupported_protein"
    within = r["within"].tolist()
    status = ["ok" if x else "unresolved" if w else "not_applicable" for x, w in zip(dna, within, strict=True)]
    told = ["ok" if x else "unresolved" if y else "not_applicable" for x, y in zip(prot, pr, strict=True)]
    text = lambda c: pa.array(c, pa.string())
    made = np.array([x is not None for x in dna], bool)
    return {
        "transcript_hgvs": text(dna), "protein_hgvs": text(prot), "hgvs_shift": pa.array(shift.astype(np.int32), mask=~made), "transcript_hgvs_status": text(status),
        "transcript_hgvs_reason": text(dr), "protein_hgvs_status": text(told), "protein_hgvs_reason": text(pr),
    }
