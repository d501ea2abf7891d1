"""All facts of a pair of event and transcript, a batch of pairs at a time.

Exons stand one after the other in flat arrays, so that each fact is a few array operations over all pairs of a batch; codons
are read for those pairs alone whose edit lies in the coding sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from varilume.functions import hgvs
from varilume.functions.vocab import FLAG, GENETIC_CODES, describe, mask_of, rules_of

#: Gaps between exons of at most this length count as part of the transcript.
SHORT_GAP = 13
#: An edit that ends this early in the CDS, or this close to the end of the last exon but one, escapes decay.
EARLY_CDS, PENULTIMATE = 101, 50
PREDICATES = ("synonymous", "missense", "stop_gained", "stop_lost", "stop_retained", "start_lost", "start_retained", "frameshift", "inframe_deletion", "inframe_insertion", "protein_altering", "partial_codon", "coding_unknown")
REGIONS = ("upstream", "downstream", "within", "complete", "contained", "exon_hit", "cdna", "cds", "coding", "utr5", "utr3", "intron", "short_gap")
SPLICE = ("donor", "acceptor", "fifth", "donor_region", "ppt", "splice_near", "intronic")
PLACES = ("cdna_start", "cdna_end", "cds_start_pos", "cds_end_pos", "protein_start", "protein_end")
TEXTS = ("consequence", "impact", "region", "ref_codons", "alt_codons", "ref_peptide", "alt_peptide", "nmd_prediction", "transcript_hgvs", "protein_hgvs", "transcript_hgvs_status", "transcript_hgvs_reason", "protein_hgvs_status", "protein_hgvs_reason")
#: Types of all that this module makes.
TYPES = dict.fromkeys((*PREDICATES, *REGIONS, *SPLICE, "delta", "ablation", "amplification", "elongation", "truncation"), "boolean") | dict.fromkeys((*PLACES, "consequence_mask", "exon"), "bigint") | dict.fromkeys(TEXTS, "string") | {"impact_code": "int", "exon_count": "int", "nmd_escape": "int", "hgvs_shift": "int"}
#: What a presentation of an edit on its transcript adds: spans of partly mapped edits, ranks, marked codons.
PROJECTED = {
    "output_allele": "string", "interbase": "boolean", "edit_cdna_first": "bigint", "edit_cdna_last": "bigint", "edit_cds_first": "bigint", "edit_cds_last": "bigint", "edit_protein_first": "bigint", "edit_protein_last": "bigint",
    "exon_first": "int", "exon_last": "int", "exon_total": "int", "intron_first": "int", "intron_last": "int", "intron_total": "int", "transcript_distance": "bigint", "cds_start_nf": "boolean", "cds_end_nf": "boolean",
    "reference_amino_acids": "string", "alternate_amino_acids": "string", "reference_codons": "string", "alternate_codons": "string",
}
TYPES |= PROJECTED
BIG = np.int64(1 << 60)
_SWAP = str.maketrans("ACGTUNRYKMBDHVSW", "TGCAANYRMKVHDBSW")
_CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
_TABLES = {k: dict(zip(_CODONS, v, strict=True)) for k, v in GENETIC_CODES.items()}
_EMPTY: dict[str, str] = dict.fromkeys(_CODONS, "")


def revcomp(s: str) -> str:
    return s.translate(_SWAP)[::-1]


def translated(s: str, table: int) -> str:
    """Residues of the whole codons, X where a base is ambiguous."""
    code = _TABLES.get(table, _EMPTY)
    return "".join([code.get(s[i : i + 3], "X") for i in range(0, len(s) - len(s) % 3, 3)])


class Pairs:
    """The arrays of a batch. Null coordinates are put out of reach, and known says where they stand."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.n = batch, batch.num_rows
        self.s, self.e = self.ints("feature_start1"), self.ints("feature_end1")
        self.ts, self.te = self.ints("transcript_start"), self.ints("transcript_end")
        self.fwd, self.flags = self.ints("strand") >= 0, self.ints("transcript_flags")
        self.cs, self.ce = self.ints("cds_start", BIG), self.ints("cds_end", -BIG)
        self.coding = self.cs < BIG
        arr = batch.column("exons")
        self.lens = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = arr.flatten()
        self.es, self.ee, self.ec = (flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("exon_start", "exon_end", "exon_cdna_start"))
        self.owner = np.repeat(np.arange(self.n), self.lens)
        self.first = np.cumsum(self.lens) - self.lens
        j = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        a, b = self.ee[j] + 1, self.es[j + 1] - 1
        keep = b >= a
        self.gap_owner, self.gs, self.ge = self.owner[j][keep], a[keep], b[keep]

    def ints(self, name: str, fill: int = 0) -> np.ndarray:
        if name not in self.batch.schema.names:
            return np.full(self.n, fill, np.int64)
        c = self.batch.column(name)
        if pa.types.is_null(c.type):
            return np.full(self.n, fill, np.int64)
        return c.cast(pa.int64()).fill_null(int(fill)).to_numpy(zero_copy_only=False)

    def texts(self, name: str, at: np.ndarray) -> list:
        return self.batch.column(name).take(pa.array(at)).to_pylist()

    def some(self, hit: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[owner[hit]] = True
        return out

    def flag(self, name: str) -> np.ndarray:
        return (self.flags & FLAG[name]) != 0

    def cdna(self, pos: np.ndarray) -> np.ndarray:
        """Place in the spliced transcript, from 1; -1 outside the exons."""
        p = pos[self.owner]
        at = np.flatnonzero((p >= self.es) & (p <= self.ee))[::-1]  # the first of several stands last and wins
        o, out = self.owner[at], np.full(self.n, -1, np.int64)
        out[o] = self.ec[at] + np.where(self.fwd[o], p[at] - self.es[at], self.ee[at] - p[at])
        return out

    def anchors(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the spliced transcript, or that of the nearer exon's edge with the distance from it; -1 beyond both ends."""
        c, offset = self.cdna(pos), np.zeros(self.n, np.int64)
        out = np.flatnonzero(c < 0)
        if len(out) and len(self.es):
            p = pos[self.owner]
            low = self.first + np.bincount(self.owner[self.ee < p], minlength=self.n) - 1
            up = self.first + np.bincount(self.owner[self.es <= p], minlength=self.n)
            out = out[(low[out] >= self.first[out]) & (up[out] < self.first[out] + self.lens[out])]
            low, up, fwd = low[out], up[out], self.fwd[out]
            dl, du = pos[out] - self.ee[low], self.es[up] - pos[out]
            lower = (dl < du) | ((dl == du) & fwd)
            near, d = np.where(lower, low, up), np.where(lower, dl, du)
            tail = lower == fwd  # the edge where the exon ends, in transcript order
            c[out] = self.ec[near] + np.where(tail, self.ee[near] - self.es[near], 0)
            offset[out] = np.where(tail, d, -d)
        return c, offset


def regions(p: Pairs) -> dict[str, np.ndarray]:
    """Facts of placement; an interbase site is a reversed span, which overlaps where both of its neighbours do."""
    s, e, fwd, coding = p.s, p.e, p.fwd, p.coding
    left, right = e < p.ts, s > p.te
    within = ~left & ~right
    so, eo, o = s[p.owner], e[p.owner], p.owner
    hit = (eo >= p.es) & (so <= p.ee)
    exon = within & p.some(hit, o)
    sg, eg, g = s[p.gap_owner], e[p.gap_owner], p.gap_owner
    met, small = (eg >= p.gs) & (sg <= p.ge), p.ge - p.gs < SHORT_GAP
    p.shorted = met & small
    short, long_ = within & p.some(p.shorted, g), within & p.some(met & ~small, g)
    on_exon = p.some(hit & (np.minimum(eo, p.ee) >= p.cs[o]) & (np.maximum(so, p.es) <= p.ce[o]), o)
    cds = coding & within & (on_exon | (short & (e >= p.cs) & (s <= p.ce)))
    cdna = exon | short
    before, after = coding & cdna & (e >= p.ts) & (s <= p.cs - 1), coding & cdna & (e >= p.ce + 1) & (s <= p.te)
    pick = lambda a, b: np.where(fwd, a, b)
    return {
        "upstream": pick(left, right), "downstream": pick(right, left), "within": within, "complete": within & (s <= p.ts) & (e >= p.te), "contained": within & (s >= p.ts) & (e <= p.te),
        "exon_hit": exon, "cdna": cdna, "cds": cds, "coding": coding, "utr5": pick(before, after), "utr3": pick(after, before), "intron": within & (long_ | ~cdna | (short & ~coding)), "short_gap": short,
    }


def splice(p: Pairs, exonic: int = 3, intronic: int = 8) -> dict[str, np.ndarray]:
    """Facts of the introns' windows; an overlapped short gap has none. Interbase sites also count at the outer edges."""
    g, a, b = p.gap_owner, p.gs, p.ge
    s, e, free = p.s[g], p.e[g], ~p.shorted
    lo, hi, site = np.minimum(s, e), np.maximum(s, e), s == e + 1
    meets = lambda x, y: (e >= x) & (s <= y)
    some = lambda hit: p.some(free & hit, g)
    pick = lambda x, y: np.where(p.fwd, x, y)
    first, last = some(meets(a, a + 1)), some(meets(b - 1, b))
    fifth = pick(some(meets(a + 4, a + 4)), some(meets(b - 4, b - 4)))
    donor_region = pick(some(meets(a + 2, a + 5)), some(meets(b - 5, b - 2))) & ~fifth
    ppt = pick(some((hi >= b - 16) & (lo <= b - 2)), some((hi >= a + 2) & (lo <= a + 16)))
    reach = intronic - 1
    near = some(meets(a + 2, a + reach) | meets(b - reach, b - 2) | meets(a - exonic, a - 1) | meets(b + 1, b + exonic) | (site & ((s == a) | (e == b) | (s == a + 2) | (e == b - 2))))
    donor, acceptor = pick(first, last), pick(last, first)
    inner = some(meets(a + 2, b - 2) | (site & ((s == a + 2) | (e == b - 2))))
    return {"donor": donor, "acceptor": acceptor, "fifth": fifth, "donor_region": donor_region, "ppt": ppt, "splice_near": near & ~donor & ~acceptor & ~donor_region & ~fifth, "intronic": inner}


def places(p: Pairs) -> dict[str, np.ndarray]:
    """Span in cDNA, CDS and protein, -1 for none. An insertion is the reversed span of the bases beside it."""
    c1, c2 = p.cdna(np.where(p.fwd, p.s, p.e)), p.cdna(np.where(p.fwd, p.e, p.s))
    start = p.cdna(np.where(p.fwd, p.cs, p.ce))
    p1, p2 = c1 - start + 1, c2 - start + 1
    length = p.ints("cds_length")
    ok = p.coding & (c1 >= 0) & (c2 >= 0) & (start >= 0) & (np.minimum(p1, p2) >= 1) & (np.maximum(p1, p2) <= length) & (c2 - c1 == p.e - p.s)
    q1, q2 = np.where(ok, p1, -1), np.where(ok, p2, -1)
    aa = lambda q: np.where(q >= 0, (q - 1) // 3 + 1, -1)
    return {"cdna_start": c1, "cdna_end": c2, "cds_start_pos": q1, "cds_end_pos": q2, "protein_start": aa(q1), "protein_end": aa(q2)}


def change(cds: str, post: str, table: int, first: int, ps: int, pe: int, ref: str, alt: str, flags: int) -> tuple | None:
    """(codons, peptides, predicate bits, edited CDS) of an edit of the CDS at place first; None where it doesn't hold ref there.

    The window is the whole codons that the edit meets; the edited window may run on into the 3' UTR. One or two bases that
    are left over read X, unless a stop stands before them.
    """
    n, m = len(ref), len(alt)
    if cds[first - 1 : first - 1 + n] != ref or alt.strip("ACGT"):
        return None
    d, c0, width = m - n, (ps - 1) * 3, max(0, pe - ps + 1) * 3
    new = cds[: first - 1] + alt + cds[first - 1 + n :]
    rc = cds[c0 : c0 + width]
    more = c0 + max(0, width + d)
    ac = new[c0:more] if more <= len(new) else (new + post)[c0:more]
    rp, ap = translated(rc, table), translated(ac, table)
    if len(ac) % 3 and ap != "*":
        ap += "X"
    level, rs, as_ = d == 0, rp.find("*"), ap.find("*")
    open_start, open_end = flags & FLAG["cds_start_nf"], flags & FLAG["cds_end_nf"]
    partial = len(cds) % 3 != 0 and pe * 3 > len(cds)
    whole = not partial
    stop_lost = rs >= 0 and as_ < 0 and whole and not open_end
    stop_retained = rs >= 0 and as_ >= 0 and (not level or rs == as_) and whole
    stop_gained = as_ >= 0 and rs < 0 and whole
    shift = d % 3 != 0 and whole and not stop_retained and not rp.startswith("*")
    edge = ap.startswith(rp) or ap.endswith(rp)
    loss = d < 0 and d % 3 == 0 and (m == 0 or rc.startswith(ac) or rc.endswith(ac)) and whole
    gain = d > 0 and d % 3 == 0 and edge and len(ap) > len(rp)
    at_start, is_start = first <= 3 and not open_start, new[:3] == "ATG"
    start_lost = at_start and not is_start and not gain and not loss
    start_retained = at_start and is_start and level
    inserted = gain and not start_lost
    altering = not level and len(rp) != len(ap) and not rp.startswith("*") and not ap.startswith("*") and not edge and not loss and not start_lost and not shift and whole
    plain = level and len(rp) == len(ap) and whole and not (stop_lost or stop_retained or stop_gained or start_lost or shift)
    odd = "X" in ap
    missense, silent = plain and rp != ap and not odd, plain and rp == ap
    unknown = odd and whole and not (shift or stop_gained or stop_lost or stop_retained or inserted or loss or altering or start_lost)
    bits = 0
    for k, c in enumerate((silent, missense, stop_gained, stop_lost, stop_retained, start_lost, start_retained, shift, loss, inserted, altering, partial, unknown)):
        bits |= bool(c) << k
    return rc, ac, rp, ap, bits, new


def coding(p: Pairs, at: dict[str, np.ndarray], proteins: bool) -> dict:
    """Predicates and texts of the pairs whose edit has a place in a known CDS; whole: what protein HGVS needs."""
    rows = np.flatnonzero((at["cds_start_pos"] >= 0) & p.batch.column("cds_sequence").is_valid().to_numpy(zero_copy_only=False))
    n = p.n
    out = {k: np.full(n, None, object) for k in ("ref_codons", "alt_codons", "ref_peptide", "alt_peptide")}
    bits, found, whole = np.zeros(n, np.int64), np.zeros(n, bool), {}
    if len(rows):
        text = lambda c: p.texts(c, rows)
        table, flags = p.ints("codon_table")[rows].tolist(), p.flags[rows].tolist()
        spans = (at[c][rows].tolist() for c in ("cds_start_pos", "protein_start", "protein_end"))
        for i, cds, post, t, fl, fwd, ref, alt, rd, ad, first, ps, pe in zip(rows.tolist(), text("cds_sequence"), text("post_cds_sequence"), table, flags, p.fwd[rows].tolist(), text("reference"), text("alternate"), text("reference_difference"), text("alternate_difference"), *spans, strict=True):
            # equal lengths keep the uploaded alleles, others the trimmed ones
            r, a = (ref.upper(), alt.upper()) if len(ref) == len(alt) else (rd, ad)
            if not fwd:
                r, a = revcomp(r), revcomp(a)
            got = change(cds, post or "", t, first, ps, pe, r, a, fl)
            if got:
                out["ref_codons"][i], out["alt_codons"][i], out["ref_peptide"][i], out["alt_peptide"][i], bits[i], new = got
                found[i] = True
                if proteins:
                    whole[i] = (cds, new + (post or ""), t)
    out |= {k: (bits >> b) & 1 == 1 for b, k in enumerate(PREDICATES)}
    return out | {"delta": found, "_whole": whole}


def structural(p: Pairs, r: dict) -> dict[str, np.ndarray]:
    """Facts of a structural event by its type and copy change."""
    kind, copy = (np.array([x or "" for x in p.batch.column(c).to_pylist()], object) for c in ("structural_type", "copy_change"))
    gain, loss = (copy == "GAIN") | np.isin(kind, ("DUP", "TDUP")), (copy == "LOSS") | (kind == "DEL")
    insertion = gain | (kind == "INS")
    s, e, cs, ce = p.s, p.e, p.cs, p.ce
    low, high = (e >= cs) & (s <= np.minimum(cs + 2, ce)), (e >= np.maximum(ce - 2, cs)) & (s <= ce)
    stop, start = np.where(p.fwd, high, low), np.where(p.fwd, low, high)
    part = r["within"] & ~r["complete"]
    in_one = p.some((s[p.owner] >= p.es) & (e[p.owner] <= p.ee), p.owner) & r["cds"]
    third = (e - s + 1) % 3 == 0
    return {
        "ablation": r["complete"] & loss, "amplification": r["complete"] & gain, "elongation": r["cdna"] & r["contained"] & insertion, "truncation": r["cdna"] & part & loss,
        "start_lost": part & p.coding & ~p.flag("cds_start_nf") & r["exon_hit"] & start, "stop_lost": part & loss & r["cds"] & stop,
        "frameshift": part & loss & in_one & ~third, "inframe_deletion": part & loss & in_one & third & (s >= cs) & (e <= ce),
    }


def terms(p: Pairs, r: dict, w: dict, d: dict, family: str, loss: np.ndarray) -> np.ndarray:
    """The mask of terms that a pair's facts name. family: small, unspecified, structural or breakend."""
    no = np.zeros(p.n, bool)
    get = lambda k: d.get(k, no)
    small = family in ("small", "unspecified")
    open_ = ~no if small else ~r["complete"]
    outside = ~r["coding"] & r["exon_hit"] & ~r["complete"]
    framed = no if small else get("frameshift") | get("inframe_deletion")
    unknown = ~r["complete"] & (get("coding_unknown") | (r["cds"] & ~get("delta") & ~framed))
    nmd = r["within"] & p.flag("nmd")
    return rules_of(
        {
            "transcript_ablation": r["complete"] & loss if small else get("ablation"), "transcript_amplification": get("amplification"),
            "splice_acceptor_variant": w["acceptor"] & small, "splice_donor_variant": w["donor"] & small, "stop_gained": get("stop_gained"), "frameshift_variant": get("frameshift"),
            "stop_lost": get("stop_lost"), "start_lost": get("start_lost"), "feature_elongation": get("elongation"), "feature_truncation": get("truncation"),
            "inframe_insertion": get("inframe_insertion"), "inframe_deletion": get("inframe_deletion"), "missense_variant": get("missense"), "protein_altering_variant": get("protein_altering"),
            "splice_donor_5th_base_variant": w["fifth"] & small, "splice_region_variant": w["splice_near"] & small, "splice_donor_region_variant": w["donor_region"] & small,
            "splice_polypyrimidine_tract_variant": w["ppt"] & ~r["exon_hit"] & open_, "incomplete_terminal_codon_variant": get("partial_codon"), "start_retained_variant": get("start_retained"),
            "stop_retained_variant": get("stop_retained"), "synonymous_variant": get("synonymous"), "coding_sequence_variant": unknown, "5_prime_UTR_variant": r["utr5"] & open_, "3_prime_UTR_variant": r["utr3"] & open_,
            "non_coding_transcript_exon_variant": outside, "intron_variant": w["intronic"] & open_, "NMD_transcript_variant": nmd, "non_coding_transcript_variant": ~r["coding"] & r["within"] & ~outside,
            "coding_transcript_variant": r["complete"] & r["coding"] & p.flag("protein_coding") & ~nmd, "upstream_gene_variant": r["upstream"], "downstream_gene_variant": r["downstream"],
        }
    )


def decay(p: Pairs, mask: np.ndarray, cds_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eligible, known, escape bits): 1 intronless, 2 early CDS, 4 last exon, 8 its neighbour."""
    n, k, e = p.n, p.lens, p.e
    bits = np.where(k == 1, 1, 0) + np.where((cds_end >= 0) & (cds_end <= EARLY_CDS), 2, 0)
    if len(p.es):
        at = lambda i: np.clip(i, 0, len(p.es) - 1)
        last = at(np.where(p.fwd, p.first + k - 1, p.first))
        bits = bits + np.where((k > 0) & (e >= p.es[last]) & (e <= p.ee[last]), 4, 0)
        before = at(np.where(p.fwd, p.first + k - 2, p.first + 1))
        a, b = p.es[before], p.ee[before]
        bits = bits + np.where((k > 1) & np.where(p.fwd, (e >= b - PENULTIMATE) & (e <= b), (e >= a) & (e <= a + PENULTIMATE)), 8, 0)
    eligible = (mask & mask_of("stop_gained", "frameshift_variant", "splice_donor_variant", "splice_acceptor_variant")) != 0
    return eligible, p.coding & (cds_end >= 0), bits.astype(np.int64).reshape(n)


def _chosen(code: np.ndarray, names: list) -> pa.Array:
    """Text by number; -1: null."""
    return pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32), mask=code < 0), pa.array(names, pa.string())).dictionary_decode()


def region_text(r: dict) -> pa.Array:
    order = (("upstream", "upstream"), ("downstream", "downstream"), ("intron", "intron"), ("cds", "coding"), ("utr5", "utr"), ("utr3", "utr"))
    bits = sum(r[k].astype(np.int64) << b for b, (k, _) in enumerate(order)) + ((~r["coding"] & r["exon_hit"]).astype(np.int64) << len(order))
    values, code = np.unique(bits, return_inverse=True)
    text = lambda v: ",".join(dict.fromkeys([t for b, (_, t) in enumerate(order) if v >> b & 1] + ["non_coding_exon"] * (v >> len(order) & 1)))
    return _chosen(code, [text(int(v)) for v in values])


def unspecified(p: Pairs, r: dict) -> dict[str, np.ndarray]:
    """Facts of the allele that stands for any other: at the start or stop codon they are kept, elsewhere in the CDS unknown."""
    low, high = (p.e >= p.cs) & (p.s <= np.minimum(p.cs + 2, p.ce)), (p.e >= np.maximum(p.ce - 2, p.cs)) & (p.s <= p.ce)
    start, stop = r["cds"] & np.where(p.fwd, low, high), r["cds"] & np.where(p.fwd, high, low)
    return {"start_retained": start, "stop_retained": stop & ~start, "coding_unknown": r["cds"] & ~start & ~stop, "delta": r["cds"]}


def projected(p: Pairs, r: dict, d: dict, at: dict, mask: np.ndarray) -> dict:
    """PROJECTED: an end of the edit that doesn't map leaves the other one; the flanks of codons that the edit keeps are in lower case."""
    within, insertion = r["within"], p.s > p.e
    c1, c2 = at["cdna_start"], at["cdna_end"]
    f = np.where(within, np.where(insertion & (c1 < 0) & (c2 >= 0), c2 + 1, c1), -1)
    g = np.where(within, np.where(insertion & (c2 < 0) & (c1 >= 0), c1 - 1, c2), -1)
    start, end = p.cdna(np.where(p.fwd, p.cs, p.ce)), p.cdna(np.where(p.fwd, p.ce, p.cs))
    beyond = insertion & ((f > end) | (g < start))
    place = lambda c: np.where(p.coding & (c >= 0) & (c >= start) & (c <= end) & ~beyond, c - start + 1, -1)
    q1, q2 = place(f), place(g)
    aa = lambda q: np.where(q >= 0, (q + 2) // 3, -1)
    out: dict = {}
    for name, a, b in (("cdna", f, g), ("cds", q1, q2), ("protein", aa(q1), aa(q2))):
        turn = (a >= 0) & (b >= 0) & (a > b)
        for end_, v in (("first", np.where(turn, b, a)), ("last", np.where(turn, a, b))):
            out[f"edit_{name}_{end_}"] = pa.array(v, pa.int64(), mask=v < 0)

    def ranks(hit: np.ndarray, owner: np.ndarray, place: np.ndarray, total: np.ndarray) -> tuple[pa.Array, pa.Array]:
        rank = np.where(p.fwd[owner], place + 1, total[owner] - place)[hit]
        first, last = np.full(p.n, BIG), np.full(p.n, -1, np.int64)
        np.minimum.at(first, owner[hit], rank)
        np.maximum.at(last, owner[hit], rank)
        none = last < 0
        return pa.array(np.where(none, 0, first).astype(np.int32), mask=none), pa.array(last.astype(np.int32), mask=none)

    so, eo = p.s[p.owner], p.e[p.owner]
    out["exon_first"], out["exon_last"] = ranks((so <= p.ee) & (eo >= p.es), p.owner, np.arange(len(p.owner)) - p.first[p.owner], p.lens)
    j = np.flatnonzero(p.owner[1:] == p.owner[:-1])  # neighbours that touch have an intron's rank too, without bases
    o = p.owner[j]
    out["intron_first"], out["intron_last"] = ranks((p.s[o] <= p.es[j + 1] - 1) & (p.e[o] >= p.ee[j] + 1), o, j - p.first[o], p.lens - 1)
    out["exon_total"], out["intron_total"] = p.lens.astype(np.int32), np.maximum(p.lens - 1, 0).astype(np.int32)
    away = np.minimum.reduce([abs(p.s - p.ts), abs(p.s - p.te), abs(p.e - p.ts), abs(p.e - p.te)])
    out["transcript_distance"] = pa.array(away, pa.int64(), mask=(mask & mask_of("upstream_gene_variant", "downstream_gene_variant")) == 0)
    out |= {"cds_start_nf": p.flag("cds_start_nf"), "cds_end_nf": p.flag("cds_end_nf"), "interbase": insertion}
    rows = np.arange(p.n)
    alleles = [(a.upper(), b.upper()) if len(a) == len(b) else (x, y) for a, b, x, y in zip(*(p.texts(c, rows) for c in ("reference", "alternate", "reference_difference", "alternate_difference")), strict=True)]
    out["output_allele"] = np.array([b or "-" for _, b in alleles], object)
    first = at["cds_start_pos"]
    texts: dict = {c: np.full(p.n, None, object) for c in ("reference_codons", "alternate_codons", "reference_amino_acids", "alternate_amino_acids")}
    for i in np.flatnonzero(d["delta"]).tolist():
        (a, b), k = alleles[i], int(first[i] - 1) % 3
        for c, codons, n in (("reference_codons", d["ref_codons"][i], len(a)), ("alternate_codons", d["alt_codons"][i], len(b))):
            texts[c][i] = (codons[:k].lower() + codons[k : k + n] + codons[k + n :].lower()) or "-"
        texts["reference_amino_acids"][i], texts["alternate_amino_acids"][i] = d["ref_peptide"][i] or "-", d["alt_peptide"][i] or "-"
    return out | texts


def evaluate(batch: pa.RecordBatch, want: list[str], family: str) -> pa.RecordBatch:
    """The columns wanted, those of the batch itself as they are."""
    p, asked = Pairs(batch), set(want)
    r = regions(p)
    w = splice(p)
    made: dict = dict(r) | w
    none = np.full(p.n, -1, np.int64)
    at, d, loss = dict.fromkeys(PLACES, none), {}, np.zeros(p.n, bool)
    if family == "small":
        changed = p.ints("length_difference")
        loss, at = changed < 0, places(p)
        d = coding(p, at, bool(asked & set(hgvs.COLUMNS)))
        d["missense"], d["frameshift"] = d["missense"] & (changed == 0), d["frameshift"] & (changed != 0)
    elif family == "structural":
        d = structural(p, r)
    elif family == "unspecified":
        d, at = unspecified(p, r), places(p)
    else:
        d = {"truncation": r["within"]}
    mask = terms(p, r, w, d, family, loss)
    made |= {k: v for k, v in d.items() if not k.startswith("_")} | {"consequence_mask": mask}
    made |= {k: pa.array(v, pa.int64(), mask=v < 0) for k, v in at.items()}
    if asked & {"consequence", "impact", "impact_code"}:
        values, code = np.unique(mask, return_inverse=True)
        named = [describe(int(v)) for v in values]
        made |= {"consequence": _chosen(code, [x[0] for x in named]), "impact_code": np.array([x[1] for x in named], np.int32)[code] if p.n else code.astype(np.int32), "impact": _chosen(code, [x[2] for x in named])}
    if "region" in asked:
        made["region"] = region_text(r)
    if asked & {"exon", "exon_count"}:
        e = p.e[p.owner]
        hit = np.flatnonzero((e >= p.es) & (e <= p.ee))[::-1]
        rank = none.copy()
        o = p.owner[hit]
        rank[o] = np.where(p.fwd[o], hit - p.first[o] + 1, p.lens[o] - (hit - p.first[o]))
        made |= {"exon": pa.array(rank, pa.int64(), mask=rank < 0), "exon_count": p.lens.astype(np.int32)}
    if asked & {"nmd_prediction", "nmd_escape"}:
        eligible, known, bits = decay(p, mask, at["cds_end_pos"])
        code = np.where(eligible, np.where(~known, 0, np.where(bits > 0, 1, 2)), -1)
        made |= {"nmd_prediction": _chosen(code, ["unresolved", "escaping", "triggering"]), "nmd_escape": pa.array(bits.astype(np.int32), mask=~(eligible & known))}
    if asked & set(hgvs.COLUMNS):
        made |= hgvs.describe_pairs(p, r, d, at)
    if asked & set(PROJECTED):
        made |= projected(p, r, d, at, mask)
    cols = []
    for name in want:
        c = made[name] if name in made else batch.column(name)
        cols.append(c if isinstance(c, pa.Array) else pa.array(c, pa.string() if c.dtype == object else None))
    return pa.RecordBatch.from_arrays(cols, names=want)
