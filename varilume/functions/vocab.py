"""Sequence Ontology terms, predicate bits, rules and genetic codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMPACTS = ("MODIFIER", "LOW", "MODERATE", "HIGH")

# Bit, term, impact code, severity rank, evaluation tier.
SO_TERMS = (
    (0, "upstream_gene_variant", 0, 32, 3),
    (1, "downstream_gene_variant", 0, 33, 3),
    (2, "intron_variant", 0, 28, 3),
    (3, "5_prime_UTR_variant", 0, 25, 3),
    (4, "3_prime_UTR_variant", 0, 26, 3),
    (5, "non_coding_transcript_exon_variant", 0, 27, 3),
    (6, "non_coding_transcript_variant", 0, 30, 3),
    (7, "splice_region_variant", 1, 16, 3),
    (8, "splice_donor_variant", 3, 3, 3),
    (9, "splice_acceptor_variant", 3, 2, 3),
    (10, "splice_donor_5th_base_variant", 1, 15, 3),
    (11, "coding_sequence_variant", 0, 23, 3),
    (12, "synonymous_variant", 1, 22, 3),
    (13, "missense_variant", 2, 13, 3),
    (14, "stop_gained", 3, 4, 3),
    (15, "stop_lost", 3, 6, 3),
    (16, "start_lost", 3, 7, 3),
    (17, "stop_retained_variant", 1, 21, 3),
    (18, "incomplete_terminal_codon_variant", 1, 19, 3),
    (19, "splice_donor_region_variant", 1, 17, 3),
    (20, "splice_polypyrimidine_tract_variant", 1, 18, 3),
    (21, "NMD_transcript_variant", 0, 29, 3),
    (22, "mature_miRNA_variant", 0, 24, 2),
    (23, "frameshift_variant", 3, 5, 3),
    (24, "inframe_deletion", 2, 12, 3),
    (25, "transcript_ablation", 3, 1, 1),
    (26, "transcript_amplification", 3, 8, 1),
    (27, "feature_elongation", 3, 9, 3),
    (28, "feature_truncation", 3, 10, 3),
    (29, "coding_transcript_variant", 0, 31, 3),
    (30, "inframe_insertion", 2, 11, 3),
    (31, "protein_altering_variant", 2, 14, 3),
    (32, "start_retained_variant", 1, 20, 3),
    (33, "intergenic_variant", 0, 40, 4),
    (34, "TFBS_ablation", 2, 34, 2),
    (35, "TFBS_amplification", 0, 35, 2),
    (36, "TF_binding_site_variant", 0, 36, 2),
    (37, "regulatory_region_ablation", 0, 37, 2),
    (38, "regulatory_region_amplification", 0, 38, 2),
    (39, "regulatory_region_variant", 0, 39, 2),
    (40, "sequence_variant", 0, 41, 4),
)
BIT = {name: bit for bit, name, _, _, _ in SO_TERMS}

# NCBI genetic codes; codons in T, C, A, G order, the first base slowest.
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    24: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG",
    25: "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    26: "FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    27: "FFLLSSSSYYQQCCWWLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    28: "FFLLSSSSYYQQCCWWLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    29: "FFLLSSSSYYYYCC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    30: "FFLLSSSSYYEECC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    31: "FFLLSSSSYYEECCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}

# One-letter and three-letter residue names.
RESIDUES = {
    "A": "Ala", "B": "Asx", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys", "L": "Leu", "M": "Met",
    "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "U": "Sec", "V": "Val", "W": "Trp", "X": "Xaa", "Y": "Tyr", "Z": "Glx", "*": "Ter",
}

# Flags of a transcript.
FLAG = {"translation": 1, "protein_coding": 2, "nmd": 4, "mirna": 8, "cds_start_nf": 16, "cds_end_nf": 32}


def so_terms(spark: SparkSession) -> DataFrame:
    """All 41 terms: bit_index, consequence_mask, consequence, impact_code, impact, severity_rank, evaluator_tier."""
    rows = [(b, 1 << b, n, i, IMPACTS[i], r, t) for b, n, i, r, t in SO_TERMS]
    return spark.createDataFrame(rows, "bit_index int, consequence_mask long, consequence string, impact_code int, impact string, severity_rank int, evaluator_tier int")


def mask_of(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


def rules(facts: dict[str, Column]) -> Column:
    """Terms of the facts that hold, as a mask: of the first tier alone if it has any, else the second, else the third."""
    tier = {n: t for _, n, _, _, t in SO_TERMS}
    zero = F.lit(0).cast("long")

    def of(t: int) -> Column:
        out = zero
        for n, c in facts.items():
            if tier[n] == t:
                out = out + F.when(c, F.lit(1 << BIT[n]).cast("long")).otherwise(zero)
        return out

    return F.coalesce(*(F.nullif(of(t), zero) for t in (1, 2, 3)), F.lit(1 << BIT["intergenic_variant"]).cast("long"))


def has(mask: Column, *names: str) -> Column:
    return mask.bitwiseAND(F.lit(mask_of(*names)).cast("long")) != 0


def impact_code(mask: Column) -> Column:
    by = {k: [n for _, n, i, _, _ in SO_TERMS if i == k] for k in (3, 2, 1)}
    return F.when(has(mask, *by[3]), 3).when(has(mask, *by[2]), 2).when(has(mask, *by[1]), 1).otherwise(0)


def impact(mask: Column) -> Column:
    code = impact_code(mask)
    return F.when(code == 3, "HIGH").when(code == 2, "MODERATE").when(code == 1, "LOW").otherwise("MODIFIER")


#: Terms in the order in which names are joined.
RENDER = sorted(BIT, key=lambda n: next(r for _, m, _, r, _ in SO_TERMS if m == n))


def consequence(mask: Column) -> Column:
    """Names joined by &, the most severe first."""
    return F.concat_ws("&", *(F.when(has(mask, n), F.lit(n)) for n in RENDER))


def describe(mask: int) -> tuple[str, int, str]:
    """(names, impact code, impact) of one mask, in the order of consequence()."""
    held = [x for x in sorted(SO_TERMS, key=lambda x: x[3]) if mask >> x[0] & 1]
    code = max((x[2] for x in held), default=0)
    return "&".join(x[1] for x in held), code, IMPACTS[code]


def rules_of(facts: dict):
    """rules() over arrays of facts."""
    import numpy as np

    tier = {n: t for _, n, _, _, t in SO_TERMS}
    sums = {t: sum((np.where(c, np.int64(1 << BIT[n]), 0) for n, c in facts.items() if tier[n] == t), np.zeros(1, np.int64)) for t in (1, 2, 3)}
    out = np.where(sums[1] != 0, sums[1], np.where(sums[2] != 0, sums[2], sums[3]))
    return np.where(out != 0, out, np.int64(1 << BIT["intergenic_variant"]))
