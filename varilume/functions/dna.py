"""Nucleotides, codons and peptides as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varilume.functions.vocab import GENETIC_CODES


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and named: keeps plans small where a value is used many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(s: Column) -> Column:
    """Upper case, U as T."""
    return F.translate(F.upper(s), "U", "T")


def revcomp(s: Column) -> Column:
    """Reverse complement, ambiguity codes and case included."""
    return F.reverse(F.translate(s, "ACGTUNRYKMBDHVSWacgtunrykmbdhvsw", "TGCAANYRMKVHDBSWtgcaanyrmkvhdbsw"))


def _code(table: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in GENETIC_CODES.items():
        out = F.when(table == k, F.lit(v)).otherwise(out)
    return F.when(table == 1, F.lit(GENETIC_CODES[1])).otherwise(out)


def residue(codon: Column, table: Column) -> Column:
    """One-letter residue of three bases; X where a base is ambiguous, null where the table is unknown."""
    at = F.lit(0)
    for k, w in ((1, 16), (2, 4), (3, 1)):
        at = at + (F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) - 1) * w
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substr(_code(table), at + 1, F.lit(1))).when(_code(table).isNotNull(), F.lit("X"))


def translate(cds: Column, table: Column) -> Column:
    """Residues of the whole codons; one or two bases at the end are left out."""
    n = F.floor(F.length(cds) / 3).cast("int")
    codons = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # the table is looked up once, not for each codon
    read = F.get(F.transform(F.array(_code(table)), lambda t: F.array_join(F.transform(codons, lambda i: _residue_in(F.substr(cds, i * 3 + 1, F.lit(3)), t)), "")), F.lit(0))
    return F.when(cds.isNotNull(), read)


def _residue_in(codon: Column, code: Column) -> Column:
    at = F.lit(1)
    for k, w in ((1, 16), (2, 4), (3, 1)):
        at = at + (F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) - 1) * w
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substr(code, at, F.lit(1))).otherwise(F.lit("X"))
