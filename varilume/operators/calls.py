"""Genotype calls before haplotypes: raw genotype text, single heterozygous calls, phase domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raw_gt(gt: Column, alternates: Column) -> Column:
    """Struct of a source record's genotype text: status, disposition, ploidy, has_missing, slots, allele_first, allele_second.

    The text is split at one separator only, | where it has any; a slot that is a dot alone is left out, and others count as the
    number that they start with, or the reference. Calls of the reference alone are omitted_reference, calls without a
    slot omitted_empty, others retained. status: ok, invalid_syntax or allele_out_of_range, which leave the rest null.
    """
    valid = F.coalesce(gt.rlike(r"^[|/]?([0-9]+|\.)([|/]([0-9]+|\.))*$"), F.lit(False))
    atoms = F.regexp_extract_all(gt, F.lit(r"([0-9]+|\.)"), F.lit(1))
    number = lambda t: F.coalesce(F.regexp_extract(t, "^([0-9]+)", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    far = F.exists(atoms, lambda t: number(t) > alternates)
    plain = ~gt.rlike("^[|/]") & F.forall(atoms, lambda t: (t != ".") & (number(t) == 0))
    slots = F.filter(F.when(F.contains(gt, F.lit("|")), F.split(gt, r"\|")).otherwise(F.split(gt, "/")), lambda t: t != ".")
    slots = F.when(~plain, F.transform(slots, lambda t: number(t).cast("int")))
    ok = valid & ~far
    kind = F.when(plain, "omitted_reference").when(F.size(slots) > 0, "retained").otherwise("omitted_empty")
    fields = {
        "disposition": kind, "ploidy": F.size(atoms), "has_missing": F.array_contains(atoms, "."), "slots": F.coalesce(F.size(slots), F.lit(0)),
        "allele_first": F.get(slots, F.lit(0)), "allele_second": F.get(slots, F.lit(1)),
    }
    fields["slots"] = F.when(plain, 0).otherwise(F.size(slots))
    return F.struct(F.when(~valid, "invalid_syntax").when(far, "allele_out_of_range").otherwise("ok").alias("status"), *(F.when(ok, c).alias(k) for k, c in fields.items()))


def resolve_single(calls: DataFrame) -> DataFrame:
    """calls where an unphased heterozygous diploid call counts as phased in the order of its slots if its sample has no other
    heterozygous or missing call on the transcript: the two haplotypes are then known, whichever is written first."""
    unsure = F.exists("alleles", lambda a: a.isNull()) | (F.size(F.array_distinct("alleles")) > 1)
    w = Window.partitionBy("transcript_index", "sample_index")
    a, b = F.get("alleles", F.lit(0)), F.get("alleles", F.lit(1))
    open_ = ~F.coalesce(F.get("phase_before", F.lit(1)), F.lit(False))
    alone = (F.size("alleles") == 2) & (a != b) & open_ & (F.sum(unsure.cast("int")).over(w) == 1)
    return calls.withColumn("phase_before", F.when(F.coalesce(alone, F.lit(False)), F.array(F.lit(False), F.lit(True))).otherwise(F.col("phase_before")))


def call_inputs(calls: DataFrame) -> DataFrame:
    """calls with what a haplotype run checks: phase_sets of the sample on the transcript (sorted, null first), ploidies met there,
    copies of the call, and versions of its event."""
    by = ["transcript_index", "sample_index"]
    domains = calls.groupBy(*by).agg(F.array_sort(F.collect_set("phase_set")).alias("phase_sets"), F.countDistinct(F.size("alleles")).alias("ploidies"))
    versions = calls.groupBy("event_index").agg(F.countDistinct("seq_region", "position", "reference", "alternate", "alt_index").alias("versions"))
    copies = calls.groupBy("event_index", *by).agg(F.count("*").alias("copies"))
    return calls.join(domains, by).join(copies, ["event_index", *by]).join(versions, "event_index")


def record_order(records: DataFrame, by: str = "seq_region", position: str = "position", ordinal: str = "ordinal") -> DataFrame:
    """records with record_order, from 0 in each region: by position, then as the source has them."""
    w = Window.partitionBy(by).orderBy(position, ordinal)
    return records.withColumn("record_order", (F.row_number().over(w) - 1).cast("long"))
