"""Where an event lies on a transcript or a feature, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varilume.functions.vocab import rules

def meets(s: Column, e: Column, a: Column, b: Column) -> Column:
    """Closed intervals overlap; a reversed one (interbase) only where both of its neighbours lie within."""
    return (e >= a) & (s <= b)


def introns(exons: Column) -> Column:
    """Gaps between neighbouring exons, exons in ascending genomic order: array of (is, ie)."""
    pairs = F.transform(F.slice(exons, 1, F.greatest(F.size(exons) - 1, F.lit(0))), lambda x, i: F.struct((x["exon_end"] + 1).alias("is"), (F.get(exons, i + 1)["exon_start"] - 1).alias("ie")))
    return F.filter(pairs, lambda g: g["ie"] >= g["is"])


def cdna_position(pos: Column, strand: Column, exons: Column) -> Column:
    """Place of a genomic position in the spliced transcript, from 1; null in introns and outside."""
    x = F.get(F.filter(exons, lambda x: (pos >= x["exon_start"]) & (pos <= x["exon_end"])), F.lit(0))
    return F.when(strand >= 0, x["exon_cdna_start"] + (pos - x["exon_start"])).otherwise(x["exon_cdna_start"] + (x["exon_end"] - pos))


def feature_mask(s: Column, e: Column, a: Column, b: Column, kind: Column, deletion: Column, gain: Column) -> Column:
    """Terms of a regulatory region (kind 1) or motif (kind 2) of span a..b."""
    within, complete, motif = meets(s, e, a, b), (s <= a) & (e >= b), kind == 2
    return rules(
        {
            "TFBS_ablation": motif & complete & deletion, "TFBS_amplification": motif & complete & gain, "TF_binding_site_variant": motif & within,
            "regulatory_region_ablation": ~motif & complete & deletion, "regulatory_region_amplification": ~motif & complete & gain, "regulatory_region_variant": ~motif & within,
        }
    )
