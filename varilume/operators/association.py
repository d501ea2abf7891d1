"""Relations beside a model: its lists as tables of their own, and transcripts that another assembly's set maps to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Status of a mapping and the column that lists it.
MAPPINGS = {"exact_model_match": "mane_mapped", "cds_exact_utr_differs": "mane_coding_region_only"}
LABELS = ("status", "refseq_nuc", "refseq_prot", "mapping_label", "source_digest", "target_assembly")


def unnested(transcripts: DataFrame, column: str) -> DataFrame:
    """transcript_index and the fields of each element of a list column: exons, mature miRNA spans, peptide edits. Empty lists give no row."""
    return transcripts.select("transcript_index", F.inline(column))


def with_mane(consequences: DataFrame, authorities: DataFrame, mappings: DataFrame) -> DataFrame:
    """consequences of transcripts that authorities know, with their flags and the lists of mapped transcripts by how they map.

    All are keyed by (model_sha256, transcript_index); mappings: these, mapping_status and LABELS. A transcript without a
    mapping has null lists. Mappings of any other status are left out.
    """
    key = ["model_sha256", "transcript_index"]
    label = F.struct(*LABELS)
    lists = {name: F.array_sort(F.collect_list(F.when(F.col("mapping_status") == kind, label))) for kind, name in MAPPINGS.items()}
    some = mappings.filter(F.col("mapping_status").isin(*MAPPINGS)).groupBy(*key).agg(*(F.when(F.size(c) > 0, c).alias(n) for n, c in lists.items()))
    flags = authorities.select(*key, "canonical", "gencode_basic", "no_retained_canonical")
    return consequences.join(flags, key).join(some, key, "left")
