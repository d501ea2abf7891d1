"""Confidence of loss-of-function calls: filters, flags and what couldn't be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilume.functions.dna import revcomp
from varilume.functions.vocab import FLAG, has
from varilume.operators.classify import introns
from varilume.operators.intervals import overlap_join
from varilume.session import reliable

END_TRUNC_REACH, MIN_INTRON = 50, 15
#: Columns of pairs that lof reads.
READ = ("event_index", "transcript_index", "seq_region", "consequence_mask", "feature_start1", "feature_end1", "strand", "transcript_flags", "exons", "cds_start", "cds_end", "cds_end_pos", "variant_kind", "reference_difference", "alternate_difference", "exon", "exon_count")


def reference_windows(sites: DataFrame, chunks: DataFrame, start: str, end: str) -> DataFrame:
    """sites (event_index, transcript_index, seq_region, start, end) with window: the reference bases, stitched from chunks.

    chunks: seq_region, start (0-based), end, seq. A window that chunks don't cover whole is null.
    """
    pieces = overlap_join(sites, chunks.select("seq_region", (F.col("start") + 1).alias("_ps"), F.col("end").alias("_pe"), "seq"), "seq_region", (start, end), ("_ps", "_pe"))
    a, b = F.greatest(F.col(start), F.col("_ps")), F.least(F.col(end), F.col("_pe"))
    part = F.struct(a.alias("at"), F.substr("seq", (a - F.col("_ps") + 1).cast("int"), (b - a + 1).cast("int")).alias("x"))
    got = pieces.groupBy("event_index", "transcript_index", start, end).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.expr("array_join(transform(parts, p -> p.x), '')")
    return got.select("event_index", "transcript_index", F.when(F.length(text) == F.col(end) - F.col(start) + 1, text).alias("window"))


def lof(pairs: DataFrame, chunks: DataFrame | None = None, min_intron_size: int = MIN_INTRON, check_complete_cds: bool = False) -> DataFrame:
    """(event_index, transcript_index, lof, lof_filter, lof_flags, lof_unchecked) of pairs of protein-coding transcripts.

    pairs: the columns READ of small_variants. HC needs a truncating or splice-site term and no filter; other rows have null.
    Distances to the stop are summed over the exons that follow, one less than each length, and END_TRUNC holds where
    the sum less the coding part of the stop's exon is at most 50. Checks that lack data are named, never guessed.
    """
    m, fwd = F.col("consequence_mask"), F.col("strand") >= 0
    v, e = F.col("feature_start1"), F.col("feature_end1")
    flags = F.coalesce(F.col("transcript_flags"), F.lit(0).cast("long"))
    flag = lambda n: flags.bitwiseAND(F.lit(FLAG[n]).cast("long")) != 0
    donor, acceptor = has(m, "splice_donor_variant"), has(m, "splice_acceptor_variant")
    other, site = has(m, "stop_gained", "frameshift_variant"), donor | acceptor
    df = pairs.filter(has(m, "stop_gained", "frameshift_variant", "splice_donor_variant", "splice_acceptor_variant") & flag("protein_coding"))
    hit = F.filter(introns(F.col("exons")), lambda g: (e >= g["is"]) & (v <= g["ie"]))
    df = df.withColumn("_intron", F.get(hit, F.lit(0)))
    stop = F.when(fwd, F.col("cds_end")).otherwise(F.col("cds_start"))

    def walked(total: Column, x: Column) -> Column:
        es, ee = x["exon_start"], x["exon_end"]
        skipped = F.when(fwd, v > ee).otherwise(v < es)
        last = F.when(fwd, (es < stop) & (ee >= stop)).otherwise((ee > stop) & (es <= stop))
        here = (v >= es) & (v <= ee)
        head, tail = F.when(fwd, es).otherwise(ee), F.when(fwd, ee).otherwise(es)
        begin = F.when(here, v).otherwise(head)
        finish = F.when(last, stop).otherwise(tail)
        return total + F.when(skipped, F.lit(0).cast("long")).otherwise(F.abs(finish - begin))

    behind = lambda x: F.when(fwd, x["exon_end"] >= v).otherwise(x["exon_start"] <= v)
    own = F.array_max(F.transform(F.filter("exons", lambda x: behind(x) & (x["exon_start"] <= stop) & (x["exon_end"] >= stop)), lambda x: F.when(fwd, stop - x["exon_start"]).otherwise(x["exon_end"] - stop)))
    distance = F.aggregate("exons", F.lit(0).cast("long"), walked)
    placed = other & F.col("cds_end_pos").isNotNull()
    df = df.withColumns({"_truncates": placed & (distance - own <= END_TRUNC_REACH), "_size": F.col("_intron.ie") - F.col("_intron.is") + 1})
    df = reliable(df)  # few rows, read by each of the joins below
    bases = {"_left": None, "_right": None, "_near": None}
    if chunks is not None:
        sites = {"_left": (F.col("_intron.is"), F.col("_intron.is") + 1), "_right": (F.col("_intron.ie") - 1, F.col("_intron.ie")), "_near": (v - 4, v + 4)}
        for name, (a, b) in sites.items():
            wanted = df.filter(site & F.col("_intron").isNotNull()).select("event_index", "transcript_index", "seq_region", a.alias("_a"), b.alias("_b"))
            df = df.join(reference_windows(wanted, chunks, "_a", "_b").withColumnRenamed("window", name), ["event_index", "transcript_index"], "left")
    else:
        df = df.withColumns(dict.fromkeys(bases, F.lit(None).cast("string")))
    turned = lambda c: F.when(fwd, F.col(c)).otherwise(revcomp(F.col(c)))
    first, last = F.when(fwd, F.col("_left")).otherwise(revcomp(F.col("_right"))), F.when(fwd, F.col("_right")).otherwise(revcomp(F.col("_left")))
    known = first.isNotNull() & last.isNotNull()
    one = F.col("variant_kind") == "snv"
    ref, alt = turned("reference_difference"), turned("alternate_difference")
    before, after = F.when(fwd, e < F.col("cds_start")).otherwise(v > F.col("cds_end")), F.when(fwd, v > F.col("cds_end")).otherwise(e < F.col("cds_start"))
    single, numbered = F.col("exon_count") == 1, F.col("exon").isNotNull()
    filters = (
        ("END_TRUNC", F.col("_truncates")), ("INCOMPLETE_CDS", F.lit(check_complete_cds) & other & ~single & (flag("cds_start_nf") | flag("cds_end_nf"))), ("SMALL_INTRON", site & (F.col("_size") < min_intron_size)),
        ("GC_TO_GT_DONOR", donor & one & (first == "GC") & (ref == "C") & (alt == "T")), ("5UTR_SPLICE", site & before), ("3UTR_SPLICE", site & after),
    )
    told = (("SINGLE_EXON", other & single), ("NO_EXON_NUMBER", placed & ~numbered), ("NON_CAN_SPLICE", site & known & ~((first == "GT") & (last == "AG"))), ("NAGNAG_SITE", acceptor & one & turned("_near").rlike("AG.AG")))
    missing = (("GERP_END_TRUNC", placed), ("PHYLOCSF", numbered), ("ANC_ALLELE", one), ("NON_CAN_SPLICE", site & ~known), ("NAGNAG_SITE", acceptor & one & F.col("_near").isNull()), ("GC_TO_GT_DONOR", donor & ~known))
    text = lambda rules: F.nullif(F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)), F.lit(""))
    out = df.select("event_index", "transcript_index", text(filters).alias("lof_filter"), text(told).alias("lof_flags"), text(missing).alias("lof_unchecked"))
    return out.select("event_index", "transcript_index", F.when(F.col("lof_filter").isNull(), "HC").otherwise("LC").alias("lof"), "lof_filter", "lof_flags", "lof_unchecked")
