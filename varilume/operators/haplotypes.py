"""Phased genotypes into haplotypes: lanes, shared paths, edited sequences, blocks, arrangements, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varilume.functions.dna import revcomp, translate
from varilume.operators.classify import cdna_position

#: Bases between a stop and the last junction beyond which decay sets in, and the exceptions' bounds.
JUNCTION_REACH, START_PROXIMAL, LONG_EXON = 50, 100, 407


def phase_call(alleles: Column, phase_before: Column, phase_set: Column | None = None, policy: str = "strict") -> Column:
    """Array of one struct per slot: input_slot, allele_index, haplotype_lane, ploidy, phase_set, phase_scope, status.

    strict: one slot, or the same allele in all, holds for all phase sets; a phased slot, or the unphased ones if they leave no
    choice, for its set; the rest are unresolved. vep_compat: called slots are lanes in their order.
    """
    if policy not in ("strict", "vep_compat"):
        raise ValueError("phase_policy must be strict or vep_compat")
    phase_set = F.lit(None).cast("bigint") if phase_set is None else phase_set.cast("bigint")
    n = F.size(alleles)
    before = F.coalesce(phase_before, F.transform(alleles, lambda x: F.lit(False)))
    called = F.filter(alleles, lambda x: x.isNotNull())
    homozygous = (F.size(called) == n) & (F.size(F.array_distinct(called)) == 1)
    loose = F.filter(F.zip_with(alleles, before, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: ~x["b"])
    certain = (F.size(loose) == 1) | (F.forall(loose, lambda x: x["a"].isNotNull()) & (F.size(F.array_distinct(F.transform(loose, lambda x: x["a"]))) == 1))

    def slot(x: Column, i: Column) -> Column:
        a, b = x["a"], x["b"]
        if policy == "vep_compat":
            rank = F.size(F.filter(F.slice(alleles, 1, i + 1), lambda y: y.isNotNull()))
            scope, lane, status = F.lit("allele_slot"), F.when(a.isNotNull(), rank), F.when(a.isNull(), "missing").otherwise("called")
        else:
            scope = F.when((n == 1) | homozygous, "all_phase_sets").when(b | certain, "phase_set").otherwise("unresolved")
            lane = F.when(scope != "unresolved", i + 1)
            status = F.when(a.isNull(), "missing").when(scope == "unresolved", "unphased").otherwise("called")
        return F.struct((i + 1).alias("input_slot"), a.alias("allele_index"), lane.alias("haplotype_lane"), n.alias("ploidy"), F.when(scope == "phase_set", phase_set).alias("phase_set"), scope.alias("phase_scope"), status.alias("status"))

    wrong = (F.size(alleles) == 0) | (F.size(before) != n)
    slots = F.transform(F.zip_with(alleles, before, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), slot)
    return F.when(alleles.isNull(), None).when(wrong, F.raise_error(F.lit("phase_call: genotype is empty or the lists differ in length"))).otherwise(slots)


def edits(calls: DataFrame, transcripts: DataFrame) -> DataFrame:
    """calls with their place in the CDS: cds_first, ref, alt on the transcript's strand; null where the alleles don't map."""
    # sequences and exons never go through the driver: sizes guessed from files would have them broadcast
    c = calls.join(transcripts.select("transcript_index", "strand", "cds_start", "cds_end", "cds_sequence", "codon_table", "exons").hint("merge"), "transcript_index")
    fwd = F.col("strand") >= 0
    end = F.col("position") + F.length("reference") - 1
    zero = cdna_position(F.when(fwd, F.col("cds_start")).otherwise(F.col("cds_end")), F.col("strand"), F.col("exons"))
    at = cdna_position(F.when(fwd, F.col("position")).otherwise(end), F.col("strand"), F.col("exons")) - zero + 1
    own = lambda x: F.when(fwd, F.upper(x)).otherwise(revcomp(F.upper(x)))
    return c.withColumns({"cds_first": at.cast("int"), "ref": own(F.col("reference")), "alt": own(F.col("alternate"))}).withColumn("cds_first", F.when((F.col("cds_first") >= 1) & (F.col("cds_first") + F.length("ref") - 1 <= F.length("cds_sequence")), F.col("cds_first")))


def apply_edits(cds: Column, changes: Column) -> Column:
    """cds with the edits (cds_first, ref, alt), which don't overlap, applied from the last to the first."""
    order = F.reverse(F.array_sort(changes))
    return F.aggregate(order, cds, lambda s, e: F.concat(F.substr(s, F.lit(1), e["cds_first"] - 1), e["alt"], F.substr(s, e["cds_first"] + F.length(e["ref"]), F.length(s))))


def haplotypes(calls: DataFrame, transcripts: DataFrame, phase_policy: str = "strict") -> DataFrame:
    """One row per transcript and distinct path of edits: carriers, contributors, CDS, protein, status and consequences.

    calls: event_index, position, reference, alternate, alt_index, transcript_index, sample_index, alleles,
    phase_before, phase_set. Two shuffles: edits gather by (transcript, sample, set, lane), then carriers by path.
    Calls that hold for all phase sets join each set of their sample and transcript. Overlapping edits or a reference
    that the CDS doesn't hold leave the path unresolved.
    """
    slots = phase_call(F.col("alleles"), F.col("phase_before"), F.col("phase_set"), phase_policy)
    c = edits(calls, transcripts).withColumn("slot", F.explode(slots)).filter("slot.allele_index = alt_index and slot.haplotype_lane is not null")
    c = c.select("*", F.col("slot.haplotype_lane").alias("lane"), F.col("slot.phase_set").alias("set"), F.col("slot.phase_scope").alias("scope"))
    keys = ["transcript_index", "sample_index"]
    sets = c.filter("scope != 'all_phase_sets'").select(*keys, "set").distinct()
    everywhere = c.filter("scope = 'all_phase_sets'").drop("set").join(sets.hint("merge"), keys, "left")
    c = c.filter("scope != 'all_phase_sets'").unionByName(everywhere)
    edit = F.struct("cds_first", "ref", "alt", "event_index")
    lanes = c.groupBy(*keys, "set", "lane").agg(F.array_sort(F.collect_set(edit)).alias("path"))
    paths = lanes.groupBy("transcript_index", "path").agg(F.count("*").alias("carrier_count"), F.countDistinct("sample_index").alias("sample_count"))
    got = paths.join(transcripts.select("transcript_index", "cds_sequence", "codon_table").hint("merge"), "transcript_index")
    fits = F.forall("path", lambda e: e["cds_first"].isNotNull() & (F.substr("cds_sequence", e["cds_first"], F.length(e["ref"])) == e["ref"]))
    apart = F.forall(F.transform(F.slice("path", 1, F.size("path") - 1), lambda e, i: e["cds_first"] + F.length(e["ref"]) <= F.get("path", i + 1)["cds_first"]), lambda x: F.coalesce(x, F.lit(False)))
    status = F.when(~F.coalesce(fits, F.lit(False)), "unresolved").when((F.size("path") > 1) & ~apart, "unresolved").otherwise("ok")
    reason = F.when(~F.coalesce(fits, F.lit(False)), "reference_mismatch_or_outside_cds").when((F.size("path") > 1) & ~apart, "overlapping_edits")
    got = got.withColumns({"prediction_status": status, "prediction_reason": reason})
    got = got.withColumn("haplotype_cds", F.when(F.col("prediction_status") == "ok", apply_edits(F.col("cds_sequence"), F.col("path"))))
    got = got.withColumns({"reference_protein": translate(F.col("cds_sequence"), F.col("codon_table")), "haplotype_protein": translate(F.col("haplotype_cds"), F.col("codon_table"))})
    return classify(got.withColumn("contributors", F.transform("path", lambda e: e["event_index"])))


def classify(df: DataFrame) -> DataFrame:
    """df with haplotype_consequence of the whole edited CDS against the reference one, the first rule that holds."""
    cds, new, rp, hp = F.col("cds_sequence"), F.col("haplotype_cds"), F.col("reference_protein"), F.col("haplotype_protein")
    shift = F.length(new) % 3 != F.length(cds) % 3
    rs, hs = F.instr(rp, "*"), F.instr(hp, "*")
    subs = F.length(new) == F.length(cds)
    text = (
        F.when(new.isNull(), None).when(new == cds, "")
        .when((F.substring(cds, 1, 3) == "ATG") & (F.substring(new, 1, 3) != "ATG"), "start_lost")
        .when((rs > 0) & (hs == 0), F.when(shift, "stop_lost&frameshift_variant").otherwise("stop_lost"))
        .when((hs > 0) & ((rs == 0) | (hs < rs)) & (F.substr(hp, F.lit(1), hs) != F.substr(rp, F.lit(1), hs)), F.when(shift, "stop_gained&frameshift_variant").otherwise("stop_gained"))
        .when(shift, "frameshift_variant").when(rp == hp, "synonymous_variant").when(subs, "missense_variant")
        .when(F.length(new) > F.length(cds), "inframe_insertion").otherwise("inframe_deletion")
    )
    return df.withColumn("haplotype_consequence", text)


def interaction_blocks(path: Column) -> Column:
    """Edits of a sorted path in blocks: one joins the last while the lengths so far shift the frame or it meets the same codon."""
    start = F.struct(F.array().cast("array<array<bigint>>").alias("blocks"), F.lit(0).alias("shift"), F.lit(-1).alias("codon"))

    def step(acc: Column, e: Column) -> Column:
        first = F.floor((e["cds_first"] + acc["shift"] - 1) / 3).cast("int")
        joined = (F.size(acc["blocks"]) > 0) & ((acc["shift"] % 3 != 0) | (first <= acc["codon"]))
        n = F.size(acc["blocks"])
        one = F.array(e["event_index"].cast("bigint"))
        blocks = F.when(joined, F.concat(F.slice(acc["blocks"], 1, n - 1), F.array(F.concat(F.element_at(acc["blocks"], F.greatest(n, F.lit(1))), one)))).otherwise(F.concat(acc["blocks"], F.array(one)))
        blocks = F.when(n == 0, F.array(one)).otherwise(blocks)
        shift = acc["shift"] + F.length(e["alt"]) - F.length(e["ref"])
        last = F.floor((e["cds_first"] + acc["shift"] + F.greatest(F.length(e["alt"]), F.lit(1)) - 2) / 3).cast("int")
        return F.struct(blocks.alias("blocks"), shift.alias("shift"), last.alias("codon"))

    return F.aggregate(path, start, step, lambda acc: acc["blocks"])


def ejc50(stop_end: Column, junction: Column, stop_exon_length: Column) -> Column:
    """Decay by the distance from a stop to the last junction, places in the edited transcript: triggering, or why not."""
    return F.when(junction.isNull(), "no_downstream_junction").when(stop_end <= START_PROXIMAL, "start_proximal").when(stop_exon_length > LONG_EXON, "long_exon").when(junction - stop_end > JUNCTION_REACH, "triggering").otherwise("escaping")


def arrangements(sites: DataFrame, most: int = 16) -> DataFrame:
    """Both lanes of every way to combine a sample's phase blocks on a transcript: 2^(blocks - 1) arrangements.

    sites: transcript_index, sample_index, block (dense from 0), event_index, first_lane (1 or 2: where the alternate
    allele lies within its block). More than most blocks raise an error. The first block stays as it is, as lanes have no names.
    """
    g = sites.groupBy("transcript_index", "sample_index").agg((F.max("block") + 1).alias("units"), F.collect_list(F.struct("event_index", "block", "first_lane")).alias("sites"))
    n = F.when(F.col("units") > most, F.raise_error(F.lit(f"arrangements: more than {most} phase blocks"))).otherwise(F.pow(F.lit(2), F.col("units") - 1).cast("int"))
    e = g.withColumn("arrangement", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("lane", F.explode(F.array(F.lit(1), F.lit(2))))
    flipped = lambda s: F.when(s["block"] == 0, F.lit(0)).otherwise(F.floor(F.col("arrangement") / F.pow(F.lit(2), s["block"] - 1)).cast("int") % 2)
    on = F.filter("sites", lambda s: F.when(flipped(s) == 1, 3 - s["first_lane"]).otherwise(s["first_lane"]) == F.col("lane"))
    return e.select("transcript_index", "sample_index", "arrangement", "lane", F.sort_array(F.transform(on, lambda s: s["event_index"])).alias("events"))


def positional_difference(a: Column, b: Column) -> Column:
    """Maximal runs of places (from 1) where two strings of one length differ, as (start, reference, alternate)."""
    places = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    zero = F.array().cast("array<struct<start:int,n:int>>")
    runs = F.aggregate(differ, zero, lambda acc, i: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["start"] + F.get(acc, F.size(acc) - 1)["n"] == i), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), (F.get(acc, F.size(acc) - 1)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(i.alias("start"), F.lit(1).alias("n"))))))
    return F.when(F.length(a) == F.length(b), F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.substr(a, r["start"], r["n"]).alias("reference"), F.substr(b, r["start"], r["n"]).alias("alternate"))))
