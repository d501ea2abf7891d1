"""Worked example of one transcript, and pairs against a brute-force join."""

import pytest
from pyspark.sql import functions as F

from varilume.operators.annotate import annotate, coding_transcripts, without_candidates
from varilume.operators.events import allele_geometry, vcf_events
from varilume.operators.intervals import overlap_join

CDS = "ATGGTACGTACGTACGTACGTACGTACGTACTACGTACGTACGTACGTACGTACGTACGTACGTACTGGTAA"
TX = "transcript_index int, seq_region int, transcript_start long, transcript_end long, strand int, transcript_flags long, cds_start long, cds_end long, cds_sequence string, codon_table int, post_cds_sequence string, exons array<struct<exon_start:bigint,exon_end:bigint,exon_cdna_start:bigint,exon_cdna_end:bigint>>"
EV = "event_index long, seq_region int, position long, reference string, alternate string"


@pytest.fixture(scope="module")
def model(spark):
    return spark.createDataFrame([(0, 1, 100, 250, 1, 3, 120, 240, CDS, 1, "ACGTACGTAC", [(100, 150, 1, 51), (200, 250, 52, 102)])], TX)


def events(spark, rows):
    return spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], EV)


def test_worked_example(spark, model):
    rows = [(110, "C", "T"), (124, "T", "C"), (125, "A", "G"), (130, "C", "CA"), (134, "C", "A"), (151, "G", "A"), (175, "A", "G")]
    got = annotate(events(spark, rows), model, rich=True, hgvs=True).orderBy("event_index").collect()
    assert [(r.consequence, r.impact, r.transcript_hgvs, r.protein_hgvs, r.nmd_prediction) for r in got] == [
        ("5_prime_UTR_variant", "MODIFIER", None, None, None),
        ("missense_variant", "MODERATE", "c.5T>C", "p.Val2Ala", None),
        ("synonymous_variant", "LOW", "c.6A>G", "p.Val2=", None),
        ("frameshift_variant", "HIGH", None, None, "escaping"),
        ("stop_gained", "HIGH", "c.15C>A", "p.Tyr5Ter", "escaping"),
        ("splice_donor_variant", "HIGH", None, None, "unresolved"),
        ("intron_variant", "MODIFIER", None, None, None),
    ]
    assert [r.transcript_hgvs_reason for r in got if r.transcript_hgvs is None] == ["missing_reference"] * 4


def test_indels(spark, model):
    rows = [(123, "GTAC", "G"), (124, "T", "TACG"), (126, "C", "CAAA"), (126, "CGT", "C"), (238, "TAA", "TCC"), (120, "A", "C"), (90, "A", "G"), (260, "A", "G")]
    got = {r.event_index: r.consequence for r in annotate(events(spark, rows), model).collect()}
    assert got[0] == "inframe_deletion" and got[1] == "inframe_insertion" and got[3] == "frameshift_variant"
    assert got[2] == "protein_altering_variant"  # Arg becomes Gln-Ser: neither edge of the peptide is kept
    assert got[4] == "stop_lost" and got[5] == "start_lost" and got[6] == "upstream_gene_variant" and got[7] == "downstream_gene_variant"


def test_events_are_validated(spark, model):
    with pytest.raises(Exception, match="position must be"):
        annotate(events(spark, [(0, "A", "C")]), model).collect()
    with pytest.raises(ValueError, match="distances"):
        annotate(events(spark, [(1, "A", "C")]), model, upstream_distance=-1)


def test_families(spark, model):
    rows = [(0, 1, 90, "N", "<DEL>", 300, "DEL", "LOSS", None, None), (1, 1, 90, "N", "<DUP>", 300, "DUP", "GAIN", None, None), (2, 1, 130, "N", "<DEL>", 140, "DEL", "LOSS", None, None), (3, 1, 125, "A", "A[1:9000[", None, None, None, 1, 9000), (4, 1, 124, "T", "C", None, None, None, None, None)]
    ev = spark.createDataFrame(rows, EV + ", end_position long, structural_type string, copy_change string, mate_seq_region int, mate_position long")
    got = {r.event_index: r.consequence for r in annotate(ev, model).collect()}
    assert got[0] == "transcript_ablation" and got[1] == "transcript_amplification" and "feature_truncation" in got[2] and "feature_truncation" in got[3] and got[4] == "missense_variant"


def test_without_candidates_and_coding(spark, model):
    ev = events(spark, [(124, "T", "C"), (99_999, "A", "C")])
    rest = without_candidates(ev, annotate(ev, model), coverage_complete=False).collect()
    assert [(r.event_index, r.consequence, r.unresolved_reason) for r in rest] == [(1, "sequence_variant", "no_feature_in_loaded_model")]
    assert [(r.event_index, r.transcripts) for r in coding_transcripts(ev, model).collect()] == [(0, [0])]


def test_overlap_join_equals_brute_force(spark):
    import random

    r = random.Random(4)
    span = lambda n, most: [(i, r.choice("ab"), a := r.randint(1, 10**7), a + int(r.paretovariate(0.3)) % most) for i in range(n)]
    left, right = span(300, 5_000_000), span(300, 5_000_000)
    lf, rf = spark.createDataFrame(left, "i int, g string, a long, b long"), spark.createDataFrame(right, "j int, g string, c long, d long")
    got = sorted(map(tuple, overlap_join(lf, rf, "g", ("a", "b"), ("c", "d"), 10).select("i", "j").collect()))
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and y[2] <= x[3] + 10 and y[3] >= x[2] - 10)
    assert got == want and len(got) == len(set(got))


def test_allele_geometry_refuses(spark):
    with pytest.raises(Exception, match="allele_geometry"):
        allele_geometry(events(spark, [(5, "A", "A")])).collect()


def test_vcf_events_example(spark):
    rows = [("chrDuck", 124, "snv", "T", ["C", "*"], None, None, None), ("chrDuck", 139, "del", "A", ["<DEL>"], 160, "DEL", None), ("chrDuck", 180, "cnv", "G", ["<DEL>", "<DUP>"], 190, "CNV", None), ("chr9", 5, "elsewhere", "A", ["G"], None, None, None)]
    rec = spark.createDataFrame(rows, "CHROM string, POS long, ID string, REF string, ALT array<string>, INFO_END int, INFO_SVTYPE string, INFO_SVLEN array<int>")
    got = vcf_events(rec, spark.createDataFrame([(1, "chrDuck")], "seq_region int, seq_region_name string")).orderBy("event_index").collect()
    assert [(r.source_id, r.source_alt, r.position, r.end_position, r.event_status, r.event_reason) for r in got] == [
        ("snv", "C", 124, None, "ok", None), ("snv", "*", 124, None, "ok", None), ("del", "<DEL>", 140, 160, "ok", None),
        ("elsewhere", "G", None, None, "unsupported", "contig_not_in_model"), ("cnv", "<DEL>", None, None, "unsupported", "multiallelic_structural_record"), ("cnv", "<DUP>", None, None, "unsupported", "multiallelic_structural_record"),
    ]


def test_splice_sites_on_both_strands(spark, model):
    minus = model.withColumns({"strand": F.lit(-1), "transcript_index": F.lit(1)})
    got = {(r.event_index, r.transcript_index): r.consequence for r in annotate(events(spark, [(151, "A", "C"), (199, "A", "C"), (155, "A", "C")]), model.unionByName(minus)).collect()}
    assert "splice_donor_variant" in got[0, 0] and "splice_acceptor_variant" in got[0, 1] and "splice_acceptor_variant" in got[1, 0] and "splice_donor_variant" in got[1, 1]
    assert "splice_donor_5th_base_variant" in got[2, 0]


def test_filter_on_the_mask_plans(spark, model):
    got = annotate(events(spark, [(124, "T", "C"), (151, "G", "A")]), model).filter(F.col("consequence_mask").bitwiseAND(F.lit(1 << 8)) != 0)
    assert [r.event_index for r in got.collect()] == [1]


def reference(spark):
    """Bases of the worked transcript's region: exons as its sequences say, introns and flanks made up."""
    seq = list(("GATTACAGC" * 40)[:320])
    spliced = "TACGTACGTACGTACGTACG" + CDS + "ACGTACGTAC"
    for k, at in enumerate([*range(100, 151), *range(200, 251)]):
        seq[at - 1] = spliced[k]
    return "".join(seq), spark.createDataFrame([(1, a, min(a + 64, 320), "".join(seq[a : a + 64])) for a in range(0, 320, 64)], "seq_region int, start long, end long, seq string")


def test_hgvs_with_reference(spark, model):
    """Coordinates of UTRs and introns, moves along repeats and duplications, on both strands."""
    seq, chunks = reference(spark)
    at = lambda a, b: seq[a - 1 : b]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    snv = lambda p: (p, at(p, p), other[at(p, p)])
    rows = [snv(110), snv(153), snv(197), snv(245), (130, at(130, 131), at(130, 130)), (130, at(130, 130), at(130, 130) + at(131, 133)), (121, "TGG", "T"), (110, "A" if at(110, 110) != "A" else "C", "T" if at(110, 110) != "T" else "G")]
    got = annotate(events(spark, rows), model, rich=True, hgvs=True, chunks=chunks).orderBy("event_index").collect()
    assert got[0].transcript_hgvs == f"c.-10{at(110, 110)}>{other[at(110, 110)]}" and got[0].transcript_hgvs_status == "ok"
    assert got[1].transcript_hgvs == f"c.31+3{at(153, 153)}>{other[at(153, 153)]}"
    assert got[2].transcript_hgvs == f"c.32-3{at(197, 197)}>{other[at(197, 197)]}"
    assert got[3].transcript_hgvs == f"c.*5{at(245, 245)}>{other[at(245, 245)]}"
    assert got[4].transcript_hgvs == "c.12del" and "fsTer" in got[4].protein_hgvs
    assert got[5].transcript_hgvs == "c.12_14dup" and got[5].consequence == "stop_gained&inframe_insertion"
    assert got[6].transcript_hgvs == "c.3_4del" and got[7].transcript_hgvs_reason == "reference_mismatch"


def test_hgvs_deletion_moves_to_the_three_prime_end(spark):
    """Against all deletions that give the same sequence, on either strand."""
    from varilume.functions.hgvs import shifted

    text = "CCATATATATGGGAAACCC"
    for low in range(1, len(text)):
        for high in range(low, min(low + 4, len(text) + 1)):
            k, cut = high - low + 1, lambda i, k=high - low + 1: text[: i - 1] + text[i - 1 + k :]
            same = [i for i in range(1, len(text) - k + 2) if cut(i) == cut(low)]
            run = [i for i in same if all(j in same for j in range(min(i, low), max(i, low) + 1))]
            assert low + shifted(text, 1, low, high, text[low - 1 : high], "", True) == max(run)
            assert low - shifted(text, 1, low, high, text[low - 1 : high], "", False) == min(run)
