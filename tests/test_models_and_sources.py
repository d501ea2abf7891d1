"""Model registry, snapshots, VCF reading, haplotypes and streams."""

import pytest
from pyspark.sql import functions as F

from varilume.operators import haplotypes as H
from varilume.operators.model import Registry, receipt
from varilume.plans import fixtures as X
from varilume.sources.vcf import coding_calls, read_vcf, sample_names

SF = "/root/testdata/sf0.001"


def test_registry(spark, tmp_path):
    models, tx = Registry(), X.transcripts(spark, SF)
    first = models.load("m", tx, X.features(spark, SF))
    assert models.load("m", tx).generation == first.generation + 1
    with pytest.raises(RuntimeError, match="reloaded"):
        models.get("m", first.generation)
    models.save("m", str(tmp_path / "snapshot"))
    assert models.restore(spark, "again", str(tmp_path / "snapshot")).rows == first.rows
    assert models.drop("m") and not models.drop("m")
    with pytest.raises(ValueError, match="over the limit"):
        models.load("m", tx, row_limit=3)
    with pytest.raises(ValueError, match="strand"):
        models.load("m", tx.withColumn("strand", F.lit(0)))


def test_receipt_ignores_order(spark):
    tx = X.transcripts(spark, SF)
    assert receipt(tx).first() == receipt(tx.orderBy(F.desc("transcript_index")).repartition(3)).first()
    assert receipt(tx).first() != receipt(tx.filter("transcript_index != 5")).first()


def test_vcf(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\nc0\t124\t.\tT\tC,G\t.\t.\tEND=124\tGT:PS\t0|1:7\t1/2\nc0\t900\t.\tT\tC\t.\t.\t.\tGT\t0|1\t0|1\n")
    assert sample_names(spark, str(path)) == ["S1", "S2"]
    tx = spark.createDataFrame([(0, 1, 100, 250, 1, 3, 120, 240, "A" * 72, 1, "", [(100, 150, 1, 51), (200, 250, 52, 102)])], "transcript_index int, seq_region int, transcript_start long, transcript_end long, strand int, transcript_flags long, cds_start long, cds_end long, cds_sequence string, codon_table int, post_cds_sequence string, exons array<struct<exon_start:bigint,exon_end:bigint,exon_cdna_start:bigint,exon_cdna_end:bigint>>")
    got = coding_calls(read_vcf(spark, str(path)), spark.createDataFrame([(1, "c0")], "seq_region int, seq_region_name string"), tx).orderBy("event_index", "sample_index").collect()
    assert [(r.alternate, r.sample_index, r.alleles, r.phase_before, r.phase_set) for r in got] == [("C", 0, [0, 1], [False, True], 7), ("C", 1, [1, 2], [False, False], None), ("G", 0, [0, 1], [False, True], 7), ("G", 1, [1, 2], [False, False], None)]
    with pytest.raises(ValueError, match="BCF"):
        read_vcf(spark, "x.bcf")


def test_two_changes_of_one_codon(spark):
    cds = "ATGGTACGTACGTACGTACGTACGTACGTACTACGTACGTACGTACGTACGTACGTACGTACGTACTGGTAA"
    tx = spark.createDataFrame([(0, 1, 120, 240, cds, 1, [(100, 150, 1, 51), (200, 250, 52, 102)])], "transcript_index int, strand int, cds_start long, cds_end long, cds_sequence string, codon_table int, exons array<struct<exon_start:bigint,exon_end:bigint,exon_cdna_start:bigint,exon_cdna_end:bigint>>")
    calls = spark.createDataFrame([(e, p, r, a, 1, 0, 0, [1, 0], [False, True], None) for e, p, r, a in ((1, 124, "T", "C"), (2, 125, "A", "G"))], "event_index long, position long, reference string, alternate string, alt_index int, transcript_index int, sample_index long, alleles array<int>, phase_before array<boolean>, phase_set long")
    (row,) = H.haplotypes(calls, tx).collect()
    assert row.contributors == [1, 2] and row.haplotype_cds[3:6] == "GCG" and row.haplotype_protein[:2] == "MA" and row.haplotype_consequence == "missense_variant"


def test_phase_call_errors(spark):
    df = spark.createDataFrame([([0, 1], [False])], "a array<int>, b array<boolean>")
    with pytest.raises(Exception, match="phase_call"):
        df.select(H.phase_call(F.col("a"), F.col("b"))).collect()
    with pytest.raises(ValueError, match="phase_policy"):
        H.phase_call(F.col("a"), F.col("b"), policy="loose")


def test_stream(spark, tmp_path):
    from varilume.streaming.annotate_stream import annotate_stream

    X.events(spark, SF).filter("form < 7").select("event_index", "seq_region", "position", "reference", "alternate").limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_index long, seq_region long, position long, reference string, alternate string").parquet(str(tmp_path / "in"))
    q = annotate_stream(stream, X.transcripts(spark, SF), 100, 100).writeStream.format("memory").queryName("annotated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("annotated").count() > 0


def test_limits(spark):
    from varilume.operators.model import Limits

    limits = Limits(100)
    limits.charge(60)
    limits.charge(-20)
    assert (limits.charged, limits.high_water) == (40, 60) and limits.reset_high_water() and limits.high_water == 40
    assert limits.set_ceiling(50) == 50
    for call in (lambda: limits.set_ceiling(10), lambda: limits.set_ceiling(0), lambda: limits.set_workers(spark, 0, 1, 1, 1), lambda: limits.set_workers(spark, 2, -1, 1, 1)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(MemoryError):
        limits.charge(20)
    assert limits.charged == 40 and limits.set_workers(spark, 6, 1 << 20, 0, 1 << 20)
