"""VCF text as records, and its calls on coding transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varilume.operators.annotate import coding_transcripts

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, CHROM, POS, ID, REF, ALT, INFO_END, INFO_SVTYPE, INFO_SVLEN, FORMAT, samples) of plain or gzipped VCF text.

    samples: array of the sample columns. ordinal grows with the place in the file. BCF raises an error.
    """
    if path.endswith(".bcf"):
        raise ValueError("BCF isn't read; convert it to VCF text")
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    part = F.split("value", "\t")
    info = lambda k: F.nullif(F.regexp_extract(F.get(part, F.lit(7)), rf"(?:^|;){k}=([^;]*)", 1), F.lit(""))
    at = lambda k: F.get(part, F.lit(k))
    return lines.select(
        "ordinal", at(0).alias("CHROM"), at(1).try_cast("bigint").alias("POS"), F.nullif(at(2), F.lit(".")).alias("ID"), at(3).alias("REF"), F.filter(F.split(at(4), ","), lambda x: x != ".").alias("ALT"),
        info("END").alias("INFO_END"), info("SVTYPE").alias("INFO_SVTYPE"), F.split(info("SVLEN"), ",").alias("INFO_SVLEN"), at(8).alias("FORMAT"), F.slice(part, 10, F.greatest(F.size(part) - 9, F.lit(0))).alias("samples"),
    )


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """Sample columns of the header line; no header line or no samples is an error."""
    header = spark.read.text(path).filter(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()
    if not header:
        raise ValueError("the file has no header line")
    names = header[0][0].split("\t")[9:]
    if not names:
        raise ValueError("the file has no samples")
    return names


def coding_calls(records: DataFrame, regions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row per ALT, coding transcript that it touches, and sample: the columns that haplotypes take.

    event_index is 64 times the record's ordinal plus the ALT's place from 0; more than 64 ALTs, a position below 1, or a
    touching record without GT raise an error. Genotypes are parsed after the join, for touching records alone.
    """
    r = records.join(F.broadcast(regions.select(F.col("seq_region_name").alias("CHROM"), "seq_region")), "CHROM")
    bad = F.when(F.size("ALT") > 64, F.raise_error(F.lit("coding_calls: more than 64 alternate alleles"))).when(F.col("POS").isNull() | (F.col("POS") < 1), F.raise_error(F.lit("coding_calls: bad position"))).otherwise(F.col("POS"))
    e = r.withColumn("POS", bad).select("*", F.posexplode("ALT").alias("at", "alternate")).filter(F.col("alternate").rlike("^[ACGTNacgtn]+$") & F.col("REF").rlike("^[ACGTNacgtn]+$") & (F.upper("alternate") != F.upper("REF")))
    e = e.withColumns({"event_index": F.col("ordinal") * 64 + F.col("at"), "position": F.col("POS"), "reference": F.col("REF")})
    touched = coding_transcripts(e.select("event_index", "seq_region", "position", "reference", "alternate"), transcripts).select("event_index", F.explode("transcripts").alias("transcript_index"))
    e = e.join(touched.hint("merge"), "event_index")
    place = F.array_position(F.split("FORMAT", ":"), "GT") - 1
    place = F.when(F.coalesce(place, F.lit(-1)) < 0, F.raise_error(F.lit("coding_calls: a record that touches a coding transcript has no GT"))).otherwise(place)
    ps = F.array_position(F.split("FORMAT", ":"), "PS") - 1
    e = e.select("event_index", "seq_region", "position", "reference", "alternate", (F.col("at") + 1).alias("alt_index"), "transcript_index", place.cast("int").alias("gt"), ps.cast("int").alias("ps"), F.posexplode("samples").alias("sample_index", "sample"))
    call = F.get(F.split("sample", ":"), F.col("gt"))
    tokens = F.regexp_extract_all(call, F.lit(r"([/|]?)([0-9]+|\.)"), F.lit(0))
    alleles = F.transform(tokens, lambda t: F.regexp_extract(t, r"([0-9]+|\.)$", 1).try_cast("int"))
    before = F.transform(tokens, lambda t: F.startswith(t, F.lit("|")))
    label = F.when(F.col("ps") >= 0, F.get(F.split("sample", ":"), F.col("ps")).try_cast("bigint"))
    return e.select("event_index", "seq_region", "position", "reference", "alternate", "alt_index", "transcript_index", F.col("sample_index").cast("bigint").alias("sample_index"), alleles.alias("alleles"), before.alias("phase_before"), label.alias("phase_set"))
